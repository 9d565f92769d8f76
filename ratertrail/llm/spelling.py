"""Spelling variants: the words one letter away from each word, and the frequent form each is a variant of.

Two words that differ by one inserted, deleted or replaced letter agree in the first half or in the second
half of the shorter one. So every word goes to its groups (length of the shorter word, side, half), and only
there it is compared, by a bit-sliced position index: for each position and letter a bitset of the group's
words that have it there. Reading a word letter by letter, a few bitwise operations a letter carry the set of
all words without an error so far and the sets with one, for the whole group at once. Pairs are never listed:
a group gives each word the number of its near words and the best of them, and these are summed up by word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratertrail.session import cut_lineage

#: Letters of a run: A to Z of either case and the Latin-1 range from U+00C0 on.
LETTERS = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form is at least this many times as frequent as its variant.
TIMES = 10
#: Every so manieth run, by its hash, loses a letter.
SLIP = 31
#: Rows of one block, and the words of one half above which a group is cut into a square of blocks.
BLOCK = 8192

_FOUND = "word string, n_near long, best_n long, best string"


def observed_runs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``word``: every run of letters that can give a word of at least ``LEAST_LENGTH`` letters, slips applied."""
    runs = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"{LETTERS}{{{LEAST_LENGTH},}}"), F.lit(0))
    upper = "".join(map(chr, range(65, 91)))
    run = F.when(F.octet_length("run") == F.char_length("run"), F.lower("run")).otherwise(F.translate("run", upper, upper.lower()))
    lowered = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).select("id", run.alias("run"))
    hashed = lowered.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return hashed.select(F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: the distinct words of at least ``LEAST_LENGTH`` letters that occur at least ``LEAST_COUNT`` times."""
    counted = observed_runs(docs, key, text).filter(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


def _position_index(strings: list[str]) -> dict:
    """Bitset of the strings (bit k for string k) for each position and letter."""
    rows = defaultdict(list)
    for k, s in enumerate(strings):
        for place in enumerate(s):
            rows[place].append(k)
    index = {}
    for place, ks in rows.items():
        bits = bytearray((ks[-1] >> 3) + 1)
        for k in ks:
            bits[k >> 3] |= 1 << (k & 7)
        index[place] = int.from_bytes(bits, "little")
    return index


def _replaced(q: str, index: dict, everything: int) -> int:
    """Words of the query's length with exactly one letter replaced."""
    none, one = everything, 0
    for place in enumerate(q):
        has = index.get(place, 0)
        same = none & has
        one = (one & has) | (none ^ same)
        none = same
        if not (one or none):
            return 0
    return one


def _inserted(q: str, index: dict, everything: int, new_head: bool) -> int:
    """Words with one letter more than the query; with ``new_head`` only those that don't begin with the query."""
    none = one = everything
    for k, c in enumerate(q):
        none &= index.get((k, c), 0)
        one = (one & index.get((k + 1, c), 0)) | none
        if not one:
            return 0
    return one ^ none if new_head else one


def _deleted(q: str, index: dict, everything: int, new_head: bool) -> int:
    """Words with one letter less than the query; with ``new_head`` only those that the query doesn't begin with."""
    none, one = everything, 0
    for k, c in enumerate(q):
        one = (one & index.get((k - 1, c), 0)) | none
        if k < len(q) - 1:
            none &= index.get((k, c), 0)
        if not one:
            return 0
    return one & ~none if new_head else one


def near_in_group(length: int, tail_shared: bool, members: list[tuple[int, str]], asked: list[str]) -> Iterator[tuple[str, int, int, str]]:
    """``word, n_near, best_n, best`` of the asked words that have near ones in one group.

    All words have ``length`` letters or one more, and share the first half of ``length``, or with
    ``tail_shared`` the rest from there on. Pairs that share both belong to the groups of the first kind.
    """
    half = length // 2
    cut = (lambda w: w[: len(w) - (length - half)]) if tail_shared else (lambda w: w[half:])
    # The bits are in order of preference, so the lowest bit of a set is the best of its words.
    ranked = sorted(members, key=lambda m: (-m[0], m[1]))
    short, long = [m for m in ranked if len(m[1]) == length], [m for m in ranked if len(m[1]) > length]
    of_short, of_long = _position_index([cut(w) for _, w in short]), _position_index([cut(w) for _, w in long])
    all_short, all_long = (1 << len(short)) - 1, (1 << len(long)) - 1
    for word in asked:
        q = cut(word)
        if len(word) == length:
            sets = [(_replaced(q, of_short, all_short), short), (_inserted(q, of_long, all_long, tail_shared), long)]
        else:
            sets = [(_deleted(q, of_short, all_short, tail_shared), short)]
        firsts = [at[(s & -s).bit_length() - 1] for s, at in sets if s]
        if firsts:
            best_n, best = min(firsts, key=lambda m: (-m[0], m[1]))
            yield word, sum(s.bit_count() for s, _ in sets), best_n, best


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    members, asked = defaultdict(list), defaultdict(list)
    for word, n, length, tail_shared, is_member, is_asked in zip(rows["word"], rows["n"], rows["length"], rows["tail_shared"], rows["is_member"], rows["is_asked"]):
        half = length // 2
        group = (length, tail_shared, word[half - length :] if tail_shared else word[:half])
        if is_member:
            members[group].append((n, word))
        if is_asked:
            asked[group].append(word)
    found = [f for g, words in asked.items() if len(members[g]) > 1 or members[g] and members[g][0][1] != words[0] for f in near_in_group(g[0], g[1], members[g], words)]
    return pd.DataFrame(found, columns=["word", "n_near", "best_n", "best"])


def _grouped(words: DataFrame) -> DataFrame:
    """Each word in its groups: as the shorter or equal one, and as the longer one, on either side."""
    size = F.char_length("word")
    lengths = F.array(*[F.struct(n.alias("length"), F.lit(s).alias("tail_shared")) for n in (size, size - 1) for s in (False, True)])
    grouped = words.select("word", "n", F.explode(F.filter(lengths, lambda g: g["length"] >= LEAST_LENGTH)).alias("g")).select("word", "n", "g.*")
    half = F.floor(F.col("length") / 2).cast("int")
    return grouped.withColumn("half", F.when(F.col("tail_shared"), F.expr("right(word, length - cast(floor(length / 2) as int))")).otherwise(F.substring("word", F.lit(1), half)))


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` of the words of ``word, n`` that have near ones; the best is the most frequent, then the least.

    Groups go to blocks of bounded size by their hash. A half that more than ``BLOCK`` words share is
    cut into c pieces and c * c blocks, one for each piece as members and each as asked words.
    """
    grouped = _grouped(words)
    total = words.count()
    crowds = cut_lineage(grouped.groupBy("length", "tail_shared", "half").agg(F.count("*").alias("crowd")).filter(F.col("crowd") > BLOCK))
    dealt = grouped.join(crowds, ["length", "tail_shared", "half"], "left")
    pieces = F.ceil(F.coalesce("crowd", F.lit(1)) / BLOCK).cast("int")
    dealt = dealt.select("word", "n", "length", "tail_shared", F.pmod(F.xxhash64("length", "tail_shared", "half"), F.lit(max(1, 4 * total // BLOCK))).alias("bucket"), pieces.alias("pieces"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("word"), "pieces").cast("int"))
    square = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda k: F.array(
        F.struct(F.col("own").alias("i"), k.alias("j")), F.struct(k.alias("i"), F.col("own").alias("j"))))))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    dealt = dealt.withColumn("at", F.explode(F.when(F.col("pieces") == 1, alone).otherwise(square)))
    blocks = dealt.select("word", "n", "length", "tail_shared", "bucket", "at.i", "at.j", (F.col("at.i") == F.col("own")).alias("is_member"), (F.col("at.j") == F.col("own")).alias("is_asked"))
    found = blocks.groupBy("bucket", "i", "j").applyInPandas(_block, _FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("least"), F.col("best")))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return merged.select("word", "n_near", (-F.col("b.least")).alias("best_n"), "b.best")


def roots(forms: DataFrame, most: int) -> DataFrame:
    """``word, root``: the last of the forms that follow from each word of ``word, form``.

    Each form is ``TIMES`` times as frequent as the word before it, so no chain has more than
    log(``most``) steps, and doubling the steps closes all chains in a logarithm of that many joins.
    """
    steps, reach = 0, LEAST_COUNT
    while reach * TIMES <= most:
        steps, reach = steps + 1, reach * TIMES
    jump, covered = forms.select("word", F.col("form").alias("root")), 1
    while covered < steps:
        on = jump.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jump = cut_lineage(jump.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        covered *= 2
    return jump


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the vocabulary.

    ``form`` is the most frequent near word (ties: the least in code-point order) if it is at least ``TIMES`` times as
    frequent, else null; ``root`` ends the chain of forms, and is the word itself where it has no form.
    Null and empty texts have no words; a null key hashes like an empty one; repeated rows count
    each; other columns are not read, whatever their names; an empty table gives an empty one.
    """
    words = cut_lineage(vocabulary(docs, key, text))
    near = near_words(words)
    formed = words.join(near, "word", "left").select(
        "word",
        F.when(F.col("best_n") >= TIMES * F.col("n"), F.col("best")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("best_n") >= TIMES * F.col("n"), F.col("best_n")).alias("form_n"),
    )
    formed = cut_lineage(formed)
    most = words.agg(F.max("n")).first()[0] or 0
    ends = roots(formed.filter("form is not null").select("word", "form"), most)
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

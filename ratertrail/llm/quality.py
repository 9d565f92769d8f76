"""Quality rules by a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Texts become lower-cased word and symbol tokens; single tokens and pairs are hashed into a fixed
number of buckets. Two multinomials over the buckets are counted, one over trusted texts and one
over the whole corpus. A text's score is the mean over its n-grams of the difference of their log
probabilities, in whole millionths of a nat, so sums don't depend on order and the threshold
decides the same way on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratertrail.session import cut_lineage

BUCKETS = 1 << 16
#: Trusted rows that the target distribution is fitted on: those of quality 1 with the least hashed ids.
TRUSTED_ROWS = 20_000
SMOOTHING = 1.0
UNITS = 1_000_000
#: The least mean log-likelihood ratio of a kept text, in millionths of a nat.
THRESHOLD = -300_000
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def _held(expr: Column) -> Column:
    """Hand a value on as a generated column, so that expressions over it don't compute it anew for each element."""
    return F.explode(F.array(expr))


def words_of(text: Column) -> Column:
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def token_hashes(text: Column) -> Column:
    """Hashes of the tokens of a text, in order."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"), F.lit(0))
    return F.transform(tokens, lambda t: F.xxhash64(t))


def ngram_buckets(hashes: Column) -> Column:
    """Buckets of all tokens and all pairs of neighbouring tokens; ``hashes`` is a column of token hashes."""
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    pairs = F.transform(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 1, F.lit(0))), lambda h, i: bucket(F.xxhash64(h, F.get(hashes, i + 1))))
    return F.concat(F.transform(hashes, bucket), pairs)


def rule_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and a struct ``rules``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Null counts as empty, for which all are 0. Windows of three words are compared by a 64-bit hash
    within the text.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = docs.select(F.struct("*").alias("doc"), _held(F.struct(words_of(t).alias("words"), F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"))).alias("v"))
    base = base.select("doc", "v.words", "v.lines")
    n = F.size("words")
    base = base.select("doc", "words", "lines", _held(F.transform("words", lambda w: F.xxhash64(w))).alias("h"))
    windows = F.transform(F.slice("h", F.lit(1), F.greatest(n - 2, F.lit(0))), lambda a, i: F.xxhash64(a, F.get("h", i + 1), F.get("h", i + 2)))
    base = base.select("doc", "words", "lines", _held(windows).alias("windows"))
    placed = F.array_sort(F.transform(F.col("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # Only texts with some window twice sort them.
    base = base.select("doc", "words", "lines", _held(F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed)).alias("placed"))
    same = F.transform("placed", lambda w, k: F.when((F.get("placed", k - 1)["h"] == w["h"]) | (F.get("placed", k + 1)["h"] == w["h"]), w["i"]))
    base = base.select("doc", "words", "lines", _held(F.sort_array(F.filter(same, lambda i: i.isNotNull()))).alias("repeated"))
    # Each repeated window covers three words, less what the next one covers.
    covered = F.transform("repeated", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("repeated", k + 1) - i, F.lit(3))))
    text_of = F.coalesce(F.col(f"doc.`{text}`"), F.lit(""))
    rules = F.struct(
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length(text_of) - F.char_length(F.translate(text_of, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda s, c: s + c), F.lit(0).cast("long")).alias("n_repeat_words"),
    )
    kept = [F.col(f"doc.`{c}`") for c in docs.columns if c != "rules"]
    return base.select(*kept, rules.alias("rules"))


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """``trusted_id``: distinct ids of at most ``rows`` labelled rows of quality 1."""
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id")
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("trusted_id")).distinct()


def bucket_weights(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``bucket, weight``: log of the trusted over the corpus probability, for the buckets seen; counted over all texts."""
    # The trusted ids are bounded by their limit.
    marked = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).join(F.broadcast(trusted), F.col("key") == F.col("trusted_id"), "left")
    hashed = marked.select(F.when(F.col("trusted_id").isNotNull(), 1).otherwise(0).alias("good"), _held(token_hashes(F.col("text"))).alias("hashes"))
    grams = hashed.select("good", F.explode(ngram_buckets(F.col("hashes"))).alias("bucket"))
    counts = cut_lineage(grams.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("good").alias("n_good")))
    totals = counts.agg(F.sum("n").alias("total"), F.sum("n_good").alias("total_good")).first()
    total, total_good = totals["total"] or 0, totals["total_good"] or 0
    if not total_good:
        return counts.select("bucket", F.lit(0).cast("long").alias("weight"))
    p = (F.col("n") + SMOOTHING) / F.lit(float(total + SMOOTHING * BUCKETS))
    p_good = (F.col("n_good") + SMOOTHING) / F.lit(float(total_good + SMOOTHING * BUCKETS))
    return counts.select("bucket", F.round(F.log(p_good / p) * UNITS).cast("long").alias("weight"))


def quality(docs: DataFrame, weights: DataFrame, text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` and a struct ``quality``: the rules, base_failed, n_grams, llr (millionths of a nat), kept.

    A text without n-grams has llr 0. Repeated rows and null keys give a row each; an empty table
    gives an empty one; columns named ``quality`` or ``rules`` are replaced.
    """
    # The weights are a fixed number of buckets, and stand as one array beside the plan's constants.
    table = weights.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("w")).first()["w"] or {}
    listed = F.split(F.lit(",".join(str(table.get(b, 0)) for b in range(BUCKETS))), ",").cast("array<bigint>")
    hashed = docs.drop("quality").select("*", _held(token_hashes(F.col(f"`{text}`"))).alias("quality"))
    total = F.aggregate(ngram_buckets(F.col("quality")), F.lit(0).cast("long"), lambda s, b: s + F.get(listed, b))
    n = F.greatest(2 * F.size("quality") - 1, F.lit(0))
    scored = hashed.withColumn("quality", F.struct(n.cast("long").alias("n_grams"), F.coalesce(F.floor(F.try_divide(total, n)), F.lit(0)).cast("long").alias("llr")))
    ruled = rule_counts(scored, text)
    r = F.col("rules")
    failed = (r["n_words"] < 50) | (100 * r["n_repeat_words"] > 50 * r["n_words"])
    verdict = F.struct("rules.*", failed.alias("base_failed"), F.col("quality.n_grams"), F.col("quality.llr"), (~failed & (F.col("quality.llr") >= threshold)).alias("kept"))
    return ruled.withColumn("quality", verdict).drop("rules")


def score_corpus(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``quality`` with weights counted over ``docs`` itself."""
    return quality(docs, bucket_weights(docs, trusted_ids(labels), key, text), text)

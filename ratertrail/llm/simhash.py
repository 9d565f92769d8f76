"""SimHash fingerprints and near-duplicate components by anchor points of a covering code.

The anchors are the words of the perfect (63, 57) code, with the 64th bit kept as it is: every
fingerprint lies within distance 1 of an anchor (the covering radius). Two fingerprints at
distance 2 or less have a point z within distance 1 of both; the anchor within distance 1 of z is
within 2 of both. So each distinct fingerprint goes to every anchor within the covering radius plus
half the threshold (33 of them), no linked pair is lost, and an anchor's group is bounded by the
geometry (2,081 distinct fingerprints), however many documents there are. Within an anchor,
members that share such a point z are linked, which is linear in the group: no pairs are formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratertrail.session import cut_lineage

SEED = 42
#: The linking distance that the anchors are laid out for.
THRESHOLD = 2
SHINGLE = 3
#: Positions 1 to 63 are the code's, position 0 is the bit left as it is; a set bit's position enters the syndrome.
_POSITIONS = range(1, 64)
_LONG = 1 << 64


def _signed(bits: int) -> int:
    return bits - _LONG if bits >= _LONG // 2 else bits


def fingerprint_of(text: bytes) -> int:
    """The signed 64-bit fingerprint of one text; 0 without words."""
    words = text.lower().split()  # on bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh64_digest  # big-endian
    joined = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    n, set_bits = len(joined), np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        set_bits += np.unpackbits(joined[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big", signed=True)


def fingerprint(text: Column) -> Column:
    """SimHash of the shingles of three words, as a long; null counts as empty."""

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([0 if t is None else fingerprint_of(t) for t in texts], dtype="int64")

    return simhash(text.cast("binary"))


def anchors(fp: Column) -> Column:
    """All anchors within distance 2 of a fingerprint (33, or 2 for one in 64)."""
    parity = [F.bit_count(fp.bitwiseAND(F.lit(_signed(sum(1 << p for p in _POSITIONS if p >> k & 1))))) % 2 for k in range(6)]
    syndrome = sum((p * (1 << k) for k, p in enumerate(parity)), F.lit(0)).cast("int")
    # Flipping the position that the syndrome names, or two positions whose XOR it is, gives a word of the code.
    nearest = F.when(syndrome == 0, fp).otherwise(fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), syndrome)))
    bits = F.array(*[F.lit(_signed(1 << p)) for p in range(64)])
    others = F.filter(F.sequence(F.lit(1), F.lit(63)), lambda i: (syndrome != 0) & (i < i.bitwiseXOR(syndrome)) & (i != syndrome))
    others = F.transform(others, lambda i: fp.bitwiseXOR(F.get(bits, i)).bitwiseXOR(F.get(bits, i.bitwiseXOR(syndrome))))
    return F.concat(F.array(nearest, nearest.bitwiseXOR(F.lit(1).cast("long"))), others)


def links(fps: DataFrame) -> DataFrame:
    """``a, b``: links that connect all distinct fingerprints ``fp`` at distance 2 or less, b the least of its group."""
    placed = fps.select("fp", F.explode(anchors(F.col("fp"))).alias("anchor"))
    crowded = placed.withColumn("members", F.count("*").over(Window.partitionBy("anchor"))).filter("members > 1")
    diff = F.col("fp").bitwiseXOR(F.col("anchor"))
    flips = F.array(*[F.lit(_signed(1 << p)) for p in range(64)])
    # Points within 1 of both the anchor and the member: one flipped bit of their difference, the anchor itself
    # if it is next to the member, all its neighbours if it is the member.
    near = F.when(diff == 0, flips).otherwise(F.filter(flips, lambda bit: diff.bitwiseAND(bit) != 0))
    points = F.transform(near, lambda bit: F.col("anchor").bitwiseXOR(bit))
    points = F.when(F.bit_count(diff) <= 1, F.concat(points, F.array(F.col("anchor")))).otherwise(points)
    shared = crowded.select("fp", F.explode(points).alias("point")).distinct()
    # At most 65 distinct fingerprints share a point.
    least = shared.withColumn("b", F.min("fp").over(Window.partitionBy("point")))
    return least.filter(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node that each node of the links ``a, b`` reaches.

    Alternates two contractions until nothing changes: every node hands its larger neighbours, then
    its smaller ones, to the least of them. Both need a logarithmic number of rounds. Each
    round is a table in the shared folder. The least neighbour comes from an aggregation and a
    join, so a node with very many links is combined before the shuffle and split in the join.
    """
    edges = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        larger = cut_lineage(larger)
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(smaller.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row: the component's least key, that of the row itself included.

    The fingerprint is a long. Null and empty texts have fingerprint 0 and are linked like others; a
    null key is passed over when the least is chosen (a component of null keys only has none);
    repeated rows give a row each; an empty table gives an empty one.
    """
    marked = cut_lineage(docs.select(F.col(f"`{key}`").alias("doc_id"), fingerprint(F.col(f"`{text}`")).alias("fingerprint")))
    fps = cut_lineage(marked.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first")))
    roots = components(links(fps.select("fp")))
    placed = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    placed = cut_lineage(placed)
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.select("fp", "root").join(least, "root").select(F.col("fp").alias("fingerprint"), "component_id")
    return marked.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    """16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", find: Callable[[DataFrame, str, str], DataFrame] = near_duplicates) -> DataFrame:
    """The rows of ``docs`` whose key is the least of their component by ``find``, one row for each such key.

    Rows with a null key are kept only if their component has no other key, one of them.
    """
    found = cut_lineage(find(docs, key, text))
    firsts = found.filter("doc_id <=> component_id").groupBy(F.col("doc_id").alias("kept_key")).count()
    kept = docs.join(firsts, docs[f"`{key}`"].eqNullSafe(firsts["kept_key"]), "left_semi")
    return kept.dropDuplicates([key]) if firsts.filter("count > 1").limit(1).count() else kept

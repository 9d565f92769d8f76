"""Sharding by a two-pass external shuffle, in DataFrame functions only.

The first pass scatters all rows by a seeded hash into buckets that fit in memory. The second
brings each bucket into a fixed order, shuffles it by Fisher and Yates (Spark's ``shuffle``) and
cuts the row of buckets into shards whose row counts are at most one apart (the law ``rows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratertrail.session import cut_lineage

SHARDS = 16
#: Bytes of text in a bucket on average, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 32_000_000, 64
SEED = 20_240_601
#: Rows of one key and text length above which they are numbered, so that they scatter as well.
CROWD = 1000
#: Buckets whose offsets one task adds up.
_BAND = 4096


def row_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def bucket_count(docs: DataFrame, text: str = "text", bucket_bytes: int = BUCKET_BYTES, least: int = LEAST_BUCKETS) -> int:
    total = docs.agg(F.sum(row_bytes(F.col(f"`{text}`")))).first()[0] or 0
    return max(least, -(-total // bucket_bytes))


def _offsets(counts: DataFrame) -> DataFrame:
    """``bucket, before``: rows of all buckets with a lower number; bands keep the running sum out of one task."""
    banded = counts.withColumn("band", F.floor(F.col("bucket") / _BAND))
    bands = banded.groupBy("band").agg(F.sum("n").alias("band_n"))
    bands = bands.select("band", (F.sum("band_n").over(Window.orderBy("band")) - F.col("band_n")).alias("band_before"))
    within = F.sum("n").over(Window.partitionBy("band").orderBy("bucket")) - F.col("n")
    return banded.select("band", "bucket", within.alias("within")).join(bands, "band").select("bucket", (F.col("within") + F.col("band_before")).alias("before"))


def shuffled_shards(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, least: int = LEAST_BUCKETS
) -> DataFrame:
    """All columns of ``docs``, ``shard`` and ``slot``: a seeded permutation of all rows, cut into shards.

    Shard s holds the rows at positions s * n / shards and on, so counts are at most one apart and
    slots are gapless from 0. The order depends on the rows, the seed and the bucket sizes, not on
    partitions, but for more than ``CROWD`` rows of one key and text length: these are written with a number each, and scatter by
    it, so repeated rows fill no bucket. Null keys and texts are values like others; an empty table gives an empty one. Columns named
    ``shard`` or ``slot`` are replaced.
    """
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    n_buckets = bucket_count(docs, text, bucket_bytes, least)
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    hashed = docs.select(F.xxhash64(k, F.octet_length(t), F.lit(seed)).alias("mixed"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"))
    crowds = cut_lineage(hashed.groupBy("mixed").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("mixed"))
    if not crowds.isEmpty():
        numbered = cut_lineage(hashed.join(crowds, "mixed", "left_semi").withColumn("mixed", F.xxhash64("mixed", F.monotonically_increasing_id())))
        hashed = hashed.join(crowds, "mixed", "left_anti").unionByName(numbered)
    bucket = F.pmod("mixed", F.lit(n_buckets)).cast("int")
    counts = hashed.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    n = counts.agg(F.sum("n")).first()[0] or 0
    entry = F.struct(F.xxhash64("mixed", F.lit(1)).alias("at"), "row")
    scattered = hashed.select(bucket.alias("bucket"), entry.alias("entry"), F.lit(None).cast("long").alias("before"))
    # A row for each bucket brings its offset along, so there is no join after the scatter.
    heads = _offsets(counts).select("bucket", F.lit(None).cast(scattered.schema["entry"].dataType).alias("entry"), F.col("before").cast("long").alias("before"))
    held = scattered.unionByName(heads).repartition(n_buckets, "bucket").groupBy("bucket").agg(F.max("before").alias("before"), F.collect_list("entry").alias("entries"))
    # shuffle() draws on through a partition: a fixed order of its buckets makes a repeated task agree.
    mixed_up = held.sortWithinPartitions("bucket").select("before", F.shuffle(F.array_sort("entries"), seed).alias("entries"))
    placed = mixed_up.select("before", F.posexplode("entries").alias("pos", "entry"))
    index = F.col("before") + F.col("pos")
    shard = F.expr(f"(before + pos) * {shards} div {max(n, 1)}").cast("int")
    first = F.expr(f"(cast(shard as bigint) * {n} + {shards - 1}) div {shards}")
    return placed.select("entry.row.*", shard.alias("shard"), index.alias("index")).select(
        *[F.col(f"`{c}`") for c in own], "shard", (F.col("index") - first).cast("long").alias("slot")
    )


def write_shards(sharded: DataFrame, path: str, slot: str = "slot", shard: str = "shard") -> None:
    """Write each shard as a folder of files, in the order of its slots within each file."""
    sharded.sortWithinPartitions(shard, slot).write.mode("overwrite").partitionBy(shard).parquet(path)

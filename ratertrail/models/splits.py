"""Stratified splits and class weights, reproducible from a row key and a seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratertrail.functions.ordering import group_ordinal, hash_band

HASH_BITS = 60


def split_hash(key: Column | str, seed: int) -> Column:
    """A uniform 60-bit number per row key: the shuffle order of every split."""
    c = F.col(key) if isinstance(key, str) else key
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), c.cast("string"))), 1, HASH_BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def _shuffled(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Adds ``__pos``, the place of a row in the shuffled order of its class.

    The hash spreads each class evenly over bands, so a class holding most rows is no hot group.
    """
    hashed = df.withColumn("__h", split_hash(key, seed))
    return group_ordinal(hashed, [label], ["__h", key], hash_band("__h", HASH_BITS), "__pos").drop("__h")


def class_quotas(df: DataFrame, label: str, fraction: float) -> DataFrame:
    """``label, n, quota``: test rows per class, ceil(fraction * n) in all, by largest remainder. Rows without a label don't count."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    # A window over the class table, which has one row per class.
    everything = W.partitionBy(F.lit(0))
    total = F.sum("n").over(everything)
    shares = counts.withColumn("__size", F.ceil(F.lit(fraction) * total)).withColumn("__share", F.col("n") * F.col("__size") / total)
    floors = shares.withColumn("__floor", F.floor("__share")).withColumn("__left", F.col("__size") - F.sum("__floor").over(everything))
    turn = F.row_number().over(everything.orderBy(F.desc(F.col("__share") - F.col("__floor")), label))
    return floors.withColumn("__turn", turn).select(
        label, "n", (F.col("__floor") + F.when(F.col("__turn") <= F.col("__left"), 1).otherwise(0)).cast("long").alias("quota")
    )


def _per_class(df: DataFrame, label: str, labels: Sequence[str] | None) -> DataFrame:
    """A table of one row per class; with the labels known it is small for certain and may be broadcast."""
    return df if labels is None else F.broadcast(df.filter(F.col(label).isin(*labels)))


def stratified_split(
    df: DataFrame, label: str, key: str, fraction: float = 0.2, seed: int = 42, labels: Sequence[str] | None = None
) -> DataFrame:
    """Adds ``is_test``. Rows without a label, or of a class outside ``labels`` when given, are left out first and count in no quota."""
    df = df.filter(F.col(label).isNotNull() if labels is None else F.col(label).isin(*labels))
    quotas = _per_class(class_quotas(df, label, fraction).select(label, "quota"), label, labels)
    return _shuffled(df, label, key, seed).join(quotas, label).withColumn("is_test", F.col("__pos") <= F.col("quota")).drop("__pos", "quota")


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` in 0..k-1, every class dealt out evenly."""
    return _shuffled(df, label, key, seed + 1).withColumn("fold", ((F.col("__pos") - 1) % k).cast("int")).drop("__pos")


def balanced_weights(df: DataFrame, label: str, name: str = "weight", labels: Sequence[str] | None = None) -> DataFrame:
    """Adds n / (k * n_class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("__n"))
    sizes = counts.agg(F.struct(F.sum("__n").alias("n"), F.count("*").alias("k"))).scalar()
    weights = counts.withColumn("__s", sizes).select(label, (F.col("__s.n") / (F.col("__s.k") * F.col("__n"))).alias(name))
    return df.join(_per_class(weights, label, labels), label)

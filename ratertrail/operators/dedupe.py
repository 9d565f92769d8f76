"""Exact duplicates and conflicting resubmissions of reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratertrail.functions.ordering import join_null_safe

_CHUNK = 100_000


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key, ordered by ``order`` and then by all other columns.

    One aggregation whose partial step already reduces a hot key to a row per task.
    """
    key, order = list(key), list(order)
    rest = [c for c in df.columns if c not in key and c not in order]
    picked = df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("__row"))
    return picked.select(*key, *[F.col(f"__row.{c}").alias(c) for c in order + rest]).select(*df.columns)


def drop_exact_duplicates(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(kept, dropped)``: the first row of each key, and every other row as an audit table.

    Null key values count as equal. The audit looks only at keys that occur more than once.
    Identical rows are counted, not ranked, so that a row repeated very often never gathers in
    one task; its copies are written out again in chunks spread over the cluster.
    """
    kept = first_per_key(df, key, order)
    suspects = conflicting_reviews(df, key)
    counted = suspects.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    firsts = first_per_key(suspects, key, order).withColumn("__kept", F.lit(1))
    marked = join_null_safe(counted, firsts, df.columns, "left")
    surplus = marked.withColumn("__n", F.col("__n") - F.coalesce("__kept", F.lit(0))).filter("__n > 0")
    chunks = surplus.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / _CHUNK).cast("int"))))
    spread = chunks.repartition(*df.columns, "__chunk")
    size = F.least(F.lit(_CHUNK), F.col("__n") - F.col("__chunk") * _CHUNK).cast("int")
    dropped = spread.withColumn("__copy", F.explode(F.sequence(F.lit(1), size))).select(*df.columns)
    return kept, dropped


def conflicting_reviews(df: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """All rows whose key occurs more than once, sorted by ``order`` when given."""
    repeated = df.groupBy(*key).agg(F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    out = join_null_safe(df, repeated, list(key), "left_semi")
    return out.orderBy(*order) if order else out

"""Counts, shares and descriptive tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratertrail.functions.ordering import join_null_safe, running_totals
from ratertrail.functions.scalar import binary_flag, owner_group, pct


def label_list(spark, labels: Sequence[str], name: str) -> DataFrame:
    """A few literal labels with their position."""
    return spark.createDataFrame(list(enumerate(labels)), f"rank int, {name} string")


def order_by_rank(df: DataFrame, label: str, order: Sequence[str], fill: dict | None = None) -> DataFrame:
    """Rows in the order of a label list; labels without rows appear with nulls (or ``fill``)."""
    grid = label_list(df.sparkSession, order, label)
    out = grid.join(df, label, "left")
    return (out.fillna(fill) if fill else out).orderBy("rank")


def value_distribution(df: DataFrame, label: str, digits: int = 2) -> DataFrame:
    """``label, n, pct`` of the non-null values."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", pct("n", total, digits))


def crosstab_ordered(df: DataFrame, row: str, col: str, order: Sequence[str], col_values: Sequence[str]) -> DataFrame:
    """Contingency table with rows in a fixed order; absent cells are 0."""
    table = df.groupBy(row).pivot(col, list(col_values)).agg(F.count(F.lit(1)))
    return order_by_rank(table, row, order, fill={v: 0 for v in col_values})


def share_by_group(df: DataFrame, group: str, condition: Column) -> DataFrame:
    """Percentage of rows meeting a condition per group."""
    return df.groupBy(group).agg((100 * F.avg(F.coalesce(condition, F.lit(False)).cast("double"))).alias("pct"))


def long_form(df: DataFrame, ids: Sequence[str], metrics: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """One row per row and metric, nulls left out.

    As ``unpivot``, but by an exploded array: after ``unpivot`` Spark does not recognise two
    branches over the same rows as equal and would scan them twice.
    """
    cells = F.array(*[F.struct(F.lit(m).alias(name), F.col(m).alias(value)) for m in metrics])
    return df.select(*ids, F.explode(cells).alias("__cell")).select(*ids, f"__cell.{name}", f"__cell.{value}").filter(F.col(value).isNotNull())


def value_histogram(df: DataFrame, group: Sequence[str], value: str, arm: Column | None = None) -> DataFrame:
    """``group, value, n`` or, with a boolean arm, ``group, value, n_a, n_b, n``; null values are left out.

    Every rank statistic starts here: equal values collapse map-side before anything is sorted.
    """
    known = df.filter(F.col(value).isNotNull())
    if arm is None:
        return known.groupBy(*group, value).agg(F.count("*").alias("n"))
    # Rows of no arm count nowhere. Filtering them before the grouping would reach the scan in some
    # branches of a plan and not in others, and keep Spark from reusing the grouped histogram.
    counts = known.groupBy(*group, value).agg(
        F.count(F.when(arm, 1)).alias("n_a"), F.count(F.when(~arm, 1)).alias("n_b")
    )
    return counts.withColumn("n", F.col("n_a") + F.col("n_b")).filter("n > 0")


def exact_median(hist: DataFrame, group: Sequence[str], value: str, n: str = "n", name: str = "median") -> DataFrame:
    """Interpolated median per group from a value histogram.

    Works on running counts, so no task ever holds all values of a group.
    """
    cum = running_totals(hist, group, [value], {"__cum": n})
    totals = hist.groupBy(*group).agg(F.sum(n).alias("__total"))
    placed = join_null_safe(cum, totals, group)
    low, high = F.floor((F.col("__total") + 1) / 2), F.floor(F.col("__total") / 2) + 1
    return placed.groupBy(*group).agg(
        (
            (F.min(F.when(F.col("__cum") >= low, F.col(value))) + F.min(F.when(F.col("__cum") >= high, F.col(value)))) / 2
        ).alias(name)
    )


def describe_by_group(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """``count, median, mean, std`` (sample SD) per group; nulls are left out of all four."""
    typed = df.withColumn(value, F.col(value).cast("double"))
    moments = typed.groupBy(*group).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )
    medians = exact_median(value_histogram(typed, group, value), group, value)
    return join_null_safe(moments, medians, list(group), "left").select(*group, "count", "median", "mean", "std")


def mean_per_sample(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.avg(m).alias(m) for m in metrics])


def pivot_labels(df: DataFrame, index: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """Long to wide; a repeated ``(index, column)`` cell is an error."""
    checked = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("repeated cell in pivot")).cast("string")).otherwise(F.max(value))
    return df.groupBy(index).pivot(column, list(columns)).agg(checked)


def censoring_summary(df: DataFrame, censored: str = "censored") -> DataFrame:
    return df.agg(
        F.count("*").alias("n"),
        F.count_if(F.col(censored)).alias("n_censored"),
        (100 * F.avg(F.col(censored).cast("double"))).alias("pct_censored"),
    )


def distinct_keys(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct().orderBy(*cols)


def total_revisions(df: DataFrame, n: str = "n_revisions_observed") -> DataFrame:
    return df.agg(F.sum(n).alias("total_revisions"))


def dataset_profile(
    instances: DataFrame,
    smell: str = "smell",
    grade: str = "severity_consensus",
    flag: str = "is_from_industry_relevant_project_raw",
    repository: str = "repository",
    owner: Column | None = None,
) -> DataFrame:
    """Counts per smell, grade and relevance, and repositories per owner class: ``block, label, n, pct``.

    One pass with grouping sets; repositories are counted once each within their owner class.
    """
    owner = owner_group(repository) if owner is None else owner
    base = instances.select(
        F.col(smell).alias("smell"),
        F.col(grade).alias("severity"),
        binary_flag(flag).alias("relevance"),
    )
    sets = [(F.col("smell"),), (F.col("severity"),), (F.col("relevance"),)]
    by_set = base.groupingSets(sets, "smell", "severity", "relevance").agg(
        F.count("*").alias("n"), F.grouping_id().alias("__set")
    )
    rows = by_set.select(
        F.when(F.col("__set") == 0b011, "smell").when(F.col("__set") == 0b101, "severity").otherwise("relevance").alias("block"),
        F.coalesce("smell", "severity", "relevance").alias("label"),
        "n",
    )
    owners = (
        instances.select(F.col(repository).alias("r"), owner.alias("label")).distinct().groupBy("label").agg(F.count("*").alias("n"))
    ).select(F.lit("owner").alias("block"), "label", "n")
    blocks = rows.unionByName(owners)
    return blocks.withColumn("pct", pct("n", F.sum("n").over(W.partitionBy("block"))))

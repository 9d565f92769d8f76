"""Resuming, failure logs and the accounting of every row lost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratertrail.functions.ordering import join_null_safe
from ratertrail.functions.scalar import clip_detail

FAILURE_COLUMNS = ("repository", "instance_id", "sample_id", "smell", "stage", "reason", "detail", "timestamp")


def pending_only(df: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """Rows whose key is not among the finished ones; give only successes as ``done`` to retry failures."""
    return df.join(done.select(*key), list(key), "left_anti")


def restrict_to_keys(df: DataFrame, keys: DataFrame, *key: str) -> DataFrame:
    return df.join(keys.select(*key), list(key), "left_semi")


def inner_on_key(left: DataFrame, right: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Inner equi-join that takes only ``cols`` from the right side."""
    return left.join(right.select(key, *cols), key, "inner")


def join_coverage(left: DataFrame, joined: DataFrame) -> DataFrame:
    """``n, n_total, pct`` of rows that found a partner; no ``pct`` of no rows."""
    return joined.agg(F.count("*").alias("n")).select(
        "n",
        left.agg(F.count("*")).scalar().alias("n_total"),
    ).withColumn("pct", F.bround(F.try_divide(100 * F.col("n"), F.col("n_total")), 2))


def attach_group_fact(members: DataFrame, facts: DataFrame, *group: str) -> DataFrame:
    """Give each member of a group what was found out once for the group."""
    return join_null_safe(members, facts, list(group), "left")


def failure_rows(
    df: DataFrame, stage: str, reason: Column | str, detail: Column | None = None, timestamp: Column | None = None
) -> DataFrame:
    """Rows of ``df`` in the shape of the failure log; columns it lacks stay null."""
    have = set(df.columns)
    reason = F.lit(reason) if isinstance(reason, str) else reason
    fixed = {
        "stage": F.lit(stage),
        "reason": reason,
        "detail": clip_detail(F.lit(None) if detail is None else detail),
        "timestamp": F.current_timestamp() if timestamp is None else timestamp,
    }
    return df.select(
        *[fixed[c].alias(c) if c in fixed else (F.col(c) if c in have else F.lit(None).cast("string").alias(c)) for c in FAILURE_COLUMNS]
    )


def split_matched(
    df: DataFrame, matched: Column, stage: str, reason: Column | str, detail: Column | None = None, timestamp: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(result, failures)``; together they hold every input row once."""
    ok = F.coalesce(matched, F.lit(False))
    return df.filter(ok), failure_rows(df.filter(~ok), stage, reason, detail, timestamp)


def union_failures(first: DataFrame, *others: DataFrame) -> DataFrame:
    for log in others:
        first = first.unionByName(log, allowMissingColumns=True)
    return first


def failure_key(clone_stage: str = "clone") -> Column:
    """Group-level rows are one per repository, the others one per instance and stage."""
    return F.when(F.col("stage") == clone_stage, F.concat_ws("::", F.lit(clone_stage), "repository")).otherwise(
        F.concat_ws("::", "stage", "instance_id")
    )


def clean_failure_log(log: DataFrame, successes: DataFrame, key: Column | None = None, ts: str = "timestamp") -> DataFrame:
    """Latest attempt per key, without the keys that succeeded since.

    ``successes`` holds the columns the key is built from.
    """
    key = failure_key() if key is None else key
    rest = [c for c in log.columns if c != ts]
    latest = log.withColumn("__key", key).groupBy("__key").agg(F.max(F.struct(ts, *rest)).alias("__row"))
    done = successes.select(key.alias("__key"))
    return latest.join(done, "__key", "left_anti").select(*[F.col(f"__row.{c}").alias(c) for c in log.columns])


def attrition_report(inputs: DataFrame, results: DataFrame, failures: DataFrame, all_label: str = "(all)") -> DataFrame:
    """Failures by stage and reason with subtotals, reconciled against the input.

    ``results`` holds one row per success with its ``stage``; on subtotal rows of a stage
    ``reconciles`` says whether successes plus failures equal the number of inputs.
    """
    counts = failures.rollup("stage", "reason").agg(F.count("*").alias("n"), F.grouping_id().alias("__g"))
    labelled = counts.select(
        F.when(F.col("__g") == 3, all_label).otherwise(F.col("stage")).alias("stage"),
        F.when(F.col("__g") >= 1, all_label).otherwise(F.col("reason")).alias("reason"),
        "n",
    )
    done = results.groupBy("stage").agg(F.count("*").alias("n_success")).withColumn("reason", F.lit(all_label))
    total = inputs.agg(F.count("*")).scalar()
    merged = labelled.join(done, ["stage", "reason"], "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))
    of_stage = (F.col("reason") == all_label) & (F.col("stage") != all_label)
    merged = merged.withColumn("n_success", F.when(of_stage, F.coalesce("n_success", F.lit(0))))
    return merged.withColumn("reconciles", F.when(of_stage, F.col("n") + F.col("n_success") == total))

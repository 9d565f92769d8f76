"""Consensus labels of a table rated by several raters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratertrail.functions.scalar import GRADES, ordinal_rank


def consensus_label(
    df: DataFrame,
    key: Sequence[str],
    label: str,
    order_of_labels: Sequence[str] = GRADES,
    rater: str | None = None,
    first_cols: Sequence[str] = (),
    order: Sequence[str] = (),
    count_distinct_raters: bool = False,
) -> DataFrame:
    """Majority label per key; ties go to the label later in ``order_of_labels``.

    The label domain is short and known, so one counter per label replaces a count per
    ``(key, label)`` and a second grouping: a single shuffle, combined map-side.
    Null labels do not vote but count as reviews; rows with a null key are left out.

    Adds ``severity_consensus, severity_tied, severity_values_seen, n_reviewers`` and, with
    ``first_cols``, the attributes of the first row by ``order`` (then by the attributes).
    """
    key, labels = list(key), list(order_of_labels)
    ranked = df.dropna(subset=key).withColumn("__rank", ordinal_rank(label, labels))
    aggs = [F.count_if(F.col("__rank") == i).alias(f"__n{i}") for i in range(len(labels))]
    if count_distinct_raters:
        if rater is None:
            raise ValueError("count_distinct_raters needs the rater column")
        aggs.append(F.count_distinct(rater).alias("n_reviewers"))
    else:
        aggs.append(F.count("*").alias("n_reviewers"))
    if first_cols:
        if not order:
            raise ValueError("first_cols needs an explicit order")
        aggs.append(F.min(F.struct(*order, *[c for c in first_cols if c not in order])).alias("__first"))
    votes = ranked.groupBy(*key).agg(*aggs)

    counts = [F.col(f"__n{i}") for i in range(len(labels))]
    top = F.greatest(*counts) if len(counts) > 1 else counts[0]
    chosen = F.when(top == 0, F.lit(None).cast("string"))
    for i in reversed(range(len(labels))):
        chosen = chosen.when(counts[i] == top, labels[i])
    at_top = sum(((c == top).cast("int") for c in counts[1:]), (counts[0] == top).cast("int"))
    seen = F.concat_ws(",", *[F.when(c > 0, name) for c, name in zip(counts, labels)])
    return votes.select(
        *key,
        *[F.col(f"__first.{c}").alias(c) for c in first_cols],
        "n_reviewers",
        chosen.alias("severity_consensus"),
        ((top > 0) & (at_top > 1)).alias("severity_tied"),
        seen.alias("severity_values_seen"),
    )

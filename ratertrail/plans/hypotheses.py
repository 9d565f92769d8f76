"""The three hypothesis tests as whole plans over instance, persistence and metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratertrail.functions.scalar import CLASS_SMELLS, GRADES, SEVERE_GRADES, binary_flag
from ratertrail.operators import stats, summaries
from ratertrail.session import cut_lineage

# The structural metrics compared between groups of classes.
CLASS_METRICS = ("wmc", "cbo", "dit", "noc", "rfc", "lcom", "loc", "total_methods", "total_fields")


def relevance_vs_severity(
    instances: DataFrame, flag: str = "is_from_industry_relevant_project_raw", grade: str = "severity_consensus"
) -> DataFrame:
    """Do relevant projects carry more severe smells? One row with the test and both shares."""
    df = instances.select(binary_flag(flag).alias("relevance"), F.col(grade).alias("grade"))
    test = stats.chi_square_test(df, "grade", "relevance")
    share = summaries.share_by_group(df, "relevance", F.col("grade").isin(*SEVERE_GRADES))
    pick = lambda v: share.filter(F.col("relevance") == v).select("pct").scalar()
    return test.withColumns({"pct_severe_relevant": pick("relevant"), "pct_severe_other": pick("other")})


def relevance_breakdown(
    instances: DataFrame,
    flag_values: Sequence[str] = ("0", "0,5", "1"),
    flag: str = "is_from_industry_relevant_project_raw",
    grade: str = "severity_consensus",
) -> DataFrame:
    """The same table by the raw three-way flag."""
    return summaries.crosstab_ordered(instances, grade, flag, GRADES, flag_values)


def severity_vs_persistence(
    instances: DataFrame, persistence: DataFrame, key: str = "instance_id", grade: str = "severity_consensus"
) -> DataFrame:
    """Do severe smells live longer? One row: censoring, both arms, rank test, effect sizes, log-rank.

    Censored rows enter the rank test at their observed value; the log-rank test knows them as censored.
    """
    arm = F.col(grade).isin(*SEVERE_GRADES)
    # Three tests read these columns of the joined rows.
    df = cut_lineage(persistence.join(instances.select(key), key, "left_semi").filter(F.col(grade).isNotNull()))
    profiles = stats.metric_profiles(df, ["persistence_revisions"], arm)
    battery = stats.compare_profiles(profiles).drop("metric")
    delta = F.try_divide(2 * F.col("u"), F.col("n_a").cast("double") * F.col("n_b")) - 1
    delta = profiles.select(F.when(F.least("n_a", "n_b") > 0, delta).alias("cliffs_delta")).scalar()
    logrank = cut_lineage(stats.logrank_test(df, "persistence_revisions", ~F.col("censored"), arm))
    censoring = summaries.censoring_summary(df)
    # The tests are null where an arm has too few rows; the censoring stands all the same.
    tested = battery.select(F.struct("*")).scalar()
    return censoring.select("n", "n_censored", "pct_censored", tested.alias("__tested")).select(
        "n", "n_censored", "pct_censored", *[F.col(f"__tested.{c}") for c in battery.columns],
        delta.alias("cliffs_delta"),
        logrank.select("statistic").scalar().alias("logrank_statistic"),
        logrank.select("p_value").scalar().alias("logrank_p_value"),
    )


def persistence_by_grade(persistence: DataFrame, grade: str = "severity_consensus") -> DataFrame:
    """Count, median, mean and SD of the persistence per grade, in grade order."""
    return summaries.order_by_rank(summaries.describe_by_group(persistence, [grade], "persistence_revisions"), grade, GRADES)


def cooccurrence_vs_metrics(
    instances: DataFrame,
    complexity: DataFrame,
    metrics: Sequence[str] = CLASS_METRICS,
    sample: str = "sample_id",
    smell: str = "smell",
    grade: str = "severity_consensus",
) -> DataFrame:
    """Are classes with both smells more complex than classes with one? One row per metric."""
    on_class = F.col(smell).isin(*CLASS_SMELLS)
    groups = stats.cooccurrence_group(instances.filter(on_class), sample, smell, grade).select(sample, "group")
    per_sample = summaries.mean_per_sample(complexity.filter(on_class), sample, metrics)
    merged = stats.inner_on_sample(groups, per_sample, sample).filter(F.col("group") != "neither")
    return stats.compare_groups(merged, metrics, F.col("group") == "co_occurring")

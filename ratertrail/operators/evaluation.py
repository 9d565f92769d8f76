"""Scores of predicted labels: confusion tables, macro averages, ROC curves, error direction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratertrail.functions.ordering import join_null_safe, running_totals
from ratertrail.functions.scalar import GRADES, ordinal_rank
from ratertrail.operators import stats
from ratertrail.operators.summaries import value_histogram


def confusion_matrix(df: DataFrame, truth: str, prediction: str, labels: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """``group, truth, prediction, n`` over the whole label grid, zeros filled."""
    counts = df.groupBy(*group, truth, prediction).agg(F.count("*").alias("n"))
    if not group:
        grid = df.sparkSession.createDataFrame([(t, p) for t in labels for p in labels], f"{truth} string, {prediction} string")
    else:
        cells = F.array(*[F.struct(F.lit(t).alias(truth), F.lit(p).alias(prediction)) for t in labels for p in labels])
        grid = counts.select(*group).distinct().withColumn("__c", F.explode(cells)).select(*group, f"__c.{truth}", f"__c.{prediction}")
    return grid.join(counts, [*group, truth, prediction], "left").fillna({"n": 0})


def confusion_array(matrix: DataFrame, truth: str, prediction: str, labels: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """The matrix as an array of rows in label order, for export."""
    cell = F.struct(ordinal_rank(truth, labels).alias("i"), ordinal_rank(prediction, labels).alias("j"), "n")
    flat = matrix.groupBy(*group).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    k = len(labels)
    rows = F.array(*[F.transform(F.slice("cells", i * k + 1, k), lambda c: c["n"]) for i in range(k)])
    return flat.select(*group, rows.alias("confusion_matrix"))


def per_class_scores(matrix: DataFrame, truth: str, prediction: str, group: Sequence[str] = ()) -> DataFrame:
    """``precision, recall, f1, support`` per class; a zero denominator scores 0."""
    n = F.col("n").cast("double")
    hit = F.when(F.col(truth) == F.col(prediction), n).otherwise(0.0)
    label = F.explode(F.array(F.struct(F.col(truth).alias("label"), n.alias("actual"), F.lit(0.0).alias("called"), hit.alias("tp")),
                              F.struct(F.col(prediction).alias("label"), F.lit(0.0).alias("actual"), n.alias("called"), F.lit(0.0).alias("tp"))))
    sums = matrix.select(*group, label.alias("s")).groupBy(*group, F.col("s.label").alias("label")).agg(
        *[F.sum(f"s.{c}").alias(c) for c in ("actual", "called", "tp")]
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, actual, called = F.col("tp"), F.col("actual"), F.col("called")
    return sums.select(
        *group, "label", ratio(tp, called).alias("precision"), ratio(tp, actual).alias("recall"),
        ratio(2 * tp, actual + called).alias("f1"), actual.cast("long").alias("support"),
    )


def classification_metrics(matrix: DataFrame, truth: str, prediction: str, group: Sequence[str] = ()) -> DataFrame:
    """``accuracy, precision_macro, recall_macro, f1_macro`` from a confusion matrix.

    The macro averages run over the labels that occur as truth or prediction.
    """
    scores = per_class_scores(matrix.filter("n > 0"), truth, prediction, group)
    macro = scores.groupBy(*group).agg(
        *[F.avg(c).alias(f"{c}_macro") for c in ("precision", "recall", "f1")],
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"),
    )
    return macro.select(*group, "accuracy", "precision_macro", "recall_macro", "f1_macro")


def score_histogram(df: DataFrame, truth: str, scores: dict[str, str | Column], group: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest histogram ``group, label, score, n_a, n_b`` from one score column per label."""
    cells = F.array(*[
        F.struct(F.lit(label).alias("label"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("score"), (F.col(truth) == label).alias("hit"))
        for label, c in scores.items()
    ])
    long = df.select(*group, F.explode(cells).alias("c")).select(*group, "c.label", "c.score", "c.hit")
    return value_histogram(long, [*group, "label"], "score", F.col("hit"))


def roc_by_class(df: DataFrame, truth: str, scores: dict[str, str | Column], group: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest AUC per class."""
    return stats.roc_auc(score_histogram(df, truth, scores, group), [*group, "label"], "score")


def macro_auc(df: DataFrame, truth: str, scores: dict[str, str | Column], group: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean of the one-vs-rest AUCs; with a single score column it is the binary AUC."""
    return roc_by_class(df, truth, scores, group).groupBy(*group).agg(F.avg("auc").alias("auc"))


def roc_curve(hist: DataFrame, group: Sequence[str] = ("label",), value: str = "score") -> DataFrame:
    """``group, threshold, fpr, tpr``: a point per distinct score and the origin (threshold null)."""
    group = list(group)
    cum = running_totals(hist, group, [value], {"tp": "n_a", "fp": "n_b"}, descending=True)
    totals = hist.groupBy(*group).agg(F.sum("n_a").alias("pos"), F.sum("n_b").alias("neg"))
    share = lambda x, t: F.when(F.col(t) > 0, F.col(x) / F.col(t))
    points = join_null_safe(cum, totals, group).select(*group, F.col(value).alias("threshold"), share("fp", "neg").alias("fpr"), share("tp", "pos").alias("tpr"))
    origin = totals.select(*group, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def error_direction(matrix: DataFrame, truth: str, prediction: str, order: Sequence[str] = GRADES, group: Sequence[str] = ()) -> DataFrame:
    """Errors below and above the true grade, and the largest error path (first by label order on a tie)."""
    step = ordinal_rank(prediction, order) - ordinal_rank(truth, order)
    wrong = matrix.withColumn("__step", step).filter("__step <> 0")
    path = F.struct("n", (-ordinal_rank(truth, order)).alias("i"), (-ordinal_rank(prediction, order)).alias("j"), F.col(truth).alias("t"), F.col(prediction).alias("p"))
    return wrong.groupBy(*group).agg(
        F.sum("n").alias("n_errors"),
        F.sum(F.when(F.col("__step") < 0, F.col("n")).otherwise(0)).alias("n_under"),
        F.sum(F.when(F.col("__step") > 0, F.col("n")).otherwise(0)).alias("n_over"),
        F.max(path).alias("__worst"),
    ).select(
        *group, "n_errors", "n_under", "n_over",
        (100 * F.col("n_under") / F.col("n_errors")).alias("pct_under"),
        F.concat_ws(" -> ", "__worst.t", "__worst.p").alias("largest_path"),
        F.col("__worst.n").alias("largest_path_n"),
    )


def escalation_rate(
    df: DataFrame, truth: str, prediction: str, by: Sequence[str], source: str = "minor", targets: Sequence[str] = ("major", "critical")
) -> DataFrame:
    """Share of rows of one true grade predicted into graver ones, per group."""
    return df.filter(F.col(truth) == source).groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.col(prediction).isin(*targets)).alias("n_escalated"),
    ).withColumn("pct", 100 * F.col("n_escalated") / F.col("n"))


def best_by(df: DataFrame, score: str, position: str, name: str, group: Sequence[str] = ()) -> DataFrame:
    """The row of the highest score; the one listed first wins a tie."""
    return df.groupBy(*group).agg(F.max_by(F.struct(name, score), F.struct(F.col(score), -F.col(position))).alias("b")).select(*group, f"b.{name}", f"b.{score}")


def generalisation_gap(results: DataFrame, cv_metric: str = "cv_accuracy_mean", test_metric: str = "test_accuracy", group: Sequence[str] = ("task", "model")) -> DataFrame:
    """Test minus cross-validation score in points, from the long table ``task, model, metric, value``."""
    picked = results.groupBy(*group).agg(
        F.max(F.when(F.col("metric") == cv_metric, F.col("value"))).alias("cv"),
        F.max(F.when(F.col("metric") == test_metric, F.col("value"))).alias("test"),
    )
    return picked.filter("cv is not null and test is not null").withColumn("gap_points", 100 * (F.col("test") - F.col("cv")))


# The columns of the model comparison and the metrics they show.
LEADERBOARD = {
    "Accuracy": "test_accuracy",
    "Precision": "test_precision_macro",
    "Recall": "test_recall_macro",
    "F1-score": "test_f1_macro",
    "ROC-AUC": "test_roc_auc",
}


def leaderboard(results: DataFrame, columns: dict[str, str] = LEADERBOARD, group: Sequence[str] = ("task", "model")) -> DataFrame:
    """The long result table with one column per headline metric."""
    return results.groupBy(*group).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(c) for c, m in columns.items()])

"""The comparison of severity classifiers: all learners, cross-validated and tested on the same split."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratertrail.functions.scalar import severe_flag
from ratertrail.models.learners import Boosting, Forest, KernelMachine, Learner, Logistic, predictions
from ratertrail.models.matrix import Matrix, build_matrix, category_values, indicators
from ratertrail.models.splits import stratified_split
from ratertrail.operators.evaluation import best_by, classification_metrics, confusion_array, confusion_matrix, macro_auc, roc_by_class
from ratertrail.operators.order_statistics import medians
from ratertrail.session import cut_lineage

# Model inputs and the seed of all splits and learners.
NUMERIC_FEATURES = (
    "cbo", "rfc", "loc", "wmc", "dit", "noc", "lcom", "total_methods", "total_fields", "method_cyclomatic_complexity", "n_reviewers",
)
CATEGORICAL_FEATURES = ("smell", "is_from_industry_relevant_project_raw")
SEED = 42

ESTIMATOR_NOTES = {
    "Random Forest": "best cuts between at most 255 bins a column; depth at most 30; samples with repetition are Poisson draws",
    "Gradient Boosting": "best cuts between at most 255 bins a column; gradients in units of a millionth",
    "Extra Trees": "depth at most 30",
    "Logistic Regression": "Newton's method instead of a quasi-Newton one; the optimum is the same",
    "SVM": "kernel on 256 landmark rows; squared hinge; one label against the rest",
}


def model_dataset(instances: DataFrame, complexity: DataFrame, metrics: Sequence[str] = NUMERIC_FEATURES, key: str = "instance_id",
                  grade: str = "severity_consensus", flag: str = "is_from_industry_relevant_project_raw") -> DataFrame:
    """Instances with a metric row, the flag as text and the binary target ``severe_binary``."""
    own = set(instances.columns)
    joined = instances.join(complexity.select(key, *[m for m in metrics if m not in own]), key, "inner")
    return joined.withColumns({flag: F.col(flag).cast("string"), "severe_binary": severe_flag(grade)})


def selection_matrix(df: DataFrame, key: str, target: str, numeric: Sequence[str] = NUMERIC_FEATURES,
                     categorical: Sequence[str] = CATEGORICAL_FEATURES) -> tuple[DataFrame, list[str], list[str]]:
    """One flat table of numbers: ``key, target``, numeric columns with exact medians for unknown values, an indicator for each category.

    Also the names of the numeric columns and of the indicators (``column_value``).
    """
    # Written once: every pass of the medians, the categories and the matrix itself read it.
    df = cut_lineage(df.select(*dict.fromkeys([key, target, *numeric, *categorical])))
    fills, hot = medians(df, numeric), indicators(category_values(df, categorical))
    known = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    filled = [F.coalesce(known(c), F.lit(fills.get(("all", c)))).alias(c) for c in numeric]
    return df.select(key, target, *filled, *[v.alias(c) for c, v in hot.items()]), list(numeric), list(hot)


# Registry of learners: name to a function of the matrix. Open to additions.
ESTIMATORS: dict[str, Callable[[Matrix], Learner]] = {
    "Random Forest": lambda m: Forest(m.cuts, n_trees=300, seed=SEED),
    "Gradient Boosting": lambda m: Boosting(m.cuts, seed=SEED),
    "Extra Trees": lambda m: Forest(m.cuts, extra=True, n_trees=300, seed=SEED),
    "Logistic Regression": lambda m: Logistic(),
    "SVM": lambda m: KernelMachine(),
}


def all_predictions(matrix: Matrix, estimators: Mapping[str, Callable[[Matrix], Learner]] = ESTIMATORS) -> tuple[DataFrame, dict[str, float]]:
    """``model, fit, id, key, truth, prediction_label, scores`` of every learner, fold and the test rows, written; and seconds by learner."""
    done, seconds = [], {}
    for name, make in estimators.items():
        start = time.time()
        done.append(cut_lineage(predictions(matrix, make(matrix))).select(F.lit(name).alias("model"), "*"))
        seconds[name] = time.time() - start
    return reduce(DataFrame.unionByName, done), seconds


def _scored(predicted: DataFrame, labels: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Long ``group, metric, value`` of the matrix scores and the AUC."""
    counts = confusion_matrix(predicted, "truth", "prediction_label", labels, group)
    points = classification_metrics(counts, "truth", "prediction_label", group)
    wide = points.join(macro_auc(predicted, "truth", _asked(labels), group), list(group), "left")
    return wide.unpivot(list(group), ["accuracy", "precision_macro", "recall_macro", "f1_macro", "auc"], "metric", "value")


def _asked(labels: Sequence[str]) -> dict:
    """The scores that are compared with the labels: that of the second one alone, where there are two."""
    return {labels[1]: F.col("scores")[1]} if len(labels) == 2 else {l: F.col("scores")[i] for i, l in enumerate(labels)}


# Names of the metrics in result documents.
TEST_METRICS = {
    "accuracy": "test_accuracy",
    "precision_macro": "test_precision_macro",
    "recall_macro": "test_recall_macro",
    "f1_macro": "test_f1_macro",
    "auc": "test_roc_auc",
}


def model_metrics(predicted: DataFrame, labels: Sequence[str], last: int) -> DataFrame:
    """``model, metric, value``: the scores on the test rows, and mean and spread of the folds' macro-F1 and accuracy.

    ``last`` is the number of the fit that was asked for the test rows; all others are folds.
    """
    out = _scored(predicted.filter(F.col("fit") == last), labels, ["model"]).replace(TEST_METRICS, subset=["metric"])
    per_fold = _scored(predicted.filter(F.col("fit") != last), labels, ["model", "fit"]).filter(F.col("metric").isin("f1_macro", "accuracy"))
    spread = per_fold.groupBy("model", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    cv = spread.unpivot(["model", "metric"], ["mean", "std"], "stat", "value")
    return out.unionByName(cv.select("model", F.concat_ws("_", F.lit("cv"), "metric", "stat").alias("metric"), "value"))


def evaluate_models(df: DataFrame, target: str, labels: Sequence[str], key: str, numeric: Sequence[str] = NUMERIC_FEATURES,
                    categorical: Sequence[str] = CATEGORICAL_FEATURES, estimators: Mapping[str, Callable[[Matrix], Learner]] = ESTIMATORS,
                    task: str | None = None, folds: int = 5, seed: int = SEED) -> DataFrame:
    """Cross-validate, fit and test every learner: ``task, model, metric, value``.

    All folds of a learner, and its fit on all training rows, run beside each other; the driver goes from
    learner to learner. ``folds=0`` leaves cross-validation out.
    """
    matrix = build_matrix(df, target, labels, key, numeric, categorical, folds, seed=seed)
    predicted, _ = all_predictions(matrix, estimators)
    return model_metrics(predicted, labels, len(matrix.fits) - 1).select(F.lit(task or target).alias("task"), "model", "metric", "value")


def split_profile(df: DataFrame, target: str, labels: Sequence[str], key: str, task: str | None = None, fraction: float = 0.2, seed: int = SEED) -> DataFrame:
    """``task, side, label, n``: the rows of each label on either side of the split, labels without rows included."""
    counts = stratified_split(df, target, key, fraction, seed, labels).groupBy(F.when(F.col("is_test"), "test").otherwise("train").alias("side"), F.col(target).alias("label")).agg(F.count("*").alias("n"))
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(l).alias("label")) for s in ("train", "test") for l in labels]))
    grid = df.sparkSession.range(1).select(cells.alias("c")).select("c.*")
    return grid.join(counts, ["side", "label"], "left").select(F.lit(task or target).alias("task"), "side", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def run_document(df: DataFrame, tasks: Mapping[str, tuple[str, Sequence[str]]], key: str, numeric: Sequence[str] = NUMERIC_FEATURES,
                 categorical: Sequence[str] = CATEGORICAL_FEATURES, estimators: Mapping[str, Callable[[Matrix], Learner]] = ESTIMATORS,
                 folds: int = 5, seed: int = SEED, curves_of: str = "Random Forest") -> DataFrame:
    """The whole comparison as one row, ready for ``write_results_json``: a struct for each task, and ``n_complete_case, seed``.

    ``tasks`` maps a name to its target column and labels. A task holds the sizes and label counts of both sides of its
    split, ``models`` (a map from name to the metrics, as text, with the confusion matrix, its labels and the seconds of all
    its fits), the best model by macro-F1 on the test rows (the first listed wins a tie), and the one-vs-rest AUC of each
    label for the learner ``curves_of``.
    """
    spark = df.sparkSession
    parts = []
    for name, (target, labels) in tasks.items():
        matrix = build_matrix(df, target, labels, key, numeric, categorical, folds, seed=seed)
        predicted, seconds = all_predictions(matrix, estimators)
        last = len(matrix.fits) - 1
        tested = predicted.filter(F.col("fit") == last)
        metrics = cut_lineage(model_metrics(predicted, labels, last))
        arrays = confusion_array(confusion_matrix(tested, "truth", "prediction_label", labels, ["model"]), "truth", "prediction_label", labels, ["model"])
        places = spark.createDataFrame([(m, i, seconds[m]) for i, m in enumerate(estimators)], "model string, place int, seconds double")
        best = best_by(metrics.filter("metric = 'test_f1_macro'").join(places, "model"), "value", "place", "model")
        entries = metrics.select("model", "metric", F.col("value").cast("string").alias("text")).unionByName(
            arrays.select("model", F.lit("confusion_matrix").alias("metric"), F.to_json("confusion_matrix").alias("text"))).unionByName(
            places.select("model", F.lit("train_seconds").alias("metric"), F.col("seconds").cast("string").alias("text"))).unionByName(
            places.select("model", F.lit("confusion_matrix_labels").alias("metric"), F.to_json(F.array(*[F.lit(l) for l in labels])).alias("text")))
        models = entries.groupBy("model").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "text")))).alias("metrics"))
        models = models.agg(F.map_from_entries(F.collect_list(F.struct("model", "metrics"))).alias("models"))
        sides = matrix.rows.groupBy((F.col("fold") < 0).alias("test"), "truth").agg(F.count("*").alias("n"))
        dist = lambda test: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("test") == test, F.struct("truth", "n")))))
        sizes = sides.agg(F.sum(F.when(~F.col("test"), F.col("n"))).alias("n_train"), F.sum(F.when(F.col("test"), F.col("n"))).alias("n_test"), dist(False).alias("train_dist"), dist(True).alias("test_dist"))
        curves = roc_by_class(tested.filter(F.col("model") == curves_of), "truth", {l: F.col("scores")[i] for i, l in enumerate(labels)})
        curves = curves.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "auc")))).alias("per_class_auc"))
        # Each part is one row, so joining them on a constant multiplies nothing.
        row = sizes.withColumn("one", F.lit(1))
        for part in (models, best.select(F.col("model").alias("best_model")), curves):
            row = row.join(part.withColumn("one", F.lit(1)), "one", "left")
        parts.append(row.select("one", F.struct("n_train", "n_test", "train_dist", "test_dist", "models", "best_model", "per_class_auc").alias(name)))
    document = df.agg(F.count("*").alias("n_complete_case")).select(F.lit(1).alias("one"), "n_complete_case", F.lit(seed).alias("seed"))
    return reduce(lambda a, b: a.join(b, "one"), parts, document).drop("one")

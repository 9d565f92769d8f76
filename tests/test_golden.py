"""Published aggregates recomputed by the operators."""

import math

import pytest
from pyspark.sql import functions as F

from ratertrail.functions.scalar import GRADES
from ratertrail.functions.tails import chi2_sf, normal_sf
from ratertrail.models import splits
from ratertrail.operators import audit, evaluation, stats

# Published counts of grades in relevant and other projects.
RELEVANT = {"none": 7467, "minor": 441, "major": 265, "critical": 65}
OTHER = {"none": 1138, "minor": 77, "major": 55, "critical": 9}


def test_relevance_table(spark):
    rows = [(g, "relevant", n) for g, n in RELEVANT.items()] + [(g, "other", n) for g, n in OTHER.items()]
    df = spark.createDataFrame(rows, "grade string, relevance string, n long")
    r = stats.chi_square_test(df, "grade", "relevance", "n").first()
    assert r.chi2 == pytest.approx(5.213388268389237) and r.dof == 3 and r.n == 9517
    assert r.p_value == pytest.approx(0.15682226309007122)
    assert r.cramers_v == pytest.approx(0.023405073026010133)
    assert r.min_expected == pytest.approx(9.944940632552274)


def test_tails(spark):
    df = spark.createDataFrame([(49.30509254593662, 1), (5.213388268389237, 3), (4.0, 2), (9.0, 4), (0.0, 1)], "x double, dof int")
    got = [r.p for r in df.select(chi2_sf("x", "dof").alias("p")).collect()]
    want = [2.1909298707555818e-12, 0.15682226309007122, math.exp(-2), math.exp(-4.5) * 5.5, 1.0]
    assert got == pytest.approx(want, rel=1e-9)
    z = spark.createDataFrame([(1.959963984540054,), (None,)], "z double").select(normal_sf("z").alias("p")).collect()
    assert z[0].p == pytest.approx(0.025) and z[1].p is None


def test_effect_size_from_u_and_moments(spark):
    assert 2 * 1544100 / (346 * 8180) - 1 == pytest.approx(0.09112879291094873)
    cols = "n_a long, mean_a double, var_a double, n_b long, mean_b double, var_b double"
    # The published count, mean and SD per grade, from which the arms are pooled.
    by_grade = {"none": (7731, 1.8112792652955634, 6.3639677027881225), "minor": (449, 2.7928730512249444, 9.587209810490533),
                "major": (283, 2.964664310954064, 9.478914009060773), "critical": (63, 8.714285714285714, 30.43895454704466)}

    def pool(*grades):
        n = sum(by_grade[g][0] for g in grades)
        m = sum(by_grade[g][0] * by_grade[g][1] for g in grades) / n
        ss = sum((by_grade[g][0] - 1) * by_grade[g][2] ** 2 + by_grade[g][0] * (by_grade[g][1] - m) ** 2 for g in grades)
        return n, m, ss / (n - 1)

    df = spark.createDataFrame([pool("major", "critical") + pool("none", "minor")], cols)
    d = df.select(stats._pooled("n_a", "mean_a", "var_a", "n_b", "mean_b", "var_b").alias("d")).first().d
    assert d == pytest.approx(0.2990419511095849)


# Published test-set matrices (rows are true grades) with accuracy and macro precision, recall and F1.
FOUR = {
    "Random Forest": ([[1455, 12, 6, 2], [52, 23, 11, 1], [23, 5, 25, 0], [4, 0, 7, 2]], (0.9244, 0.6084, 0.4691, 0.5104)),
    "Gradient Boosting": ([[1464, 5, 5, 1], [52, 28, 7, 0], [19, 10, 22, 2], [5, 1, 5, 2]], (0.9312, 0.6378, 0.4708, 0.5248)),
    "Extra Trees": ([[1445, 18, 11, 1], [46, 28, 12, 1], [16, 12, 24, 1], [5, 1, 4, 3]], (0.9214, 0.6002, 0.4963, 0.5321)),
    "Logistic Regression": ([[1222, 155, 67, 31], [13, 39, 29, 6], [8, 17, 13, 15], [1, 1, 6, 5]], (0.7856, 0.3418, 0.4767, 0.3643)),
    "SVM": ([[1238, 177, 49, 11], [2, 53, 30, 2], [3, 18, 24, 8], [0, 2, 5, 6]], (0.8114, 0.4131, 0.5907, 0.4559)),
}
TWO = {
    "Random Forest": ([[1551, 11], [42, 24]], (0.9674, 0.8297, 0.6783, 0.7292)),
    "Gradient Boosting": ([[1552, 10], [50, 16]], (0.9631, 0.7921, 0.618, 0.6644)),
    "Extra Trees": ([[1548, 14], [39, 27]], (0.9674, 0.817, 0.7001, 0.7439)),
    "Logistic Regression": ([[1301, 261], [10, 56]], (0.8335, 0.5845, 0.8407, 0.5991)),
    "SVM": ([[1398, 164], [16, 50]], (0.8894, 0.6112, 0.8263, 0.6483)),
}


@pytest.mark.parametrize("labels, published", [(GRADES, FOUR), (("not_severe", "severe"), TWO)])
def test_published_matrices(spark, labels, published):
    rows = [(m, t, p, cells[i][j]) for m, (cells, _) in published.items() for i, t in enumerate(labels) for j, p in enumerate(labels)]
    df = spark.createDataFrame(rows, "model string, truth string, pred string, n long")
    got = {r.model: (r.accuracy, r.precision_macro, r.recall_macro, r.f1_macro) for r in evaluation.classification_metrics(df, "truth", "pred", ["model"]).collect()}
    for model, (_, want) in published.items():
        assert [round(x, 4) for x in got[model]] == pytest.approx(list(want), abs=1.01e-4)
    arrays = {r.model: r.confusion_matrix for r in evaluation.confusion_array(df, "truth", "pred", labels, ["model"]).collect()}
    assert arrays == {m: cells for m, (cells, _) in published.items()}


def test_error_direction(spark):
    cells = FOUR["Random Forest"][0]
    df = spark.createDataFrame([(t, p, cells[i][j]) for i, t in enumerate(GRADES) for j, p in enumerate(GRADES)], "truth string, pred string, n long")
    r = evaluation.error_direction(df, "truth", "pred").first()
    assert (r.n_errors, r.n_under, r.n_over) == (123, 91, 32) and r.pct_under == pytest.approx(73.98, abs=0.01)
    # Minor called none is the most frequent path.
    assert (r.largest_path, r.largest_path_n) == ("minor -> none", 52)


def test_split_quotas(spark):
    sizes = {"none": 7370, "minor": 436, "major": 267, "critical": 64}
    df = spark.createDataFrame([(g, n) for g, n in sizes.items()], "y string, n int").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")
    got = {r.y: r.quota for r in splits.class_quotas(df, "y", 0.2).collect()}
    assert got == {"none": 1475, "minor": 87, "major": 53, "critical": 13}
    two = df.withColumn("y", F.when(F.col("y").isin("major", "critical"), "severe").otherwise("not_severe"))
    assert {r.y: r.quota for r in splits.class_quotas(two, "y", 0.2).collect()} == {"not_severe": 1562, "severe": 66}


def test_attrition_of_the_full_run(spark):
    counts = {
        ("persistence", "repo_not_cloned"): 750, ("persistence", "commit_not_ancestor_of_head"): 180,
        ("persistence", "remap_candidate_not_ancestor_of_head"): 20, ("persistence", "path_unreadable_at_labelled_commit"): 18,
        ("persistence", "unexpected_error"): 12, ("persistence", "entity_not_found_at_labelled_commit"): 10, ("persistence", "git_log_failed"): 1,
        ("complexity", "repo_not_cloned"): 750, ("complexity", "ck_failed"): 486, ("complexity", "no_join_match"): 88, ("complexity", "checkout_failed"): 56,
    }
    expand = lambda rows, schema: spark.createDataFrame(rows, schema).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n", "i")
    failures = expand([(s, r, n) for (s, r), n in counts.items()], "stage string, reason string, n int")
    results = expand([("persistence", 8526), ("complexity", 8137)], "stage string, n int")
    rows = audit.attrition_report(spark.range(9517), results, failures).collect()
    totals = {r.stage: r for r in rows if r.reason == "(all)"}
    assert (totals["persistence"].n, totals["complexity"].n, totals["(all)"].n) == (991, 1380, 2371)
    assert totals["persistence"].reconciles and totals["complexity"].reconciles
    assert {(r.stage, r.reason): r.n for r in rows if r.reason != "(all)"} == counts

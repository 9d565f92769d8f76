import math
import random

import pytest
from pyspark.sql import functions as F

from ratertrail.models import benchmark as B
from ratertrail.models import learners as L
from ratertrail.models import selection as M
from ratertrail.models import splits
from ratertrail.queries import views as V


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        severe = i % 4 == 0
        loc = rng.gauss(60 if severe else 20, 6)
        rows.append((str(i), "severe" if severe else "not_severe", loc, loc * 2 + rng.gauss(0, 1), rng.random() if i % 9 else None, rng.choice(["blob", "data class"])))
    return spark.createDataFrame(rows, "id string, y string, loc double, rfc double, noise double, smell string").cache()


def test_split_and_folds_are_stratified_and_repeatable(table):
    split = splits.stratified_split(table, "y", "id")
    sizes = {(r.y, r.is_test): r["count"] for r in split.groupBy("y", "is_test").count().collect()}
    assert sizes == {("severe", True): 20, ("severe", False): 80, ("not_severe", True): 60, ("not_severe", False): 240}
    ids = lambda d: {r.id for r in d.filter("is_test").collect()}
    assert ids(split) == ids(splits.stratified_split(table.repartition(7), "y", "id")) != ids(splits.stratified_split(table, "y", "id", seed=1))
    folds = [r["count"] for r in splits.stratified_folds(table, "y", "id").groupBy("y", "fold").count().collect()]
    assert sorted(folds) == [20] * 5 + [60] * 5


def test_weights_balance_the_classes(table):
    sums = splits.balanced_weights(table, "y").groupBy("y").agg(F.sum("weight").alias("w")).collect()
    assert [r.w for r in sums] == pytest.approx([200.0, 200.0])


def test_benchmark_finds_the_signal(table):
    quick = {"Random Forest": lambda m: L.Forest(m.cuts, n_trees=5, max_depth=4), "Logistic Regression": lambda m: L.Logistic()}
    rows = B.evaluate_models(table, "y", ["not_severe", "severe"], "id", ["loc", "noise"], ["smell"], quick, "binary", folds=2).collect()
    got = {(r.model, r.metric): r.value for r in rows}
    assert set(r.task for r in rows) == {"binary"} and len(rows) == 18
    for model in quick:
        assert got[model, "test_roc_auc"] > 0.95 and got[model, "test_f1_macro"] > 0.85 and 0 <= got[model, "cv_f1_macro_std"] < 0.1


def _mi_brute(rows, k=3):
    psi = lambda m: -0.5772156649015329 + sum(1 / i for i in range(1, int(m)))
    total = []
    for x, y in rows:
        mine = sorted(abs(x - a) for a, b in rows if b == y)[1:]
        kk = min(k, len(mine))
        if kk:
            total.append((psi(kk), psi(len(mine) + 1), psi(sum(abs(x - a) < mine[kk - 1] for a, b in rows if rows_of[b] > 1))))
    n = len(total)
    return max(0.0, psi(n) + sum(t[0] - t[1] - t[2] for t in total) / n)


rows_of: dict = {}


@pytest.mark.parametrize("seed", [1, 2])
def test_information_matches_brute_force(spark, seed):
    """Classes of very different size, one of two rows, one of a single row; values spread over many bands."""
    rng = random.Random(seed)
    rows = [(rng.choice([-1, 1]) * 10 ** rng.uniform(-4, 4), rng.choice("aaaaaaab")) for _ in range(150)] + [(1.5, "c"), (200.25, "c"), (3.25, "d")]
    rows_of.clear()
    for _, y in rows:
        rows_of[y] = rows_of.get(y, 0) + 1
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(rows)], "id int, x double, y string")
    got = M.mutual_information(df, ["x"], "y", "id", jitter=False).first().mi
    assert got == pytest.approx(_mi_brute([r for r in rows if rows_of[r[1]] > 1]), abs=1e-9)


def test_information_survives_ties(spark):
    df = spark.range(300).select("id", (F.col("id") % 3).alias("y"), (F.col("id") % 3 * 2.0).alias("same"), F.lit(1.0).alias("flat"))
    got = {r.feature: r.mi for r in M.mutual_information(df, ["same", "flat"], "y", "id").collect()}
    assert got["same"] == pytest.approx(math.log(3), abs=0.05) and got["flat"] < 0.1


@pytest.fixture
def short_stretches(spark, monkeypatch):
    monkeypatch.setattr(M, "STRETCH_ROWS", 7)
    monkeypatch.setattr(M, "RUN_ROWS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_information_across_stretches(spark, short_stretches, monkeypatch):
    """Stretches and runs of a few rows: the same number, and only what lies at their ends is ranked by running totals."""
    ranked = []
    totals = M.running_totals
    monkeypatch.setattr(M, "running_totals", lambda line, *rest: ranked.append(line.count()) or totals(line, *rest))
    rng = random.Random(5)
    rows = [(rng.choice([-1, 1]) * 10 ** rng.uniform(-4, 4), rng.choice("aaaab")) for _ in range(200)] + [(1.5, "c"), (200.25, "c"), (3.25, "d"), (0.5, "d"), (-0.5, "d")]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(rows)], "id int, x double, y string")
    rows_of.clear()
    for _, y in rows:
        rows_of[y] = rows_of.get(y, 0) + 1
    assert M.mutual_information(df, ["x"], "y", "id", jitter=False).first().mi == pytest.approx(_mi_brute(rows), abs=1e-9)
    monkeypatch.setattr(M, "STRETCH_ROWS", 100_000)
    monkeypatch.setattr(M, "RUN_ROWS", 20)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ranked.clear()
    assert M.mutual_information(df, ["x"], "y", "id", jitter=False).first().mi == pytest.approx(_mi_brute(rows), abs=1e-9)
    assert ranked and sum(ranked) < len(rows), "not three marks for each row"


def test_information_counts_rows_of_one_key_together(spark, short_stretches):
    """Copies of a row share their count, tied or not; all rows tied in one value spread over many stretches."""
    once = spark.range(40).select("id", (F.col("id") % 2).alias("y"), (F.col("id") * F.col("id") % 37).cast("double").alias("x"), F.lit(1.0).alias("flat"))
    got = {r.feature: r.mi for r in M.mutual_information(once.unionByName(once), ["x", "flat"], "y", "id", jitter=False).collect()}
    assert got["flat"] == pytest.approx(1.5, abs=1e-9), "digamma(40) + digamma(3) - digamma(40) - digamma(1): 40 keys, each alone in its radius of zero"
    assert set(got) == {"x", "flat"} and got["x"] >= 0


def test_metrics_count_each_distinct_column_by_itself(spark, tmp_path):
    """Null suppliers and orders are not counted, a part without any has 0; no row is expanded once more for each count."""
    lines = [(10, 1, 5, 1), (10, 1, 5, 2), (11, 1, 6, 3), (None, 1, None, 4), (12, 2, None, 5), (12, 2, None, 6), (13, None, 5, 1), (14, 9, 5, 1)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"
    spark.createDataFrame([(*r, 2.0, 250.0) for r in lines], schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 8), (2, 3), (3, 4)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    out = V.metrics(spark, str(tmp_path))
    assert {tuple(r) for r in out.collect()} == {(1, 4, 2, 2, 8, 8, 4, 0, 1, 0), (2, 2, 0, 1, 4, 4, 0, 2, 3, 3)}
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_pruning_keeps_the_better_of_a_pair(table):
    assert M.prune_correlated(table, {"loc": 0.2, "rfc": 0.3, "noise": 0.1}) == ["loc"]
    assert M.prune_correlated(table, {"loc": 0.3, "rfc": 0.3}) == ["rfc"], "the later one loses a tie"
    assert M.prune_correlated(table, {"loc": 0.3}) == []


def test_threshold_is_inclusive(spark):
    kept, dropped = M.split_by_threshold(spark.createDataFrame([("a", 0.05), ("b", 0.04)], "feature string, mi double"))
    assert [r.feature for r in kept.collect()] == ["a"] and [r.feature for r in dropped.collect()] == ["b"]


def test_selection_keeps_one_of_two_copies(table):
    df = table.withColumn("blob", (F.col("smell") == "blob").cast("double")).fillna({"noise": 0.5})
    rows = M.feature_selection(df, ["loc", "rfc"], ["blob"], "y", ["not_severe", "severe"], "id", folds=2, num_trees=3, max_depth=3).collect()
    kept = {(r.stage, r.feature): r.kept for r in rows}
    assert kept["mutual_information", "loc"] and kept["mutual_information", "rfc"] and not kept["mutual_information", "blob"]
    assert kept["correlation", "loc"] != kept["correlation", "rfc"]
    assert sum(r.kept for r in rows if r.stage == "recursive_elimination") == 1


def test_rows_without_a_label_count_in_no_quota(spark):
    df = spark.createDataFrame([(i, "a" if i < 4 else "b" if i < 6 else None) for i in range(10)], "id int, y string")
    assert {r.y: r.n for r in splits.class_quotas(df, "y", 0.5).collect()} == {"a": 4, "b": 2}
    out = splits.stratified_split(df, "y", "id", 0.5).collect()
    assert len(out) == 6 and sum(r.is_test for r in out) == 3


def test_elimination_keeps_the_telling_feature(spark):
    rng = random.Random(5)
    rows = [(i, "severe" if i % 3 == 0 else "not_severe", float(i % 3 == 0) + rng.random() * 0.5, rng.random(), rng.random()) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, y string, telling double, noise_a double, noise_b double")
    rounds = M.rfe_cv(df, ["noise_a", "telling", "noise_b"], "y", ["not_severe", "severe"], "id", folds=2, num_trees=5, max_depth=3)
    assert [len(f) for f, _ in rounds] == [3, 2, 1] and rounds[-1][0] == ["telling"] and rounds[-1][1] > 0.9
    assert all(set(b) < set(a) for (a, _), (b, _) in zip(rounds, rounds[1:]))

import math
import random
import re
from itertools import combinations
from statistics import median

import pytest
from pyspark.sql import functions as F

from ratertrail.functions.scalar import GRADES
from ratertrail.functions.tails import chi2_sf, normal_sf, upper_tails
from ratertrail.operators import evaluation as E
from ratertrail.operators import stats, summaries
from ratertrail.operators import stats as stats_module
from ratertrail.plans.hypotheses import severity_vs_persistence


def _arms(seed, na=37, nb=52):
    rng = random.Random(seed)
    return [rng.choice([rng.randrange(6), rng.lognormvariate(0, 3), -rng.random()]) for _ in range(na)], [float(rng.randrange(5)) for _ in range(nb)]


def _frame(spark, a, b):
    return spark.createDataFrame([("m", float(x), True) for x in a] + [("m", float(x), False) for x in b], "metric string, value double, arm boolean")


@pytest.mark.parametrize("seed", [1, 2])
def test_rank_statistics_match_all_pairs(spark, seed):
    a, b = _arms(seed)
    hist = summaries.value_histogram(_frame(spark, a, b), ["metric"], "value", F.col("arm"))
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    r = stats.mann_whitney(hist).first()
    assert r.u == pytest.approx(u) and (r.n_a, r.n_b) == (len(a), len(b))
    n = len(a) + len(b)
    pooled = a + b
    ties = sum(pooled.count(v) ** 3 - pooled.count(v) for v in set(pooled))
    sd = math.sqrt(len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (u - len(a) * len(b) / 2 - 0.5) / sd
    assert r.z == pytest.approx(z) and r.p_value == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)))
    assert stats.cliffs_delta(hist).first().cliffs_delta == pytest.approx(sum((x > y) - (x < y) for x in a for y in b) / len(a) / len(b))


def test_exact_law_is_flagged(spark):
    hist = lambda a, b: summaries.value_histogram(_frame(spark, a, b), ["metric"], "value", F.col("arm"))
    assert stats.mann_whitney(hist([1, 2], range(10, 30))).first().exact_applicable
    assert not stats.mann_whitney(hist([1, 1], range(10, 30))).first().exact_applicable
    assert not stats.mann_whitney(hist(range(9), range(10, 30))).first().exact_applicable


def test_medians_are_interpolated(spark):
    groups = {"odd": [5.0, 1.0, 3.0], "even": [4.0, 1.0, 2.0, 9.0], "tied": [2.0, 2.0, 7.0, 7.0], "one": [-3.5]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("odd", None)], "g string, v double")
    got = {r.g: r for r in summaries.describe_by_group(df, ["g"], "v").collect()}
    assert {g: r["median"] for g, r in got.items()} == {g: median(vs) for g, vs in groups.items()}
    assert got["odd"]["count"] == 3 and got["one"]["std"] is None


def test_groups_too_small_are_skipped(spark):
    df = spark.createDataFrame([(True, 1.0, None), (True, 2.0, 1.0), (False, 3.0, 2.0), (False, 4.0, 5.0)], "arm boolean, x double, y double")
    assert [r.metric for r in stats.compare_groups(df, ["x", "y"], F.col("arm")).collect()] == ["x"]


def test_equal_values_give_nan_effect(spark):
    assert math.isnan(stats.cohens_d(_frame(spark, [1, 1], [1, 1]), ["metric"], "value", F.col("arm")).first().cohens_d)


def test_logrank_by_hand(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(8), rng.random() < 0.7, rng.random() < 0.4) for _ in range(80)]
    z = v = 0.0
    for t in sorted({r[0] for r in rows}):
        na, nb = (sum(r[0] >= t and r[2] == arm for r in rows) for arm in (True, False))
        d, da = sum(r[0] == t and r[1] for r in rows), sum(r[0] == t and r[1] and r[2] for r in rows)
        n = na + nb
        z += da - d * na / n
        v += d * na * nb * (n - d) / (n * n * (n - 1)) if n > 1 else 0
    r = stats.logrank_test(spark.createDataFrame(rows, "t int, event boolean, arm boolean"), "t", F.col("event"), F.col("arm")).first()
    assert (r.z, r.v, r.statistic) == pytest.approx((z, v, z * z / v))
    assert r.p_value == pytest.approx(math.erfc(math.sqrt(z * z / v / 2)))


def test_kappa_from_formed_pairs(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(12), rng.randrange(5), rng.choice(GRADES)) for _ in range(120)]
    pairs = [(GRADES.index(a[2]), GRADES.index(b[2])) for a, b in combinations(rows, 2) if a[0] == b[0] and a[1] != b[1]]
    both = pairs + [(b, a) for a, b in pairs]
    n = len(both)
    share = [sum(a == g for a, _ in both) for g in range(4)]
    observed = sum((a - b) ** 2 for a, b in both)
    expected = sum(share[i] * share[j] / n * (i - j) ** 2 for i in range(4) for j in range(4))
    df = spark.createDataFrame(rows, "inst int, rater int, g string")
    r = stats.weighted_kappa(df, ["inst"], "rater", "g").first()
    assert r.n_pairs == len(pairs) and r.kappa == pytest.approx(1 - observed / expected)
    assert r.exact_pct == pytest.approx(100 * sum(a == b for a, b in pairs) / len(pairs))
    assert r.within_one_pct == pytest.approx(100 * sum(abs(a - b) <= 1 for a, b in pairs) / len(pairs))
    counts = {(x.a, x.b): x.n for x in stats.rater_pairs(df, ["inst"], "rater", "g").collect()}
    assert all(counts[i, j] == both.count((i, j)) for i in range(4) for j in range(4))


def test_votes_are_dealt_in_small_parts(spark):
    """The groups of raters do not stand beside those of the dedupe in one task, and three labels give symmetric counts."""
    rng = random.Random(8)
    rows = [(rng.randrange(3), rng.randrange(6), rng.choice("xyz"), rng.choice("pq")) for _ in range(90)] + [(1, None, "x", "p"), (1, 2, None, "p"), (None, 1, "x", "q"), (None, 2, "z", "q")]
    df = spark.createDataFrame(rows, "inst int, rater int, g string, kind string").distinct()
    out = stats.rater_pairs(df, ["inst"], "rater", "g", list("xyz"), by=["kind"])
    kept = [r for r in {tuple(r) for r in rows} if r[1] is not None and r[2] is not None]
    want = {(k, a, b): 0 for k in "pq" for a in range(3) for b in range(3)}
    for a in kept:
        for b in kept:
            if a[0] == b[0] and a[3] == b[3] and a[1] != b[1]:
                want[a[3], "xyz".index(a[2]), "xyz".index(b[2])] += 1
    assert {(r.kind, r.a, r.b): r.n for r in out.collect()} == want
    dealt = stats.rater_pairs(df, ["inst"], "rater", "g")
    assert f"hashpartitioning(inst, rater, {stats.VOTE_TASKS})".replace(" ", "") in re.sub(r"#\d+|\s", "", dealt._jdf.queryExecution().executedPlan().toString())


def test_missing_smell_counts_as_present(spark):
    df = spark.createDataFrame([(1, "blob", "none"), (2, "blob", "minor"), (2, "data class", "none"), (3, "blob", "none"), (3, "data class", "none"), (4, "blob", "major"), (4, "data class", "minor")], "s int, smell string, g string")
    run = lambda **kw: {r.s: r.group for r in stats.cooccurrence_group(df, "s", "smell", "g", **kw).collect()}
    assert run() == {1: "isolated", 2: "isolated", 3: "neither", 4: "co_occurring"}
    assert run(missing_is_present=False) == {1: "neither", 2: "isolated", 3: "neither", 4: "co_occurring"}


def test_chi_square_shapes(spark):
    table = lambda cells: stats.chi_square_test(spark.createDataFrame([(str(i), str(j), n) for i, row in enumerate(cells) for j, n in enumerate(row)], "a string, b string, n long"), "a", "b", "n").first()
    r = table([[10, 20], [30, 25]])
    e = [[40 * 30 / 85, 45 * 30 / 85], [40 * 55 / 85, 45 * 55 / 85]]
    want = sum((abs(o - x) - 0.5) ** 2 / x for orow, xrow in zip([[10, 20], [30, 25]], e) for o, x in zip(orow, xrow))
    assert r.dof == 1 and r.chi2 == pytest.approx(want)
    empty_cell = table([[5, 0, 7], [3, 6, 2]])
    expected = [[12 * c / 23 for c in (8, 6, 9)], [11 * c / 23 for c in (8, 6, 9)]]
    want = sum((o - x) ** 2 / x for orow, xrow in zip([[5, 0, 7], [3, 6, 2]], expected) for o, x in zip(orow, xrow))
    assert empty_cell.dof == 2 and empty_cell.chi2 == pytest.approx(want)
    assert table([[5, 0], [7, 0]]).chi2 == 0.0, "an empty column is left out"


def test_area_equals_trapezoids(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(rng.choice("xyz"), round(rng.random(), 1)) for _ in range(150)], "truth string, p double")
    hist = E.score_histogram(df, "truth", {"x": "p", "y": 1 - F.col("p")})
    auc = {r.label: r.auc for r in stats.roc_auc(hist, ["label"], "score").collect()}
    points = E.roc_curve(hist).collect()
    for label, area in auc.items():
        line = sorted((p.fpr, p.tpr) for p in points if p.label == label)
        assert line[0] == (0.0, 0.0) and line[-1] == (1.0, 1.0)
        assert sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(line, line[1:])) == pytest.approx(area)


def test_first_listed_wins_a_tie(spark):
    df = spark.createDataFrame([("b", 0, 0.5), ("a", 1, 0.5), ("c", 2, 0.1)], "model string, at int, f1 double")
    assert E.best_by(df, "f1", "at", "model").first().model == "b"


def test_persistence_with_an_empty_arm_still_counts_censoring(spark):
    rows = [(str(i), "none", i, i % 2 == 0) for i in range(4)]
    df = spark.createDataFrame(rows, "instance_id string, severity_consensus string, persistence_revisions long, censored boolean")
    row = severity_vs_persistence(df, df).first()
    assert (row["n"], row["n_censored"]) == (4, 2) and row["cliffs_delta"] is None


def test_rank_test_of_a_single_row(spark):
    hist = spark.createDataFrame([("m", 1.0, 1, 0, 1)], "metric string, value double, n_a long, n_b long, n long")
    assert stats_module.mann_whitney(hist).first()["z"] is None
    assert stats_module.cliffs_delta(hist).first()["cliffs_delta"] is None


def test_exact_law_counts_every_order(spark):
    """All ways to place the smaller arm among the ranks, one by one."""
    for m, n in ((1, 1), (2, 3), (3, 3), (4, 5), (5, 3)):
        us = [sum(ranks) - m * (m + 1) // 2 for ranks in combinations(range(1, m + n + 1), m)]
        assert list(upper_tails(m, n)) == pytest.approx([sum(u >= k for u in us) / len(us) for k in range(m * n + 1)])
    # Published critical values: U <= 13 for 8 and 8, and U <= 2 for 5 and 5, one-sided at five in a thousand and a hundred.
    assert 1 - upper_tails(8, 8)[8] <= 0.005 < 1 - upper_tails(8, 8)[9]
    assert 1 - upper_tails(5, 5)[2] <= 0.01 < 1 - upper_tails(5, 5)[3]
    wide = upper_tails(8, 5000)
    assert wide[0] == 1 and wide[-1] == pytest.approx(1 / math.comb(5008, 8)) and wide[20000] == pytest.approx(0.5, abs=1e-4)


def test_small_untied_arms_get_the_exact_law(spark):
    a, b, tied = [3.5, 9.0, 7.25], [1.0, 2.0, 8.0, 4.0, -1.0], [1.0, 2.0, 2.0, 4.0, -1.0]
    rows = [(m, v, arm) for m, other in (("free", b), ("tied", tied)) for arm, vs in ((True, a), (False, other)) for v in vs] + [("alone", 1.0, True)]
    df = spark.createDataFrame(rows, "metric string, value double, arm boolean")
    got = {r.metric: r for r in stats.mann_whitney(summaries.value_histogram(df, ["metric"], "value", F.col("arm"))).collect()}
    u = sum(x > y for x in a for y in b)
    us = [sum(x > y for x in pick for y in set(a + b) - set(pick)) for pick in combinations(a + b, 3)]
    assert got["free"].u == u and got["free"].p_value == pytest.approx(sum(v >= u for v in us) / len(us)) and got["free"].exact_applicable
    assert got["tied"].p_value == pytest.approx(0.5 * math.erfc(got["tied"].z / math.sqrt(2))) and not got["tied"].exact_applicable
    assert got["alone"].p_value is None


def test_tails_are_accurate(spark):
    zs = [-40.0, -6.0, -2.6, -1.0, 0.0, 1e-9, 0.5, 2.4, 3.53, 3.54, 8.0, 30.0]
    got = [r.p for r in spark.createDataFrame([(z,) for z in zs], "z double").select(normal_sf("z").alias("p")).collect()]
    assert got == pytest.approx([0.5 * math.erfc(z / math.sqrt(2)) for z in zs], rel=1e-10)
    # Even degrees of freedom have a closed form of their own; one degree is the square of a normal.
    cases = [(x, d) for x in (0.0, 0.3, 4.0, 11.0, 60.0, 900.0) for d in (0, 1, 2, 3, 4, 9, 10)]
    got = [r.p for r in spark.createDataFrame(cases, "x double, d long").select(chi2_sf("x", "d").alias("p")).collect()]
    for (x, d), p in zip(cases, got):
        h = x / 2
        if d == 0 or x == 0:
            want = 1.0
        elif d % 2 == 0:
            want = math.exp(-h) * sum(h**k / math.factorial(k) for k in range(d // 2))
        else:
            want = math.erfc(math.sqrt(h)) + math.exp(-h) * sum(h ** (k + 0.5) / math.gamma(k + 1.5) for k in range((d - 1) // 2))
        assert p == pytest.approx(want, rel=1e-9, abs=1e-300), (x, d)


def test_profiles_agree_with_and_without_bands(spark, monkeypatch):
    a, b = _arms(7)
    df = _frame(spark, a, b)
    ask = lambda: stats.compare_groups(df.withColumn("other", F.col("value") * -2), ["value", "other"], F.col("arm")).orderBy("metric").collect()
    plain = ask()
    monkeypatch.setattr("ratertrail.functions.ordering.SMALL_ROWS", 0)
    banded = ask()
    for p, q in zip(plain, banded):
        assert [p.metric, *p[1:-2], p[-1]] == [q.metric, *(pytest.approx(v) for v in q[1:-2]), pytest.approx(q[-1])]
    assert plain[1].median_a == pytest.approx(median(a)) and plain[1].mean_b == pytest.approx(sum(b) / len(b))

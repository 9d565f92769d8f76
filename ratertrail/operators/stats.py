"""Group comparisons: chi-square, ranks, effect sizes, log-rank, rater agreement.

Everything is computed from value histograms and marginals, so the only rows that are sorted
are distinct values, and only within bands (``functions.ordering``). Tail probabilities are
added to the finished statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratertrail.functions.ordering import join_null_safe, running_totals
from ratertrail.functions.scalar import GRADES, case_recode, ordinal_rank
from ratertrail.functions.tails import EXACT_CELLS, chi2_sf, exact_rank_tails, normal_sf
from ratertrail.operators.summaries import long_form, pivot_labels, value_histogram
from ratertrail.session import cut_lineage

#: Parts into which votes are dealt for agreement; up to 200 are written without a sort.
VOTE_TASKS = 200


def chi_square_test(df: DataFrame, row: str, col: str, count: str | None = None) -> DataFrame:
    """Independence of two labels: ``chi2, dof, p_value, cramers_v, min_expected, n``.

    With ``count`` the input already is a long contingency table. Empty cells count with
    observed 0; the continuity correction applies at one degree of freedom only.
    """
    known = df.filter(F.col(row).isNotNull() & F.col(col).isNotNull())
    amount = F.count("*") if count is None else F.sum(count)
    cells = known.groupBy(row, col).agg(amount.cast("double").alias("o")).filter("o > 0")
    rows = cells.groupBy(row).agg(F.sum("o").alias("nr"))
    cols = cells.groupBy(col).agg(F.sum("o").alias("nc"))
    side = lambda frame, c: frame.agg(
        F.struct(F.count("*").alias("size"), F.sum(c).alias("total"), F.min(c).alias("least"), F.sum(1 / F.col(c)).alias("inverse"))
    ).scalar()
    filled = cells.join(rows, row).join(cols, col).select("o", "nr", "nc", side(rows, "nr").alias("r"), side(cols, "nc").alias("c"))
    e = F.col("nr") * F.col("nc") / F.col("r.total")
    gap = F.abs(F.col("o") - e)
    sums = filled.agg(
        F.sum(gap * gap / e).alias("over_filled"),
        F.sum(e).alias("e_filled"),
        F.count("*").alias("n_filled"),
        F.max(gap).alias("gap"),
        F.any_value("r").alias("r"),
        F.any_value("c").alias("c"),
    ).filter("n_filled > 0")
    n, r, k = F.col("r.total"), F.col("r.size"), F.col("c.size")
    dof, smaller = (r - 1) * (k - 1), F.least(r, k) - 1
    # An empty cell adds its expected count; in a 2x2 table all four gaps are equal.
    empty = F.when(F.col("n_filled") == r * k, 0.0).otherwise(n - F.col("e_filled"))
    shrunk = F.col("gap") - F.least(F.lit(0.5), F.col("gap"))
    corrected = shrunk * shrunk * n * F.col("r.inverse") * F.col("c.inverse")
    chi2 = F.when(dof == 0, 0.0).when(dof == 1, corrected).otherwise(F.col("over_filled") + empty)
    out = sums.select(
        chi2.alias("chi2"), dof.cast("long").alias("dof"), smaller.alias("smaller"),
        (F.col("r.least") * F.col("c.least") / n).alias("min_expected"), n.cast("long").alias("n"),
    )
    return out.select(
        "chi2",
        "dof",
        chi2_sf("chi2", "dof").alias("p_value"),
        F.when(F.col("smaller") > 0, F.sqrt(F.col("chi2") / F.col("n") / F.col("smaller"))).alias("cramers_v"),
        "min_expected",
        "n",
    )


def average_rank(hist: DataFrame, group: Sequence[str], value: str, n: str = "n") -> DataFrame:
    """Adds ``avg_rank``: the mean rank of each value among all rows of its group."""
    cum = running_totals(hist, group, [value], {"__cum": n})
    return cum.withColumn("avg_rank", F.col("__cum") - F.col(n) + (F.col(n) + 1) / 2.0).drop("__cum")


def rank_sums(hist: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Per group ``n_a, n_b, u, ties``: arm sizes, U of arm a, and the sum of t^3 - t over ties."""
    ranked = average_rank(hist, group, value)
    t = F.col("n").cast("double")
    sums = ranked.groupBy(*group).agg(
        F.sum("n_a").alias("n_a"),
        F.sum("n_b").alias("n_b"),
        F.sum(F.col("n_a") * F.col("avg_rank")).alias("rank_sum"),
        F.sum(t * t * t - t).alias("ties"),
        F.max("n").alias("largest_tie"),
    )
    na = F.col("n_a").cast("double")
    return sums.withColumn("u", F.col("rank_sum") - na * (na + 1) / 2).drop("rank_sum")


def _rank_test(sums: DataFrame, group: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The test from ``n_a, n_b, u, ties, largest_tie``; ``sums`` is a written table of one row a group."""
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = na + nb
    sd = F.sqrt(na * nb / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(F.col("u") - na * nb / 2 - 0.5, sd)
    exact = (F.least("n_a", "n_b") <= 8) & (F.col("largest_tie") <= 1)
    tested = sums.withColumns({"z": F.when(sd > 0, z), "exact_applicable": exact})
    law = exact_rank_tails(tested.filter("exact_applicable and least(n_a, n_b) > 0").filter(na * nb <= EXACT_CELLS))
    joined = tested.join(law, ["n_a", "n_b", "u"], "left")
    p = F.when(F.col("exact_applicable") & F.col("exact_p").isNotNull(), F.col("exact_p")).otherwise(normal_sf("z"))
    return joined.select(*group, "n_a", "n_b", "u", "z", p.alias("p_value"), "exact_applicable", *keep)


def mann_whitney(hist: DataFrame, group: Sequence[str] = ("metric",), value: str = "value") -> DataFrame:
    """One-sided test that arm a is larger: ``n_a, n_b, u, z, p_value, exact_applicable``.

    The exact law of U for untied values with at most eight in one arm (``exact_applicable``) and a product of
    the sizes within ``EXACT_CELLS``; else the normal approximation with tie and continuity correction, which ``z`` is always of.
    """
    return _rank_test(cut_lineage(rank_sums(hist, group, value)), group)


def cliffs_delta(hist: DataFrame, group: Sequence[str] = ("metric",), value: str = "value") -> DataFrame:
    """P(a > b) - P(a < b) per group, from U."""
    sums = rank_sums(hist, group, value)
    delta = F.try_divide(2 * F.col("u"), F.col("n_a").cast("double") * F.col("n_b")) - 1
    return sums.select(*group, "n_a", "n_b", F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), delta).alias("cliffs_delta"))


def roc_auc(hist: DataFrame, group: Sequence[str] = ("metric",), value: str = "value") -> DataFrame:
    """Area under the ROC curve per group; arm a holds the positives, ties count half."""
    sums = rank_sums(hist, group, value)
    auc = F.col("u") / (F.col("n_a").cast("double") * F.col("n_b"))
    return sums.select(*group, "n_a", "n_b", F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), auc).alias("auc"))


def arm_moments(df: DataFrame, group: Sequence[str], value: str, arm: Column) -> DataFrame:
    """Count, mean and sample variance of both arms per group, in one pass."""
    x = F.col(value).cast("double")
    return df.groupBy(*group).agg(
        *[
            f(F.when(side, x)).alias(f"{name}_{tag}")
            for tag, side in (("a", arm), ("b", ~arm))
            for name, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))
        ]
    )


def cohens_d(df: DataFrame, group: Sequence[str], value: str, arm: Column) -> DataFrame:
    """Standardised mean difference with pooled sample SD; NaN when that is zero."""
    moments = arm_moments(df, group, value, arm)
    return moments.select(*group, "n_a", "n_b", _pooled("n_a", "mean_a", "var_a", "n_b", "mean_b", "var_b").alias("cohens_d"))


def _pooled(na: str, ma: str, va: str, nb: str, mb: str, vb: str) -> Column:
    na, ma, va, nb, mb, vb = (F.col(c) for c in (na, ma, va, nb, mb, vb))
    sd = F.sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))
    return F.when(sd == 0, F.lit(float("nan"))).otherwise((ma - mb) / sd)


def risk_table(df: DataFrame, time: str, event: Column, arm: Column, group: Sequence[str] = ()) -> DataFrame:
    """``time, d_a, d_b, at_risk_a, at_risk_b`` per distinct time; a subject leaving at t is at risk at t."""
    group = list(group)
    base = df.filter(F.col(time).isNotNull() & arm.isNotNull())
    if not group:
        base, group = base.withColumn("__all", F.lit(0)), ["__all"]
    hist = base.groupBy(*group, time).agg(
        F.count_if(arm).alias("x_a"), F.count_if(~arm).alias("x_b"), F.count_if(arm & event).alias("d_a"), F.count_if(~arm & event).alias("d_b")
    )
    left = running_totals(hist, group, [time], {"at_risk_a": "x_a", "at_risk_b": "x_b"}, descending=True)
    return left.drop("x_a", "x_b", "__all")


def logrank_test(df: DataFrame, time: str, event: Column, arm: Column, group: Sequence[str] = ()) -> DataFrame:
    """Two-arm log-rank test: ``statistic, z, v, p_value`` with one degree of freedom."""
    risk = risk_table(df, time, event, arm, group)
    na, nb = F.col("at_risk_a").cast("double"), F.col("at_risk_b").cast("double")
    n, d = na + nb, (F.col("d_a") + F.col("d_b")).cast("double")
    v = F.when(n > 1, d * na * nb * (n - d) / (n * n * (n - 1))).otherwise(0.0)
    out = risk.groupBy(*group).agg(F.sum(F.col("d_a") - d * na / n).alias("z"), F.sum(v).alias("v"))
    out = out.withColumn("statistic", F.when(F.col("v") > 0, F.col("z") * F.col("z") / F.col("v")))
    return out.withColumn("p_value", chi2_sf("statistic", F.lit(1)))


def arm_profile(hist: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Per group, from one ordered pass over a histogram: ``n, median, mean, var`` of both arms, and ``u, ties, largest_tie``."""
    x, sides = F.col(value), ("a", "b")
    totals = hist.groupBy(*group).agg(*[F.sum(f"n_{s}").alias(f"__n_{s}") for s in sides], *[F.sum(F.col(f"n_{s}") * x).alias(f"__x_{s}") for s in sides])
    cum = running_totals(hist, group, [value], {"__c": "n", "__c_a": "n_a", "__c_b": "n_b"})
    # One row a group: small beside the histogram, and left to Spark's own size check.
    placed = join_null_safe(cum, totals, group)
    mean = {s: F.try_divide(F.col(f"__x_{s}"), F.col(f"__n_{s}")) for s in sides}
    reach = lambda s, k: F.min(F.when((F.col(f"__c_{s}") >= k) & (F.col(f"n_{s}") > 0), x))
    t = F.col("n").cast("double")
    out = placed.groupBy(*group).agg(
        *[F.any_value(f"__n_{s}").alias(f"n_{s}") for s in sides],
        *[((reach(s, F.floor((F.col(f"__n_{s}") + 1) / 2)) + reach(s, F.floor(F.col(f"__n_{s}") / 2) + 1)) / 2).alias(f"median_{s}") for s in sides],
        *[F.any_value(mean[s]).alias(f"mean_{s}") for s in sides],
        *[F.sum(F.col(f"n_{s}") * (x - mean[s]) * (x - mean[s])).alias(f"__q_{s}") for s in sides],
        F.sum(F.col("n_a") * (F.col("__c") - F.col("n") + (F.col("n") + 1) / 2.0)).alias("__rank_sum"),
        F.sum(t * t * t - t).alias("ties"),
        F.max("n").alias("largest_tie"),
    )
    na = F.col("n_a").cast("double")
    var = [F.when(F.col(f"n_{s}") > 1, F.col(f"__q_{s}") / (F.col(f"n_{s}") - 1)).alias(f"var_{s}") for s in sides]
    return out.select(*group, "n_a", "n_b", "median_a", "median_b", "mean_a", "mean_b", *var, (F.col("__rank_sum") - na * (na + 1) / 2).alias("u"), "ties", "largest_tie")


def metric_profiles(df: DataFrame, metrics: Sequence[str], arm: Column) -> DataFrame:
    """``arm_profile`` of many metrics, a row for each that has values; written, as it is read more than once."""
    typed = df.select(arm.alias("__arm"), *[F.col(m).cast("double").alias(m) for m in metrics])
    hist = value_histogram(long_form(typed, ["__arm"], metrics), ["metric"], "value", F.col("__arm"))
    return cut_lineage(arm_profile(cut_lineage(hist), ["metric"], "value"))


def compare_profiles(profiles: DataFrame, min_rows: int = 2) -> DataFrame:
    """Rank test, medians, means and Cohen's d from ``metric_profiles``; metrics with an arm of fewer than ``min_rows`` are skipped."""
    d = _pooled("n_a", "mean_a", "var_a", "n_b", "mean_b", "var_b")
    few = profiles.filter(F.least("n_a", "n_b") >= min_rows).withColumn("cohens_d", d)
    tested = _rank_test(few, ["metric"], ["median_a", "median_b", "mean_a", "mean_b", "cohens_d"])
    return tested.select("metric", "n_a", "n_b", "median_a", "median_b", "mean_a", "mean_b", "u", "z", "p_value", "exact_applicable", "cohens_d")


def compare_groups(df: DataFrame, metrics: Sequence[str], arm: Column, min_rows: int = 2) -> DataFrame:
    """Rank test, medians, means and Cohen's d for many metrics at once, one row per metric.

    Nulls are left out per metric; metrics with an arm of fewer than ``min_rows`` are skipped.
    """
    return compare_profiles(metric_profiles(df, metrics, arm), min_rows)


def rater_pairs(
    df: DataFrame, instance: Sequence[str], rater: str, label: str, order_of_labels: Sequence[str] = GRADES, by: Sequence[str] = ()
) -> DataFrame:
    """How often two different raters of one instance gave ranks ``(a, b)``: ``by, a, b, n``.

    Each unordered pair counts once in both orders. Pairs are counted, never formed: an instance
    with c_a and c_b votes has c_a * c_b ordered pairs, minus those of one rater with itself. Votes
    are dealt by instance and rater into ``VOTE_TASKS`` parts that are not merged again, so that the
    groups of a task stay a small share of all; sums are held for a <= b only. The votes of one rater on
    one instance meet in one task, which only counts them.
    """
    k = len(order_of_labels)
    group = [*instance, *[b for b in by if b not in instance]]
    ranked = df.select(*group, rater, ordinal_rank(label, order_of_labels).alias("__rank"))
    ranked = ranked.filter(F.col("__rank").isNotNull() & F.col(rater).isNotNull()).repartition(VOTE_TASKS, *group, rater)
    per_rater = ranked.groupBy(*group, rater).agg(*[F.count_if(F.col("__rank") == i).alias(f"c{i}") for i in range(k)])
    half = [(i, j) for i in range(k) for j in range(i, k)]
    product = lambda x, i, j: F.col(f"{x}{i}") * F.col(f"{x}{j}")
    per_instance = per_rater.groupBy(*group).agg(
        *[F.sum(f"c{i}").alias(f"t{i}") for i in range(k)], *[F.sum(product("c", i, j)).alias(f"s{i}_{j}") for i, j in half]
    )
    totals = per_instance.groupBy(*by).agg(
        *[F.sum(product("t", i, j) - F.col(f"s{i}_{j}")).alias(f"p{i}_{j}") for i, j in half]
    )
    pairs = lambda i, j: F.col(f"p{min(i, j)}_{max(i, j)}")
    cells = F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), pairs(i, j).alias("n")) for i in range(k) for j in range(k)])
    return totals.select(*by, F.explode(cells).alias("cell")).select(*by, "cell.a", "cell.b", "cell.n")


def weighted_kappa(
    df: DataFrame, instance: Sequence[str], rater: str, label: str, order_of_labels: Sequence[str] = GRADES, by: Sequence[str] = ()
) -> DataFrame:
    """Quadratic-weighted kappa, exact and within-one agreement (%) and the number of pairs, per ``by``.

    Since the pair table is symmetric both marginals agree, and the expected disagreement needs
    only their first two moments.
    """
    pairs = rater_pairs(df, instance, rater, label, order_of_labels, by)
    n, gap = F.col("n").cast("double"), F.col("a") - F.col("b")
    sums = pairs.groupBy(*by).agg(
        F.sum("n").alias("ordered"),
        F.sum(n * gap * gap).alias("wo"),
        F.sum(n * F.col("a")).alias("m1"),
        F.sum(n * F.col("a") * F.col("a")).alias("m2"),
        F.sum(F.when(gap == 0, n)).alias("same"),
        F.sum(F.when(F.abs(gap) <= 1, n)).alias("near"),
    ).filter("ordered > 0")
    total = F.col("ordered").cast("double")
    expected = 2 * (F.col("m2") - F.col("m1") * F.col("m1") / total)
    return sums.select(
        *by,
        F.when(expected > 0, 1 - F.col("wo") / expected).alias("kappa"),
        (100 * F.col("same") / total).alias("exact_pct"),
        (100 * F.col("near") / total).alias("within_one_pct"),
        F.floor(F.col("ordered") / 2).cast("long").alias("n_pairs"),
    )


def cooccurrence_group(
    df: DataFrame,
    index: str,
    smell: str,
    grade: str,
    pair: tuple[str, str] = ("blob", "data class"),
    absent: str = "none",
    missing_is_present: bool = True,
) -> DataFrame:
    """``index, group``: both, one or neither of two smells present. A smell never rated counts as present by default."""
    wide = pivot_labels(df, index, smell, grade, pair)
    a, b = (
        ~F.col(f"`{p}`").eqNullSafe(F.lit(absent)) if missing_is_present else F.coalesce(F.col(f"`{p}`") != absent, F.lit(False))
        for p in pair
    )
    group = case_recode([(a & b, "co_occurring"), (a | b, "isolated")], "neither")
    return wide.select(index, *[F.col(f"`{p}`") for p in pair], group.alias("group"))


def inner_on_sample(groups: DataFrame, per_sample: DataFrame, key: str = "sample_id") -> DataFrame:
    return groups.join(per_sample, key, "inner")

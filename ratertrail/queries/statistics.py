"""Queries on group comparisons, tail probabilities included: their series are written out in SQL as well."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratertrail.functions import scalar as S
from ratertrail.operators import evaluation as E
from ratertrail.operators import stats, summaries
from ratertrail.plans import hypotheses as H
from ratertrail.queries import views as V
from ratertrail.queries.registry import query
from ratertrail.queries.views import sql


def rounded(df, **digits):
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


# Tail probabilities as macros would have them: the series of the error function below 2.5, its continued fraction above.
def _erfc_sql(x: str) -> str:
    a, t = f"abs({x})", f"({x}) ** 2"
    small = f"1 - 2 / sqrt(pi()) * {a} * exp(-({t})) * list_reduce(range(80, 0, -1), lambda f, n: 1 + 2 * {t} / (2 * n + 1) * f, 1.0::double)"
    large = f"exp(-({t})) / sqrt(pi()) / ({a} + list_reduce(range(80, 0, -1), lambda f, n: n / 2.0::double / ({a} + f), 0.0::double))"
    return f"(case when {a} < 2.5 then {small} else {large} end)"


def normal_sf_sql(z: str) -> str:
    e = _erfc_sql(f"({z}) / sqrt(2.0::double)")
    return f"(0.5::double * case when ({z}) < 0 then 2 - {e} else {e} end)"


def chi2_sf_sql(x: str, dof: str) -> str:
    h, m, shift = f"(({x}) / 2)", f"(({dof}) // 2)", f"(case when ({dof}) % 2 = 1 then 0.5 else 0 end)"
    inner = f"(case when {m} > 0 then list_reduce(range({m} - 1, 0, -1), lambda f, n: 1 + {h} / (n + {shift}) * f, 1.0::double) else 0 end)"
    odd = f"{_erfc_sql(f'sqrt({h})')} + exp(-{h}) * sqrt({h}) / gamma(1.5) * {inner}"
    return f"(case when ({dof}) <= 0 or ({x}) <= 0 then 1 when ({dof}) % 2 = 1 then {odd} else exp(-{h}) * {inner} end)"


def _chi_sql(cells: str, n_cols: str = "") -> str:
    """Chi-square of a long table ``cells`` of a, b, o."""
    return f"""
  c as (select a, b, cast(o as double) as o from ({cells})),
  r as (select a, sum(o) as nr from c group by a), k as (select b, sum(o) as nc from c group by b), t as (select sum(o) as n from c),
  e as (select coalesce(o, 0) as o, nr * nc / n as e from r cross join k cross join t left join c on c.a = r.a and c.b = k.b),
  x as (select sum((o - e) * (o - e) / e) as chi2, sum((abs(o - e) - least(0.5, abs(o - e))) * (abs(o - e) - least(0.5, abs(o - e))) / e) as yates, min(e) as min_expected from e),
  d as (select (select count(*) from r) as nr, (select count(*) from k) as nk),
  chi as (select case when (nr - 1) * (nk - 1) = 1 then yates else chi2 end as chi2, (nr - 1) * (nk - 1) as dof, least(nr, nk) - 1 as s, min_expected, cast(n as bigint) as n from x, d, t)"""


def _with(prefix: str, ctes: str, body: str) -> str:
    """Append further views to a ``with`` query that ends in ``select 1``."""
    assert prefix.endswith("select 1")
    return prefix[: -len("select 1")].rstrip() + "," + ctes + "\n" + body


_CHI_OUT = f"select round(chi2, 6) as chi2, dof, round({chi2_sf_sql('chi2', 'dof')}, 9) as p_value, round(sqrt(chi2 / n / s), 6) as cramers_v, round(min_expected, 6) as min_expected, n from chi"


@query("chi_square_test", _with(sql("select 1", "consensus"), _chi_sql("select severity_consensus as a, smell as b, count(*) as o from consensus group by 1, 2"), _CHI_OUT))
def _(spark, sf):
    out = stats.chi_square_test(V.consensus(spark, sf), "severity_consensus", "smell")
    return rounded(out, chi2=6, p_value=9, cramers_v=6, min_expected=6)


@query("chi_square_two_by_two", _with(sql("select 1", "consensus"), _chi_sql("select severity_tied as a, smell = 'blob' as b, count(*) as o from consensus group by 1, 2"), _CHI_OUT))
def _(spark, sf):
    df = V.consensus(spark, sf).withColumn("is_blob", F.col("smell") == "blob")
    return rounded(stats.chi_square_test(df, "severity_tied", "is_blob"), chi2=6, p_value=9, cramers_v=6, min_expected=6)


# Arms: lineitem by return flag, the price as a continuous metric and the quantity as a tied one.
_ARMS = """select 'price' as metric, l_extendedprice as value, l_returnflag = 'R' as arm from lineitem union all select 'quantity', l_quantity, l_returnflag = 'R' from lineitem
  union all select 'discount', l_discount, l_returnflag = 'R' from lineitem"""


def _arms(spark, sf):
    li = V.table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").alias("arm"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    return summaries.long_form(li, ["arm"], ["price", "quantity", "discount"])


_Z = "(u - n_a * n_b / 2.0::double - 0.5) / sqrt(n_a::double * n_b / 12 * ((n_a + n_b + 1) - ties / ((n_a + n_b)::double * (n_a + n_b - 1))))"
_RANKED = f"""ranked as (select metric, arm, value, rank() over (partition by metric order by value) + (count(*) over (partition by metric, value) - 1) / 2.0::double as rk,
  count(*) over (partition by metric, value) as t from ({_ARMS})),
  u as (select metric, count(*) filter (where arm) as n_a, count(*) filter (where not arm) as n_b, sum(rk) filter (where arm) - (count(*) filter (where arm))::double * ((count(*) filter (where arm)) + 1) / 2 as u,
    sum(t::double * t - 1) as ties, max(t) as largest from ranked group by 1)"""


@query("mann_whitney", f"""with {_RANKED} select metric, n_a, n_b, round(u, 2) as u, round({_Z}, 6) as z, round({normal_sf_sql(_Z)}, 9) as p_value,
  least(n_a, n_b) <= 8 and largest <= 1 as exact_applicable from u""")
def _(spark, sf):
    out = stats.mann_whitney(summaries.value_histogram(_arms(spark, sf), ["metric"], "value", F.col("arm")))
    return rounded(out, u=2, z=6, p_value=9)


# Suppliers of a nation by their balance, hardly ever tied: arms of a few rows each, whose law is counted out by a
# recurrence over the ranks (how many ways to take j of the first k ranks with a given sum).
_FEW = """few as (select s_nationkey as metric, s_acctbal as value, s_suppkey % 3 = 0 as arm from supplier), placed as (select *, rank() over (partition by metric order by value) as rk, count(*) over (partition by metric, value) as t from few),
  u as (select metric, count(*) filter (where arm) as n_a, count(*) filter (where not arm) as n_b, coalesce(sum(rk) filter (where arm), 0) - (count(*) filter (where arm)) * ((count(*) filter (where arm)) + 1) / 2 as u, max(t) as largest from placed group by 1),
  small as (select * from u where least(n_a, n_b) between 1 and 8 and largest <= 1 and n_a + n_b <= 48),
  dp(k, j, s, c) as (select 0::bigint, 0::bigint, 0::bigint, 1::hugeint union all select k + 1, j + x, s + x * (k + 1), cast(sum(c) as hugeint) from dp cross join (values (0::bigint), (1::bigint)) t(x) where k < 48 and j + x <= 8 group by all),
  law as (select small.metric, sum(c) filter (where s >= taken) / sum(c)::double as above, sum(c) filter (where s <= taken) / sum(c)::double as below, n_a <= 8 as direct
    from (select *, least(n_a, n_b) as m, case when n_a <= 8 then u else n_a * n_b - u end + least(n_a, n_b) * (least(n_a, n_b) + 1) / 2 as taken from small) small join dp on k = n_a + n_b and j = m group by all)"""


@query("mann_whitney_exact", f"""with recursive {_FEW} select metric, n_a, n_b, cast(u as double) as u, round(case when direct then above else below end, 9) as p_value from small join law using (metric)""")
def _(spark, sf):
    """Rank tests of small arms without ties, by the exact law."""
    df = V.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("metric"), F.col("s_acctbal").alias("value"), (F.col("s_suppkey") % 3 == 0).alias("arm"))
    out = stats.mann_whitney(summaries.value_histogram(df, ["metric"], "value", F.col("arm")))
    return rounded(out.filter("exact_applicable and least(n_a, n_b) > 0 and n_a + n_b <= 48").select("metric", "n_a", "n_b", "u", "p_value"), p_value=9)


@query("cliffs_delta", f"with {_RANKED} select metric, n_a, n_b, round(2 * u / (n_a::double * n_b) - 1, 9) as cliffs_delta from u")
def _(spark, sf):
    return rounded(stats.cliffs_delta(summaries.value_histogram(_arms(spark, sf), ["metric"], "value", F.col("arm"))), cliffs_delta=9)


@query("roc_auc", f"with {_RANKED} select metric, n_a, n_b, round(u / (n_a::double * n_b), 9) as auc from u")
def _(spark, sf):
    return rounded(stats.roc_auc(summaries.value_histogram(_arms(spark, sf), ["metric"], "value", F.col("arm"))), auc=9)


@query("average_rank", f"with {_RANKED} select distinct metric, value, rk as avg_rank, t as n from ranked")
def _(spark, sf):
    hist = summaries.value_histogram(_arms(spark, sf), ["metric"], "value")
    return stats.average_rank(hist, ["metric"], "value").select("metric", "value", "avg_rank", "n")


_D_SQL = """(avg(value) filter (where arm) - avg(value) filter (where not arm)) / sqrt(((count(*) filter (where arm) - 1) * var_samp(value) filter (where arm)
  + (count(*) filter (where not arm) - 1) * var_samp(value) filter (where not arm)) / (count(*) - 2))"""


@query("cohens_d", f"select metric, count(*) filter (where arm) as n_a, count(*) filter (where not arm) as n_b, round({_D_SQL}, 9) as cohens_d from ({_ARMS}) group by 1")
def _(spark, sf):
    return rounded(stats.cohens_d(_arms(spark, sf), ["metric"], "value", F.col("arm")), cohens_d=9)


@query("compare_groups", f"""with {_RANKED}, v as (select metric, round({_D_SQL}, 8) as cohens_d, round(avg(value) filter (where arm), 6) as mean_a, round(avg(value) filter (where not arm), 6) as mean_b,
    round(quantile_cont(value, 0.5) filter (where arm), 6) as median_a, round(quantile_cont(value, 0.5) filter (where not arm), 6) as median_b from ({_ARMS}) group by 1)
  select metric, n_a, n_b, median_a, median_b, mean_a, mean_b, round(u, 2) as u, round({_Z}, 6) as z, round({normal_sf_sql(_Z)}, 9) as p_value,
    least(n_a, n_b) <= 8 and largest <= 1 as exact_applicable, cohens_d from u join v using (metric)""")
def _(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    out = stats.compare_groups(li, ["price", "quantity", "discount"], F.col("l_returnflag") == "R")
    return rounded(out, u=2, z=6, p_value=9, cohens_d=8, mean_a=6, mean_b=6, median_a=6, median_b=6)


# --- survival -------------------------------------------------------------------------------

_TIMES = "t as (select persistence_revisions as t, severity_consensus in ('major', 'critical') as arm, not censored as event from survivals)"
_RISK = f"""{_TIMES}, times as (select t, count(*) filter (where arm and event) as d_a, count(*) filter (where not arm and event) as d_b, count(*) filter (where arm) as x_a, count(*) filter (where not arm) as x_b from t group by t),
  risk as (select t, d_a, d_b, cast(sum(x_a) over (order by t desc) as bigint) as at_risk_a, cast(sum(x_b) over (order by t desc) as bigint) as at_risk_b from times)"""
_LOGRANK = """select sum(d_a - d * na / n) as z, sum(case when n > 1 then d * na * nb * (n - d) / (n * n * (n - 1)) else 0 end) as v
  from (select *, (d_a + d_b)::double as d, at_risk_a::double as na, at_risk_b::double as nb, (at_risk_a + at_risk_b)::double as n from risk)"""


def _survivals(spark, sf):
    return V.persistence(spark, sf).filter("failure_reason is null")


@query("risk_table", _with(sql("select 1", "survivals"), _RISK, "select t as persistence_revisions, d_a, d_b, at_risk_a, at_risk_b from risk"))
def _(spark, sf):
    return stats.risk_table(_survivals(spark, sf), "persistence_revisions", ~F.col("censored"), F.col("severity_consensus").isin(*S.SEVERE_GRADES))


@query("logrank_test", _with(sql("select 1", "survivals"), _RISK, f"select round(z, 6) as z, round(v, 6) as v, round(z * z / v, 6) as statistic, round({chi2_sf_sql('(z * z / v)', '1')}, 9) as p_value from ({_LOGRANK})"))
def _(spark, sf):
    out = stats.logrank_test(_survivals(spark, sf), "persistence_revisions", ~F.col("censored"), F.col("severity_consensus").isin(*S.SEVERE_GRADES))
    return rounded(out, z=6, v=6, statistic=6, p_value=9)


# --- agreement ------------------------------------------------------------------------------

_PAIRS = """pairs as (select a.smell, ga.rank as ra, gb.rank as rb from kept a join kept b on a.sample_id = b.sample_id and a.smell = b.smell and a.reviewer_id < b.reviewer_id
  join grades ga on ga.severity = a.severity join grades gb on gb.severity = b.severity),
  both_ways as (select smell, ra as a, rb as b from pairs union all select smell, rb, ra from pairs)"""
_KAPPA = """with h as (select {by} a, b, count(*)::double as n from both_ways group by all), m as (select {by} a, sum(n) as na from h group by all), t as (select {by} sum(n) as nn from h {group}),
  o as (select {by} sum(n * (a - b) * (a - b)) as wo, 100 * sum(n) filter (where a = b) / sum(n) as exact_pct, 100 * sum(n) filter (where abs(a - b) <= 1) / sum(n) as within_one_pct from h {group}),
  e as (select {m1} sum(m1.na * m2.na / t.nn * (m1.a - m2.a) * (m1.a - m2.a)) as we, any_value(t.nn) as nn from m m1 join m m2 on {on} join t on {ont} {mgroup})
  select {o} round(1 - wo / we, 9) as kappa, round(exact_pct, 9) as exact_pct, round(within_one_pct, 9) as within_one_pct, cast(nn / 2 as bigint) as n_pairs from o join e on {oe}"""
_KAPPA_ALL = _KAPPA.format(by="", group="", m1="", on="true", ont="true", mgroup="", o="", oe="true")
_KAPPA_BY = _KAPPA.format(by="smell,", group="group by smell", m1="m1.smell,", on="m1.smell = m2.smell", ont="t.smell = m1.smell", mgroup="group by m1.smell", o="o.smell,", oe="o.smell = e.smell")


@query("rater_pairs", _with(sql("select 1", "kept", "grades"), _PAIRS, """select smell, cast(x.a as bigint) as a, cast(y.b as bigint) as b, count(p.a) as n from (select distinct smell from kept) s
  cross join range(4) x(a) cross join range(4) y(b) left join both_ways p using (smell, a, b) group by 1, 2, 3"""))
def _(spark, sf):
    out = stats.rater_pairs(V.kept(spark, sf), ["sample_id", "smell"], "reviewer_id", "severity", by=["smell"])
    return out.withColumns({"a": F.col("a").cast("long"), "b": F.col("b").cast("long")})


@query("weighted_kappa", _with(sql("select 1", "kept", "grades"), _PAIRS, f"select * from ({_KAPPA_BY})"))
def _(spark, sf):
    out = stats.weighted_kappa(V.kept(spark, sf), ["sample_id", "smell"], "reviewer_id", "severity", by=["smell"])
    return rounded(out, kappa=9, exact_pct=9, within_one_pct=9)


@query("weighted_kappa_overall", _with(sql("select 1", "kept", "grades"), _PAIRS, f"select * from ({_KAPPA_ALL})"))
def _(spark, sf):
    out = stats.weighted_kappa(V.kept(spark, sf), ["sample_id", "smell"], "reviewer_id", "severity")
    return rounded(out, kappa=9, exact_pct=9, within_one_pct=9)


# --- co-occurrence and the three hypotheses -------------------------------------------------

_WIDE = """wide as (select sample_id, max(severity_consensus) filter (where smell = 'blob') as blob, max(severity_consensus) filter (where smell = 'data class') as dc from instances where type = 'class' group by 1),
  grouped as (select *, case when blob is distinct from 'none' and dc is distinct from 'none' then 'co_occurring' when blob is distinct from 'none' or dc is distinct from 'none' then 'isolated' else 'neither' end as "group" from wide)"""


@query("cooccurrence_group", _with(sql("select 1", "instances"), _WIDE, """select sample_id, "group" from grouped"""))
def _(spark, sf):
    df = V.instances(spark, sf).filter("type = 'class'")
    return stats.cooccurrence_group(df, "sample_id", "smell", "severity_consensus").select("sample_id", "group")


@query("inner_on_sample", _with(sql("select 1", "instances", "complexity"), _WIDE, """select g.sample_id, "group", m.wmc, m.loc from grouped g join
  (select sample_id, avg(wmc) as wmc, avg(loc) as loc from complexity where smell in ('blob', 'data class') group by 1) m on m.sample_id = g.sample_id"""))
def _(spark, sf):
    groups = stats.cooccurrence_group(V.instances(spark, sf).filter("type = 'class'"), "sample_id", "smell", "severity_consensus").select("sample_id", "group")
    per_sample = summaries.mean_per_sample(V.complexity(spark, sf).filter(F.col("smell").isin(*S.CLASS_SMELLS)), "sample_id", ["wmc", "loc"])
    return stats.inner_on_sample(groups, per_sample)


_RELEVANCE = "select severity_consensus as a, case when is_from_industry_relevant_project_raw = '1' then 'relevant' else 'other' end as b, count(*) as o from instances group by 1, 2"


@query("relevance_vs_severity", _with(sql("select 1", "instances"), _chi_sql(_RELEVANCE), f"""select round(chi2, 6) as chi2, dof, round({chi2_sf_sql('chi2', 'dof')}, 9) as p_value, round(sqrt(chi2 / n / s), 6) as cramers_v, round(min_expected, 6) as min_expected, n,
  round((select 100 * avg(case when severity_consensus in ('major', 'critical') then 1.0::double else 0 end) from instances where is_from_industry_relevant_project_raw = '1'), 6) as pct_severe_relevant,
  round((select 100 * avg(case when severity_consensus in ('major', 'critical') then 1.0::double else 0 end) from instances where is_from_industry_relevant_project_raw <> '1'), 6) as pct_severe_other from chi"""))
def _(spark, sf):
    out = H.relevance_vs_severity(V.instances(spark, sf))
    return rounded(out, chi2=6, p_value=9, cramers_v=6, min_expected=6, pct_severe_relevant=6, pct_severe_other=6)


@query("relevance_breakdown", sql("""select rank, severity_consensus, count(*) filter (where is_from_industry_relevant_project_raw = '0') as f0, count(*) filter (where is_from_industry_relevant_project_raw = '0,5') as f05,
  count(*) filter (where is_from_industry_relevant_project_raw = '1') as f1 from instances join grades on severity = severity_consensus group by 1, 2""", "instances", "grades"))
def _(spark, sf):
    return H.relevance_breakdown(V.instances(spark, sf)).toDF("severity_consensus", "rank", "f0", "f05", "f1")


_H2 = f"""{_RISK}, ranked as (select t as value, arm, rank() over (order by t) + (count(*) over (partition by t) - 1) / 2.0::double as rk, count(*) over (partition by t) as n from t),
  u as (select count(*) filter (where arm) as n_a, count(*) filter (where not arm) as n_b, sum(rk) filter (where arm) - (count(*) filter (where arm))::double * ((count(*) filter (where arm)) + 1) / 2 as u,
    sum(n::double * n - 1) as ties, max(n) as largest, {_D_SQL} as d, avg(value) filter (where arm) as ma, avg(value) filter (where not arm) as mb,
    quantile_cont(value::double, 0.5) filter (where arm) as qa, quantile_cont(value::double, 0.5) filter (where not arm) as qb from ranked)"""


@query("severity_vs_persistence", _with(sql("select 1", "survivals"), _H2, f"""select n_a + n_b as n, (select count(*) from t where not event) as n_censored,
  round(100.0::double * (select count(*) from t where not event) / (n_a + n_b), 6) as pct_censored, n_a, n_b, round(qa, 6) as median_a, round(qb, 6) as median_b, round(ma, 6) as mean_a, round(mb, 6) as mean_b,
  round(u, 2) as u, round({_Z}, 6) as z, round({normal_sf_sql(_Z)}, 9) as p_value,
  least(n_a, n_b) <= 8 and largest <= 1 as exact_applicable, round(d, 6) as cohens_d, round(2 * u / (n_a::double * n_b) - 1, 6) as cliffs_delta, round((select z * z / v from ({_LOGRANK})), 6) as logrank_statistic,
  round((select {chi2_sf_sql('(z * z / v)', '1')} from ({_LOGRANK})), 9) as logrank_p_value from u"""))
def _(spark, sf):
    persistence = _survivals(spark, sf)
    labels = V.revisions(spark, sf).filter("event_type = 'signup'")
    out = H.severity_vs_persistence(labels, persistence, key="event_id")
    return rounded(out, p_value=9, logrank_p_value=9, pct_censored=6, median_a=6, median_b=6, mean_a=6, mean_b=6, u=2, z=6, cohens_d=6, cliffs_delta=6, logrank_statistic=6)


@query("persistence_by_grade", sql("""select rank, severity_consensus, count(*) as count, round(quantile_cont(persistence_revisions::double, 0.5), 6) as median, round(avg(persistence_revisions), 6) as mean,
  round(stddev_samp(persistence_revisions), 6) as std from survivals join grades on severity = severity_consensus group by 1, 2""", "survivals", "grades"))
def _(spark, sf):
    return rounded(H.persistence_by_grade(_survivals(spark, sf)), median=6, mean=6, std=6)


_METRIC_UNPIVOT = " union all ".join(f"select '{m}' as metric, {m} as value, \"group\" = 'co_occurring' as arm from joined" for m in H.CLASS_METRICS)


@query("cooccurrence_vs_metrics", _with(sql("select 1", "instances", "complexity"), _WIDE + f""",
  joined as (select "group", m.* from grouped g join (select sample_id, {', '.join(f'avg({m}) as {m}' for m in H.CLASS_METRICS)} from complexity where smell in ('blob', 'data class') group by 1) m
    on m.sample_id = g.sample_id where "group" <> 'neither'), arms as ({_METRIC_UNPIVOT}),
  ranked as (select *, rank() over (partition by metric order by value) + (count(*) over (partition by metric, value) - 1) / 2.0::double as rk, count(*) over (partition by metric, value) as t from arms),
  u as (select metric, count(*) filter (where arm) as n_a, count(*) filter (where not arm) as n_b, sum(rk) filter (where arm) - (count(*) filter (where arm))::double * ((count(*) filter (where arm)) + 1) / 2 as u,
    sum(t::double * t - 1) as ties, {_D_SQL} as d, avg(value) filter (where arm) as ma, avg(value) filter (where not arm) as mb, quantile_cont(value, 0.5) filter (where arm) as qa, quantile_cont(value, 0.5) filter (where not arm) as qb
    from ranked group by 1)""", f"""select metric, n_a, n_b, round(qa, 6) as median_a, round(qb, 6) as median_b, round(ma, 6) as mean_a, round(mb, 6) as mean_b, round(u, 2) as u,
  round({_Z}, 6) as z, round({normal_sf_sql(_Z)}, 9) as p_value, round(d, 6) as cohens_d from u"""))
def _(spark, sf):
    out = H.cooccurrence_vs_metrics(V.instances(spark, sf), V.complexity(spark, sf)).drop("exact_applicable")
    return rounded(out, p_value=9, median_a=6, median_b=6, mean_a=6, mean_b=6, u=2, z=6, cohens_d=6)


# --- evaluation of given predictions --------------------------------------------------------

_GRID = "grid as (select a.severity as truth, b.severity as predicted from grades a cross join grades b)"
_MATRIX = f"{_GRID}, matrix as (select g.truth, g.predicted, count(p.truth) as n from grid g left join predictions p using (truth, predicted) group by 1, 2)"
_CLASS = """per_class as (select severity as label, sum(n) filter (where truth = severity)::double as actual, sum(n) filter (where predicted = severity)::double as called,
  sum(n) filter (where truth = severity and predicted = severity)::double as tp from matrix cross join grades group by 1),
  scored as (select label, case when called > 0 then tp / called else 0 end as precision, case when actual > 0 then tp / actual else 0 end as recall, case when actual + called > 0 then 2 * tp / (actual + called) else 0 end as f1, actual, tp from per_class)"""


def _matrix(spark, sf):
    return E.confusion_matrix(V.predictions(spark, sf), "truth", "predicted", S.GRADES)


@query("confusion_matrix", _with(sql("select 1", "predictions", "grades"), _MATRIX, "select * from matrix"))
def _(spark, sf):
    return _matrix(spark, sf)


@query("confusion_array", _with(sql("select 1", "predictions", "grades"), _MATRIX, """select array_to_string(list(array_to_string(cells, ',') order by rank), ';') as cells from
  (select truth, list(n order by b.rank) as cells from matrix join grades b on b.severity = predicted group by 1) join grades on severity = truth"""))
def _(spark, sf):
    rows = E.confusion_array(_matrix(spark, sf), "truth", "predicted", S.GRADES)
    return rows.select(F.array_join(F.transform("confusion_matrix", lambda r: F.array_join(r.cast("array<string>"), ",")), ";").alias("cells"))


@query("per_class_scores", _with(sql("select 1", "predictions", "grades"), f"{_MATRIX}, {_CLASS}", "select label, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1, cast(actual as bigint) as support from scored"))
def _(spark, sf):
    return rounded(E.per_class_scores(_matrix(spark, sf), "truth", "predicted"), precision=9, recall=9, f1=9)


@query("classification_metrics", _with(sql("select 1", "predictions", "grades"), f"{_MATRIX}, {_CLASS}", "select round(sum(tp) / sum(actual), 9) as accuracy, round(avg(precision), 9) as precision_macro, round(avg(recall), 9) as recall_macro, round(avg(f1), 9) as f1_macro from scored"))
def _(spark, sf):
    out = E.classification_metrics(_matrix(spark, sf), "truth", "predicted")
    return rounded(out, accuracy=9, precision_macro=9, recall_macro=9, f1_macro=9)


_SCORES = "scores as (" + " union all ".join(f"select '{g}' as label, score_{g} as score, truth = '{g}' as hit from predictions" for g in S.GRADES) + ")"
_AUC = """auc as (select label, count(*) filter (where hit) as n_a, count(*) filter (where not hit) as n_b, (sum(rk) filter (where hit) - (count(*) filter (where hit))::double * ((count(*) filter (where hit)) + 1) / 2)
  / ((count(*) filter (where hit))::double * (count(*) filter (where not hit))) as auc from (select *, rank() over (partition by label order by score) + (count(*) over (partition by label, score) - 1) / 2.0::double as rk from scores) group by 1)"""
_SCORE_COLS = {g: f"score_{g}" for g in S.GRADES}


@query("roc_by_class", _with(sql("select 1", "predictions"), f"{_SCORES}, {_AUC}", "select label, n_a, n_b, round(auc, 9) as auc from auc"))
def _(spark, sf):
    return rounded(E.roc_by_class(V.predictions(spark, sf), "truth", _SCORE_COLS), auc=9)


@query("macro_auc", _with(sql("select 1", "predictions"), f"{_SCORES}, {_AUC}", "select round(avg(auc), 9) as auc from auc"))
def _(spark, sf):
    return rounded(E.macro_auc(V.predictions(spark, sf), "truth", _SCORE_COLS), auc=9)


@query("roc_curve", _with(sql("select 1", "predictions"), _SCORES, """select label, score as threshold, round(sum(fp) over w / sum(fp) over (partition by label), 9) as fpr, round(sum(tp) over w / sum(tp) over (partition by label), 9) as tpr
  from (select label, score, (count(*) filter (where hit))::double as tp, (count(*) filter (where not hit))::double as fp from scores group by 1, 2) window w as (partition by label order by score desc)
  union all select distinct label, null, 0, 0 from scores"""))
def _(spark, sf):
    hist = E.score_histogram(V.predictions(spark, sf), "truth", _SCORE_COLS)
    return rounded(E.roc_curve(hist), fpr=9, tpr=9)


@query("error_direction", _with(sql("select 1", "predictions", "grades"), f"{_MATRIX}, errors as (select m.*, b.rank - a.rank as step, a.rank as i, b.rank as j from matrix m join grades a on a.severity = truth join grades b on b.severity = predicted where truth <> predicted)",
  """select cast(sum(n) as bigint) as n_errors, cast(sum(n) filter (where step < 0) as bigint) as n_under, cast(sum(n) filter (where step > 0) as bigint) as n_over, round(100.0::double * sum(n) filter (where step < 0) / sum(n), 6) as pct_under,
  arg_max(truth || ' -> ' || predicted, (n, -i, -j)) as largest_path, max(n) as largest_path_n from errors"""))
def _(spark, sf):
    return rounded(E.error_direction(_matrix(spark, sf), "truth", "predicted"), pct_under=6)


@query("escalation_rate", sql("""select smell, count(*) as n, count(*) filter (where predicted in ('major', 'critical')) as n_escalated, round(100.0::double * count(*) filter (where predicted in ('major', 'critical')) / count(*), 6) as pct
  from predictions where truth = 'minor' group by 1""", "predictions"))
def _(spark, sf):
    return rounded(E.escalation_rate(V.predictions(spark, sf), "truth", "predicted", ["smell"]), pct=6)


# Results of four pretended models: each predicts the grade of one smell's share of the samples.
_RESULTS = """results as (select 'severity' as task, smell as model, metric, value from (select smell, avg(case when truth = predicted then 1.0::double else 0 end) as test_accuracy,
  avg(case when truth = predicted and sample_id % 5 <> 0 then 1.0::double else 0 end) / 0.8::double as cv_accuracy_mean, avg(score_none) as test_roc_auc from predictions group by 1) unpivot (value for metric in (test_accuracy, cv_accuracy_mean, test_roc_auc)))"""


def _results(spark, sf):
    hit = F.col("truth") == F.col("predicted")
    wide = V.predictions(spark, sf).groupBy(F.lit("severity").alias("task"), F.col("smell").alias("model")).agg(
        F.avg(hit.cast("double")).alias("test_accuracy"), (F.avg((hit & (F.col("sample_id") % 5 != 0)).cast("double")) / 0.8).alias("cv_accuracy_mean"), F.avg("score_none").alias("test_roc_auc"))
    return wide.unpivot(["task", "model"], ["test_accuracy", "cv_accuracy_mean", "test_roc_auc"], "metric", "value")


@query("generalisation_gap", _with(sql("select 1", "predictions"), _RESULTS, """select task, model, round(cv, 9) as cv, round(test, 9) as test, round(100 * (test - cv), 7) as gap_points from
  (select task, model, max(value) filter (where metric = 'cv_accuracy_mean') as cv, max(value) filter (where metric = 'test_accuracy') as test from results group by 1, 2)"""))
def _(spark, sf):
    return rounded(E.generalisation_gap(_results(spark, sf)), cv=9, test=9, gap_points=7)


@query("leaderboard", _with(sql("select 1", "predictions"), _RESULTS, """select task, model, round(max(value) filter (where metric = 'test_accuracy'), 9) as accuracy, round(max(value) filter (where metric = 'test_roc_auc'), 9) as auc from results group by 1, 2"""))
def _(spark, sf):
    out = E.leaderboard(_results(spark, sf), {"accuracy": "test_accuracy", "auc": "test_roc_auc"})
    return rounded(out, accuracy=9, auc=9)


@query("best_by", _with(sql("select 1", "predictions"), _RESULTS, """select model, round(value, 9) as value from (select *, row_number() over (order by value desc, model) r from results where metric = 'test_accuracy') where r = 1"""))
def _(spark, sf):
    listed = _results(spark, sf).filter("metric = 'test_accuracy'").withColumn("position", S.ordinal_rank("model", S.SMELLS))
    return rounded(E.best_by(listed, "value", "position", "model"), value=9)


@query("read_model_results", _with(sql("select 1", "predictions"), _RESULTS, "select task, model, metric, round(value, 9) as value from results"))
def _(spark, sf):
    from ratertrail.session import scratch_path
    from ratertrail.sources import tables

    per_model = _results(spark, sf).groupBy("task", "model").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))
    doc = per_model.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("model", "metrics"))).alias("models")).select(F.struct("models").alias("severity"))
    path = scratch_path(spark, "results")
    tables.write_results_json(doc, path)
    return rounded(tables.read_model_results(spark, path, ["severity"]), value=9)

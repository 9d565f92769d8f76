"""Queries on splits, classifiers and feature selection.

What learners predict has no SQL equivalent; SQL checks the rows tested and the form of their scores. Everything
around them (splits, weights, matrices, information) has one.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratertrail.functions import scalar as S
from ratertrail.models import benchmark as B
from ratertrail.models import selection as M
from ratertrail.models import splits
from ratertrail.models.learners import predictions
from ratertrail.models.matrix import build_matrix
from ratertrail.queries import views as V
from ratertrail.queries.registry import query
from ratertrail.queries.statistics import _with, rounded
from ratertrail.queries.views import sql
from ratertrail.streaming.incremental import process_incrementally
from ratertrail.session import cut_lineage, scratch_path

LABELS = ["not_severe", "severe"]


def _dataset(spark, sf):
    instances = cut_lineage(V.instances(spark, sf))  # both sides read it
    return B.model_dataset(instances, V.complexity(spark, sf, instances))


_DATASET = """dataset as (select i.*, c.wmc, c.cbo, c.dit, c.noc, c.rfc, c.lcom, c.loc, c.total_methods, c.total_fields, c.method_cyclomatic_complexity,
  case when i.severity_consensus in ('major', 'critical') then 'severe' else 'not_severe' end as severe_binary from instances i join complexity c using (instance_id))"""


def dataset_sql(body: str, extra: str = "") -> str:
    return _with(sql("select 1", "instances", "complexity"), _DATASET + extra, body)


@query("model_dataset", dataset_sql("select * from dataset"))
def _(spark, sf):
    return _dataset(spark, sf)


@query("balanced_weights", dataset_sql("select instance_id, round(t.n / (t.k * c.n::double), 9) as weight from dataset join (select severity_consensus, count(*) as n from dataset group by 1) c using (severity_consensus) cross join (select count(*) as n, count(distinct severity_consensus) as k from dataset) t"))
def _(spark, sf):
    return rounded(splits.balanced_weights(_dataset(spark, sf), "severity_consensus").select("instance_id", "weight"), weight=9)


_QUOTAS = """, counts as (select severity_consensus, count(*) as n from dataset group by 1), sized as (select *, ceil(0.2::double * sum(n) over ()) as size, n * ceil(0.2::double * sum(n) over ()) / sum(n) over () as share from counts),
  turns as (select *, floor(share) as low, row_number() over (order by share - floor(share) desc, severity_consensus) as turn, size - sum(floor(share)) over () as spare from sized),
  quotas as (select severity_consensus, n, cast(low + case when turn <= spare then 1 else 0 end as bigint) as quota from turns)"""
_HASH = "('0x' || substr(md5('{seed}:' || instance_id), 1, 15))::bigint"


@query("class_quotas", dataset_sql("select * from quotas", _QUOTAS))
def _(spark, sf):
    return splits.class_quotas(_dataset(spark, sf), "severity_consensus", 0.2)


@query("stratified_split", dataset_sql(f"""select instance_id, row_number() over (partition by severity_consensus order by {_HASH.format(seed=42)}, instance_id) <= quota as is_test from dataset join quotas using (severity_consensus)""", _QUOTAS))
def _(spark, sf):
    return splits.stratified_split(_dataset(spark, sf), "severity_consensus", "instance_id").select("instance_id", "is_test")


@query("stratified_folds", dataset_sql(f"""select instance_id, cast((row_number() over (partition by severity_consensus order by {_HASH.format(seed=43)}, instance_id) - 1) % 5 as bigint) as fold from dataset"""))
def _(spark, sf):
    out = splits.stratified_folds(_dataset(spark, sf), "severity_consensus", "instance_id")
    return out.select("instance_id", F.col("fold").cast("long").alias("fold"))


def _filled_sql(f: str) -> str:
    return f"""select '{f}' as feature, round(any_value(m), 6) as fill, round(avg(coalesce({f}, m)), 6) as mean, round(coalesce(nullif(stddev_pop(coalesce({f}, m)), 0), 1), 6) as spread
      from dataset cross join (select median({f})::double as m from dataset)"""


@query("feature_matrix", dataset_sql(" union all ".join(_filled_sql(f) for f in B.NUMERIC_FEATURES)))
def _(spark, sf):
    """What a fit on all rows fills unknown values with, and how it scales the filled columns."""
    info = build_matrix(_dataset(spark, sf), "severity_consensus", S.GRADES, "instance_id", B.NUMERIC_FEATURES, folds=0, fraction=0).fits[-1]
    rows = [(f, info.fills[j], info.means[j], info.spreads[j]) for j, f in enumerate(B.NUMERIC_FEATURES)]
    return rounded(spark.createDataFrame(rows, "feature string, fill double, mean double, spread double"), fill=6, mean=6, spread=6)


_HOT = [("smell", v) for v in S.SMELLS] + [(V.FLAG, v) for v in ("0", "0,5", "1")]


@query("selection_matrix", dataset_sql("select instance_id, severity_consensus, " + ", ".join(f"coalesce({f}, (select median({f}) from dataset))::double as {f}" for f in B.NUMERIC_FEATURES)
       + ", " + ", ".join(f"""({c} = '{v}')::int::double as "{c}_{v}\"""" for c, v in _HOT) + " from dataset"))
def _(spark, sf):
    """The flat matrix that feature selection starts from: exact medians for unknown values, an indicator for each category."""
    return B.selection_matrix(_dataset(spark, sf), "instance_id", "severity_consensus")[0]


_NUMBERS = ["cbo", "rfc", "loc", "n_reviewers"]


@query("correlations", dataset_sql(" union all ".join(f"select '{a}' as feature_a, '{b}' as feature_b, round(corr({a}, {b}), 8) as r from dataset" for a, b in combinations(_NUMBERS, 2))))
def _(spark, sf):
    return rounded(M.correlations(_dataset(spark, sf), _NUMBERS), r=8)


_SCORES = {"rfc": 0.4, "cbo": 0.3, "n_reviewers": 0.2, "loc": 0.1}
_PAIR_ROWS = " union all ".join(
    f"select {i} as idx, '{a}' as a, '{b}' as b, '{b}' as loser, abs(corr({a}, {b})) as r from dataset" for i, (a, b) in enumerate(combinations(_SCORES, 2), 1)
)


@query("prune_correlated", "with recursive" + dataset_sql(f"""select unnest(dropped) as feature from s where idx = (select max(idx) from s)""", f""", p as ({_PAIR_ROWS}),
  s as (select 0 as idx, []::varchar[] as dropped union all select p.idx, case when p.r > 0.8 and not list_contains(dropped, p.a) and not list_contains(dropped, p.b) then list_append(dropped, p.loser) else dropped end
    from s join p on p.idx = s.idx + 1)""").removeprefix("with"))
def _(spark, sf):
    dropped = M.prune_correlated(_dataset(spark, sf), _SCORES)
    return spark.createDataFrame([(f,) for f in dropped], "feature string")


_DISCRETE = ["smell", V.FLAG, "type"]


@query("mutual_information_discrete", dataset_sql(" union all ".join(f"""select '{f}' as feature, round(greatest(sum(n / t * ln(n * t / (nx * ny))), 0), 9) as mi from (
  select count(*)::double as n, sum(count(*)) over (partition by {f})::double as nx, sum(count(*)) over (partition by severity_consensus)::double as ny, sum(count(*)) over ()::double as t from dataset group by {f}, severity_consensus)""" for f in _DISCRETE)))
def _(spark, sf):
    return rounded(M.mutual_information_discrete(_dataset(spark, sf), _DISCRETE, "severity_consensus"), mi=9)


def _digamma(m: str) -> str:
    x = f"({m} + 6)"
    tail = " - ".join(f"1.0::double / ({m} + {i})" for i in range(6))
    return f"(ln({x}) - 0.5::double / {x} - 1 / (12.0::double * {x} * {x}) + 1 / (120.0::double * {x} ** 4) - 1 / (252.0::double * {x} ** 6) + 1 / (240.0::double * {x} ** 8) - {tail})"


# One row per part: its revenue, hardly ever tied, against its brand's class.
_REVENUE = """points as (select l_partkey as id, any_value(p_size % 5) as y, sum(l_extendedprice) + l_partkey * 1e-4::double as x from lineitem join part on p_partkey = l_partkey group by 1)"""


@query("mutual_information", f"""with {_REVENUE}, near as (select *, count(*) over c as ny, list_sort(list_filter([x - lag(x, 1) over w, x - lag(x, 2) over w, x - lag(x, 3) over w, lead(x, 1) over w - x, lead(x, 2) over w - x, lead(x, 3) over w - x], lambda d: d is not null)) as gaps
    from points window w as (partition by y order by x), c as (partition by y)),
  m as (select a.id, a.ny, (select count(*) from points b where abs(b.x - a.x) < a.gaps[3] - 1e-7::double) as m from near a)
  select 'x' as feature, round(greatest({_digamma("count(*)::double")} + {_digamma("3.0::double")} - avg({_digamma("ny::double")}) - avg({_digamma("m::double")}), 0), 6) as mi from m""")
def _(spark, sf):
    part = V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5).alias("y"))
    revenue = V.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg((F.sum("l_extendedprice") + F.col("l_partkey") * 1e-4).alias("x"))
    return rounded(M.mutual_information(revenue.join(part, "id"), ["x"], "y", "id", jitter=False), mi=6)


def _tied_sql(f: str) -> str:
    """The same for one metric, its ties broken by the hash of the row's key."""
    unit = _HASH.format(seed=42) + "::double / 1152921504606846976.0::double"
    return f"""select '{f}' as feature, round(greatest({_digamma("count(*)::double")} + {_digamma("3.0::double")} - avg({_digamma("ny::double")}) - avg({_digamma("m::double")}), 0), 6) as mi from (
    select a.ny, greatest((select count(*) from p_{f} b where b.x > a.lo and b.x < a.hi), 1) as m from (
      select *, case when up then x - gap else v end as lo, case when up then v else x + gap end as hi from (
        select *, near[3].d as gap, near[3].up as up, near[3].v as v from (
          select x, y, count(*) over (partition by y) as ny, list_sort([{{'d': x - lag(x, 1) over w, 'up': false, 'v': lag(x, 1) over w}}, {{'d': x - lag(x, 2) over w, 'up': false, 'v': lag(x, 2) over w}}, {{'d': x - lag(x, 3) over w, 'up': false, 'v': lag(x, 3) over w}},
            {{'d': lead(x, 1) over w - x, 'up': true, 'v': lead(x, 1) over w}}, {{'d': lead(x, 2) over w - x, 'up': true, 'v': lead(x, 2) over w}}, {{'d': lead(x, 3) over w - x, 'up': true, 'v': lead(x, 3) over w}}], 'ASC', 'NULLS LAST') as near
          from (select severity_consensus as y, {f}::double + {unit} * 1e-10::double * greatest(1.0::double, (select avg(abs({f}::double)) from dataset)) as x from dataset) window w as (partition by y order by x)))) a)"""


_TIED = ", ".join(f"p_{f} as (select {f}::double + {_HASH.format(seed=42)}::double / 1152921504606846976.0::double * 1e-10::double * greatest(1.0::double, (select avg(abs({f}::double)) from dataset)) as x from dataset)" for f in _NUMBERS)


@query("mutual_information_tied", dataset_sql("select *, row_number() over (order by mi desc, feature) as place from (" + " union all ".join(_tied_sql(f) for f in _NUMBERS) + ")", ", " + _TIED))
def _(spark, sf):
    """Integer metrics, their many ties broken by the jitter."""
    df = cut_lineage(_dataset(spark, sf))
    return M.rank_features(rounded(M.mutual_information(df, _NUMBERS, "severity_consensus", "instance_id"), mi=6))


@query("rank_features", dataset_sql("""select smell as feature, avg(loc) as mi, row_number() over (order by avg(loc) desc, smell) as place from dataset group by 1""").replace("avg(loc) as mi", "round(avg(loc), 6) as mi"))
def _(spark, sf):
    scores = rounded(_dataset(spark, sf).groupBy(F.col("smell").alias("feature")).agg(F.avg("loc").alias("mi")), mi=6)
    return M.rank_features(scores)


@query("split_by_threshold", dataset_sql("select instance_id, case when loc >= 15000 then 'kept' else 'dropped' end as side from dataset"))
def _(spark, sf):
    kept, dropped = M.split_by_threshold(_dataset(spark, sf), 15000, "loc")
    return kept.select("instance_id", F.lit("kept").alias("side")).unionByName(dropped.select("instance_id", F.lit("dropped").alias("side")))


# Each pair of features, with the rows that have both.
@query("feature_pairs", dataset_sql(" union all ".join(f"select '{a}' as a, '{b}' as b, count(*) filter ({a} is not null and {b} is not null) as n from dataset" for a, b in combinations(B.NUMERIC_FEATURES, 2))))
def _(spark, sf):
    both = [F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n") for a, b in M.feature_pairs(B.NUMERIC_FEATURES)]
    counts = _dataset(spark, sf).agg(F.array(*both).alias("n"))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in M.feature_pairs(B.NUMERIC_FEATURES)])
    return counts.select(F.explode(F.arrays_zip(pairs.alias("p"), F.col("n"))).alias("z")).select("z.p.*", "z.n")


# --- learners -------------------------------------------------------------------------------

# Which rows are tested, and their truth, is exact; what is predicted for them is checked for its form.
_TESTED = dataset_sql(f"""select instance_id, severe_binary as truth, true as label_valid, true as score_valid
  from (select *, row_number() over (partition by severe_binary order by {_HASH.format(seed=42)}, instance_id) as pos from dataset) join quotas using (severe_binary) where pos <= quota""",
  _QUOTAS.replace("severity_consensus", "severe_binary"))


def _predict(spark, sf, name):
    """The learner at its full defaults, on all training rows, asked for all test rows."""
    m = build_matrix(_dataset(spark, sf), "severe_binary", LABELS, "instance_id", B.NUMERIC_FEATURES, B.CATEGORICAL_FEATURES, folds=0)
    out = predictions(m, B.ESTIMATORS[name](m))
    finite = (F.size("scores") == len(LABELS)) & F.forall("scores", lambda s: s.isNotNull() & (s >= 0) & (s <= 1))
    total = F.aggregate("scores", F.lit(0.0), lambda a, s: a + s)
    return out.select(F.col("key").alias("instance_id"), "truth", F.col("prediction_label").isin(*LABELS).alias("label_valid"), (finite & (F.abs(total - 1) < 1e-9)).alias("score_valid"))


@query("model_rf", _TESTED)
def _(spark, sf):
    return _predict(spark, sf, "Random Forest")


@query("model_extra_trees", _TESTED)
def _(spark, sf):
    return _predict(spark, sf, "Extra Trees")


@query("model_gbt", _TESTED)
def _(spark, sf):
    return _predict(spark, sf, "Gradient Boosting")


@query("model_logreg", _TESTED)
def _(spark, sf):
    return _predict(spark, sf, "Logistic Regression")


@query("model_svm", _TESTED)
def _(spark, sf):
    return _predict(spark, sf, "SVM")


TASKS = {"multiclass_4severity": ("severity_consensus", S.GRADES), "binary_majorcritical": ("severe_binary", LABELS)}


@query("split_profile", " union all by name ".join(f"""select * from ({dataset_sql(f"""select '{name}' as task, side, label, cast(count(pos) as bigint) as n
  from (select unnest({list(labels)}) as label) cross join (select unnest(['train', 'test']) as side)
  left join (select {target} as label, case when row_number() over (partition by {target} order by {_HASH.format(seed=42)}, instance_id) <= quota then 'test' else 'train' end as side, 1 as pos from dataset join quotas using ({target})) using (label, side)
  group by all""", _QUOTAS.replace("severity_consensus", target))})""" for name, (target, labels) in TASKS.items()))
def _(spark, sf):
    """Rows of each label on either side of both tasks' splits."""
    df = cut_lineage(_dataset(spark, sf))
    return reduce(DataFrame.unionByName, [B.split_profile(df, target, labels, "instance_id", name) for name, (target, labels) in TASKS.items()])


@query("evaluate_models")
def _(spark, sf):
    """All five learners on both tasks, five folds and the test rows, at their full defaults."""
    df = cut_lineage(_dataset(spark, sf))
    return reduce(DataFrame.unionByName, [B.evaluate_models(df, target, labels, "instance_id", task=name) for name, (target, labels) in TASKS.items()])


@query("rfe_cv")
def _(spark, sf):
    """Recursive elimination of all numeric features: five folds, 200 trees."""
    rounds = M.rfe_cv(cut_lineage(_dataset(spark, sf)), B.NUMERIC_FEATURES, "severe_binary", LABELS, "instance_id")
    return spark.createDataFrame([(len(f), ",".join(f), s) for f, s in rounds], "n_features int, features string, f1_macro double")


@query("feature_selection")
def _(spark, sf):
    """The three stages over the whole flat matrix, at the operators' defaults."""
    flat, numeric, hot = B.selection_matrix(_dataset(spark, sf), "instance_id", "severity_consensus")
    return M.feature_selection(flat, numeric, hot, "severity_consensus", S.GRADES, "instance_id")


# --- incremental runs -----------------------------------------------------------------------


@query("process_incrementally", "select event_id, user_id, value * 2 as doubled from events where event_type <> 'error'")
def _(spark, sf):
    """Events as keys to process, run twice; errors fail, and the second run must add nothing."""
    root = scratch_path(spark, "run")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    stream = stream.select("event_id", "user_id", "event_type", "value")

    def operator(df):
        ok = F.col("event_type") != "error"
        return df.filter(ok).select("event_id", "user_id", (F.col("value") * 2).alias("doubled")), df.filter(~ok)

    for _ in range(2):
        out = process_incrementally(stream, "event_id", operator, f"{root}/store", f"{root}/checkpoint")
    return out

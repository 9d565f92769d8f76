"""Queries on joins, failure logs and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratertrail.functions import scalar as S
from ratertrail.operators import audit as A
from ratertrail.operators import matching as M
from ratertrail.operators.dedupe import first_per_key
from ratertrail.queries import views as V
from ratertrail.queries.registry import query
from ratertrail.queries.views import sql
from ratertrail.session import scratch_path
from ratertrail.sources import tables


@query("inner_on_key", sql("select i.*, c.wmc, c.loc from instances i join complexity c using (instance_id)", "instances", "complexity"))
def _(spark, sf):
    return A.inner_on_key(V.instances(spark, sf), V.complexity(spark, sf), "instance_id", ["wmc", "loc"])


@query("join_coverage", sql("""select n, n_total, cast(round_even(100.0::double * n / n_total, 2) as double) as pct from
  (select (select count(*) from complexity) as n, (select count(*) from instances) as n_total)""", "instances", "complexity"))
def _(spark, sf):
    inst = V.instances(spark, sf)
    return A.join_coverage(inst, A.inner_on_key(inst, V.complexity(spark, sf), "instance_id", []))


@query("pending_only", sql("select instance_id, smell from instances where instance_id not in (select instance_id from complexity)", "instances", "complexity"))
def _(spark, sf):
    return A.pending_only(V.instances(spark, sf), V.complexity(spark, sf), "instance_id").select("instance_id", "smell")


@query("restrict_to_keys", sql("select instance_id from instances where repository in (select p_brand from part where p_size = 50)", "instances"))
def _(spark, sf):
    keys = V.table(spark, sf, "part").filter("p_size = 50").select(F.col("p_brand").alias("repository"))
    return A.restrict_to_keys(V.instances(spark, sf), keys, "repository").select("instance_id")


@query("attach_group_fact", sql("""select instance_id, i.repository, f.p_name as first_name, f.p_size as first_size from instances i join
  (select * from (select *, row_number() over (partition by p_brand order by p_partkey) r from part) where r = 1) f on f.p_brand = i.repository""", "instances"))
def _(spark, sf):
    part = V.table(spark, sf, "part")
    facts = first_per_key(part, ["p_brand"], ["p_partkey"]).select(F.col("p_brand").alias("repository"), F.col("p_name").alias("first_name"), F.col("p_size").alias("first_size"))
    return A.attach_group_fact(V.instances(spark, sf).select("instance_id", "repository"), facts, "repository")


_FAILED = sql("""select repository, instance_id, cast(sample_id as bigint) as sample_id, smell, 'complexity' as stage, 'no_join_match' as reason, 'loc=' || coalesce(cast(loc as varchar), '') as detail
  from instances left join (select instance_id as ok from complexity) on ok = instance_id left join metrics using (sample_id) where ok is null""", "instances", "complexity", "metrics")


def _complexity_outcome(spark, sf):
    inst = V.instances(spark, sf).select("repository", "instance_id", "sample_id", "smell")
    done = V.complexity(spark, sf).select("instance_id", F.lit(True).alias("ok"))
    joined = inst.join(done, "instance_id", "left").join(V.metrics(spark, sf).select("sample_id", "loc"), "sample_id", "left")
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return A.split_matched(joined, F.col("ok"), "complexity", "no_join_match", F.concat(F.lit("loc="), F.coalesce(F.col("loc").cast("string"), F.lit(""))), stamp)


@query("split_matched", _FAILED)
def _(spark, sf):
    return _complexity_outcome(spark, sf)[1].drop("timestamp")


@query("split_matched_results", sql("select instance_id from complexity", "complexity"))
def _(spark, sf):
    return _complexity_outcome(spark, sf)[0].select("instance_id")


# Attempts: events as attempts of stages; views and clicks failed, purchases succeeded.
_ATTEMPTS = """select case when event_id % 5 = 0 then 'clone' when event_id % 2 = 0 then 'complexity' else 'persistence' end as stage, 'r' || user_id as repository,
  case when event_id % 5 = 0 then null else cast(user_id * 8 + event_id % 8 as varchar) end as instance_id, event_type, ts, event_id from events"""


def _attempts(spark, sf):
    e = F.col("event_id")
    return V.table(spark, sf, "events").select(
        S.case_recode([(e % 5 == 0, "clone"), (e % 2 == 0, "complexity")], "persistence").alias("stage"),
        F.concat(F.lit("r"), "user_id").alias("repository"),
        F.when(e % 5 != 0, (F.col("user_id") * 8 + e % 8).cast("string")).alias("instance_id"),
        "event_type", F.col("ts").alias("timestamp"), "event_id",
    )


_KEY = "case when stage = 'clone' then stage || '::' || repository else stage || '::' || instance_id end"


@query("clean_failure_log", f"""select stage, repository, instance_id, event_type as reason, event_id from (
  select *, row_number() over (partition by {_KEY} order by ts desc, event_id desc) r from ({_ATTEMPTS}) where event_type in ('view', 'click', 'error')) f
  where r = 1 and {_KEY} not in (select {_KEY} from ({_ATTEMPTS}) where event_type = 'purchase')""")
def _(spark, sf):
    tries = _attempts(spark, sf)
    log = tries.filter(F.col("event_type").isin("view", "click", "error")).select("timestamp", "event_id", "stage", "repository", "instance_id", F.col("event_type").alias("reason"))
    out = A.clean_failure_log(log, tries.filter("event_type = 'purchase'"))
    return out.drop("timestamp")


@query("union_failures", f"""select stage, repository, instance_id, count(*) as n from ({_ATTEMPTS}) where event_type = 'error' group by 1, 2, 3""")
def _(spark, sf):
    tries = _attempts(spark, sf).filter("event_type = 'error'").drop("event_id", "event_type")
    clones = tries.filter("stage = 'clone'").drop("instance_id")
    log = A.union_failures(tries.filter("stage = 'persistence'"), tries.filter("stage = 'complexity'"), clones)
    return log.groupBy("stage", "repository", "instance_id").agg(F.count("*").alias("n"))


@query("attrition_report", sql("""
  with f as (select 'complexity' as stage, 'no_join_match_' || smell as reason from instances where instance_id not in (select instance_id from complexity)
    union all select 'tied', 'tied_' || smell from instances where severity_tied)
  select stage, reason, count(*) as n, null as n_success, null as reconciles from f group by 1, 2
  union all select f.stage, '(all)', count(*), any_value(ok), count(*) + any_value(ok) = (select count(*) from instances) from f
    join (select 'complexity' as stage, count(*) as ok from complexity union all select 'tied', count(*) from instances where not severity_tied) s on s.stage = f.stage group by 1
  union all select '(all)', '(all)', count(*), null, null from f""", "instances", "complexity").replace("\n  with f as", ",\n f as").replace(")\n,\n f as", "),\n f as"))
def _(spark, sf):
    inst, comp = V.instances(spark, sf), V.complexity(spark, sf)
    lost = A.pending_only(inst, comp, "instance_id").select(F.lit("complexity").alias("stage"), F.concat(F.lit("no_join_match_"), "smell").alias("reason"))
    tied = inst.filter("severity_tied").select(F.lit("tied").alias("stage"), F.concat(F.lit("tied_"), "smell").alias("reason"))
    done = comp.select(F.lit("complexity").alias("stage")).unionByName(inst.filter("not severity_tied").select(F.lit("tied").alias("stage")))
    return A.attrition_report(inst, done, lost.unionByName(tied))


# --- matching: part as a catalogue of classes and functions ---------------------------------

# Probes ask for every part by name and brand; every third brand is misspelt, every fifth name unknown.
_PROBES = """select p_partkey as probe, case when p_partkey % 5 = 0 then p_name || '?' else p_name end as name,
  case when p_partkey % 3 = 0 then p_brand || '?' else p_brand end as path, (p_size + p_partkey % 2) % 50 as n_params from part"""


def _probes(spark, sf):
    k = F.col("p_partkey")
    return V.table(spark, sf, "part").select(
        k.alias("probe"), F.when(k % 5 == 0, F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name")).alias("name"),
        F.when(k % 3 == 0, F.concat("p_brand", F.lit("?"))).otherwise(F.col("p_brand")).alias("path"), ((F.col("p_size") + k % 2) % 50).alias("n_params"),
    )


@query("match_class_tiered", f"""select probe, name, path, join_level, case when join_level = 'class_fqcn+path' then path_first else name_first end as ordinal from (
  select p.*, case when n = 1 then 'class_fqcn' when n_path = 1 then 'class_fqcn+path' when n > 1 then 'class_fqcn_ambiguous_first_match' end as join_level, name_first, path_first
  from ({_PROBES}) p left join (select p_name, count(*) n, min(p_partkey) name_first from part group by 1) a on a.p_name = p.name
  left join (select p_name, p_brand, count(*) n_path, min(p_partkey) path_first from part group by 1, 2) b on b.p_name = p.name and b.p_brand = p.path)""")
def _(spark, sf):
    catalogue = V.table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("path"), F.col("p_partkey").alias("ordinal"))
    return M.match_class_tiered(_probes(spark, sf).drop("n_params"), catalogue, "name", "path", ["ordinal"], ["ordinal"])


@query("match_function_tiered", f"""select probe, name, path, cast(n_params as bigint) as n_params, coalesce(exact, first) as ordinal,
  case when exact is not null then 'method_fqcn+name+arity' when first is not null then 'method_fqcn+name_only' end as join_level
  from ({_PROBES}) p left join (select p_name, p_brand, min(p_partkey) as first from part group by 1, 2) a on a.p_name = p.name and a.p_brand = p.path
  left join (select p_name, p_brand, p_size, min(p_partkey) as exact from part group by 1, 2, 3) b on b.p_name = p.name and b.p_brand = p.path and b.p_size = p.n_params""")
def _(spark, sf):
    catalogue = V.table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("path"), F.col("p_size").alias("arity"), F.col("p_partkey").alias("ordinal"))
    out = M.match_function_tiered(_probes(spark, sf), catalogue, ["name", "path"], "arity", "n_params", ["ordinal"], ["ordinal"])
    return out.withColumn("n_params", F.col("n_params").cast("long"))


@query("match_failures", f"""select count(*) as n, 'no_join_match' as reason from ({_PROBES}) where name not in (select p_name from part)""")
def _(spark, sf):
    catalogue = V.table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("path"), F.col("p_partkey").alias("ordinal"))
    joined = M.match_class_tiered(_probes(spark, sf), catalogue, "name", "path", ["ordinal"], ["ordinal"])
    detail = F.concat(F.lit("code_name="), "name", F.lit(" path="), "path")
    return A.split_matched(joined, F.col("join_level").isNotNull(), "complexity", "no_join_match", detail)[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("load_metric_tables", """select p_partkey as wmc, replace(p_name, ' ', '.') as class_name, 'src/' || p_brand as path, function_name, arity from
  (select *, 'run' as function_name, cast(p_size as int) as arity from part)""")
def _(spark, sf):
    part = V.table(spark, sf, "part")
    name = F.replace("p_name", F.lit(" "), F.lit("$"))
    value = F.col("p_partkey")
    root = scratch_path(spark, "metrics")
    classes = part.select(F.concat(F.lit("/repo/src/"), "p_brand").alias("file"), name.alias("class"), *[value.alias(c) for c in
                          ("wmc", "cbo", "dit", "noc", "rfc", "lcom", "loc", "totalMethodsQty", "totalFieldsQty")])
    methods = part.select(name.alias("class"), F.concat(F.lit("run/"), "p_size", F.lit("[int, java.util.List]")).alias("method"), *[value.alias(c) for c in ("cbo", "rfc", "loc", "wmc")])
    tables.write_table(classes, f"{root}/class", "csv")
    tables.write_table(methods, f"{root}/method", "csv")
    c, m = tables.load_metric_tables(spark, f"{root}/class", f"{root}/method", "/repo")
    joined = c.select("class_name", "path", "wmc").join(m.select("class_name", "function_name", "arity", "wmc"), ["class_name", "wmc"])
    return joined.select(F.col("wmc").cast("long").alias("wmc"), "class_name", "path", "function_name", "arity")


@query("clone_log_profile", """select status, count(*) as n, cast(sum(size) as bigint) as size_bytes from
  (select case when o_orderstatus = 'P' then 'failed' when o_orderstatus = 'F' then 'skipped_exists' else 'cloned' end as status, cast(floor(o_totalprice) as bigint) as size from orders) group by 1""")
def _(spark, sf):
    orders = V.table(spark, sf, "orders")
    status = S.case_recode([(F.col("o_orderstatus") == "P", "failed"), (F.col("o_orderstatus") == "F", "skipped_exists")], "cloned")
    return orders.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.sum(F.floor("o_totalprice").cast("long")).alias("size_bytes"))

"""Queries on reviews and instances: sources, scalar expressions, consensus, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratertrail.functions import scalar as S
from ratertrail.operators import consensus as C
from ratertrail.operators import dedupe, summaries
from ratertrail.queries import views as V
from ratertrail.queries.registry import query
from ratertrail.queries.views import sql
from ratertrail.session import scratch_path
from ratertrail.sources import tables

INSTANCE_COLUMNS = "instance_id, sample_id, smell, type, repository, is_from_industry_relevant_project_raw, n_reviewers, severity_consensus, severity_tied, severity_values_seen"


@query("consensus_label", sql("select * from consensus", "consensus"))
def _(spark, sf):
    return V.consensus(spark, sf)


@query("instances_pipeline", sql(f"select {INSTANCE_COLUMNS} from instances", "instances"))
def instances_pipeline(spark, sf):
    return V.instances(spark, sf).orderBy("sample_id", "smell")


@query("consensus_distinct_raters", sql("""
  select v.sample_id, v.smell, v.n_reviewers, c.severity_consensus from
  (select sample_id, smell, count(distinct reviewer_id) as n_reviewers from kept group by 1, 2) v join consensus c using (sample_id, smell)""", "consensus"))
def _(spark, sf):
    out = C.consensus_label(V.kept(spark, sf), ["sample_id", "smell"], "severity", rater="reviewer_id", count_distinct_raters=True)
    return out.select("sample_id", "smell", "n_reviewers", "severity_consensus")


@query("first_row_attrs", sql("""
  select sample_id, smell, epoch_us(review_timestamp) as first_micros, id, reviewer_id from
  (select *, row_number() over (partition by sample_id, smell order by review_timestamp, id, reviewer_id) r from kept) where r = 1""", "kept"))
def _(spark, sf):
    out = C.consensus_label(V.kept(spark, sf), ["sample_id", "smell"], "severity",
                            first_cols=["review_timestamp", "id", "reviewer_id"], order=["review_timestamp", "id", "reviewer_id"])
    return out.select("sample_id", "smell", F.unix_micros("review_timestamp").alias("first_micros"), "id", "reviewer_id")


@query("distinct_values_seen", sql("""
  select sample_id, string_agg(severity, ',' order by rank) as severity_values_seen
  from (select distinct sample_id, severity, rank from reviews join grades using (severity)) group by sample_id""", "reviews", "grades"))
def _(spark, sf):
    return C.consensus_label(V.reviews(spark, sf), ["sample_id"], "severity").select("sample_id", "severity_values_seen")


@query("drop_exact_duplicates", sql("select id, reviewer_id, sample_id, smell, severity, epoch_us(review_timestamp) as micros from kept", "kept"))
def _(spark, sf):
    kept, _ = dedupe.drop_exact_duplicates(V.reviews(spark, sf), V.REVIEW_KEY, V.REVIEW_ORDER)
    return kept.select("id", "reviewer_id", "sample_id", "smell", "severity", F.unix_micros("review_timestamp").alias("micros"))


@query("drop_exact_duplicates_audit", sql("select id, reviewer_id, sample_id, smell, severity, epoch_us(review_timestamp) as micros from numbered where rn > 1", "numbered"))
def _(spark, sf):
    _, dropped = dedupe.drop_exact_duplicates(V.reviews(spark, sf), V.REVIEW_KEY, V.REVIEW_ORDER)
    return dropped.select("id", "reviewer_id", "sample_id", "smell", "severity", F.unix_micros("review_timestamp").alias("micros"))


@query("conflicting_reviews", sql("""
  select reviewer_id, sample_id, smell, severity, id from (select *, count(*) over (partition by reviewer_id, sample_id, smell) c from kept) where c > 1""", "kept"))
def _(spark, sf):
    out = dedupe.conflicting_reviews(V.kept(spark, sf), ["reviewer_id", "sample_id", "smell"], ["sample_id", "smell"])
    return out.select("reviewer_id", "sample_id", "smell", "severity", "id")


# --- sources and sinks: written to the shared folder and read back --------------------------


@query("read_reviews", "select l_orderkey*100 + l_linenumber as id, l_suppkey as reviewer_id, l_partkey as sample_id, epoch_us(l_shipdate) as micros from lineitem")
def _(spark, sf):
    path = scratch_path(spark, "reviews")
    tables.write_table(V.reviews(spark, sf), path, "csv")
    schema = "id long, reviewer_id long, sample_id long, smell string, severity string, review_timestamp timestamp"
    back = tables.read_reviews(spark, path, schema)
    return back.select("id", "reviewer_id", "sample_id", F.unix_micros("review_timestamp").alias("micros"))


@query("read_table", sql(f"select {INSTANCE_COLUMNS} from instances", "instances"))
def _(spark, sf):
    path = scratch_path(spark, "instances")
    df = V.instances(spark, sf)
    tables.write_table(df, path, "csv")
    return tables.read_table(spark, path, df.schema)


@query("write_table", sql("select sample_id, smell, severity_consensus from consensus", "consensus"))
def _(spark, sf):
    path = scratch_path(spark, "consensus")
    tables.write_table(V.consensus(spark, sf).select("sample_id", "smell", "severity_consensus"), path, partition_by=["severity_consensus"])
    return tables.read_table(spark, path, "sample_id long, smell string, severity_consensus string", "parquet")


@query("append_table", "select p_brand as repository, 'complexity' as stage from part union all select p_brand, 'persistence' from part")
def _(spark, sf):
    path = scratch_path(spark, "log")
    part = V.table(spark, sf, "part").select(F.col("p_brand").alias("repository"))
    for stage in ("complexity", "persistence"):
        tables.append_table(part.withColumn("stage", F.lit(stage)), path, partition_by=["stage"])
    return tables.read_table(spark, path, "repository string, stage string", "parquet")


@query("read_key_list", "select distinct p_brand as repository from part")
def _(spark, sf):
    path = scratch_path(spark, "keys")
    lines = V.table(spark, sf, "part").select(F.explode(F.array(F.concat(F.lit("  "), "p_brand", F.lit("\t")), F.lit("  "))).alias("value"))
    lines.write.text(path)
    return tables.read_key_list(spark, path)


@query("write_results_json", sql("select count(*) as n, count(*) filter (where severity_tied) as n_tied from consensus", "consensus"))
def _(spark, sf):
    path = scratch_path(spark, "results")
    doc = V.consensus(spark, sf).agg(F.struct(F.count("*").alias("n"), F.count_if("severity_tied").alias("n_tied")).alias("consensus"))
    tables.write_results_json(doc, path)
    return spark.read.schema("consensus struct<n:long,n_tied:long>").json(path).select("consensus.*")


# --- scalar expressions ---------------------------------------------------------------------


@query("instance_key", sql("select distinct sample_id || '::' || smell as instance_id from reviews", "reviews"))
def _(spark, sf):
    return V.reviews(spark, sf).select(S.instance_key("sample_id", "smell").alias("instance_id")).distinct()


@query("ordinal_rank", sql("select rank as severity_rank, count(*) as n from reviews join grades using (severity) group by rank", "reviews", "grades"))
def _(spark, sf):
    return V.reviews(spark, sf).groupBy(S.ordinal_rank("severity", S.GRADES).alias("severity_rank")).agg(F.count("*").alias("n"))


@query("equality_filter", sql("select sample_id, smell from consensus where severity_consensus in ('major', 'critical') and smell <> 'blob'", "consensus"))
def _(spark, sf):
    c = V.consensus(spark, sf)
    return c.filter(F.col("severity_consensus").isin(*S.SEVERE_GRADES) & (F.col("smell") != "blob")).select("sample_id", "smell")


@query("binary_flag", sql("select instance_id, case when is_from_industry_relevant_project_raw = '1' then 'relevant' else 'other' end as relevance from instances", "instances"))
def _(spark, sf):
    return V.instances(spark, sf).select("instance_id", S.binary_flag(V.FLAG).alias("relevance"))


@query("severe_flag", sql("select instance_id, case when severity_consensus in ('major', 'critical') then 'severe' else 'not_severe' end as severe_binary from instances", "instances"))
def _(spark, sf):
    return V.instances(spark, sf).select("instance_id", S.severe_flag("severity_consensus").alias("severe_binary"))


@query("case_recode", "select p_partkey, case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end as size_class from part")
def _(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", S.case_recode([(F.col("p_size") < 10, "small"), (F.col("p_size") < 30, "medium")], "large").alias("size_class"))


_URL = "'git@github.com:' || lower(c_mktsegment) || '/' || c_name || case when c_custkey % 3 = 0 then '.git' else '' end"


def _urls(spark, sf):
    suffix = F.when(F.col("c_custkey") % 3 == 0, ".git").otherwise("")
    return V.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("git@github.com:"), F.lower("c_mktsegment"), F.lit("/"), "c_name", suffix).alias("url"))


@query("repo_slug", f"""select c_custkey, replace(regexp_replace(substr({_URL}, 16), '\\.git$', ''), '/', '__') as slug from customer""")
def _(spark, sf):
    return _urls(spark, sf).select("c_custkey", S.repo_slug("url").alias("slug"))


@query("repo_https_url", f"select c_custkey, 'https://github.com/' || substr({_URL}, 16) as url from customer")
def _(spark, sf):
    return _urls(spark, sf).select("c_custkey", S.repo_https_url("url").alias("url"))


_CODE_SQL = """select p_partkey, 'org.' || lower(p_type) || '.' || replace(p_name, ' ', '.') ||
  case when p_size % 3 = 0 then '#' || p_brand || ' A|F<X, Y>|B' when p_size % 3 = 1 then ' A|G<K, V>' else '' end as code_name from part"""


def _code_names(spark, sf):
    size = F.col("p_size") % 3
    tail = F.when(size == 0, F.concat(F.lit("#"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(" A|F<X, Y>|B"))).when(size == 1, " A|G<K, V>").otherwise("")
    return V.table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("org."), F.lower("p_type"), F.lit("."), F.replace("p_name", F.lit(" "), F.lit(".")), tail).alias("code_name")
    )


_CODE_SQL = _CODE_SQL.replace("'#' || p_brand", "'#' || replace(p_brand, '#', '')")


@query("parse_class_name", f"select p_partkey, list_extract(string_split(split_part(code_name, '#', 1), '.'), -1) as class_name from ({_CODE_SQL})")
def _(spark, sf):
    return _code_names(spark, sf).select("p_partkey", S.parse_class_name("code_name").alias("class_name"))


@query("parse_function_name", f"""
  select p_partkey, case when hashed then split_part(code_name, '#', 1) else array_to_string(segments[:-2], '.') end as class_name,
    case when hashed then head else segments[-1] end as function_name,
    cast(case when params = '' then 0 else len(string_split(params, '|')) end as bigint) as n_params
  from (select *, string_split(head, '.') as segments from (
    select *, split_part(tail, ' ', 1) as head, case when contains(tail, ' ') then substr(tail, instr(tail, ' ') + 1) else '' end as params from (
      select *, contains(code_name, '#') as hashed, case when contains(code_name, '#') then split_part(code_name, '#', 2) else code_name end as tail from ({_CODE_SQL}))))""")
def _(spark, sf):
    f = S.parse_function_name("code_name")
    return _code_names(spark, sf).select("p_partkey", f["class_name"].alias("class_name"), f["function_name"].alias("function_name"), f["n_params"].cast("long").alias("n_params"))


@query("dotted_name", "select p_partkey, replace(replace(p_name, ' ', '$'), '$', '.') as class_name from part")
def _(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", S.dotted_name(F.replace("p_name", F.lit(" "), F.lit("$"))).alias("class_name"))


_SIG_SQL = "case when p_size % 4 = 0 then p_name else p_name || '/' || p_size || '[' || p_type || ']' end"


@query("parse_signature", f"""select p_partkey, nullif(regexp_extract({_SIG_SQL}, '^([^/]+)/(\\d+)', 1), '') as name,
  try_cast(nullif(regexp_extract({_SIG_SQL}, '^([^/]+)/(\\d+)', 2), '') as int) as arity from part""")
def _(spark, sf):
    text = F.when(F.col("p_size") % 4 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit("/"), "p_size", F.lit("["), "p_type", F.lit("]")))
    return V.table(spark, sf, "part").select("p_partkey", S.parse_signature(text).alias("s")).select("p_partkey", "s.*")


@query("relative_path", """select p_partkey, ltrim('//' || p_brand || '/' || p_name, '/') as path,
  case when starts_with(p_brand || '/' || p_name, 'Brand#1/') then substr(p_brand || '/' || p_name, 9) else p_brand || '/' || p_name end as below from part""")
def _(spark, sf):
    path = F.concat_ws("/", "p_brand", "p_name")
    return V.table(spark, sf, "part").select("p_partkey", S.relative_path(F.concat(F.lit("//"), path)).alias("path"), S.relative_path(path, "Brand#1").alias("below"))


@query("clip_detail", "select doc_id, substr(text, 1, 500) as head, right(text, 2000) as tail from documents")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", S.clip_detail("text").alias("head"), S.clip_detail("text", tail=2000).alias("tail"))


@query("parse_iso_ts", "select event_id, epoch_us(ts) // 1000000 * 1000000 - case when event_id % 2 = 0 then 0 else 7200000000 end as micros from events")
def _(spark, sf):
    stem = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.concat(stem, F.when(F.col("event_id") % 2 == 0, "Z").otherwise("+02:00"))
    return V.table(spark, sf, "events").select("event_id", F.unix_micros(S.parse_iso_ts(text)).alias("micros"))


@query("elapsed_days", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(floor((epoch_us(o_orderdate) + 43200000000 - epoch_us(l_shipdate)) / 86400000000.0) as bigint) as days
  from lineitem join orders on o_orderkey = l_orderkey""")
def _(spark, sf):
    joined = V.table(spark, sf, "lineitem").join(V.table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    noon = F.col("o_orderdate") + F.expr("interval 12 hours")
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.elapsed_days(F.col("l_shipdate"), noon).alias("days"))


@query("flag_negative", """select count(*) as n, count(*) filter (where epoch_us(l_shipdate) < epoch_us(o_orderdate)) as n_negative
  from lineitem join orders on o_orderkey = l_orderkey""")
def _(spark, sf):
    joined = V.table(spark, sf, "lineitem").join(V.table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.agg(F.count("*").alias("n"), F.count_if(S.flag_negative(S.elapsed_days("o_orderdate", "l_shipdate"))).alias("n_negative"))


@query("project_by_kind", sql("select * from complexity", "complexity"))
def _(spark, sf):
    return V.complexity(spark, sf)


@query("pct", "select p_partkey, cast(round_even(100 * p_size / 7.0::double, 2) as double) as pct from part")
def _(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", S.pct("p_size", F.lit(7.0)).alias("pct"))


_OWNER_URL = """'git@github.com:' || case c_nationkey % 4 when 0 then 'apache' when 1 then 'Eclipse-x' when 2 then 'Apache' else 'other' end || '/' || c_name || '.git'"""


@query("owner_group", f"""select case when contains(u, 'github.com:apache/') then 'apache' when contains(lower(u), 'github.com:eclipse') then 'eclipse' else 'other' end as owner,
  count(*) as n from (select distinct {_OWNER_URL} as u from customer) group by 1""")
def _(spark, sf):
    nation = F.col("c_nationkey") % 4
    url = F.concat(F.lit("git@github.com:"), S.case_recode([(nation == 0, "apache"), (nation == 1, "Eclipse-x"), (nation == 2, "Apache")], "other"), F.lit("/"), "c_name", F.lit(".git"))
    return V.table(spark, sf, "customer").select(url.alias("u")).distinct().groupBy(S.owner_group("u").alias("owner")).agg(F.count("*").alias("n"))


@query("human_bytes", """select o_orderkey, case when b < 1024 then format('{:.1f}B', b) when b < 1048576 then format('{:.1f}KB', b / 1024)
  when b < 1073741824 then format('{:.1f}MB', b / 1048576) when b < 1099511627776 then format('{:.1f}GB', b / 1073741824) else format('{:.1f}TB', b / 1099511627776) end as size_human
  from (select o_orderkey, cast(floor(o_totalprice) * (1 + o_orderkey % 5) * (1 + o_orderkey % 5) * (1 + o_orderkey % 5) * (1 + o_orderkey % 5) * (1 + o_orderkey % 5) / (1 + 100 * (o_custkey % 7)) as bigint)::double as b from orders)""")
def _(spark, sf):
    k = 1 + F.col("o_orderkey") % 5
    n = F.bround(F.floor("o_totalprice") * k * k * k * k * k / (1 + 100 * (F.col("o_custkey") % 7))).cast("long")
    return V.table(spark, sf, "orders").select("o_orderkey", S.human_bytes(n).alias("size_human"))


# --- summaries ------------------------------------------------------------------------------


@query("value_distribution", sql("select severity_consensus, count(*) as n, cast(round_even(100.0::double * count(*) / sum(count(*)) over (), 2) as double) as pct from consensus group by 1", "consensus"))
def _(spark, sf):
    return summaries.value_distribution(V.consensus(spark, sf), "severity_consensus")


@query("crosstab_ordered", sql("""select rank, severity_consensus, count(*) filter (where smell = 'blob') as blob, count(*) filter (where smell = 'data class') as "data class",
  count(*) filter (where smell = 'feature envy') as "feature envy", count(*) filter (where smell = 'long method') as "long method"
  from consensus join grades on severity = severity_consensus group by 1, 2""", "consensus", "grades"))
def _(spark, sf):
    return summaries.crosstab_ordered(V.consensus(spark, sf), "severity_consensus", "smell", S.GRADES, S.SMELLS)


@query("order_by_rank", sql("select rank, severity_consensus, n from (select severity_consensus, count(*) as n from consensus group by 1) join grades on severity = severity_consensus", "consensus", "grades"))
def _(spark, sf):
    counts = V.consensus(spark, sf).groupBy("severity_consensus").agg(F.count("*").alias("n"))
    return summaries.order_by_rank(counts, "severity_consensus", S.GRADES)


@query("share_by_group", sql("select smell, round(100 * avg(case when severity_consensus in ('major', 'critical') then 1.0::double else 0 end), 8) as pct from consensus group by 1", "consensus"))
def _(spark, sf):
    out = summaries.share_by_group(V.consensus(spark, sf), "smell", F.col("severity_consensus").isin(*S.SEVERE_GRADES))
    return out.withColumn("pct", F.round("pct", 8))


@query("describe_by_group", """select l_returnflag, count(l_extendedprice) as count, round(quantile_cont(l_extendedprice, 0.5), 6) as median,
  round(avg(l_extendedprice), 4) as mean, round(stddev_samp(l_extendedprice), 4) as std from lineitem group by 1""")
def _(spark, sf):
    out = summaries.describe_by_group(V.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.select("l_returnflag", "count", F.round("median", 6).alias("median"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("mean_per_sample", sql("""select sample_id, round(avg(wmc), 6) as wmc, round(avg(loc), 6) as loc, round(avg(total_fields), 6) as total_fields
  from complexity where smell in ('blob', 'data class') group by 1""", "complexity"))
def _(spark, sf):
    df = V.complexity(spark, sf).filter(F.col("smell").isin(*S.CLASS_SMELLS))
    cols = ["wmc", "loc", "total_fields"]
    return summaries.mean_per_sample(df, "sample_id", cols).select("sample_id", *[F.round(c, 6).alias(c) for c in cols])


@query("pivot_labels", sql("""select sample_id, max(severity_consensus) filter (where smell = 'blob') as blob, max(severity_consensus) filter (where smell = 'data class') as data_class,
  max(severity_consensus) filter (where smell = 'feature envy') as feature_envy, max(severity_consensus) filter (where smell = 'long method') as long_method from consensus group by 1""", "consensus"))
def _(spark, sf):
    wide = summaries.pivot_labels(V.consensus(spark, sf), "sample_id", "smell", "severity_consensus", S.SMELLS)
    return wide.toDF("sample_id", *[s.replace(" ", "_") for s in S.SMELLS])


@query("distinct_keys", "select distinct p_brand from part")
def _(spark, sf):
    return summaries.distinct_keys(V.table(spark, sf, "part"), "p_brand")


@query("dataset_profile", sql("""select block, label, n, cast(round_even(100.0::double * n / sum(n) over (partition by block), 2) as double) as pct from (
  select 'smell' as block, smell as label, count(*) as n from instances group by 2 union all
  select 'severity', severity_consensus, count(*) from instances group by 2 union all
  select 'relevance', case when is_from_industry_relevant_project_raw = '1' then 'relevant' else 'other' end, count(*) from instances group by 2 union all
  select 'owner', case when contains(repository, 'Brand#1') then 'apache' when contains(lower(repository), 'brand#2') then 'eclipse' else 'other' end, count(*)
  from (select distinct repository from instances) group by 2)""", "instances"))
def _(spark, sf):
    return summaries.dataset_profile(V.instances(spark, sf), owner=S.owner_group("repository", "Brand#1", "brand#2"))


@query("label_titles", sql("""select distinct smell, array_to_string(list_transform(string_split(smell, ' '), lambda w: upper(w[1]) || w[2:]), ' ') as title from reviews""", "reviews"))
def _(spark, sf):
    return V.reviews(spark, sf).select("smell").distinct().select("smell", F.initcap("smell").alias("title"))

"""Views that cast the driver's tables into the shapes the operators expect, in Spark and as SQL.

Every view covers its whole tables. ``sql(body, names...)`` prefixes a query with the views it
uses; ``VIEWS`` lists them in dependency order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratertrail.functions.scalar import CLASS_SMELLS, GRADES, case_recode, instance_key, ordinal_rank, project_by_kind
from ratertrail.operators.consensus import consensus_label
from ratertrail.operators.dedupe import first_per_key
from ratertrail.operators.survival import persistence_from_labels

REVIEW_KEY = ["reviewer_id", "sample_id", "smell", "severity"]
REVIEW_ORDER = ["review_timestamp", "id"]
FLAG = "is_from_industry_relevant_project_raw"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table; zone-less timestamps become instants of a UTC session."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"})


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    line, quantity = F.col("l_linenumber"), F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 100 + line).alias("id"),
        F.col("l_suppkey").alias("reviewer_id"),
        F.col("l_partkey").alias("sample_id"),
        case_recode([(line <= 2, "blob"), (line <= 4, "data class"), (line == 5, "feature envy")], "long method").alias("smell"),
        case_recode([(quantity <= 30, "none"), (quantity <= 40, "minor"), (quantity <= 47, "major")], "critical").alias("severity"),
        F.col("l_shipdate").alias("review_timestamp"),
    )


def kept(spark: SparkSession, sf: str) -> DataFrame:
    return first_per_key(reviews(spark, sf), REVIEW_KEY, REVIEW_ORDER)


def consensus(spark: SparkSession, sf: str) -> DataFrame:
    return consensus_label(kept(spark, sf), ["sample_id", "smell"], "severity")


def brand_flag(brand: Column) -> Column:
    number = F.substring_index(brand, "#", -1).cast("int") % 5
    return case_recode([(number == 0, "0"), (number == 1, "0,5")], "1")


def instances(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("sample_id"), F.col("p_brand").alias("repository"))
    return consensus(spark, sf).join(part, "sample_id").select(
        instance_key("sample_id", "smell").alias("instance_id"),
        "sample_id",
        "smell",
        F.when(F.col("smell").isin(*CLASS_SMELLS), "class").otherwise("function").alias("type"),
        "repository",
        brand_flag(F.col("repository")).alias(FLAG),
        "n_reviewers",
        "severity_consensus",
        "severity_tied",
        "severity_values_seen",
    )


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").filter("l_partkey is not null")
    sample = F.col("l_partkey").alias("sample_id")
    # Each distinct count by itself: in one aggregation every row would be hashed once more for each, with all sums.
    distinct = lambda c, name: line.select(sample, c).distinct().groupBy("sample_id").agg(F.count(c).alias(name))
    summed = line.groupBy(sample).agg(
        F.count("*").alias("wmc"),
        F.sum("l_quantity").cast("long").alias("lcom"),
        F.sum(F.floor(F.col("l_extendedprice") / 100)).cast("long").alias("loc"),
        F.count_if(F.col("l_linenumber") <= 4).alias("total_methods"),
        F.count_if(F.col("l_linenumber") > 4).alias("total_fields"),
    )
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("sample_id"), (F.col("p_size") % 7).cast("long").alias("dit"), (F.col("p_size") % 4).cast("long").alias("noc")
    )
    counted = summed.join(distinct("l_suppkey", "cbo"), "sample_id").join(distinct("l_orderkey", "rfc"), "sample_id").join(part, "sample_id")
    return counted.select("sample_id", "wmc", "cbo", "rfc", "lcom", "loc", "total_methods", "total_fields", "dit", "noc")


def complexity(spark: SparkSession, sf: str, rated: DataFrame | None = None) -> DataFrame:
    """Instances (``rated``, where they are at hand) with metrics; no row for samples of one part size, so that the join loses some."""
    both = (instances(spark, sf) if rated is None else rated).select("instance_id", "sample_id", "smell", "severity_consensus").join(metrics(spark, sf), "sample_id")
    both = both.filter((F.col("loc") % 10) != 0)
    c = F.col
    return both.select("instance_id", "sample_id", "smell", "severity_consensus", *project_by_kind("smell", {
        "wmc": (c("wmc"), None), "cbo": (c("cbo"), c("cbo")), "dit": (c("dit"), None), "noc": (c("noc"), None),
        "rfc": (c("rfc"), c("rfc")), "lcom": (c("lcom"), None), "loc": (c("loc"), c("loc")),
        "total_methods": (c("total_methods"), None), "total_fields": (c("total_fields"), None),
        "method_cyclomatic_complexity": (None, c("wmc")),
    }))


def revisions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as revisions of one file per user."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        "event_id", "user_id", "ts", "event_type", "value",
        (k % 10 != 0).alias("readable"), (F.col("event_type") != "error").alias("alive"), (F.col("value") >= 5).alias("holds"),
        case_recode([(F.col("value") < 60, "none"), (F.col("value") < 100, "minor"), (F.col("value") < 160, "major")], "critical").alias("severity_consensus"),
    )


def persistence(spark: SparkSession, sf: str) -> DataFrame:
    """Survival from every signup."""
    return persistence_from_labels(
        revisions(spark, sf), ["user_id"], "ts", ["event_id"], F.col("event_type") == "signup", "readable", "alive", "holds", "event_id",
        keep=["event_id", "severity_consensus"],
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Grades with a predicted grade and a score per grade from fixed arithmetic."""
    rank = ordinal_rank("severity_consensus", GRADES)
    h = (F.col("sample_id") * 7 + F.length("smell") * 31) % 100
    shifted = F.get(F.array(*[F.lit(g) for g in GRADES]), ((rank + 1 + h % 3) % 4).cast("int"))
    score = lambda i, g: ((F.col("sample_id") * (17 + i) + F.col("n_reviewers") * 13 + rank * 5) % 1000) / 1000.0 + F.when(F.col("severity_consensus") == g, 0.25).otherwise(0.0)
    return instances(spark, sf).select(
        "instance_id", "sample_id", "smell", F.col("severity_consensus").alias("truth"),
        F.when(h < 70, F.col("severity_consensus")).otherwise(shifted).alias("predicted"),
        *[score(i, g).alias(f"score_{g}") for i, g in enumerate(GRADES)],
    )


VIEWS: list[tuple[str, tuple[str, ...], str]] = [
    ("reviews", (), """select l_orderkey*100 + l_linenumber as id, l_suppkey as reviewer_id, l_partkey as sample_id,
      case when l_linenumber <= 2 then 'blob' when l_linenumber <= 4 then 'data class' when l_linenumber = 5 then 'feature envy' else 'long method' end as smell,
      case when l_quantity <= 30 then 'none' when l_quantity <= 40 then 'minor' when l_quantity <= 47 then 'major' else 'critical' end as severity,
      l_shipdate as review_timestamp from lineitem"""),
    ("numbered", ("reviews",), """select *, row_number() over (partition by reviewer_id, sample_id, smell, severity order by review_timestamp, id) as rn from reviews"""),
    ("kept", ("numbered",), "select * exclude (rn) from numbered where rn = 1"),
    ("grades", (), "select * from (values ('none', 0), ('minor', 1), ('major', 2), ('critical', 3)) g(severity, rank)"),
    ("votes", ("kept", "grades"), """select sample_id, smell, severity, rank, count(*) as n from kept join grades using (severity) group by all"""),
    ("tops", ("votes",), "select *, max(n) over (partition by sample_id, smell) as top from votes"),
    ("consensus", ("tops",), """select sample_id, smell, cast(sum(n) as bigint) as n_reviewers, arg_max(severity, n * 10 + rank) as severity_consensus,
      count(*) filter (where n = top) > 1 as severity_tied, string_agg(severity, ',' order by rank) as severity_values_seen
      from tops group by sample_id, smell"""),
    ("instances", ("consensus",), """select sample_id || '::' || smell as instance_id, sample_id, smell,
      case when smell in ('blob', 'data class') then 'class' else 'function' end as type, p_brand as repository,
      case cast(split_part(p_brand, '#', 2) as int) % 5 when 0 then '0' when 1 then '0,5' else '1' end as is_from_industry_relevant_project_raw,
      n_reviewers, severity_consensus, severity_tied, severity_values_seen from consensus join part on p_partkey = sample_id"""),
    ("metrics", (), """select s.*, cast(p_size % 7 as bigint) as dit, cast(p_size % 4 as bigint) as noc from (
      select l_partkey as sample_id, count(*) as wmc, count(distinct l_suppkey) as cbo, count(distinct l_orderkey) as rfc,
        cast(sum(l_quantity) as bigint) as lcom, cast(sum(cast(floor(l_extendedprice / 100) as bigint)) as bigint) as loc,
        count(*) filter (where l_linenumber <= 4) as total_methods, count(*) filter (where l_linenumber > 4) as total_fields
      from lineitem group by l_partkey) s join part on p_partkey = sample_id"""),
    ("complexity", ("instances", "metrics"), """select instance_id, i.sample_id, smell, severity_consensus,
      case when type = 'class' then cast(wmc as double) end as wmc, cast(cbo as double) as cbo,
      case when type = 'class' then cast(dit as double) end as dit, case when type = 'class' then cast(noc as double) end as noc,
      cast(rfc as double) as rfc, case when type = 'class' then cast(lcom as double) end as lcom, cast(loc as double) as loc,
      case when type = 'class' then cast(total_methods as double) end as total_methods,
      case when type = 'class' then cast(total_fields as double) end as total_fields,
      case when type = 'function' then cast(wmc as double) end as method_cyclomatic_complexity
      from instances i join metrics m on i.sample_id = m.sample_id where loc % 10 <> 0"""),
    ("revisions", (), """select event_id, user_id, ts, event_type, value, cast(json_extract_string(props, '$.k') as int) % 10 <> 0 as readable,
      event_type <> 'error' as alive, value >= 5 as holds,
      case when value < 60 then 'none' when value < 100 then 'minor' when value < 160 then 'major' else 'critical' end as severity_consensus from events"""),
    ("marked", ("revisions",), """select *, row_number() over (partition by user_id order by ts, event_id) as pos,
      case when not readable then 'path_unreadable_at_revision' when not alive then 'entity_not_found' when not holds then 'condition_no_longer_holds' end as cause
      from revisions"""),
    ("fates", ("marked",), """select *, min(case when cause is not null then pos end) over (partition by user_id order by pos rows between 1 following and unbounded following) as death_pos,
      max(pos) over (partition by user_id) as last_pos from marked"""),
    ("persistence", ("fates",), """select l.user_id, l.event_id, l.severity_consensus,
      case when not l.readable then 'path_unreadable_at_labelled_commit' when not l.alive then 'entity_not_found_at_labelled_commit' end as failure_reason,
      l.last_pos - l.pos as n_revisions_observed, e.pos - l.pos as persistence_revisions,
      cast(floor((epoch_us(e.ts) - epoch_us(l.ts)) / 86400000000.0) as bigint) as persistence_days,
      epoch_us(e.ts) < epoch_us(l.ts) as days_anomalous_negative, l.death_pos is null as censored,
      case when l.death_pos is null then 'right_censored_at_last_observed_revision' else e.cause end as death_reason,
      l.ts as labelled_commit_date, cast(e.event_id as varchar) as death_commit, e.ts as death_commit_date,
      cast(z.event_id as varchar) as last_observed_commit, z.ts as last_observed_commit_date
      from fates l join fates e on e.user_id = l.user_id and e.pos = coalesce(l.death_pos, l.last_pos)
      join fates z on z.user_id = l.user_id and z.pos = l.last_pos where l.event_type = 'signup'"""),
    ("survivals", ("persistence",), "select * from persistence where failure_reason is null"),
    ("predictions", ("instances",), """select instance_id, sample_id, smell, severity_consensus as truth,
      case when h < 70 then severity_consensus else ['none', 'minor', 'major', 'critical'][cast((rank + 1 + h % 3) % 4 as int) + 1] end as predicted,
      ((sample_id * 17 + n_reviewers * 13 + rank * 5) % 1000) / 1000.0::double + case when rank = 0 then 0.25::double else 0 end as score_none,
      ((sample_id * 18 + n_reviewers * 13 + rank * 5) % 1000) / 1000.0::double + case when rank = 1 then 0.25::double else 0 end as score_minor,
      ((sample_id * 19 + n_reviewers * 13 + rank * 5) % 1000) / 1000.0::double + case when rank = 2 then 0.25::double else 0 end as score_major,
      ((sample_id * 20 + n_reviewers * 13 + rank * 5) % 1000) / 1000.0::double + case when rank = 3 then 0.25::double else 0 end as score_critical
      from (select *, (sample_id * 7 + length(smell) * 31) % 100 as h,
        case severity_consensus when 'none' then 0 when 'minor' then 1 when 'major' then 2 else 3 end as rank from instances)"""),
]


def sql(body: str, *names: str) -> str:
    """``body`` under the views it names and the ones those need."""
    need, stack = set(), list(names)
    deps = {n: d for n, d, _ in VIEWS}
    while stack:
        n = stack.pop()
        if n not in need:
            need.add(n)
            stack.extend(deps[n])
    ctes = ",\n".join(f"{n} as ({text})" for n, _, text in VIEWS if n in need)
    return (f"with recursive {ctes}\n" if "recursive" in body[:20] else f"with {ctes}\n" if ctes else "") + body

"""Queries on revision histories and commit graphs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratertrail.functions import scalar as S
from ratertrail.operators import graph as G
from ratertrail.operators import summaries, survival
from ratertrail.queries import views as V
from ratertrail.queries.registry import query
from ratertrail.queries.views import sql
from ratertrail.session import cut_lineage, scratch_path
from ratertrail.sources import tables

_DATES = ("labelled_commit_date", "death_commit_date", "last_observed_commit_date")
_PERSISTENCE_SQL = """failure_reason,
  case when failure_reason is null then n_revisions_observed end as n_revisions_observed, case when failure_reason is null then persistence_revisions end as persistence_revisions,
  case when failure_reason is null then persistence_days end as persistence_days, case when failure_reason is null then days_anomalous_negative end as days_anomalous_negative,
  case when failure_reason is null then censored end as censored, case when failure_reason is null then death_reason end as death_reason,
  case when failure_reason is null then epoch_us(labelled_commit_date) end as labelled_commit_date, case when failure_reason is null then death_commit end as death_commit,
  case when failure_reason is null then epoch_us(death_commit_date) end as death_commit_date, case when failure_reason is null then last_observed_commit end as last_observed_commit,
  case when failure_reason is null then epoch_us(last_observed_commit_date) end as last_observed_commit_date"""


def _plain_dates(df):
    return df.withColumns({c: F.unix_micros(c) for c in _DATES})


@query("persistence_from_labels", sql(f"select user_id, event_id, severity_consensus, {_PERSISTENCE_SQL} from persistence", "persistence"))
def _(spark, sf):
    return _plain_dates(V.persistence(spark, sf))


@query("revision_ordinal", sql("select user_id, event_id, pos - 1 as ordinal from marked", "marked"))
def _(spark, sf):
    return survival.revision_ordinal(V.revisions(spark, sf), ["user_id"], "ts", ["event_id"]).select("user_id", "event_id", "ordinal")


@query("persistence_walk", sql(f"""select user_id, {_PERSISTENCE_SQL} from (
  select l.user_id, case when not l.readable then 'path_unreadable_at_labelled_commit' when not l.alive then 'entity_not_found_at_labelled_commit' end as failure_reason,
    l.last_pos - l.pos as n_revisions_observed, e.pos - l.pos as persistence_revisions, cast(floor((epoch_us(e.ts) - epoch_us(l.ts)) / 86400000000.0) as bigint) as persistence_days,
    epoch_us(e.ts) < epoch_us(l.ts) as days_anomalous_negative, l.death_pos is null as censored,
    case when l.death_pos is null then 'right_censored_at_last_observed_revision' else e.cause end as death_reason, l.ts as labelled_commit_date,
    cast(e.event_id as varchar) as death_commit, e.ts as death_commit_date, cast(z.event_id as varchar) as last_observed_commit, z.ts as last_observed_commit_date
  from fates l join fates e on e.user_id = l.user_id and e.pos = coalesce(l.death_pos, l.last_pos) join fates z on z.user_id = l.user_id and z.pos = l.last_pos where l.pos = 1)""", "fates"))
def _(spark, sf):
    history = survival.revision_ordinal(V.revisions(spark, sf), ["user_id"], "ts", ["event_id"])
    return _plain_dates(survival.persistence_walk(history, ["user_id"], "ordinal", "ts", "readable", "alive", "holds", "event_id"))


@query("censoring_summary", sql("""select count(*) as n, count(*) filter (where censored) as n_censored, round(100.0::double * avg(case when censored then 1.0::double else 0 end), 8) as pct_censored from survivals""", "survivals"))
def _(spark, sf):
    df = V.persistence(spark, sf).filter("failure_reason is null")
    return summaries.censoring_summary(df).withColumn("pct_censored", F.round("pct_censored", 8))


@query("total_revisions", sql("select cast(sum(n_revisions_observed) as bigint) as total_revisions from survivals", "survivals"))
def _(spark, sf):
    return summaries.total_revisions(V.persistence(spark, sf).filter("failure_reason is null"))


# --- commit graph: orders of a customer as commits of a repository ---------------------------
# Finished (O) orders form the main line; each has its predecessor as first parent and, for keys
# divisible by 5, the order three back as second. F orders are branch tips that grow from the
# latest main commit before them; P orders are commits no reference reaches.

_COMMITS = """select cast(o_custkey as varchar) as repo, lpad(cast(o_orderkey as varchar), 12, '0') as sha, o_orderkey as n, o_orderdate as committer_date,
  o_orderpriority as author_email, o_orderstatus as status, cast(cast(floor(o_totalprice / 100000) as bigint) as varchar) as content from orders"""
_MAIN = f"""select repo, sha, n, committer_date, lag(sha, 1) over w as p1, lag(sha, 3) over w as p3, first_value(sha) over (partition by repo order by committer_date desc, sha desc) as head_sha
  from ({_COMMITS}) where status = 'O' window w as (partition by repo order by committer_date, sha)"""
_EDGES = f"""select repo, sha, p1 as parent_sha from main where p1 is not null union all select repo, sha, p3 from main where p3 is not null and n % 5 = 0
  union all select * from (select c.repo, c.sha, (select max_by(m.sha, (m.committer_date, m.sha)) from main m where m.repo = c.repo and (m.committer_date, m.sha) < (c.committer_date, c.sha)) as parent_sha
    from commits c where status = 'F') where parent_sha is not null"""
_GRAPH = f"commits as ({_COMMITS}), main as ({_MAIN}), edges as ({_EDGES}), heads as (select distinct repo, head_sha from main)"


def _commits(spark, sf):
    return V.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("repo"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("sha"), F.col("o_orderkey").alias("n"),
        F.col("o_orderdate").alias("committer_date"), F.col("o_orderpriority").alias("author_email"), F.col("o_orderstatus").alias("status"),
        F.floor(F.col("o_totalprice") / 100000).cast("string").alias("content"),
    )


def _graph(spark, sf):
    """``(commits, parents, heads)``; each customer has a few dozen orders, so plain windows serve to build the test graph."""
    commits = _commits(spark, sf)
    line = W.partitionBy("repo").orderBy("committer_date", "sha")
    main = F.col("status") == "O"
    placed = commits.withColumn("latest", F.last(F.when(main, F.col("sha")), ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, -1)))
    trunk = placed.filter(main).withColumn("third", F.lag("sha", 3).over(line))
    parents = placed.filter(F.col("status").isin("O", "F")).select("repo", "sha", F.col("latest").alias("parent_sha"), F.lit(0).alias("parent_no"))
    parents = parents.unionByName(trunk.filter(F.col("n") % 5 == 0).select("repo", "sha", F.col("third").alias("parent_sha"), F.lit(1).alias("parent_no")))
    heads = trunk.groupBy("repo").agg(F.max(F.struct("committer_date", "sha")).alias("t")).select("repo", F.col("t.sha").alias("head_sha"))
    # These stand for stored tables, so they are written before the graph queries read them.
    return cut_lineage(commits), cut_lineage(parents.filter(F.col("parent_sha").isNotNull())), cut_lineage(heads)


_REACH = f"""with recursive {_GRAPH}, reach as (select repo, head_sha as root, head_sha as sha from heads union select r.repo, r.root, e.parent_sha from reach r join edges e on e.repo = r.repo and e.sha = r.sha)"""


@query("reachable", f"{_REACH} select repo, root, sha from reach")
def _(spark, sf):
    commits, parents, heads = _graph(spark, sf)
    return G.reachable(parents, heads.select("repo", F.col("head_sha").alias("root")), commits)


@query("is_ancestor", f"{_REACH} select c.repo, c.sha as commit, h.head_sha as of, r.sha is not null as is_ancestor from commits c join heads h on h.repo = c.repo left join reach r on r.repo = c.repo and r.sha = c.sha")
def _(spark, sf):
    commits, parents, heads = _graph(spark, sf)
    pairs = commits.select("repo", F.col("sha").alias("commit")).join(heads.withColumnRenamed("head_sha", "of"), "repo")
    return G.is_ancestor(pairs, parents, commits)


@query("generation", f"""with {_GRAPH} select c.repo, c.sha, case when c.status = 'P' then 0 when c.status = 'O' then m.pos else coalesce(f.pos + 1, 0) end as generation
  from commits c left join (select repo, sha, row_number() over (partition by repo order by committer_date, sha) - 1 as pos from main) m on m.repo = c.repo and m.sha = c.sha
  left join edges e on c.status = 'F' and e.repo = c.repo and e.sha = c.sha
  left join (select repo, sha, row_number() over (partition by repo order by committer_date, sha) - 1 as pos from main) f on f.repo = e.repo and f.sha = e.parent_sha""")
def _(spark, sf):
    commits, parents, _ = _graph(spark, sf)
    return G.generation(parents, commits)


_META = "author_email, 'd' || (n % 2) as author_date, 's' || (n % 3) as subject"


def _with_meta(commits):
    return commits.withColumns({"author_date": F.concat(F.lit("d"), F.col("n") % 2), "subject": F.concat(F.lit("s"), F.col("n") % 3)})


def _blobs(commits):
    """One file per commit; its content is missing for the dearest orders."""
    return commits.filter("content <> '4'").select("repo", "sha", F.lit("f").alias("path"), "content")


_REMAP = f"""select t.repo, t.sha, c.sha as candidate_sha from
  (select *, (select count(*) from meta o where o.repo = m.repo and o.author_email = m.author_email and o.author_date = m.author_date and o.subject = m.subject and o.sha <> m.sha and o.status <> 'P') as others
   from meta m) t join meta c on c.repo = t.repo and c.author_email = t.author_email and c.author_date = t.author_date and c.subject = t.subject and c.sha <> t.sha and c.status <> 'P'
  where others = 1 and t.content = c.content and t.content <> '4'"""


@query("remap_commit", f"with {_GRAPH}, meta as (select *, {_META} from commits) {_REMAP}")
def _(spark, sf):
    commits = _with_meta(_commits(spark, sf))
    reached = commits.filter("status <> 'P'").select("repo", "sha")
    return G.remap_commit(commits, _blobs(commits), commits.select("repo", "sha", F.lit("f").alias("path")), reached).drop("path")


@query("resolve_effective_commit", f"""{_REACH}, meta as (select *, {_META} from commits), remaps as ({_REMAP})
  select c.repo, c.sha, h.head_sha, case when r.sha is not null then c.sha when rc.sha is not null then m.candidate_sha end as effective_sha,
    r.sha is null and rc.sha is not null as remapped,
    case when r.sha is not null or rc.sha is not null then null when m.candidate_sha is not null then 'remap_candidate_not_ancestor_of_head' else 'commit_not_ancestor_of_head' end as reason
  from commits c left join heads h on h.repo = c.repo left join reach r on r.repo = c.repo and r.sha = c.sha
  left join remaps m on m.repo = c.repo and m.sha = c.sha left join reach rc on rc.repo = c.repo and rc.sha = m.candidate_sha""")
def _(spark, sf):
    commits, parents, heads = _graph(spark, sf)
    commits = _with_meta(commits)
    targets = commits.select("repo", "sha", F.lit("f").alias("path"))
    out = G.resolve_effective_commit(targets, heads, commits, parents, _blobs(commits), commits.filter("status <> 'P'").select("repo", "sha"))
    return out.drop("path")


# Files: a commit touches the file of its number mod 3; every 7th renames it from the next file.
_CHANGES = "select repo, sha, 'f' || (n % 3) as path, case when n % 7 = 0 then 'f' || ((n + 1) % 3) end as old_path from commits"
# Walked from the first main commit to the head, for each of the three files.
_HISTORY = f"""{_REACH.replace('recursive', 'recursive', 1)}, starts as (select repo, min_by(sha, (committer_date, sha)) as from_sha from main group by 1),
  span as (select r.repo, s.from_sha, r.root as head_sha, r.sha, row_number() over (partition by r.repo order by m.committer_date, m.sha) as at, m.committer_date
    from reach r join starts s on s.repo = r.repo join main m on m.repo = r.repo and m.sha = r.sha where r.sha <> s.from_sha),
  changes as ({_CHANGES}), names as (select * from (values ('f0'), ('f1'), ('f2')) v(path)),
  touched as (select p.*, c.path as name, c.old_path from span p join changes c on c.repo = p.repo and c.sha = p.sha),
  walk as (
    select s.repo, n.path, s.from_sha, h.head_sha, n.path as name, 1000000000::bigint as below, (select max(t.at) from touched t where t.repo = s.repo and t.name = n.path and t.old_path is not null) as since
    from starts s join heads h on h.repo = s.repo join names n on true
    union select w.repo, w.path, w.from_sha, w.head_sha, r.old_path, w.since, (select max(t.at) from touched t where t.repo = w.repo and t.name = r.old_path and t.old_path is not null and t.at < w.since)
    from walk w join touched r on r.repo = w.repo and r.at = w.since)
  select w.repo, w.path, w.from_sha, w.head_sha, row_number() over (partition by w.repo, w.path order by t.at) as ordinal, t.sha, epoch_us(t.committer_date) as committer_date, t.name as path_at_commit
  from walk w join touched t on t.repo = w.repo and t.name = w.name and t.at < w.below and (w.since is null or t.at >= w.since)"""


def _file_changes(commits):
    n = F.col("n")
    return commits.select("repo", "sha", F.concat(F.lit("f"), n % 3).alias("path"), F.when(n % 7 == 0, F.concat(F.lit("f"), (n + 1) % 3)).alias("old_path"))


@query("history_after", _HISTORY)
def _(spark, sf):
    commits, parents, heads = _graph(spark, sf)
    starts = commits.filter("status = 'O'").groupBy("repo").agg(F.min(F.struct("committer_date", "sha")).alias("t")).select("repo", F.col("t.sha").alias("from_sha"))
    targets = starts.join(heads, "repo").withColumn("path", F.explode(F.array(*[F.lit(f"f{i}") for i in range(3)])))
    out = G.history_after(targets, commits.select("repo", "sha", "committer_date"), parents, _file_changes(commits))
    return out.withColumn("committer_date", F.unix_micros("committer_date"))


@query("lookup_content", f"with commits as ({_COMMITS}) select repo, sha, 'f' as path, case when content <> '4' then content end as content from commits")
def _(spark, sf):
    commits = _commits(spark, sf)
    return G.lookup_content(commits.select("repo", "sha", F.lit("f").alias("path")), _blobs(commits)).select("repo", "sha", "path", "content")


@query("parse_commit_log", """select lpad(cast(o_orderkey as varchar), 12, '0') as sha, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as committer_date, i as position,
  case i when 0 then 'src/' || o_orderpriority else 'doc|' || o_orderstatus end as path from orders join (values (0), (1)) v(i) on i < o_orderkey % 3""")
def _(spark, sf):
    path = scratch_path(spark, "log")
    k = F.col("o_orderkey")
    head = F.concat_ws("|", F.lit("COMMIT"), F.lpad(k.cast("string"), 12, "0"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    paths = F.slice(F.array(F.concat(F.lit("src/"), "o_orderpriority"), F.concat(F.lit("doc|"), "o_orderstatus")), 1, (k % 3).cast("int"))
    V.table(spark, sf, "orders").select(F.concat_ws("\n", head, F.lit(""), F.array_join(paths, "\n"))).write.text(path)
    return tables.parse_commit_log(spark, path)


@query("parse_commit_meta", """select lpad(cast(o_orderkey as varchar), 12, '0') as sha, o_orderpriority as author_email, strftime(o_orderdate, '%Y-%m-%d') as author_date,
  'fix|' || o_orderstatus as subject from orders where o_orderkey % 4 <> 0""")
def _(spark, sf):
    k = F.col("o_orderkey")
    subject = F.when(k % 4 != 0, F.concat(F.lit("fix|"), "o_orderstatus"))
    line = F.concat_ws("|", F.lpad(k.cast("string"), 12, "0"), "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd"), subject)
    return tables.parse_commit_meta(V.table(spark, sf, "orders").select(line.alias("value")))

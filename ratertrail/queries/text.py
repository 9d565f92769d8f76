"""Queries on source text: page markup as it is, and code texts written from every order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratertrail.functions import scalar as S
from ratertrail.operators import source_text as T
from ratertrail.plans.pipelines import complexity_table, persistence_table
from ratertrail.queries import views as V
from ratertrail.queries.history import _GRAPH, _graph
from ratertrail.queries.registry import query
from ratertrail.session import cut_lineage
from ratertrail.operators.matching import normalise_classes, normalise_functions

# One literal or comment, or the text up to the next one.
_TOKEN = r"""'"(?:[^"\\]|\\(?s:.))*\\?"?|''(?:[^''\\]|\\(?s:.))*\\?''?|//[^\n]*|/\*(?s:.)*?(?:\*/|\z)|[^"''/]+|/'"""
_MASK = r"""array_to_string(list_transform(regexp_extract_all({text}, {token}), lambda t: case
  when starts_with(t, '//') then ' /' || repeat(' ', length(t) - 2) when starts_with(t, '/*') then regexp_replace(t, '[^\n]', ' ', 'g')
  when regexp_full_match(t, '"(?:[^"\\]|\\(?s:.))*"') then '"' || repeat(' ', length(t) - 2) || '"' when regexp_full_match(t, '''(?:[^''\\]|\\(?s:.))*''') then '''' || repeat(' ', length(t) - 2) || ''''
  when t[1] in ('"', '''') then t[1] || repeat(' ', length(t) - 1) else t end), '')"""


def _mask_sql(text: str) -> str:
    return _MASK.replace("{text}", text).replace("{token}", _TOKEN)


@query("mask_source", f"select page_id, {_mask_sql('html')} as mask from pages")
def _(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", T.mask_source("html").alias("mask"))


@query("mask_source_documents", f"select doc_id, md5({_mask_sql('text')}) as mask_md5 from documents")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.md5(T.mask_source("text")).alias("mask_md5"))


# A class per order: n functions (getters, setters, or branching ones that call others) and pad lines.
_SHAPE = """select o_orderkey as k, cast(o_custkey as varchar) as repo, o_orderstatus as status, o_custkey % 25 as n, o_orderkey % 250 as pad, o_totalprice as price,
  case o_orderkey % 4 when 0 then 'blob' when 1 then 'data class' when 2 then 'feature envy' else 'long method' end as smell from orders"""
_TEXT_SQL = r"""'package p;' || chr(10) || '// order ' || k || ' with { brace' || chr(10) || '/* block " { */' || chr(10) || 'public class Order' || k || ' {' || chr(10)
  || '    private String s = "open { brace \" and more";' || chr(10)
  || array_to_string(list_transform(range(1, n + 1), lambda i: case status when 'O' then '    public int getF' || i || '() { return f' || i || '; }' || chr(10)
     when 'F' then '    public void setF' || i || '(int f) { this.f' || i || ' = f; }' || chr(10)
     else '    public int run' || i || '(int a, java.util.Map<K, V> b) {' || chr(10) || case when i = 1 then repeat('        int x;' || chr(10), pad) else '' end
       || '        if (a > 0) { other.call(a); }' || chr(10) || '        return helper.go(a);' || chr(10) || '    }' || chr(10) end), '')
  || case when status <> 'P' then repeat('    int x;' || chr(10), pad) else '' end || '}' || chr(10) || 'class After { }' || chr(10)"""


def _sources(spark, sf):
    k = F.col("o_orderkey")
    shape = V.table(spark, sf, "orders").select(
        k.alias("k"), F.col("o_custkey").cast("string").alias("repo"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 25).alias("n"), (k % 250).cast("int").alias("pad"),
        F.col("o_totalprice").alias("price"), S.case_recode([(k % 4 == 0, "blob"), (k % 4 == 1, "data class"), (k % 4 == 2, "feature envy")], "long method").alias("smell"),
    )
    # Writing and reading the texts is the work here, so the keys are spread over the cluster first.
    shape = shape.repartition(2 * spark.sparkContext.defaultParallelism, "k")
    numbers = F.filter(F.sequence(F.lit(0).cast("long"), F.col("n")), lambda i: i > 0)
    branching = lambda i: F.concat(
        F.lit("    public int run"), i, F.lit("(int a, java.util.Map<K, V> b) {\n"), F.when(i == 1, F.repeat(F.lit("        int x;\n"), F.col("pad"))).otherwise(""),
        F.lit("        if (a > 0) { other.call(a); }\n        return helper.go(a);\n    }\n"))
    function = lambda i: F.when(F.col("status") == "O", F.concat(F.lit("    public int getF"), i, F.lit("() { return f"), i, F.lit("; }\n"))).when(
        F.col("status") == "F", F.concat(F.lit("    public void setF"), i, F.lit("(int f) { this.f"), i, F.lit(" = f; }\n"))).otherwise(branching(i))
    text = F.concat(
        F.lit("package p;\n// order "), "k", F.lit(' with { brace\n/* block " { */\npublic class Order'), "k", F.lit(' {\n    private String s = "open { brace \\" and more";\n'),
        F.array_join(F.transform(numbers, function), ""), F.when(F.col("status") != "P", F.repeat(F.lit("    int x;\n"), F.col("pad"))).otherwise(""), F.lit("}\nclass After { }\n"),
    )
    name = F.concat(F.lit("p.Order"), "k")
    signature = F.when(F.col("status") == "O", "#getF1").when(F.col("status") == "F", "#setF1 int").otherwise("#run1 int|Map<K, V>")
    code_name = F.when(F.col("smell").isin(*S.CLASS_SMELLS), name).otherwise(F.concat(name, signature))
    return shape.withColumns({"text": text, "code_name": code_name})


_CLASS_END = "5 + case when status = 'P' then 4 * n + case when n > 0 then pad else 0 end else n + pad end + 1"


@query("mask_source_code", f"select k, md5(text) as text_md5, md5({_mask_sql('text')}) as mask_md5 from (select k, {_TEXT_SQL} as text from ({_SHAPE}))")
def _(spark, sf):
    return _sources(spark, sf).select("k", F.md5("text").alias("text_md5"), F.md5(T.mask_source("text")).alias("mask_md5"))


@query("find_class_span", f"select k, 4 as start_line, cast({_CLASS_END} as int) as end_line from ({_SHAPE})")
def _(spark, sf):
    found = _sources(spark, sf).select("k", T.find_class_span(F.col("text"), F.concat(F.lit("Order"), "k")).alias("s"))
    return found.select("k", "s.start_line", "s.end_line")


@query("find_function_span", f"select k, case when n > 0 then 6 end as start_line, cast(case when n > 0 then case when status = 'P' then 9 + pad else 6 end end as int) as end_line from ({_SHAPE})")
def _(spark, sf):
    name = F.when(F.col("status") == "O", "getF1").when(F.col("status") == "F", "setF1").otherwise("run1")
    n_params = F.when(F.col("status") == "O", 0).when(F.col("status") == "F", 1).otherwise(2)
    found = _sources(spark, sf).select("k", T.find_function_span(F.col("text"), name, n_params).alias("s"))
    return found.select("k", "s.start_line", "s.end_line")


@query("list_functions", f"""select k, i as ordinal, case status when 'O' then 'getF' when 'F' then 'setF' else 'run' end || i as name from (select *, unnest(range(1, n + 1)) as i from ({_SHAPE}))""")
def _(spark, sf):
    listed = _sources(spark, sf).select("k", F.posexplode(T.list_functions("text")).alias("at", "f"))
    return listed.select("k", (F.col("at") + 1).cast("long").alias("ordinal"), "f.name")


_CLASS_LINES = f"({_CLASS_END} - 3)"
_STATUS = f"""case when smell in ('blob', 'data class') then true else n > 0 end as alive,
  case smell when 'blob' then {_CLASS_LINES} >= 200 and n >= 20 when 'data class' then n > 0 and status <> 'P'
    when 'feature envy' then case when n > 0 then status = 'P' end else case when n > 0 then status = 'P' and pad + 4 >= 100 end end as holds"""


@query("entity_status", f"select k, smell, {_STATUS} from ({_SHAPE})")
def _(spark, sf):
    return T.entity_status(_sources(spark, sf), "text", "smell", "code_name").select("k", "smell", "alive", "holds")


@query("status_by_revision", f"""select k, price <= 450000 as readable, case when readable then alive end as alive, case when readable then holds end as holds from
  (select *, price <= 450000 as readable from (select k, price, {_STATUS} from ({_SHAPE})))""")
def _(spark, sf):
    src = _sources(spark, sf).withColumns({"sha": F.col("k").cast("string"), "path": F.lit("src/Order.java")})
    blobs = src.filter("price <= 450000").select("repo", "sha", "path", F.col("text").alias("content"))
    out = T.status_by_revision(src.select("k", "repo", "sha", "path", "smell", "code_name"), blobs)
    return out.select("k", "readable", "alive", "holds")


# --- whole stages ---------------------------------------------------------------------------
# Instances: two entities per customer labelled at the customer's first main commit. Every commit
# of the main line holds the text of its order, in which the class always is called Order.


def _pipeline(spark, sf, fates=False):
    """The stage's tables run through it. With ``fates`` a customer's number mod 5 decides what befalls its repository: nothing (0),
    the labelled commit was rewritten and is found again (1), was never seen (2), there is no clone (3), no such file (4)."""
    commits, parents, heads = _graph(spark, sf)
    texts = _sources(spark, sf).select("repo", F.lpad(F.col("k").cast("string"), 12, "0").alias("sha"), F.lit("src/Order.java").alias("path"),
                                       F.regexp_replace("text", "class Order\\d+", "class Order").alias("content"))
    starts = commits.filter("status = 'O'").groupBy("repo").agg(F.min(F.struct("committer_date", "sha")).alias("t")).select("repo", F.col("t.sha").alias("commit_hash"))
    labelled = starts.withColumn("smell", F.explode(F.array(F.lit("data class"), F.lit("feature envy"))))
    instances = labelled.select(
        S.instance_key("repo", "smell").alias("instance_id"), F.col("repo").cast("long").alias("sample_id"), "smell", F.lit("minor").alias("severity_consensus"),
        F.col("repo").alias("repository"), "commit_hash", F.lit("/src/Order.java").alias("path"),
        F.when(F.col("smell") == "data class", "p.Order").otherwise("p.Order#getF1").alias("code_name"),
    )
    changes = commits.select("repo", "sha", F.lit("src/Order.java").alias("path"), F.lit(None).cast("string").alias("old_path"))
    stamps = commits.withColumns({"author_date": F.lit("d"), "subject": F.col("sha")})
    if fates:
        fate, lost = F.col("repository").cast("long") % 5, F.concat(F.lit("lost-"), "commit_hash")
        instances = instances.withColumns({"commit_hash": F.when(fate.isin(1, 2), lost).otherwise(F.col("commit_hash")), "path": F.when(fate == 4, "/src/None.java").otherwise(F.col("path"))})
        heads = heads.filter(F.col("repo").cast("long") % 5 != 3)
        # The rewritten commit is a twin of the first one of the main line: the same stamps and text under another hash.
        twin = starts.filter(F.col("repo").cast("long") % 5 == 1).select("repo", F.col("commit_hash").alias("sha"))
        renamed = lambda t: t.join(twin, ["repo", "sha"], "left_semi").withColumn("sha", F.concat(F.lit("lost-"), "sha"))
        stamps, texts = stamps.unionByName(renamed(stamps)), cut_lineage(texts)
        texts = texts.unionByName(renamed(texts))
    # These stand for stored tables, so they are written before the stage reads them.
    return persistence_table(*[cut_lineage(t) for t in (instances, heads, stamps, parents, changes, texts)])


_WALK = f"""with {_GRAPH}, shape as ({_SHAPE}),
  line as (select m.repo, m.sha, m.committer_date, s.n, row_number() over (partition by m.repo order by m.committer_date, m.sha) - 1 as pos from main m join shape s on s.k = m.n),
  smells as (select * from (values ('data class'), ('feature envy')) v(smell)),
  states as (select l.*, smell, case when smell = 'data class' then true else n > 0 end as alive, case when smell = 'data class' then n > 0 else false end as holds from line l cross join smells),
  labels as (select repo, smell from states where pos = 0 and alive),
  fate as (select repo, smell, max(pos) as last_pos, min(pos) filter (where pos > 0 and (not alive or not holds)) as death from states group by 1, 2)
  select repo || '::' || smell as instance_id, cast(last_pos as bigint) as n_revisions_observed, cast(coalesce(death, last_pos) as bigint) as persistence_revisions, death is null as censored,
    case when death is null then 'right_censored_at_last_observed_revision' when not s.alive then 'entity_not_found' else 'condition_no_longer_holds' end as death_reason, s.sha as death_commit,
    cast(floor((epoch_us(s.committer_date) - epoch_us(z.committer_date)) / 86400000000.0) as bigint) as persistence_days
  from fate f join labels using (repo, smell) join states s on s.repo = f.repo and s.smell = f.smell and s.pos = coalesce(death, last_pos) join states z on z.repo = f.repo and z.smell = f.smell and z.pos = 0"""


@query("persistence_pipeline", _WALK)
def _(spark, sf):
    table, _ = _pipeline(spark, sf)
    return table.select("instance_id", "n_revisions_observed", "persistence_revisions", "censored", "death_reason", "death_commit", "persistence_days")


@query("persistence_pipeline_provenance", f"""with {_GRAPH}, shape as ({_SHAPE}), starts as (select repo, min_by(sha, (committer_date, sha)) as sha, min_by(n, (committer_date, sha)) as k from main group by 1),
  given as (select s.repo, s.sha, s.repo::bigint % 5 as fate, v.smell, h.n from starts s join shape h using (k) cross join (values ('data class'), ('feature envy')) v(smell)),
  judged as (select *, case when fate = 3 then 'repo_not_cloned' when fate = 2 then 'commit_not_ancestor_of_head' when fate = 4 then 'path_unreadable_at_labelled_commit'
    when smell = 'feature envy' and n = 0 then 'entity_not_found_at_labelled_commit' end as reason from given)
  select repo || '::' || smell as instance_id, reason, case when reason is null then case when fate = 1 then 'lost-' else '' end || sha end as original_commit_hash,
    case when reason is null then sha end as effective_commit_hash, case when reason is null then fate = 1 end as commit_remapped from judged""")
def _(spark, sf):
    """Every instance: the commits it was walked from, or why it was not."""
    table, failures = _pipeline(spark, sf, fates=True)
    none = F.lit(None).cast("string")
    walked = table.select("instance_id", none.alias("reason"), "original_commit_hash", "effective_commit_hash", "commit_remapped")
    return walked.unionByName(failures.select("instance_id", "reason", none.alias("original_commit_hash"), none.alias("effective_commit_hash"), F.lit(None).cast("boolean").alias("commit_remapped")))


def _complexity(spark, sf):
    part = V.table(spark, sf, "part")
    key = F.col("p_partkey")
    name = F.concat(F.lit("org."), F.replace("p_name", F.lit(" "), F.lit("$")))
    value = [key.cast("double").alias(c) for c in ("wmc", "cbo", "dit", "noc", "rfc", "lcom", "loc", "totalMethodsQty", "totalFieldsQty")]
    classes = normalise_classes(part.select(F.lit("r").alias("repository"), key.alias("ordinal"), F.concat(F.lit("/w/"), "p_brand").alias("file"), name.alias("class"), *value), "/w")
    methods = normalise_functions(part.select(F.lit("r").alias("repository"), key.alias("ordinal"), name.alias("class"), F.concat(F.lit("run/"), F.col("p_size") % 5, F.lit("[int]")).alias("method"), *value[:1], *value[1:2], *value[4:5], *value[6:7]))
    instances = part.select(
        key.cast("string").alias("instance_id"), key.alias("sample_id"), S.case_recode([(key % 4 == 0, "blob"), (key % 4 == 1, "data class"), (key % 4 == 2, "feature envy")], "long method").alias("smell"),
        F.lit("none").alias("severity_consensus"), F.lit("r").alias("repository"), F.concat(F.lit("/"), "p_brand").alias("path"),
        F.concat(F.lit("org."), F.replace("p_name", F.lit(" "), F.lit(".")), F.when(key % 7 == 0, "X").otherwise(""), F.when(key % 4 >= 2, "#run A|B").otherwise("")).alias("code_name"),
    )
    return complexity_table(instances, classes, methods, "0.7.0")


_PARTS = """p as (select *, case p_partkey % 4 when 0 then 'blob' when 1 then 'data class' when 2 then 'feature envy' else 'long method' end as smell, p_partkey % 4 < 2 as on_class, p_partkey % 7 = 0 as lost from part),
  a as (select p_name, count(*) n, min(p_partkey) f from part group by 1), b as (select p_name, p_brand, count(*) n, min(p_partkey) f from part group by 1, 2), c as (select p_name, min(p_partkey) f from part where p_size % 5 = 2 group by 1)"""


@query("complexity_pipeline", f"""with {_PARTS}, m as (select p.*, case when on_class then case when a.n = 1 then 'class_fqcn' when b.n = 1 then 'class_fqcn+path' else 'class_fqcn_ambiguous_first_match' end
    else case when c.f is not null then 'method_fqcn+name+arity' else 'method_fqcn+name_only' end end as join_level,
    case when on_class then case when a.n > 1 and b.n = 1 then b.f else a.f end else coalesce(c.f, a.f) end as hit
  from p join a using (p_name) join b using (p_name, p_brand) left join c using (p_name) where not lost)
  select cast(p_partkey as varchar) as instance_id, smell, join_level, case when on_class then hit::double end as wmc, hit::double as cbo, hit::double as loc, case when on_class then hit::double end as total_fields,
    case when not on_class then hit::double end as method_cyclomatic_complexity from m""")
def _(spark, sf):
    return _complexity(spark, sf)[0].select("instance_id", "smell", "join_level", "wmc", "cbo", "loc", "total_fields", "method_cyclomatic_complexity")


@query("complexity_pipeline_failures", f"with {_PARTS} select cast(p_partkey as varchar) as instance_id, smell, 'complexity' as stage, 'no_join_match' as reason from p where lost")
def _(spark, sf):
    return _complexity(spark, sf)[1].select("instance_id", "smell", "stage", "reason")


# Brands are repositories: by the last digit of its name a brand is not cloned (5), fails at the tool (3), leaves unreadable
# output (2) or fails at the checkout (4); of the last, 44 and 54 succeed at the commit that their content re-identifies.
_FATE = """case right(p_brand, 1) when '5' then 'repo_not_cloned' when '4' then case when p_brand in ('Brand#44', 'Brand#54') then null else 'checkout_failed' end when '3' then 'ck_failed' when '2' then 'ck_output_unreadable' end"""


@query("complexity_pipeline_provenance", f"""select cast(p_partkey as varchar) as instance_id, coalesce({_FATE}, case when p_partkey % 7 = 0 then 'no_join_match' end) as reason,
  case when {_FATE} is null and p_partkey % 7 > 0 then 'c ' || p_brand end as original_commit_hash,
  case when {_FATE} is null and p_partkey % 7 > 0 then case right(p_brand, 1) when '4' then 'd ' else 'c ' end || p_brand end as effective_commit_hash,
  case when {_FATE} is null and p_partkey % 7 > 0 then right(p_brand, 1) = '4' end as commit_remapped from part""")
def _(spark, sf):
    """Every part as an instance of its brand: measured with its commits, or failed for one of five reasons."""
    part = V.table(spark, sf, "part")
    key, digit = F.col("p_partkey"), F.right("p_brand", F.lit(1))
    name = F.concat(F.lit("p.C"), key)
    classes = normalise_classes(part.select(F.col("p_brand").alias("repository"), key.alias("ordinal"), F.concat(F.lit("/w/"), key).alias("file"), name.alias("class"),
                                            *[key.cast("double").alias(c) for c in ("wmc", "cbo", "dit", "noc", "rfc", "lcom", "loc", "totalMethodsQty", "totalFieldsQty")]), "/w")
    methods = normalise_functions(spark.createDataFrame([], "repository string, ordinal long, class string, method string, cbo double, rfc double, loc double, wmc double"))
    instances = part.select(
        key.cast("string").alias("instance_id"), key.alias("sample_id"), F.lit("blob").alias("smell"), F.lit("none").alias("severity_consensus"), F.col("p_brand").alias("repository"),
        F.concat(F.lit("c "), "p_brand").alias("commit_hash"), F.lit("/a").alias("path"), F.when(key % 7 == 0, "p.None").otherwise(name).alias("code_name"),
    )
    brands = part.select(F.col("p_brand").alias("repo"), digit.alias("digit")).distinct()
    both = brands.select("repo", "digit", F.explode(F.array(F.lit("c "), F.lit("d "))).alias("c")).withColumn("sha", F.concat("c", "repo"))
    commits = both.filter("c = 'c ' or digit = '4'").select("repo", "sha", F.lit("a").alias("author_email"), F.lit("t").alias("author_date"), F.lit("s").alias("subject"))
    blobs = both.select("repo", "sha", F.lit("a").alias("path"), F.when(F.col("repo").isin("Brand#44", "Brand#54"), "same").otherwise(F.col("sha")).alias("content"))
    checkouts = both.select("repo", "sha", ((F.col("c") == "d ") | (F.col("digit") != "4")).alias("ok"), F.lit("not our ref").alias("error"))
    runs = brands.select("repo", (F.col("digit") != "3").alias("ok"), (F.col("digit") != "2").alias("readable"), F.lit("tool").alias("error"))
    given = [cut_lineage(t) for t in (instances, classes, methods, brands.filter("digit <> '5'").select(F.col("repo").alias("repository")), checkouts, runs, commits, blobs)]
    instances, classes, methods, cloned, checkouts, runs, commits, blobs = given
    table, failures = complexity_table(instances, classes, methods, "0.7.0", None, cloned, checkouts, runs, commits, blobs)
    none = F.lit(None).cast("string")
    measured = table.select("instance_id", none.alias("reason"), "original_commit_hash", "effective_commit_hash", "commit_remapped")
    return measured.unionByName(failures.select("instance_id", "reason", none.alias("original_commit_hash"), none.alias("effective_commit_hash"), F.lit(None).cast("boolean").alias("commit_remapped")))

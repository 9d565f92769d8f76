"""The stages from instances to the persistence and metric tables, failures included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratertrail.functions.scalar import CLASS_SMELLS, parse_function_name, project_by_kind, relative_path
from ratertrail.operators.audit import attach_group_fact, pending_only, split_matched, union_failures
from ratertrail.operators.dedupe import first_per_key
from ratertrail.operators.graph import history_after, remap_commit, resolve_effective_commit
from ratertrail.operators.matching import match_class_tiered, match_function_tiered
from ratertrail.operators.source_text import status_by_revision
from ratertrail.operators.survival import persistence_walk
from ratertrail.session import cut_lineage
from ratertrail.sources import schemas

# Fixed value: the mark of the method that judged survival.
PROXY_METHOD = "entity_alive+size_shape_proxy_v1"


def representatives(instances: DataFrame) -> DataFrame:
    """``repo, sha, path``: commit and path of each repository's first instance."""
    if "commit_hash" not in instances.columns:  # metrics may stand without a known commit
        instances = instances.withColumn("commit_hash", F.lit(None).cast("string"))
    first = first_per_key(instances.select("repository", "sample_id", "smell", "commit_hash", "path"), ["repository"], ["sample_id", "smell"])
    return first.select(F.col("repository").alias("repo"), F.col("commit_hash").alias("sha"), relative_path("path").alias("path"))


def persistence_table(
    instances: DataFrame,
    heads: DataFrame,
    commits: DataFrame,
    commit_parents: DataFrame,
    file_changes: DataFrame,
    blobs: DataFrame,
    reachable_commits: DataFrame | None = None,
    done: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(persistence, failures)`` of all instances, or of those not ``done`` yet.

    Commits are resolved once per repository, at its first instance whether done or not; histories walked once per file, texts judged once
    per distinct content; only keys travel until the texts are fetched.
    """
    todo = instances if done is None else pending_only(instances, done, "instance_id")
    todo = todo.withColumn("path", relative_path("path"))
    cloned, missing = split_matched(
        attach_group_fact(todo, heads.select(F.col("repo").alias("repository"), "head_sha"), "repository"),
        F.col("head_sha").isNotNull(), "persistence_history", "repo_not_cloned", F.col("repository"),
    )
    resolved = resolve_effective_commit(representatives(instances), heads, commits, commit_parents, blobs, reachable_commits)
    facts = cut_lineage(resolved.select(F.col("repo").alias("repository"), "effective_sha", "remapped", "reason"))
    placed = attach_group_fact(cloned, facts, "repository")
    walked, lost = split_matched(placed, F.col("effective_sha").isNotNull(), "persistence_history", F.col("reason"), F.col("commit_hash"))
    walked = walked.withColumn("repo", F.col("repository"))

    file_key = ["repo", "path", "from_sha", "head_sha"]
    files = walked.select("repo", "path", F.col("effective_sha").alias("from_sha"), "head_sha").distinct()
    later = history_after(files, commits, commit_parents, file_changes).select(*file_key, "ordinal", "sha", F.col("committer_date").alias("ts"), "path_at_commit")
    dates = commits.select("repo", F.col("sha").alias("from_sha"), F.col("committer_date").alias("ts"))
    label = files.join(dates, ["repo", "from_sha"], "left").select(
        *file_key, F.lit(0).cast("long").alias("ordinal"), F.col("from_sha").alias("sha"), "ts", F.col("path").alias("path_at_commit")
    )
    asked = walked.select("instance_id", "smell", "code_name", "repo", "path", F.col("effective_sha").alias("from_sha"), "head_sha")
    revisions = asked.join(label.unionByName(later), file_key).select(
        "instance_id", "smell", "code_name", "repo", "ordinal", "sha", "ts", F.col("path_at_commit").alias("path")
    )
    fates = persistence_walk(status_by_revision(revisions, blobs), ["instance_id"], "ordinal", "ts", "readable", "alive", "holds", "sha")
    fates = cut_lineage(fates)
    joined = walked.join(fates, "instance_id")
    alive, unborn = split_matched(joined, F.col("failure_reason").isNull(), "persistence_history", F.col("failure_reason"), F.col("code_name"))
    table = alive.select(
        "instance_id", "sample_id", "smell", "severity_consensus", "repository", F.col("path").alias("path_at_label"), "code_name",
        F.col("commit_hash").alias("original_commit_hash"), F.col("remapped").alias("commit_remapped"),
        F.col("effective_sha").alias("effective_commit_hash"), F.col("head_sha").alias("head_sha_used"),
        *[c for c in fates.columns if c not in ("instance_id", "failure_reason")], F.lit(PROXY_METHOD).alias("proxy_method"),
    )
    return _as_declared(table, schemas.PERSISTENCE), _as_declared(union_failures(missing, lost, unborn), schemas.FAILURES)


def _as_declared(df: DataFrame, declared: str) -> DataFrame:
    """The declared columns in their order and types."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in T._parse_datatype_string(declared)])


def measured_commits(
    instances: DataFrame,
    cloned: DataFrame | None = None,
    checkouts: DataFrame | None = None,
    tool_runs: DataFrame | None = None,
    commits: DataFrame | None = None,
    blobs: DataFrame | None = None,
) -> DataFrame:
    """Per repository: ``original_sha, effective_sha, remapped`` and, where it couldn't be measured, ``reason, detail``.

    ``cloned`` lists repositories; ``checkouts`` (repo, sha, ok, error) and ``tool_runs`` (repo, ok,
    readable, error) hold outcomes, and what has no row failed. Of several attempts a successful one counts, then the one
    whose error text comes last. A failed checkout is tried again at the
    commit that the first path's content re-identifies, when ``commits`` and ``blobs`` are given.
    Tables left out stand for success everywhere.
    """
    state = representatives(instances)
    yes = F.lit(True)
    state = state.withColumn("here", yes) if cloned is None else state.join(cloned.select(F.col("repository").alias("repo"), yes.alias("here")).distinct(), "repo", "left")
    tries = None if checkouts is None else checkouts.groupBy("repo", "sha").agg(F.max(F.struct("ok", "error")).alias("t"))
    none = F.lit(None).cast("string")
    if tries is None:
        state = state.withColumns({"ok": yes, "error": none})
    else:
        state = state.join(tries.select("repo", "sha", F.coalesce("t.ok", F.lit(False)).alias("ok"), F.col("t.error").alias("error")), ["repo", "sha"], "left")
    state = cut_lineage(state.withColumn("ok", F.coalesce("ok", F.lit(False))))
    if tries is None or commits is None or blobs is None:
        state = state.withColumns({"candidate_sha": none, "then_ok": F.lit(False), "then_error": none})
    else:
        remaps = remap_commit(commits, blobs, state.filter("here and not ok"))
        second = tries.select("repo", F.col("sha").alias("candidate_sha"), F.coalesce("t.ok", F.lit(False)).alias("then_ok"), F.col("t.error").alias("then_error"))
        state = state.join(remaps, ["repo", "sha", "path"], "left").join(second, ["repo", "candidate_sha"], "left")
    if tool_runs is None:
        state = state.withColumns({"ran": yes, "readable": yes, "run_error": none})
    else:
        runs = tool_runs.groupBy("repo").agg(F.max(F.struct("ok", "readable", "error")).alias("t"))
        state = state.join(runs.select("repo", F.coalesce("t.ok", F.lit(False)).alias("ran"), F.coalesce("t.readable", F.lit(False)).alias("readable"), F.col("t.error").alias("run_error")), "repo", "left")
    out, then = F.col("ok"), F.coalesce("then_ok", F.lit(False))
    both = F.concat(F.lit("original: "), F.coalesce("error", F.lit("")), F.lit(" | after remap to "), F.col("candidate_sha"), F.lit(": "), F.coalesce("then_error", F.lit("")))
    reason = (
        F.when(F.col("here").isNull(), "repo_not_cloned").when(~out & ~then, "checkout_failed")
        .when(~F.coalesce("ran", F.lit(False)), "ck_failed").when(~F.coalesce("readable", F.lit(False)), "ck_output_unreadable")
    )
    detail = (
        F.when(F.col("here").isNull(), F.col("repo")).when(~out & ~then, F.coalesce(both, "error")).otherwise(F.col("run_error"))
    )
    return cut_lineage(state.select(
        F.col("repo").alias("repository"), F.col("sha").alias("original_sha"), F.when(~out & then, F.col("candidate_sha")).otherwise(F.col("sha")).alias("effective_sha"),
        (~out & then).alias("remapped"), reason.alias("reason"), detail.alias("detail"),
    ))


def complexity_table(
    instances: DataFrame, classes: DataFrame, methods: DataFrame, version: str, done: DataFrame | None = None, cloned: DataFrame | None = None,
    checkouts: DataFrame | None = None, tool_runs: DataFrame | None = None, commits: DataFrame | None = None, blobs: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(complexity, failures)``: instances with the metrics of the entity they name, and the commit measured.

    ``classes`` and ``methods`` are normalised metric tables with ``repository`` and the file order
    ``ordinal``. For the other tables see ``measured_commits``; a repository without measures fails as a whole.
    """
    todo = instances if done is None else pending_only(instances, done, "instance_id")
    facts = measured_commits(instances, cloned, checkouts, tool_runs, commits, blobs)
    todo, unmeasured = split_matched(attach_group_fact(todo, facts, "repository"), F.col("reason").isNull(), "complexity", F.col("reason"), F.col("detail"))
    c = F.col
    own = todo.columns
    by_class = todo.filter(c("smell").isin(*CLASS_SMELLS)).withColumns({"class_name": c("code_name"), "__path": c("path"), "path": relative_path("path")})
    measures = ["wmc", "cbo", "dit", "noc", "rfc", "lcom", "loc", "totalMethodsQty", "totalFieldsQty"]
    on_class = match_class_tiered(by_class, classes, "class_name", "path", ["ordinal"], measures, ["repository"])
    on_class = on_class.withColumn("path", c("__path")).select(*own, "join_level", *measures)
    name = parse_function_name("code_name")
    by_function = todo.filter(~c("smell").isin(*CLASS_SMELLS)).withColumns(
        {"class_name": name["class_name"], "function_name": name["function_name"], "n_params": name["n_params"]}
    )
    on_function = match_function_tiered(by_function, methods, ["class_name", "function_name"], "arity", "n_params", ["ordinal"], ["cbo", "rfc", "loc", "wmc"], ["repository"])
    both = on_class.unionByName(on_function.select(*own, "join_level", "cbo", "rfc", "loc", "wmc"), allowMissingColumns=True)
    matched, failures = split_matched(
        both, c("join_level").isNotNull(), "complexity", "no_join_match",
        F.concat(F.lit("code_name="), F.coalesce("code_name", F.lit("")), F.lit(" path="), F.coalesce("path", F.lit(""))),
    )
    projected = project_by_kind("smell", {
        "wmc": (c("wmc"), None), "cbo": (c("cbo"), c("cbo")), "dit": (c("dit"), None), "noc": (c("noc"), None), "rfc": (c("rfc"), c("rfc")),
        "lcom": (c("lcom"), None), "loc": (c("loc"), c("loc")), "total_methods": (c("totalMethodsQty"), None),
        "total_fields": (c("totalFieldsQty"), None), "method_cyclomatic_complexity": (None, c("wmc")),
    })
    table = matched.select(
        "instance_id", "sample_id", "smell", "severity_consensus", "repository", c("original_sha").alias("original_commit_hash"), c("remapped").alias("commit_remapped"),
        c("effective_sha").alias("effective_commit_hash"), c("path").alias("path_at_label"), "code_name", "join_level", *projected, F.lit(version).alias("ck_version"),
    )
    return _as_declared(table, schemas.COMPLEXITY), _as_declared(union_failures(unmeasured, failures), schemas.FAILURES)

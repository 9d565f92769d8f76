"""Queries on commit graphs given as edge tables.

Repositories of at most ``SMALL_EDGES`` edges are packed into groups of about that size and each group is swept in one
task: in topological order, with a bit for each of a few roots, or with the longest path so far. Larger repositories
go by *jumps*: one chosen parent per commit forms chains, and joining the chain table with itself
doubles the distance of a jump. A chain of n commits is closed in log2(n) joins instead of n; only switches to another
parent of a merge cost a further round. Each round is written to the shared folder, so the rounds survive lost executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratertrail.functions.ordering import group_ordinal, time_band
from ratertrail.session import cut_lineage

#: Edges of a repository, or of a group of repositories, that one task may hold.
SMALL_EDGES = 100_000
#: Roots that are swept together; more roots of a repository go to further groups.
ROOTS_AT_ONCE = 16
CHANGE_ORDER = ("committer_date", "generation", "sha")


def _chain(parents: DataFrame) -> DataFrame:
    """One parent per commit: the first by ``parent_no`` when given, else the least."""
    by = ["parent_no", "parent_sha"] if "parent_no" in parents.columns else ["parent_sha"]
    return parents.groupBy("repo", "sha").agg(F.min(F.struct(*by)).alias("p")).select("repo", "sha", F.col("p.parent_sha").alias("to"))


def jump_tables(commit_parents: DataFrame) -> list[DataFrame]:
    """Tables ``repo, sha, to`` of 1, 2, 4, ... steps along the chains, up to the longest chain."""
    levels, step = [], cut_lineage(_chain(commit_parents.filter(F.col("parent_sha").isNotNull())))
    while not step.isEmpty():
        levels.append(step)
        far = step.select("repo", F.col("sha").alias("to"), F.col("to").alias("far"))
        step = cut_lineage(step.join(far, ["repo", "to"]).select("repo", "sha", F.col("far").alias("to")))
    return levels


def _sorted_by_size(commit_parents: DataFrame, repos: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Known edges with a ``pack`` for those of small repositories, and those of larger ones (None if there are none)."""
    edges = commit_parents.filter(F.col("parent_sha").isNotNull())
    edges = edges if repos is None else edges.join(repos.select("repo").distinct(), "repo", "left_semi")
    sizes = cut_lineage(edges.groupBy("repo").agg(F.count("*").alias("edges")))
    small = F.col("edges") <= SMALL_EDGES
    total, large = sizes.agg(F.sum(F.when(small, F.col("edges"))), F.count_if(~small)).first()
    # A few packs for each core where there is little to do; by size where there is much.
    packs = max(-(-(total or 0) // SMALL_EDGES), min(4 * edges.sparkSession.sparkContext.defaultParallelism, (total or 0) // 500 + 1))
    packed = edges.join(sizes.filter(~small), "repo", "left_anti") if large else edges
    packed = packed.select("repo", "sha", "parent_sha", F.pmod(F.xxhash64("repo"), F.lit(packs)).alias("pack"))
    return packed, edges.join(sizes.filter(~small), "repo", "left_semi") if large else None


class _Graph:
    """The commits of some repositories, numbered, and their edges in an order in which children come before parents."""

    def __init__(self, edges: pd.DataFrame):
        self.repo = np.concatenate([edges["repo"].to_numpy(object)] * 2)
        self.sha = np.concatenate([edges["sha"].to_numpy(object), edges["parent_sha"].to_numpy(object)])
        numbers, self.names = pd.factorize(self._named(self.repo, self.sha))
        first = np.zeros(len(self.names), np.int64)
        first[numbers[::-1]] = np.arange(len(numbers))[::-1]
        self.repo, self.sha = self.repo[first], self.sha[first]
        self.child, self.parent = numbers[: len(edges)], numbers[len(edges) :]

    @staticmethod
    def _named(repo: np.ndarray, sha: np.ndarray) -> np.ndarray:
        return repo + "\0" + sha if len(repo) else np.zeros(0, object)

    def __len__(self) -> int:
        return len(self.names)

    def number(self, repo: pd.Series, sha: pd.Series) -> np.ndarray:
        """The number of each commit, -1 for one without edges."""
        return pd.Index(self.names, dtype=object).get_indexer(self._named(repo.to_numpy(object), sha.to_numpy(object)))

    def topological(self) -> np.ndarray | None:
        """The places of the edges, children first; None if there is a cycle."""
        order = np.argsort(self.child, kind="stable")
        starts = np.searchsorted(self.child[order], np.arange(len(self) + 1))
        waiting = np.bincount(self.parent, minlength=len(self))
        ready, done = np.flatnonzero(waiting == 0), []
        while len(ready):
            # All edges of the commits that nothing waits for any more.
            counts = starts[ready + 1] - starts[ready]
            places = order[np.repeat(starts[ready] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())]
            done.append(places)
            freed = np.bincount(self.parent[places], minlength=0)
            hit = np.flatnonzero(freed)
            waiting[hit] -= freed[hit]
            ready = hit[waiting[hit] == 0]
        found = np.concatenate(done) if done else np.zeros(0, np.int64)
        return found if len(found) == len(self.child) else None

    def sweep(self, bits: np.ndarray) -> np.ndarray:
        """The bits of every commit and of all from which it is reached."""
        places = self.topological()
        bits = bits.tolist()
        child, parent = self.child.tolist(), self.parent.tolist()
        if places is not None:
            for e in places.tolist():
                bits[parent[e]] |= bits[child[e]]
            return np.array(bits, np.int64)
        changed = True
        while changed:
            changed = False
            for c, p in zip(child, parent):
                if bits[c] & ~bits[p]:
                    bits[p] |= bits[c]
                    changed = True
        return np.array(bits, np.int64)

    def longest(self) -> np.ndarray:
        """The number of steps on the longest way down from every commit."""
        places = self.topological()
        if places is None:
            raise ValueError("the parents of some commits form a cycle")
        steps, child, parent = [0] * len(self), self.child.tolist(), self.parent.tolist()
        for e in reversed(places.tolist()):
            c, p = child[e], parent[e]
            if steps[p] >= steps[c]:
                steps[c] = steps[p] + 1
        return np.array(steps, np.int64)


def _apart(df: DataFrame) -> DataFrame:
    """The same columns under identities of their own, for a cogroup with a relative."""
    return df.toDF(*df.columns)


def _with_goes(roots: DataFrame, name: str) -> DataFrame:
    """Distinct roots ``repo, name`` with a ``go`` and a ``bit``: few roots of a repository share a go."""
    ordinal = F.row_number().over(W.partitionBy("repo").orderBy(name)) - 1
    return roots.select("repo", name).distinct().withColumn("at", ordinal).select(
        "repo", name, F.floor(F.col("at") / ROOTS_AT_ONCE).cast("int").alias("go"), (F.col("at") % ROOTS_AT_ONCE).cast("int").alias("bit"))


def _swept(graph: _Graph, roots: pd.DataFrame, name: str) -> tuple[_Graph, np.ndarray]:
    bits, at = np.zeros(len(graph), np.int64), graph.number(roots["repo"], roots[name])
    np.bitwise_or.at(bits, at[at >= 0], np.int64(1) << roots["bit"].to_numpy(np.int64)[at >= 0])
    return graph, graph.sweep(bits) if len(graph) else bits


def _reach_in_tasks(packed: DataFrame, roots: DataFrame) -> DataFrame:
    """``repo, root, sha`` without the roots that have no edges."""
    goes = _with_goes(roots, "root")
    edges = _apart(packed.join(goes.select("repo", "go").distinct(), "repo"))
    asked = goes.join(packed.select("repo", "pack").distinct(), "repo")

    def reach(edges: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        graph, bits = _swept(_Graph(edges), asked, "root")
        place = {(r, b): root for r, root, b in zip(asked["repo"], asked["root"], asked["bit"])}
        hit, bit = np.nonzero(bits[:, None] >> np.arange(ROOTS_AT_ONCE)[None, :] & 1)
        if not len(hit):
            return pd.DataFrame()  # columns without rows don't survive the way back from a cogroup
        repo = graph.repo[hit]
        return pd.DataFrame({"repo": repo, "root": [place[at] for at in zip(repo, bit)], "sha": graph.sha[hit]})

    return edges.groupBy("pack", "go").cogroup(asked.groupBy("pack", "go")).applyInPandas(reach, "repo string, root string, sha string")


def reachable(commit_parents: DataFrame, roots: DataFrame, commits: DataFrame | None = None, sized: tuple | None = None) -> DataFrame:
    """``repo, root, sha``: every commit reachable from each root, itself included.

    With ``commits`` given, roots not found there are unknown and reach nothing. ``sized`` takes the parents as sorted by
    size already.
    """
    roots = roots.select(F.col("repo").cast("string").alias("repo"), F.col("root").cast("string").alias("root")).distinct()
    if commits is not None:
        roots = roots.join(commits.select("repo", F.col("sha").alias("root")), ["repo", "root"], "left_semi")
    roots = cut_lineage(roots)
    packed, large = _sorted_by_size(commit_parents, roots) if sized is None else sized
    swept = _reach_in_tasks(packed, roots)
    own = roots.withColumn("sha", F.col("root"))
    if large is None:
        # A root without edges reaches itself alone; the others come with the sweep.
        return cut_lineage(swept.unionByName(own).distinct())
    far = _reach_by_jumps(large, roots.join(large.select("repo").distinct(), "repo", "left_semi"))
    return cut_lineage(swept.unionByName(own).unionByName(far).distinct())


def _reach_by_jumps(parents: DataFrame, roots: DataFrame) -> DataFrame:
    levels = jump_tables(parents)
    others = parents.select("repo", "sha", F.col("parent_sha").alias("to")).join(levels[0], ["repo", "sha", "to"], "left_anti")
    others = cut_lineage(others.distinct())
    merges = not others.isEmpty()

    seen: list[DataFrame] = []
    fresh = roots.withColumn("sha", F.col("root"))
    while True:
        span = fresh
        for level in reversed(levels):
            hop = span.join(level, ["repo", "sha"], "left")
            span = hop.select("repo", "root", F.explode(F.array_compact(F.array("sha", "to"))).alias("sha")).distinct()
        # What was seen before stays where it was written; only new rows are.
        for before in seen:
            span = span.join(before, ["repo", "root", "sha"], "left_anti")
        seen.append(cut_lineage(span))
        entry = seen[-1].join(others, ["repo", "sha"]).select("repo", "root", F.col("to").alias("sha")).distinct() if merges else None
        for before in seen if merges else ():
            entry = entry.join(before, ["repo", "root", "sha"], "left_anti")
        fresh = cut_lineage(entry) if merges else None
        if fresh is None or fresh.isEmpty():
            return reduce(DataFrame.unionByName, seen)


def generation(commit_parents: DataFrame, commits: DataFrame, sized: tuple | None = None) -> DataFrame:
    """``repo, sha, generation``: steps on the longest way down to a commit without parents, so every parent is below its child.

    Commits without edges are 0; a cycle of parents is an error.
    """
    packed, large = _sorted_by_size(commit_parents, commits) if sized is None else sized

    def longest(edges: pd.DataFrame) -> pd.DataFrame:
        graph = _Graph(edges)
        return pd.DataFrame({"repo": graph.repo, "sha": graph.sha, "generation": graph.longest()})

    found = packed.groupBy("pack").applyInPandas(longest, "repo string, sha string, generation long")
    if large is not None:
        found = found.unionByName(_generation_by_jumps(large))
    return commits.select("repo", "sha").join(found, ["repo", "sha"], "left").fillna({"generation": 0})


def _generation_by_jumps(parents: DataFrame) -> DataFrame:
    """Longest ways by doubling along the chains; every switch to another parent on such a way costs a round."""
    edges = parents.select("repo", "sha", F.col("parent_sha").alias("to")).distinct()
    levels = jump_tables(parents)
    others = cut_lineage(edges.join(levels[0], ["repo", "sha", "to"], "left_anti"))
    nodes = edges.select("repo", "sha").unionByName(edges.select("repo", F.col("to").alias("sha"))).distinct()
    now = cut_lineage(nodes.withColumn("generation", F.lit(0).cast("long")))
    most = now.count()
    while True:
        for exponent, level in enumerate(levels):
            below = now.select("repo", F.col("sha").alias("to"), (F.col("generation") + (1 << exponent)).alias("via"))
            raised = level.join(below, ["repo", "to"]).select("repo", "sha", "via")
            now = cut_lineage(now.join(raised, ["repo", "sha"], "left").select("repo", "sha", F.greatest("generation", "via").alias("generation")))
        below = now.select("repo", F.col("sha").alias("to"), (F.col("generation") + 1).alias("via"))
        raised = others.join(below, ["repo", "to"]).groupBy("repo", "sha").agg(F.max("via").alias("via"))
        raised = cut_lineage(raised.join(now, ["repo", "sha"]).filter("via > generation").select("repo", "sha", "via"))
        if raised.isEmpty():
            return now
        now = cut_lineage(now.join(raised, ["repo", "sha"], "left").select("repo", "sha", F.greatest("generation", "via").alias("generation")))
        if now.agg(F.max("generation")).first()[0] > most:
            raise ValueError("the parents of some commits form a cycle")


def is_ancestor(pairs: DataFrame, commit_parents: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """Adds ``is_ancestor`` to ``repo, commit, of``; a commit is its own ancestor, an unknown one is none.

    The sweep answers the pairs that are asked, and nothing else is written.
    """
    asked = pairs.select(*[F.col(c).cast("string").alias(c) for c in ("repo", "commit", "of")]).dropna().distinct()
    if commits is not None:
        asked = asked.join(commits.select("repo", F.col("sha").alias("of")), ["repo", "of"], "left_semi")
    asked = cut_lineage(asked)
    packed, large = _sorted_by_size(commit_parents, asked)
    goes = _with_goes(asked, "of")
    edges = _apart(packed.join(goes.select("repo", "go").distinct(), "repo"))
    placed = asked.join(goes, ["repo", "of"]).join(packed.select("repo", "pack").distinct(), "repo")

    def answer(edges: pd.DataFrame, placed: pd.DataFrame) -> pd.DataFrame:
        graph, bits = _swept(_Graph(edges), placed, "of")
        at = graph.number(placed["repo"], placed["commit"])
        hit = (at >= 0) & (np.r_[bits, 0][at] >> placed["bit"].to_numpy(np.int64) & 1 == 1)
        return pd.DataFrame({c: placed[c].to_numpy(object)[hit] for c in ("repo", "commit", "of")}) if hit.any() else pd.DataFrame()

    hits = edges.groupBy("pack", "go").cogroup(placed.groupBy("pack", "go")).applyInPandas(answer, "repo string, commit string, of string")
    hits = hits.unionByName(asked.filter("commit = of").select("repo", "commit", "of"))
    if large is not None:
        far = _reach_by_jumps(large, asked.join(large.select("repo").distinct(), "repo", "left_semi").select("repo", F.col("of").alias("root")).distinct())
        hits = hits.unionByName(far.select("repo", F.col("sha").alias("commit"), F.col("root").alias("of")).join(asked, ["repo", "commit", "of"], "left_semi"))
    hits = hits.distinct().withColumn("__hit", F.lit(True))
    return pairs.join(hits, ["repo", "commit", "of"], "left").withColumn("is_ancestor", F.coalesce("__hit", F.lit(False))).select(*pairs.columns, "is_ancestor")


def content_digests(blobs: DataFrame) -> DataFrame:
    """Content by SHA-256 and length, taken at the scan so that texts stay out of shuffles."""
    return blobs.filter(F.col("content").isNotNull()).select(
        "repo", "sha", "path", F.struct(F.sha2("content", 256).alias("hash"), F.length("content").alias("length")).alias("digest")
    )


def lookup_content(revisions: DataFrame, blobs: DataFrame) -> DataFrame:
    """Adds ``content`` of ``(repo, sha, path)``; null when there is none."""
    key = ["repo", "sha", "path"]
    asked = blobs.select(*key, "content").join(revisions.select(*key).distinct(), key, "left_semi")
    return revisions.join(asked, key, "left")


def remap_commit(
    commits: DataFrame, blobs: DataFrame, targets: DataFrame, reachable_commits: DataFrame | None = None
) -> DataFrame:
    """``repo, sha, path, candidate_sha`` for targets ``repo, sha, path`` re-identified under another hash.

    Each path is verified for itself. A candidate shares author, author date and subject, is the only other commit that does, and
    holds the same content at the path. Commits of equal metadata are counted, not paired.
    ``reachable_commits`` (``repo, sha``) limits the candidates; by default all commits count.
    """
    meta = ["repo", "author_email", "author_date", "subject"]
    pool = commits if reachable_commits is None else commits.join(reachable_commits.select("repo", "sha"), ["repo", "sha"], "left_semi")
    twins = pool.groupBy(*meta).agg(F.count("*").alias("n"), F.min("sha").alias("lo"), F.max("sha").alias("hi"))
    wanted = targets.select("repo", "sha", "path").join(commits.select(*meta, "sha"), ["repo", "sha"]).join(twins, meta)
    if reachable_commits is None:
        wanted = wanted.withColumn("inside", F.lit(1))
    else:
        inside = reachable_commits.select("repo", "sha").distinct().withColumn("inside", F.lit(1))
        wanted = wanted.join(inside, ["repo", "sha"], "left").fillna({"inside": 0})
    only = wanted.filter(F.col("n") - F.col("inside") == 1).withColumn(
        "candidate_sha", F.when((F.col("inside") == 1) & (F.col("lo") == F.col("sha")), F.col("hi")).otherwise(F.col("lo"))
    )
    # Only contents that are asked for are read and digested.
    asked = only.select("repo", F.explode(F.array("sha", "candidate_sha")).alias("sha"), "path").distinct()
    digests = content_digests(blobs.join(asked, ["repo", "sha", "path"], "left_semi"))
    mine = digests.withColumnRenamed("digest", "__mine")
    theirs = digests.select("repo", F.col("sha").alias("candidate_sha"), "path", F.col("digest").alias("__theirs"))
    checked = only.join(mine, ["repo", "sha", "path"]).join(theirs, ["repo", "candidate_sha", "path"])
    return checked.filter(F.col("__mine") == F.col("__theirs")).select("repo", "sha", "path", "candidate_sha").distinct()


def resolve_effective_commit(
    targets: DataFrame,
    heads: DataFrame,
    commits: DataFrame,
    commit_parents: DataFrame,
    blobs: DataFrame,
    reachable_commits: DataFrame | None = None,
) -> DataFrame:
    """The commit to walk from, for targets ``repo, sha, path``: itself, a verified remap, or a reason.

    Adds ``head_sha, effective_sha, remapped, reason``.
    """
    pinned = targets.join(heads.select("repo", "head_sha"), "repo", "left")
    reach = reachable(commit_parents, heads.select("repo", F.col("head_sha").alias("root")), commits)
    on_head = reach.select("repo", F.col("root").alias("head_sha"), "sha", F.lit(True).alias("__on"))
    first = pinned.join(on_head, ["repo", "head_sha", "sha"], "left")
    remaps = remap_commit(commits, blobs, first.filter(F.col("__on").isNull()), reachable_commits)
    second = first.join(remaps, ["repo", "sha", "path"], "left").join(
        on_head.select("repo", "head_sha", F.col("sha").alias("candidate_sha"), F.col("__on").alias("__then")),
        ["repo", "head_sha", "candidate_sha"],
        "left",
    )
    direct, via = F.coalesce("__on", F.lit(False)), F.coalesce("__then", F.lit(False))
    return second.select(
        *targets.columns,
        "head_sha",
        F.when(direct, F.col("sha")).when(via, F.col("candidate_sha")).alias("effective_sha"),
        (~direct & via).alias("remapped"),
        F.when(direct | via, F.lit(None).cast("string"))
        .when(F.col("candidate_sha").isNotNull(), "remap_candidate_not_ancestor_of_head")
        .otherwise("commit_not_ancestor_of_head")
        .alias("reason"),
    )


def history_after(
    targets: DataFrame,
    commits: DataFrame,
    commit_parents: DataFrame,
    file_changes: DataFrame,
    order: Sequence[str] = CHANGE_ORDER,
) -> DataFrame:
    """Changes to a file strictly after a commit, through renames, oldest first.

    Targets are ``repo, path, from_sha, head_sha``; the result adds ``ordinal, sha,
    committer_date, path_at_commit``. Commits count when reachable from the head and not from
    ``from_sha``. The walk starts at the head under the given path; before the latest change
    that renamed a file to the current name, the old name is followed.
    """
    key, span = ["repo", "path", "from_sha", "head_sha"], ["repo", "from_sha", "head_sha"]
    wanted = targets.select(*key).distinct()
    ends = cut_lineage(wanted.select(*span).distinct())
    names = _names_in_question(wanted, file_changes)
    sized = _sorted_by_size(commit_parents, ends)
    commits = known = commits.join(ends.select("repo").distinct(), "repo", "left_semi")
    touched = file_changes.select("repo", "sha", F.col("path").alias("name"), "old_path").join(names, ["repo", "name"], "left_semi")
    if "generation" in order and "generation" not in commits.columns:
        commits = commits.join(generation(commit_parents, commits, sized), ["repo", "sha"])
    dated = touched.join(commits.select("repo", *dict.fromkeys(["sha", "committer_date", *order])), ["repo", "sha"])
    roots = ends.select("repo", F.explode(F.array("from_sha", "head_sha")).alias("root"))
    reach = reachable(commit_parents, roots, known, sized)
    upto_head = ends.join(reach.withColumnRenamed("root", "head_sha"), ["repo", "head_sha"])
    between = upto_head.join(reach.withColumnRenamed("root", "from_sha"), ["repo", "from_sha", "sha"], "left_anti")
    changes = cut_lineage(between.join(dated, ["repo", "sha"]).withColumn("at", F.struct(*order)))

    segments = _segments(wanted, changes, key, span)
    inside = (F.col("below").isNull() | (F.col("at") < F.col("below"))) & (F.col("since").isNull() | (F.col("at") >= F.col("since")))
    found = segments.join(changes, [*span, "name"]).filter(inside)
    found = found.select(*key, "sha", *[c for c in order if c != "sha"], F.col("name").alias("path_at_commit"))
    numbered = group_ordinal(found, key, list(order), time_band("committer_date"))
    return numbered.select(*key, "ordinal", "sha", "committer_date", "path_at_commit")


def _names_in_question(wanted: DataFrame, file_changes: DataFrame) -> DataFrame:
    """``repo, name``: the asked paths, and every name that some rename in their repositories left behind; no other name is ever followed."""
    renamed = file_changes.filter("old_path is not null").select("repo", F.col("old_path").alias("name"))
    return wanted.select("repo", F.col("path").alias("name")).unionByName(renamed.join(wanted.select("repo").distinct(), "repo", "left_semi")).distinct()


def _segments(wanted: DataFrame, changes: DataFrame, key: Sequence[str], span: Sequence[str]) -> DataFrame:
    """``key, name, since, below``: under which name a file is followed from which change (null: the first) to before which.

    A rename is a node; the one that counts before it is the latest older one to its old name. These
    pointers are found for all renames at once and followed by doubling.
    """
    stamp = changes.schema["at"].dataType
    renames = changes.filter(F.col("old_path").isNotNull()).groupBy(*span, "name", "at").agg(F.max("old_path").alias("old_path"))
    renames = cut_lineage(renames)
    none = F.lit(None).cast(stamp)
    # For every start and every rename: the latest rename to the name it looks for that is older than it is.
    seeks = renames.select(*span, F.col("old_path").alias("name"), F.col("at").alias("seen_at"), F.lit(None).cast("string").alias("path")).unionByName(
        wanted.select(*span, F.col("path").alias("name"), none.alias("seen_at"), "path"))
    line = renames.select(*span, "name", F.col("at").alias("seen_at"), F.lit(None).cast("string").alias("path"), F.lit(True).alias("is_rename")).unionByName(seeks.withColumn("is_rename", F.lit(False)))
    # A start looks from the end of all changes; a rename does not see itself, nor one at the same change.
    ordered = W.partitionBy(*span, "name").orderBy(F.col("seen_at").asc_nulls_last(), "is_rename").rowsBetween(W.unboundedPreceding, -1)
    latest = F.last(F.when(F.col("is_rename"), F.col("seen_at")), ignorenulls=True).over(ordered)
    pointers = cut_lineage(line.withColumn("next", latest).filter(~F.col("is_rename")).select(*span, "name", "seen_at", "path", "next"))
    first = pointers.filter(F.col("path").isNotNull()).select(*key, F.col("next").alias("node"))
    to = renames.select(*span, "at", "old_path").join(
        pointers.filter(F.col("path").isNull()).select(*span, F.col("name").alias("old_path"), F.col("seen_at").alias("at"), "next"), [*span, "old_path", "at"])
    # A change may rename several files, so a node is a change and the name it gave.
    step = renames.join(to.select(*span, "at", "old_path", "next").distinct(), [*span, "at", "old_path"]).select(
        *span, F.struct("at", "name").alias("node"), F.struct(F.col("next").alias("at"), F.col("old_path").alias("name")).alias("to"), F.col("old_path"))
    step = cut_lineage(step)
    starts = first.select(*key, F.struct(F.col("node").alias("at"), F.col("path").alias("name")).alias("node"))
    levels, jump = [], step.select(*span, "node", "to")
    while not jump.isEmpty():
        levels.append(jump)
        further = jump.select(*span, F.col("node").alias("to"), F.col("to").alias("far"))
        jump = cut_lineage(jump.join(further, [*span, "to"]).select(*span, "node", F.col("far").alias("to")))
    visited = starts
    for level in reversed(levels):
        hop = visited.join(level, [*span, "node"], "left")
        visited = hop.select(*key, F.explode(F.array_compact(F.array("node", "to"))).alias("node")).distinct()
    visited = cut_lineage(visited)
    # A visited node stands for the name up to there: since its change (null: none renamed to it), and before the change that led to it.
    led = visited.join(step, [*span, "node"]).select(*key, F.col("to").alias("node"), F.col("node.at").alias("below"))
    return visited.join(led, [*key, "node"], "left").select(*key, F.col("node.name").alias("name"), F.col("node.at").alias("since"), "below")

import random
from datetime import datetime, timedelta

import pytest

from ratertrail.operators import graph as G

T0 = datetime(2024, 1, 1)


def _random_graph(seed, n=60, repo="r"):
    rng = random.Random(seed)
    edges = []
    for i in range(1, n):
        for j in {rng.randrange(max(0, i - 6), i) for _ in range(rng.choice([1, 1, 2, 3]))}:
            edges.append((repo, f"c{i:03d}", f"c{j:03d}"))
    return edges


def _ancestors(edges, root):
    seen, todo = {root}, [root]
    while todo:
        c = todo.pop()
        for _, child, parent in edges:
            if child == c and parent not in seen:
                seen.add(parent)
                todo.append(parent)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_reachable_matches_a_plain_walk(spark, seed):
    edges = _random_graph(seed) + _random_graph(seed + 10, 20, "s")
    parents = spark.createDataFrame(edges, "repo string, sha string, parent_sha string")
    roots = [("r", "c059"), ("r", "c030"), ("r", "c000"), ("s", "c019")]
    got = {}
    for r in G.reachable(parents, spark.createDataFrame(roots, "repo string, root string")).collect():
        assert r.sha not in got.setdefault((r.repo, r.root), set()), "each commit once"
        got[r.repo, r.root].add(r.sha)
    assert got == {(repo, root): _ancestors([e for e in edges if e[0] == repo], root) for repo, root in roots}


def test_ancestor_is_reflexive_transitive_and_false_for_unknown(spark):
    edges = _random_graph(3, 25)
    parents = spark.createDataFrame(edges, "repo string, sha string, parent_sha string")
    names = [f"c{i:03d}" for i in range(25)]
    commits = spark.createDataFrame([("r", c) for c in names], "repo string, sha string")
    pairs = [("r", a, b) for a in [*names, "zzz"] for b in ("c024", "c012", "zzz")]
    got = {(r.commit, r.of): r.is_ancestor for r in G.is_ancestor(spark.createDataFrame(pairs, "repo string, commit string, of string"), parents, commits).collect()}
    assert len(got) == len(pairs) and got["c012", "c012"] and got["c024", "c024"] and not got["zzz", "zzz"] and not got["zzz", "c024"]
    for a in names:
        assert got[a, "c024"] == (a in _ancestors(edges, "c024"))
        if got[a, "c012"] and got["c012", "c024"]:
            assert got[a, "c024"]


def test_long_chain_needs_few_rounds(spark):
    edges = [("r", f"c{i:05d}", f"c{i - 1:05d}") for i in range(1, 3000)]
    parents = spark.createDataFrame(edges, "repo string, sha string, parent_sha string")
    assert len(G.jump_tables(parents)) == 12
    assert G.reachable(parents, spark.createDataFrame([("r", "c02999")], "repo string, root string")).count() == 3000


def _commits(spark, names, **meta):
    rows = [("r", c, *meta.get(c, ("a", "d", c)), T0 + timedelta(hours=i)) for i, c in enumerate(names)]
    return spark.createDataFrame(rows, "repo string, sha string, author_email string, author_date string, subject string, committer_date timestamp")


def test_history_follows_renames_and_stops_at_the_label(spark):
    names = [f"c{i}" for i in range(7)]
    parents = spark.createDataFrame([("r", names[i], names[i - 1]) for i in range(1, 7)], "repo string, sha string, parent_sha string")
    changes = spark.createDataFrame(
        [("r", "c1", "old", None), ("r", "c2", "old", None), ("r", "c3", "other", None), ("r", "c4", "new", "old"), ("r", "c5", "new", None), ("r", "c6", "old", None)],
        "repo string, sha string, path string, old_path string",
    )
    targets = spark.createDataFrame([("r", "new", "c1", "c6"), ("r", "old", "c1", "c6"), ("r", "new", "c6", "c6")], "repo string, path string, from_sha string, head_sha string")
    rows = G.history_after(targets, _commits(spark, names), parents, changes).collect()
    seen = lambda path: [(r.sha, r.path_at_commit) for r in sorted(rows, key=lambda r: r.ordinal) if r.path == path]
    assert seen("new") == [("c2", "old"), ("c4", "new"), ("c5", "new")]
    assert seen("old") == [("c2", "old"), ("c6", "old")]
    assert not [r for r in rows if r.from_sha == "c6"]


def test_equal_dates_follow_the_graph(spark):
    names = ["z", "m", "a"]
    commits = _commits(spark, names).withColumn("committer_date", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(T0))
    parents = spark.createDataFrame([("r", "m", "z"), ("r", "a", "m")], "repo string, sha string, parent_sha string")
    changes = spark.createDataFrame([("r", "m", "f", None), ("r", "a", "f", None)], "repo string, sha string, path string, old_path string")
    rows = G.history_after(spark.createDataFrame([("r", "f", "z", "a")], "repo string, path string, from_sha string, head_sha string"), commits, parents, changes).collect()
    assert [r.sha for r in sorted(rows, key=lambda r: r.ordinal)] == ["m", "a"]


def test_remaps_need_a_unique_twin_of_equal_content(spark):
    same = {"x": ("a", "d", "one"), "x2": ("a", "d", "one"), "y": ("a", "d", "two"), "y2": ("a", "d", "two"), "z": ("a", "d", "3"), "z2": ("a", "d", "3"), "z3": ("a", "d", "3"), "w": ("a", "d", "4"), "w2": ("a", "d", "4")}
    commits = _commits(spark, list(same), **same)
    blobs = spark.createDataFrame([("r", "x", "f", "t"), ("r", "x2", "f", "t"), ("r", "y", "f", "t"), ("r", "y2", "f", "other"), ("r", "z", "f", "t"), ("r", "z2", "f", "t"), ("r", "z3", "f", "t"), ("r", "w2", "f", "t")],
                                  "repo string, sha string, path string, content string")
    targets = spark.createDataFrame([("r", c, "f") for c in ("x", "y", "z", "w")], "repo string, sha string, path string")
    inside = spark.createDataFrame([("r", c) for c in ("x2", "y2", "z2", "z3", "w2")], "repo string, sha string")
    assert [(r.sha, r.candidate_sha) for r in G.remap_commit(commits, blobs, targets, inside).collect()] == [("x", "x2")]
    assert [(r.sha, r.candidate_sha) for r in G.remap_commit(commits, blobs, targets).collect()] == [("x", "x2")]


def test_effective_commits(spark):
    # main: m0 <- m1 (head); s is on a side branch; lost is the twin of m0, gone the twin of s.
    meta = {"m0": ("a", "d", "x"), "m1": ("a", "d", "y"), "s": ("a", "d", "z"), "lost": ("a", "d", "x"), "gone": ("a", "d", "z"), "odd": ("a", "d", "q")}
    commits = _commits(spark, list(meta), **meta)
    parents = spark.createDataFrame([("r", "m1", "m0"), ("r", "s", "m0")], "repo string, sha string, parent_sha string")
    heads = spark.createDataFrame([("r", "m1")], "repo string, head_sha string")
    blobs = spark.createDataFrame([("r", c, "f", "t") for c in meta], "repo string, sha string, path string, content string")
    targets = spark.createDataFrame([("r", c, "f") for c in ("m0", "m1", "lost", "gone", "odd")], "repo string, sha string, path string")
    reached = spark.createDataFrame([("r", c) for c in ("m0", "m1", "s")], "repo string, sha string")
    got = {r.sha: (r.effective_sha, r.remapped, r.reason) for r in G.resolve_effective_commit(targets, heads, commits, parents, blobs, reached).collect()}
    assert got == {
        "m0": ("m0", False, None), "m1": ("m1", False, None), "lost": ("m0", True, None),
        "gone": (None, False, "remap_candidate_not_ancestor_of_head"), "odd": (None, False, "commit_not_ancestor_of_head"),
    }


def _ladder(n):
    """Two lines whose longest way changes sides at every step."""
    return [("l", f"a{i + 1}", f"a{i}") for i in range(n)] + [("l", f"b{i + 1}", f"b{i}") for i in range(n)] + [("l", f"a{i}", f"b{i}") for i in range(1, n + 1)] + [("l", f"b{i + 1}", f"a{i}") for i in range(n)]


def _longest(edges):
    parents = {}
    for _, child, parent in edges:
        parents.setdefault(child, []).append(parent)
    known = {}

    def steps(c):
        if c not in known:
            known[c] = max((1 + steps(p) for p in parents.get(c, [])), default=0)
        return known[c]

    return {c: steps(c) for e in edges for c in e[1:]}


@pytest.mark.parametrize("small", [100_000, 1])
def test_parents_are_below_their_children(spark, monkeypatch, small):
    monkeypatch.setattr(G, "SMALL_EDGES", small)
    graphs = {"l": _ladder(4), "r": _random_graph(5, 25)}
    edges = [e for g in graphs.values() for e in g]
    parents = spark.createDataFrame(edges, "repo string, sha string, parent_sha string")
    commits = spark.createDataFrame([(r, c) for r, g in graphs.items() for c in {c for e in g for c in e[1:]} | {"alone"}], "repo string, sha string")
    got = {(r.repo, r.sha): r.generation for r in G.generation(parents, commits).collect()}
    assert all(got[r, c] > got[r, p] for r, c, p in edges) and got["l", "alone"] == 0
    for r, g in graphs.items():
        assert {c: n for (repo, c), n in got.items() if repo == r and c != "alone"} == _longest(g)


def test_cycles_are_an_error_for_generations_only(spark):
    parents = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a"), ("r", "c", "d")], "repo string, sha string, parent_sha string")
    with pytest.raises(Exception, match="cycle"):
        G.generation(parents, spark.createDataFrame([("r", "a")], "repo string, sha string")).collect()
    assert {r.sha for r in G.reachable(parents, spark.createDataFrame([("r", "b")], "repo string, root string")).collect()} == set("abcd")


@pytest.mark.parametrize("small", [100_000, 30])
def test_many_roots_and_pairs(spark, monkeypatch, small):
    """More roots than go together, and a repository beyond the size of one task beside a small one."""
    monkeypatch.setattr(G, "SMALL_EDGES", small)
    graphs = {"r": _random_graph(8, 40), "s": _random_graph(9, 12, "s"), "t": []}
    edges = [e for g in graphs.values() for e in g]
    parents = spark.createDataFrame([*edges, ("s", "c000", None)], "repo string, sha string, parent_sha string")
    names = [f"c{i:03d}" for i in range(40)]
    pairs = [(r, a, b) for r in graphs for a in [*names[::3], "lost"] for b in [*names[1::2], "lost"]] + [(None, "c001", "c001"), ("r", None, "c001")]
    commits = spark.createDataFrame([(r, c) for r in graphs for c in names], "repo string, sha string")
    for known in (None, commits):
        got = G.is_ancestor(spark.createDataFrame([*pairs, pairs[0]], "repo string, commit string, of string"), parents, known).collect()
        assert len(got) == len(pairs) + 1
        for r in got:
            up = _ancestors([e for e in edges if e[0] == r.repo], r.of)
            assert r.is_ancestor == (r.repo is not None and r.commit in up and (known is None or r.of != "lost")), r
    roots = spark.createDataFrame([(r, c) for r in graphs for c in names], "repo string, root string")
    got = [(r.repo, r.root, r.sha) for r in G.reachable(parents, roots).collect()]
    assert len(got) == len(set(got)) and set(got) == {(r, c, a) for r, g in graphs.items() for c in names for a in _ancestors(g, c)}


def test_chains_of_renames_take_few_rounds(spark, monkeypatch):
    """64 renames of one file, another file that takes up an old name, and a rename back to the first name."""
    n = 66
    names = [f"c{i:02d}" for i in range(n)]
    parents = spark.createDataFrame([("r", names[i], names[i - 1]) for i in range(1, n)], "repo string, sha string, parent_sha string")
    changes = [("r", names[i], f"f{i}", f"f{i - 1}") for i in range(1, 65)] + [("r", names[40], "f3", None), ("r", names[65], "f0", "f64"), ("r", names[41], "g", "f3"), ("r", names[41], "h", "g")]
    changes = spark.createDataFrame(changes, "repo string, sha string, path string, old_path string")
    targets = spark.createDataFrame([("r", p, "c00", "c65") for p in ("f64", "f0", "g", "h", "none")], "repo string, path string, from_sha string, head_sha string")
    rounds = []
    monkeypatch.setattr(G, "cut_lineage", lambda df, cut=G.cut_lineage: rounds.append(1) or cut(df))
    out = G.history_after(targets, _commits(spark, names), parents, changes)
    seen = {}
    for r in sorted(out.collect(), key=lambda r: r.ordinal):
        seen.setdefault(r.path, []).append((r.sha, r.path_at_commit))
    line = [(names[i], f"f{i}") for i in range(1, 65)]
    assert seen["f64"] == line and seen["f0"] == [*line, ("c65", "f0")] and "none" not in seen
    assert seen["g"] == [("c01", "f1"), ("c02", "f2"), ("c03", "f3"), ("c40", "f3"), ("c41", "g")]
    # Within one change a rename doesn't follow another one.
    assert seen["h"] == [("c41", "h")]
    assert len(rounds) < 40

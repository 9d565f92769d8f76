"""Incremental runs, whole stages, and the registered queries."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ratertrail.operators.matching import normalise_classes, normalise_functions
from ratertrail.operators.graph import remap_commit
from ratertrail.plans.pipelines import _as_declared, complexity_table, persistence_table
from ratertrail.session import run_folder, scratch_path
from ratertrail.sources import schemas, tables
from ratertrail.streaming import incremental
from ratertrail.streaming.incremental import process_incrementally

T0 = datetime(2024, 1, 1)


def _runner(spark, tmp_path, operator):
    src, store, check = (str(tmp_path / n) for n in ("in", "store", "check"))

    def run(folder=check):
        stream = spark.readStream.schema("k int, v string").parquet(src)
        return sorted(r.k for r in process_incrementally(stream, "k", operator, store, folder).collect())

    return run, lambda ks: spark.createDataFrame([(k, "x") for k in ks], "k int, v string").coalesce(1).write.mode("append").parquet(src), store


def test_reruns_add_nothing_and_retry_failures(spark, tmp_path):
    broken = {2, 5}

    def operator(df):
        bad = F.col("k").isin(*broken) if broken else F.lit(False)
        return df.filter(~bad), df.filter(bad)

    run, add, store = _runner(spark, tmp_path, operator)
    add([1, 2, 3, 3])
    assert run() == [1, 3] == run()
    add([3, 4, 5])
    assert run() == [1, 3, 4], "a key already done is not processed again"
    assert sorted(r.k for r in incremental.open_failures(spark, store).collect()) == [2, 5]
    broken.clear()
    assert run() == [1, 2, 3, 4, 5] == run()
    assert incremental.open_failures(spark, store).isEmpty()
    # The same files under a new checkpoint are new batches, but all their keys are done.
    assert run(str(tmp_path / "other")) == [1, 2, 3, 4, 5]


def test_a_run_that_ends_between_any_two_writes_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    """The first run ends before, the second after each write in turn; what is published stays whole."""

    class Ended(Exception):
        pass

    left = {"steps": None}

    def ending(step):
        def wrapped(*args):
            if left["steps"] == 0:
                raise Ended
            step(*args)
            left["steps"] = None if left["steps"] is None else left["steps"] - 1

        return wrapped

    monkeypatch.setattr(incremental, "_write", ending(incremental._write))
    monkeypatch.setattr(incremental, "_publish", ending(incremental._publish))
    odd = lambda df: (df.filter("k % 5 > 0"), df.filter("k % 5 = 0"))
    run, add, store = _runner(spark, tmp_path, odd)
    given = []
    for k in range(5):
        given += [10 * k + 1, 10 * k + 2, 10 * k + 5]
        add(given[-3:] + given[:2])
        left["steps"] = k
        if k < 4:
            with pytest.raises(Exception):
                run()
        left["steps"] = None
        assert run() == [g for g in given if g % 5] == run()
        assert sorted(r.k for r in incremental.open_failures(spark, store).collect()) == [g for g in given if not g % 5]
    published = incremental.manifests(spark, store)
    assert [m["number"] for m in published] == list(range(1, len(published) + 1))


def test_only_key_lists_in_range_are_read(spark, tmp_path, monkeypatch):
    run, add, store = _runner(spark, tmp_path, lambda df: (df, df.limit(0)))
    for ks in ([1, 2], [100, 101], [1000]):
        add(ks)
        run()
    read = []
    monkeypatch.setattr(incremental, "_read", lambda s, store, epochs, part, own=incremental._read: read.append((part, [m["number"] for m in epochs])) or own(s, store, epochs, part))
    add([101, 102, 20])
    assert run() == [1, 2, 20, 100, 101, 102, 1000] and ("keys", [2]) in read


JAVA = "class A {\n%s}"
GETTER, BRANCH = " int g() { return a; }\n", " int h() { if (a) { b(); } return 1; }\n"


def test_persistence_stage(spark):
    meta = "repo string, sha string, author_email string, author_date string, subject string, committer_date timestamp"
    names = ["c0", "c1", "c2", "c3"]
    commits = spark.createDataFrame([("r", c, "a", "d", c, T0 + timedelta(days=2 * i)) for i, c in enumerate(names)] + [("s", "c9", "a", "d", "x", T0)], meta)
    parents = spark.createDataFrame([("r", names[i], names[i - 1]) for i in range(1, 4)], "repo string, sha string, parent_sha string")
    heads = spark.createDataFrame([("r", "c3"), ("s", "c8")], "repo string, head_sha string")
    changes = spark.createDataFrame([("r", "c1", "A.java", None), ("r", "c3", "A.java", None)], "repo string, sha string, path string, old_path string")
    blobs = spark.createDataFrame([("r", "c0", "A.java", JAVA % GETTER), ("r", "c1", "A.java", JAVA % GETTER), ("r", "c3", "A.java", JAVA % BRANCH)], "repo string, sha string, path string, content string")
    schema = "instance_id string, sample_id long, smell string, severity_consensus string, repository string, commit_hash string, path string, code_name string"
    instances = spark.createDataFrame([
        ("1", 1, "data class", "minor", "r", "c0", "/A.java", "p.A"),
        ("2", 2, "feature envy", "none", "r", "c0", "/A.java", "p.A#g"),
        ("3", 3, "blob", "none", "r", "c0", "/A.java", "p.B"),
        ("4", 4, "blob", "none", "r", "c0", "/No.java", "p.B"),
        ("5", 5, "blob", "none", "s", "c9", "/A.java", "p.A"),
        ("6", 6, "blob", "none", "gone", "c9", "/A.java", "p.A"),
    ], schema)
    table, failures = persistence_table(instances, heads, commits, parents, changes, blobs)
    got = {r.instance_id: r for r in table.collect()}
    assert {k: (r.persistence_revisions, r.persistence_days, r.death_reason, r.death_commit, r.n_revisions_observed) for k, r in got.items()} == {
        "1": (2, 6, "condition_no_longer_holds", "c3", 2), "2": (1, 2, "condition_no_longer_holds", "c1", 2),
    }
    assert {r.instance_id: r.reason for r in failures.collect()} == {
        "3": "entity_not_found_at_labelled_commit", "4": "path_unreadable_at_labelled_commit", "5": "commit_not_ancestor_of_head", "6": "repo_not_cloned",
    }
    # A second run leaves out what is done and tries the failed ones again.
    again, failed = persistence_table(instances, heads, commits, parents, changes, blobs, done=spark.createDataFrame([("1",), ("2",)], "instance_id string"))
    assert again.isEmpty() and failed.count() == 4


def test_complexity_stage(spark):
    number = ", ".join(f"{c} double" for c in ("wmc", "cbo", "dit", "noc", "rfc", "lcom", "loc", "totalMethodsQty", "totalFieldsQty"))
    row = lambda i, f, c: ("r", i, f, c, *[float(i)] * 9)
    classes = normalise_classes(spark.createDataFrame(
        [row(0, "/w/a/A.java", "p.A"), row(1, "/w/a/B.java", "p.B$C"), row(2, "/w/b/B.java", "p.B$C"), row(3, "/w/a/D.java", "p.D"), row(4, "/w/a/D.java", "p.D")],
        f"repository string, ordinal int, file string, class string, {number}"), "/w")
    methods = normalise_functions(spark.createDataFrame(
        [("r", 0, "p.A", "f/0", 1.0, 1.0, 1.0, 1.0), ("r", 1, "p.A", "f/2[int,int]", 2.0, 2.0, 2.0, 2.0), ("r", 2, "p.A", "(initializer)", 3.0, 3.0, 3.0, 3.0)],
        "repository string, ordinal int, class string, method string, cbo double, rfc double, loc double, wmc double"))
    schema = "instance_id string, sample_id long, smell string, severity_consensus string, repository string, path string, code_name string"
    cases = [("a", "blob", "/a/A.java", "p.A"), ("b", "blob", "/b/B.java", "p.B.C"), ("c", "data class", "/a/D.java", "p.D"), ("d", "long method", "", "p.A#f X|Y"),
             ("e", "long method", "", "p.A.f X|Y|Z"), ("f", "long method", "", "p.A#g"), ("g", "blob", "", "p.Z")]
    table, failures = complexity_table(spark.createDataFrame([(i, 1, s, "none", "r", p, c) for i, s, p, c in cases], schema), classes, methods, "v")
    got = {r.instance_id: (r.join_level, r.loc, r.wmc, r.method_cyclomatic_complexity) for r in table.collect()}
    assert got == {
        "a": ("class_fqcn", 0.0, 0.0, None), "b": ("class_fqcn+path", 2.0, 2.0, None), "c": ("class_fqcn_ambiguous_first_match", 3.0, 3.0, None),
        "d": ("method_fqcn+name+arity", 2.0, None, 2.0), "e": ("method_fqcn+name_only", 1.0, None, 1.0),
    }
    assert {(r.instance_id, r.reason) for r in failures.collect()} == {("f", "no_join_match"), ("g", "no_join_match")}


def test_commit_log_text(spark, tmp_path):
    (tmp_path / "log.txt").write_text("COMMIT|a|2024-01-01T00:00:00Z\n\nsrc/A.java\n docs/COMMIT|x \nCOMMIT|b|2024-01-02T00:00:00|z\nCOMMIT|c|2024-01-03\nB.java\n")
    rows = {(r.sha, r.committer_date, r.position, r.path) for r in tables.parse_commit_log(spark, str(tmp_path / "log.txt")).collect()}
    assert rows == {("a", "2024-01-01T00:00:00Z", 0, "src/A.java"), ("a", "2024-01-01T00:00:00Z", 1, "docs/COMMIT|x"), ("c", "2024-01-03", 0, "B.java")}


def test_csv_keeps_flags_text_and_line_ends(spark, tmp_path):
    schema = "k int, flag string, grade string, note string"
    df = spark.createDataFrame([(1, "0,5", "none", 'say "hi",\nthen go'), (2, "1", "minor", None)], schema)
    tables.write_table(df, str(tmp_path / "t"), "csv")
    back = tables.read_table(spark, str(tmp_path / "t"), schema)
    assert sorted(map(tuple, back.collect())) == [(1, "0,5", "none", 'say "hi",\nthen go'), (2, "1", "minor", None)]
    with pytest.raises(ValueError, match="expected 3 rows"):
        tables.read_reviews(spark, str(tmp_path / "t"), schema, expected_rows=3)


def test_csv_is_read_by_name(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "o__r").mkdir()
    (tmp_path / "m" / "o__r" / "class.csv").write_text("file,class,type,cbo,cboModified,fanin,fanout,wmc,dit,noc,rfc,lcom,loc,totalMethodsQty,totalFieldsQty\n/w/A.java,p.A$B,class,1,91,92,93,2,3,4,5,6,7,8,9\n/w/B.java,p.B,class,x,91,92,93,2,3,4,5,6,7,8,9\n")
    classes, methods = tables.load_metric_tables(spark, str(tmp_path / "m" / "*" / "class.csv"), None, "/w")
    a, b = classes.orderBy("ordinal").collect()
    assert (a.repository, a.class_name, a.path, a.cbo, a.wmc, a.dit, a.noc, a.rfc, a.lcom, a.loc, a.totalMethodsQty, a.totalFieldsQty) == ("o/r", "p.A.B", "A.java", 1, 2, 3, 4, 5, 6, 7, 8, 9)
    assert b.cbo is None and b.wmc == 2 and methods.count() == 0 and {"repository", "ordinal"} <= set(methods.columns)
    (tmp_path / "s.csv").write_text("note,k\nseven,7\n")
    assert tables.read_table(spark, str(tmp_path / "s.csv"), "k int, note string", multi_line=False).collect() == [(7, "seven")]
    with pytest.raises(ValueError, match="lacks the columns missing"):
        tables.read_table(spark, str(tmp_path / "s.csv"), "k int, missing string")


def test_stage_tables_have_their_declared_types(spark, tmp_path):
    for declared in (schemas.PERSISTENCE, schemas.COMPLEXITY, schemas.FAILURES):
        empty = _as_declared(spark.createDataFrame([], declared), declared)
        empty.write.parquet(str(tmp_path / str(len(declared))))
        assert tables.read_table(spark, str(tmp_path / str(len(declared))), declared, "parquet").count() == 0


def test_remap_is_verified_path_by_path(spark):
    commits = spark.createDataFrame([("r", c, "a", "d", "s") for c in ("x", "y")], "repo string, sha string, author_email string, author_date string, subject string")
    blobs = spark.createDataFrame([("r", "x", "p1", "same"), ("r", "y", "p1", "same"), ("r", "x", "p2", "one"), ("r", "y", "p2", "other"), ("r", "x", "p3", "t"), ("r", "y", "p3", "t")], "repo string, sha string, path string, content string")
    targets = spark.createDataFrame([("r", "x", p) for p in ("p1", "p2", "p3")], "repo string, sha string, path string")
    assert sorted(map(tuple, remap_commit(commits, blobs, targets).collect())) == [("r", "x", "p1", "y"), ("r", "x", "p3", "y")]


def test_stage_tables_are_removed_together(spark, tmp_path):
    path = scratch_path(spark, "x")
    assert path.startswith(run_folder(spark)) and spark.sparkContext.applicationId in path


def test_registry(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 120
    rows = entry.entry(spark).collect()
    assert len(rows) > 700 and [(r.sample_id, r.smell) for r in rows] == sorted((r.sample_id, r.smell) for r in rows)

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ratertrail.functions import scalar as S
from ratertrail.operators import audit, consensus, dedupe, summaries

SCHEMA = "rater int, sample int, label string, at int"


def test_ties_go_up_and_nulls_do_not_vote(spark):
    rows = [(1, 1, "none", 1), (2, 1, "major", 2), (1, 2, "minor", 1), (2, 2, "minor", 2), (3, 2, "critical", 3), (1, 3, None, 1), (2, 3, "none", 2), (1, 4, None, 1), (1, None, "none", 1)]
    got = {r["sample"]: r for r in consensus.consensus_label(spark.createDataFrame(rows, SCHEMA), ["sample"], "label").collect()}
    assert set(got) == {1, 2, 3, 4}
    assert (got[1].severity_consensus, got[1].severity_tied, got[1].severity_values_seen) == ("major", True, "none,major")
    assert (got[2].severity_consensus, got[2].severity_tied, got[2].n_reviewers) == ("minor", False, 3)
    assert (got[3].severity_consensus, got[3].n_reviewers) == ("none", 2)
    assert (got[4].severity_consensus, got[4].severity_tied) == (None, False)


def test_unknown_label_is_an_error(spark):
    with pytest.raises(Exception, match="outside the given order"):
        consensus.consensus_label(spark.createDataFrame([(1, 1, "odd", 1)], SCHEMA), ["sample"], "label").collect()


def test_consensus_does_not_depend_on_row_order(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(5), rng.randrange(8), rng.choice(S.GRADES), rng.randrange(50)) for _ in range(200)]
    run = lambda r: sorted(map(str, consensus.consensus_label(spark.createDataFrame(r, SCHEMA), ["sample"], "label", first_cols=["rater"], order=["at", "rater"]).collect()))
    first = run(rows)
    rng.shuffle(rows)
    assert run(rows) == first


def test_kept_and_dropped_are_the_input(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "_CHUNK", 7)
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, None]), rng.randrange(3), rng.choice(["none", "minor"]), rng.randrange(3)) for _ in range(150)]
    rows += [(9, 9, "none", 0)] * 40
    kept, dropped = dedupe.drop_exact_duplicates(spark.createDataFrame(rows, SCHEMA), ["rater", "sample", "label"], ["at"])
    kept, dropped = [tuple(r) for r in kept.collect()], [tuple(r) for r in dropped.collect()]
    assert Counter(kept) + Counter(dropped) == Counter(rows)
    assert len({r[:3] for r in kept}) == len(kept) == len({r[:3] for r in rows})
    assert all(r[3] == min(x[3] for x in rows if x[:3] == r[:3]) for r in kept)


def test_split_matched_keeps_every_row(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("instance_id"), F.when(F.col("id") % 3 == 0, True).alias("ok"))
    ok, failed = audit.split_matched(df, F.col("ok"), "s", "r", F.lit("x" * 600))
    assert ok.count() + failed.count() == 20
    assert failed.first().detail == "x" * 500 and failed.columns == list(audit.FAILURE_COLUMNS)


def test_latest_attempts_without_later_successes(spark):
    log = spark.createDataFrame(
        [("a", "1", "complexity", "old", 1), ("a", "1", "complexity", "new", 2), ("a", "2", "complexity", "x", 1), ("a", None, "clone", "c1", 1), ("a", None, "clone", "c2", 2)],
        "repository string, instance_id string, stage string, reason string, timestamp int",
    )
    done = spark.createDataFrame([("a", "2", "complexity")], "repository string, instance_id string, stage string")
    assert {(r.instance_id, r.reason) for r in audit.clean_failure_log(log, done).collect()} == {("1", "new"), (None, "c2")}


def test_pivot_refuses_repeated_cells(spark):
    df = spark.createDataFrame([(1, "blob", "none"), (1, "blob", "minor")], "s int, smell string, g string")
    with pytest.raises(Exception, match="repeated cell"):
        summaries.pivot_labels(df, "s", "smell", "g", ["blob"]).collect()


def test_absent_labels_stay_in_the_table(spark):
    df = spark.createDataFrame([("none", "x"), ("critical", "y")], "g string, c string")
    rows = summaries.crosstab_ordered(df, "g", "c", S.GRADES, ["x", "y"]).collect()
    assert [(r.g, r.x, r.y) for r in rows] == [("none", 1, 0), ("minor", 0, 0), ("major", 0, 0), ("critical", 0, 1)]


def test_scalar_expressions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(S.repo_slug(F.lit("git@github.com:a/b:c.git"))) == "a__b:c"
    assert one(S.repo_https_url(F.lit("git@github.com:a/b.git"))) == "https://github.com/a/b.git"
    assert one(S.parse_class_name(F.lit("p.q.Type.Inner#m A"))) == "Inner"
    f = one(S.parse_function_name(F.lit("pkg.Type.method A|F<X, Y>")))
    assert (f.class_name, f.function_name, f.n_params) == ("pkg.Type", "method", 2)
    f = one(S.parse_function_name(F.lit("pkg.Type#method")))
    assert (f.class_name, f.function_name, f.n_params) == ("pkg.Type", "method", 0)
    f = one(S.parse_function_name(F.lit("method A||B")))
    assert (f.class_name, f.function_name, f.n_params) == ("", "method", 2)
    s = one(S.parse_signature(F.lit("run/12[int]")))
    assert (s.name, s.arity) == ("run", 12)
    assert tuple(one(S.parse_signature(F.lit("run")))) == (None, None)
    days = lambda a, b: one(S.elapsed_days(S.parse_iso_ts(F.lit(a)), S.parse_iso_ts(F.lit(b))))
    assert days("2024-03-18T12:00:00Z", "2024-03-15T00:00:00Z") == -4
    assert days("2024-03-15T00:00:00+02:00", "2024-03-15T23:59:59Z") == 1
    assert one(S.human_bytes(F.lit(1280))) == "1.2KB" and one(S.human_bytes(F.lit(1023))) == "1023.0B"
    assert one(S.human_bytes(F.lit(5 * 1024**4))) == "5.0TB"
    assert one(S.relative_path(F.lit("/repo/src/A.java"), "/repo")) == "src/A.java" and one(S.relative_path(F.lit("/other/A"), "/repo")) == "/other/A"
    assert one(S.owner_group(F.lit("git@github.com:ECLIPSE/x"))) == "eclipse" and one(S.owner_group(F.lit("git@github.com:Apache/x"))) == "other"
    assert one(S.pct(F.lit(0.125), digits=0)) == 12 and one(S.binary_flag(F.lit("0,5"))) == "other"
    assert one(S.flag_negative(F.lit(None).cast("long"))) is False

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ratertrail.operators import survival as S

T0 = datetime(2024, 1, 1, 12)
SCHEMA = "e int, id int, ts timestamp, readable boolean, alive boolean, holds boolean, label boolean"


def _events(seed, n=160):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        readable = rng.random() > 0.1
        alive = rng.random() > 0.1 if readable else None
        holds = rng.choice([True, True, True, None, False]) if alive else None
        rows.append((rng.randrange(4), i, T0 + timedelta(minutes=rng.randrange(40_000)), readable, alive, holds, rng.random() < 0.3))
    return rows


def _walk(history):
    """Walk one history by hand; ``history[0]`` is the label."""
    for i, r in enumerate(history[1:], 1):
        cause = S.UNREADABLE if not r[3] else S.GONE if not r[4] else S.FAILS if r[5] is False else None
        if cause:
            return i, (r[2] - history[0][2]).days, False, cause, str(r[1])
    last = history[-1]
    return len(history) - 1, (last[2] - history[0][2]).days, True, S.CENSORED, str(last[1])


def _got(r):
    return r.persistence_revisions, r.persistence_days, r.censored, r.death_reason, r.death_commit


def test_walk_from_first_revision(spark):
    rows = _events(1)
    history = S.revision_ordinal(spark.createDataFrame(rows, SCHEMA), ["e"], "ts", ["id"])
    got = {r.e: r for r in S.persistence_walk(history, ["e"], "ordinal", "ts", "readable", "alive", "holds", "id").collect()}
    for e in range(4):
        mine = sorted((r for r in rows if r[0] == e), key=lambda r: (r[2], r[1]))
        if not mine[0][3]:
            assert got[e].failure_reason == "path_unreadable_at_labelled_commit" and got[e].persistence_revisions is None
        elif not mine[0][4]:
            assert got[e].failure_reason == "entity_not_found_at_labelled_commit"
        else:
            assert _got(got[e]) == _walk(mine) and got[e].n_revisions_observed == len(mine) - 1


def test_walk_from_every_label(spark):
    rows = _events(2, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    out = S.persistence_from_labels(df, ["e"], "ts", ["id"], F.col("label"), "readable", "alive", "holds", "id", keep=["id"]).collect()
    assert len(out) == sum(r[6] for r in rows)
    by_id = {r[1]: r for r in rows}
    for r in out:
        mine = sorted((x for x in rows if x[0] == r.e), key=lambda x: (x[2], x[1]))
        tail = mine[mine.index(by_id[r.id]):]
        if tail[0][3] and tail[0][4]:
            assert _got(r) == _walk(tail) and r.n_revisions_observed == len(tail) - 1
        else:
            assert r.failure_reason is not None and r.censored is None


def test_single_revision_is_censored_at_zero(spark):
    df = spark.createDataFrame([(1, 7, T0, True, True, False, True)], SCHEMA).withColumn("ordinal", F.lit(0))
    args = (["e"], "ordinal", "ts", "readable", "alive", "holds", "id")
    r = S.persistence_walk(df, *args).first()
    assert _got(r) == (0, 0, True, S.CENSORED, "7") and r.days_anomalous_negative is False
    assert S.persistence_walk(df, *args, require_baseline_condition=True).first().failure_reason == "condition_not_met_at_labelled_commit"


def test_negative_days_are_flagged_not_clamped(spark):
    df = spark.createDataFrame([(1, 0, T0, True, True, True, True), (1, 1, T0 - timedelta(hours=1), True, False, None, False)], SCHEMA).withColumn("ordinal", F.col("id"))
    r = S.persistence_walk(df, ["e"], "ordinal", "ts", "readable", "alive", "holds", "id").first()
    assert (r.persistence_days, r.days_anomalous_negative, r.death_reason) == (-1, True, S.GONE)

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratertrail.functions import ordering as O
from ratertrail.functions.tails import digamma


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_match_pandas(spark, descending):
    rng = random.Random(1)
    values = sorted({round(rng.choice([-1, 1]) * 10 ** rng.uniform(-3, 6), 3) for _ in range(400)})
    rows = [(rng.choice(["a", "b", None]), v, rng.randrange(9)) for v in values]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    order = [F.desc("v")] if descending else ["v"]
    got = {(r.g, r.v): r.t for r in O.running_totals(df, ["g"], order, {"t": "n"}, O.magnitude_band("v", 4), descending).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "v", "n"]).fillna({"g": "-"}).sort_values("v", ascending=not descending)
    pdf["t"] = pdf.groupby("g").n.cumsum()
    assert got == {(None if r.g == "-" else r.g, r.v): r.t for r in pdf.itertuples()}


def test_bands_are_monotone(spark):
    rng = random.Random(2)
    xs = sorted([0.0, -0.0, 1e300, -1e300, 1e-300] + [rng.choice([-1, 1]) * 10 ** rng.uniform(-12, 12) for _ in range(500)])
    bands = [r.b for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", O.magnitude_band("x").alias("b")).orderBy("x").collect()]
    assert bands == sorted(bands)


def test_hot_group_is_split_over_bands(spark):
    """A group with nearly all rows never sits in one window partition."""
    df = spark.range(20000).select(F.when(F.col("id") % 50 == 0, "rare").otherwise("hot").alias("g"), (F.col("id") * 7919 % 20011).cast("double").alias("v"))
    largest = df.groupBy("g", O.magnitude_band("v").alias("b")).count().agg(F.max("count")).first()[0]
    assert largest < 2000
    out = O.group_ordinal(df, ["g"], ["v"], O.magnitude_band("v"))
    assert out.groupBy("g").agg(F.count("*").alias("n"), F.max("ordinal").alias("m"), F.count_distinct("ordinal").alias("d")).filter("n <> m or n <> d").isEmpty()


@pytest.mark.parametrize("value", ["id / 20000 * 0.0035", "if(id % 10 < 7, 0, id)", "1e6 + id / 20"])
def test_ranges_follow_the_data(spark, value):
    """Narrow values, ties and an offset divide as evenly as any others."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20000).select(F.lit("hot").alias("g"), "id", F.expr(value).cast("double").alias("v"))
        sizes = [r["count"] for r in O.range_banded(df, ["g", "v", "id"]).groupBy(O.BAND).count().collect()]
        assert len(sizes) >= 3 and max(sizes) < 2 * 20000 / len(sizes)
        out = O.group_ordinal(df, ["g"], ["v", "id"])
        assert out.agg(F.max("ordinal"), F.count_distinct("ordinal")).first() == (20000, 20000)
        assert out.orderBy("v", "id").limit(1).first()["ordinal"] == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_time_ordinals_cross_days(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), "id", F.timestamp_seconds(F.col("id") * 40_000 % 9_999_991).alias("ts"))
    got = O.group_ordinal(df, ["g"], ["ts", "id"], O.time_band("ts"), start=0).toPandas().sort_values(["g", "ts", "id"])
    assert (got.ordinal == got.groupby("g").cumcount()).all()


def test_digamma(spark):
    got = spark.createDataFrame([(1,), (2,), (10,), (1000,)], "m int").select(digamma(F.col("m")).alias("p")).toPandas().p
    assert got.tolist() == pytest.approx([-0.5772156649015329, 0.42278433509846713, 2.2517525890667211, 6.907255195648812], rel=1e-10)

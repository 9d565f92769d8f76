"""Running totals and ordinals that do not put a whole group into one task.

A window partitioned by a group alone sorts that group in a single task, however large it is.
Here each group is first cut into *bands*: ranges of the ordering value. Totals per band are
aggregated (with map-side combining), a small window over the bands turns them into offsets,
and the fine window runs per ``(group, band)``. By default bands are Spark's own range
partitions of the rows in question, tie-breakers included, so they follow the data; the banded
table is written once, so a retried task agrees with the first attempt. Where the spread is known
(uniform hashes, clock times), a fixed monotone expression saves that pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratertrail.session import cut_lineage

BAND = "__band"
#: A table of no more rows than this is numbered or summed in order without bands.
SMALL_ROWS = 200_000


def range_banded(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``BAND``, which rises with ``keys`` (nulls first) and holds about equally many rows each, whatever the values."""
    return cut_lineage(df.repartitionByRange(*[F.col(k) for k in keys]).withColumn(BAND, F.spark_partition_id()))


def magnitude_band(value: Column | str, per_unit: int = 256) -> Column:
    """Monotone band for metrics and scores: equal steps of the signed logarithm.

    Heavy-tailed metrics spread evenly, and a double has at most a few hundred thousand bands.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.coalesce(F.floor(F.signum(v) * F.log1p(F.abs(v)) * per_unit).cast("long"), F.lit(-(1 << 62)))


def time_band(ts: Column | str, seconds: int = 86_400) -> Column:
    """Monotone band for event times: fixed steps of the clock."""
    t = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")
    return F.coalesce(F.floor(F.unix_micros(t) / F.lit(seconds * 1_000_000)).cast("long"), F.lit(-(1 << 62)))


def hash_band(h: Column | str, bits: int = 60, bands: int = 4096) -> Column:
    """Monotone band for a uniform non-negative hash of ``bits`` bits."""
    c = F.col(h) if isinstance(h, str) else h
    return F.coalesce(F.shiftright(c, bits - (bands.bit_length() - 1)).cast("long"), F.lit(-1))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet, keeping the key columns of the left side."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed[f"__r_{k}"])
    joined = left.join(renamed, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{k}" for k in keys])


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    sums: dict[str, str],
    band: Column | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add ``{name: inclusive running total of column}`` in ``order`` within ``group``.

    ``order`` must be total within a group and a given ``band`` monotone in its first column;
    without one the rows are written, counted, and, if there are more than ``SMALL_ROWS``, cut into ranges of ``group`` and
    ``order`` (column names then). With ``descending`` both run from the top.
    """
    group, keys = list(group), [*group, *order]
    direction = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    order = [direction(o) if isinstance(o, str) else o for o in order]
    if band is None:
        df = cut_lineage(df)
        if df.count() <= SMALL_ROWS:
            running = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
            return df.withColumns({n: F.sum(c).over(running) for n, c in sums.items()})
    banded = range_banded(df, keys) if band is None else df.withColumn(BAND, band)
    per_band = banded.groupBy(*group, BAND).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = W.partitionBy(*group).orderBy(direction(BAND)).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_band.select(
        *group, BAND, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums]
    )
    upto = W.partitionBy(*group, BAND).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = banded.withColumns({f"__l_{n}": F.sum(c).over(upto) for n, c in sums.items()})
    joined = join_null_safe(local, offsets, [*group, BAND])
    return joined.withColumns({n: F.col(f"__l_{n}") + F.col(f"__o_{n}") for n in sums}).drop(
        BAND, *[f"__l_{n}" for n in sums], *[f"__o_{n}" for n in sums]
    )


def group_ordinal(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], band: Column | None = None, name: str = "ordinal", start: int = 1
) -> DataFrame:
    """Row number within each group, hot groups spread over bands."""
    out = running_totals(df.withColumn("__one", F.lit(1).cast("long")), group, order, {name: "__one"}, band)
    out = out.drop("__one")
    return out if start == 1 else out.withColumn(name, F.col(name) + (start - 1))

"""Resumable runs: process only new keys, publish results by epoch, retry what failed.

A store is a folder. Each batch writes an epoch below it (results, failures, the keys that have a result) and then publishes
it by one small manifest; what no manifest names was never written as far as readers are concerned. A run that ends
between any two writes leaves an unpublished epoch behind, and the next run does the batch again under another name.
Manifests carry the least and greatest key of their epoch, so a batch reads only the key lists it may overlap.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratertrail.operators.audit import pending_only
from ratertrail.operators.dedupe import first_per_key
from ratertrail.session import cut_lineage

Operator = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _write(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def _publish(spark: SparkSession, store: str, manifest: dict[str, Any]) -> None:
    """The manifest under its number; of two runs that publish the same number one fails."""
    files, folder = _files(spark, f"{store}/manifests")
    files.mkdirs(folder)
    hidden = spark._jvm.org.apache.hadoop.fs.Path(folder, f"_{uuid.uuid4().hex}")
    out = files.create(hidden)
    out.write(bytearray(json.dumps(manifest, default=str).encode()))
    out.close()
    if not files.rename(hidden, spark._jvm.org.apache.hadoop.fs.Path(folder, f"{manifest['number']:010d}.json")):
        raise RuntimeError(f"epoch {manifest['number']} of {store} is there already")


def manifests(spark: SparkSession, store: str) -> list[dict[str, Any]]:
    """The published epochs, oldest first: one small record for each batch that was ever run."""
    files, folder = _files(spark, f"{store}/manifests")
    if not files.exists(folder) or not any(s.getPath().getName().endswith(".json") for s in files.listStatus(folder)):
        return []
    lines = spark.read.option("pathGlobFilter", "*.json").text(f"{store}/manifests", wholetext=True).collect()
    return sorted((json.loads(r["value"]) for r in lines), key=lambda m: m["number"])


def _read(spark: SparkSession, store: str, epochs: list[dict[str, Any]], part: str) -> DataFrame | None:
    paths = [f"{store}/epochs/{m['epoch']}/{part}" for m in epochs]
    return spark.read.schema(spark.read.parquet(paths[0]).schema).parquet(*paths) if paths else None


def results(spark: SparkSession, store: str) -> DataFrame | None:
    """All published results; None before the first epoch."""
    return _read(spark, store, manifests(spark, store), "results")


def open_failures(spark: SparkSession, store: str) -> DataFrame | None:
    """The rows that failed when they were tried last; a retry takes the place of all failures before it."""
    published = manifests(spark, store)
    since = max((m["number"] for m in published if m["retry"]), default=0)
    return _read(spark, store, [m for m in published if m["number"] >= since], "failures")


def _pending(rows: DataFrame, key: str, store: str, published: list[dict[str, Any]]) -> DataFrame:
    """The first row of each key that has no result yet; only key lists whose range the rows touch are read."""
    rows = cut_lineage(first_per_key(rows, [key], [c for c in rows.columns if c != key]))
    if not published:
        return rows
    least, most = rows.agg(F.min(key).cast("string"), F.max(key).cast("string")).first()
    kind = rows.schema[key].dataType.simpleString()
    ranges = rows.sparkSession.createDataFrame([(m["number"], m["least"], m["most"]) for m in published if m["least"] is not None], "number long, least string, most string")
    # Bounds are kept as text and compared as what they are.
    touched = ranges.filter((F.col("most").cast(kind) >= F.lit(least).cast(kind)) & (F.col("least").cast(kind) <= F.lit(most).cast(kind)))
    numbers = {r["number"] for r in touched.collect()} if least is not None else set()
    done = _read(rows.sparkSession, store, [m for m in published if m["number"] in numbers], "keys")
    return rows if done is None else cut_lineage(pending_only(rows, done, key))


def process_batch(batch: DataFrame, key: str, operator: Operator, store: str, token: str, retry: bool = False) -> None:
    """Run ``operator`` on the first row of each key that has no result yet, and publish one epoch.

    ``token`` names the batch: one that was published already is left alone, so a batch that is delivered
    again adds nothing. Rows with a null key are taken as one key.
    """
    spark = batch.sparkSession
    published = manifests(spark, store)
    if any(m["token"] == token for m in published):
        return
    found, failed = operator(_pending(batch, key, store, published))
    number = published[-1]["number"] + 1 if published else 1
    epoch = f"{number:010d}-{uuid.uuid4().hex}"
    folder = f"{store}/epochs/{epoch}"
    _write(found, f"{folder}/results")
    # From here on the written rows count, so that results, keys and bounds agree.
    keys = spark.read.parquet(f"{folder}/results").select(key).distinct()
    _write(keys.repartitionByRange(key).sortWithinPartitions(key), f"{folder}/keys")
    least, most = spark.read.parquet(f"{folder}/keys").agg(F.min(key).cast("string"), F.max(key).cast("string")).first()
    _write(failed, f"{folder}/failures")
    _publish(spark, store, {"number": number, "epoch": epoch, "token": token, "retry": retry, "least": least, "most": most})


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The name that a stream keeps with its checkpoint; batch numbers count within it."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()["value"])["id"]


def process_incrementally(stream: DataFrame, key: str, operator: Operator, store: str, checkpoint: str) -> DataFrame:
    """Drain the files that are new in ``stream`` through ``operator`` and return all results of the store.

    ``operator`` splits its input into results, which hold the key, and failed input rows. Rows that failed
    before are tried again first. A second run without new files adds nothing; a store without any epoch gives an
    empty table like the stream.
    """
    spark = stream.sparkSession
    earlier = open_failures(spark, store)
    if earlier is not None and not earlier.isEmpty():
        process_batch(earlier, key, operator, store, f"retry-{uuid.uuid4().hex}", retry=True)
    query = (
        stream.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, number: process_batch(batch, key, operator, store, f"{_stream_id(spark, checkpoint)}-{number}"))
        .start()
    )
    query.awaitTermination()
    found = results(spark, store)
    return spark.createDataFrame([], stream.schema) if found is None else found

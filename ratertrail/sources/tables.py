"""Reading and writing tables, key lists, logs and result documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratertrail.operators.matching import normalise_classes, normalise_functions
from ratertrail.sources import schemas

# CSV dialect (quoted fields may hold line ends, quotes are doubled) and timestamps with offset.
CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}
COMMIT_MARK = "COMMIT|"
EDGE_SPACE = r"^\s+|\s+$"


def _check_rows(df: DataFrame, expected: int | None) -> DataFrame:
    """Fail when the number of rows differs from the contract; costs a count."""
    if expected is not None and (n := df.count()) != expected:
        raise ValueError(f"expected {expected} rows, got {n}")
    return df


def _read_by_name(reader, path: str, schema: T.StructType, extra: dict[str, Column] | None = None) -> DataFrame:
    """A headed file as text, its columns found by name and cast to the declared types; others are left out.

    A declared column that the header lacks is an error; a value that doesn't fit its type is null.
    """
    raw = reader.load(path)
    if missing := [f.name for f in schema if f.name not in raw.columns]:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema], *[c.alias(n) for n, c in (extra or {}).items()])


def read_table(
    spark: SparkSession, path: str, schema: str | T.StructType, format: str = "csv", multi_line: bool = True, extra: dict[str, Column] | None = None, **options: str
) -> DataFrame:
    """A table with a declared schema; CSV columns are found by the names in the header, whatever their order.

    ``multi_line=False`` lets large CSV files without line ends in fields be split. ``extra`` adds
    columns to CSV tables that may use the file's ``_metadata``.
    """
    if format == "csv":
        declared = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        reader = spark.read.format("csv").options(**{**CSV_OPTIONS, "multiLine": str(multi_line).lower(), **options})
        return _read_by_name(reader, path, declared, extra)
    return spark.read.schema(schema).options(**options).format(format).load(path)


def read_reviews(
    spark: SparkSession, path: str, schema: str = schemas.REVIEWS, format: str = "csv", expected_rows: int | None = None, multi_line: bool = True
) -> DataFrame:
    """A review export; "first" among its rows is by ``review_timestamp, id``, a stated order rather than file order."""
    return _check_rows(read_table(spark, path, schema, format, multi_line), expected_rows)


def read_key_list(spark: SparkSession, path: str, name: str = "repository") -> DataFrame:
    """Distinct non-blank trimmed lines."""
    return spark.read.text(path).select(F.regexp_replace("value", EDGE_SPACE, "").alias(name)).filter(F.col(name) != "").distinct()


def write_table(df: DataFrame, path: str, format: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    _writer(df, "overwrite", format, partition_by).save(path)


def append_table(df: DataFrame, path: str, format: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Add rows; running twice adds them twice unless finished keys are left out first (``pending_only``)."""
    _writer(df, "append", format, partition_by).save(path)


def _writer(df: DataFrame, mode: str, format: str, partition_by: Sequence[str]):
    writer = df.write.mode(mode).format(format).partitionBy(*partition_by) if partition_by else df.write.mode(mode).format(format)
    return writer.options(header="true", escape='"') if format == "csv" else writer


def write_results_json(df: DataFrame, path: str) -> None:
    """One JSON document per row: a struct of results in a one-row frame gives one document per run."""
    df.write.mode("overwrite").json(path)


_MODEL = T.MapType(T.StringType(), T.StringType())
_TASK = T.StructType([T.StructField("models", T.MapType(T.StringType(), _MODEL))])


def read_model_results(spark: SparkSession, path: str, tasks: Sequence[str]) -> DataFrame:
    """A nested result document to ``task, model, metric, value``; model and metric names are data.

    Metrics that are not numbers (matrices, label lists) are left out.
    """
    schema = T.StructType([T.StructField(t, _TASK) for t in tasks])
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    per_task = F.array(*[F.struct(F.lit(t).alias("task"), F.col(f"{t}.models").alias("models")) for t in tasks])
    models = doc.select(F.explode(per_task).alias("t")).select("t.task", F.explode("t.models").alias("model", "metrics"))
    values = models.select("task", "model", F.explode("metrics").alias("metric", "text"))
    return values.select("task", "model", "metric", F.col("text").try_cast("double").alias("value")).filter("value is not null")


def load_metric_tables(
    spark: SparkSession, class_path: str, method_path: str | None, base: str | None = None, format: str = "csv",
    repository: str | Column | None = None, multi_line: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Class and method metric tables with their join keys, ``repository`` and the file order ``ordinal``.

    Without a method table it is empty. ``repository`` names the repository of all rows, or is an
    expression over ``_metadata``; by default it is the name of the file's folder, ``__`` for ``/``.
    """
    if repository is None:
        repository = F.replace(F.element_at(F.split("_metadata.file_path", "/"), -2), F.lit("__"), F.lit("/"))
    where = {
        "repository": F.lit(repository) if isinstance(repository, str) else repository,
        # The place of the row's split in its file, then of the row in the split.
        "ordinal": F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")),
    }

    def read(path: str, schema: str) -> DataFrame:
        if format == "csv":
            return read_table(spark, path, schema, multi_line=multi_line, extra=where)
        return spark.read.format(format).load(path).select(*T._parse_datatype_string(schema).names, *[c.alias(n) for n, c in where.items()])

    classes = normalise_classes(read(class_path, schemas.CLASS_METRICS), base)
    if method_path is None:
        methods = spark.createDataFrame([], schemas.METHOD_METRICS).select("*", *[F.lit(None).cast(t).alias(n) for n, t in classes.select(*where).dtypes])
    else:
        methods = read(method_path, schemas.METHOD_METRICS)
    return classes, normalise_functions(methods)


def parse_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """Log text, a marker line per commit and its paths below, to ``sha, committer_date, path, position``.

    A line that starts with the marker ends a record, so a commit is one record and the file can
    be split. Blank lines are dropped; a commit without a path gives no row.
    """
    records = spark.read.option("lineSep", "\n" + COMMIT_MARK).text(path)
    record = F.when(F.startswith("value", F.lit(COMMIT_MARK)), F.substr("value", F.lit(len(COMMIT_MARK) + 1))).otherwise(F.col("value"))
    lines = F.split(record, r"\r?\n")
    head = F.split(lines.getItem(0), r"\|", 2)
    below = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    paths = F.filter(F.transform(below, lambda p: F.regexp_replace(p, EDGE_SPACE, "")), lambda p: p != "")
    return records.select(head.getItem(0).alias("sha"), head.getItem(1).alias("committer_date"), F.posexplode(paths).alias("position", "path"))


def parse_commit_meta(lines: DataFrame, column: str = "value") -> DataFrame:
    """``sha|email|date|subject`` lines to columns; the subject may hold the separator, shorter lines are skipped."""
    parts = F.split(F.col(column), r"\|", 4)
    named = [parts.getItem(i).alias(n) for i, n in enumerate(("sha", "author_email", "author_date", "subject"))]
    return lines.filter(F.size(parts) == 4).select(*[c for c in lines.columns if c != column], *named)

"""Tiered matching of labelled entities to a catalogue of measured ones.

Candidates are never paired up: the catalogue is reduced to one row per key of each tier
(count and first row), so that a probe meets at most one row per tier however often its
name occurs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratertrail.functions.scalar import dotted_name, parse_signature, relative_path


def normalise_classes(classes: DataFrame, base: str | None = None) -> DataFrame:
    """Add ``class_name`` (source form) and ``path`` (repository-relative) to a class metric table."""
    return classes.withColumns({"class_name": dotted_name("class"), "path": relative_path("file", base)})


def normalise_functions(functions: DataFrame) -> DataFrame:
    """Add ``class_name, function_name, arity`` to a function metric table."""
    return (
        functions.withColumn("__sig", parse_signature("method"))
        .withColumns({"class_name": dotted_name("class"), "function_name": F.col("__sig.name"), "arity": F.col("__sig.arity")})
        .drop("__sig")
    )


def match_class_tiered(
    probes: DataFrame,
    catalogue: DataFrame,
    name: str,
    path: str,
    order: Sequence[str],
    metrics: Sequence[str],
    scope: Sequence[str] = (),
) -> DataFrame:
    """Probes with the metrics of their catalogue row and ``join_level``; both null without a match.

    ``scope`` columns (say the repository) must agree as well. Levels: the only row of that
    name; the only one of several on the probe's path; else the first by ``order``.
    """
    scope, order, metrics = list(scope), list(order), list(metrics)
    rest = [m for m in metrics if m not in order]
    at_path = catalogue.groupBy(*scope, name, path).agg(
        F.count("*").alias("__n_path"), F.min(F.struct(*order, *rest)).alias("__at_path")
    )
    by_name = at_path.groupBy(*scope, name).agg(F.sum("__n_path").alias("__n_name"), F.min("__at_path").alias("__first"))
    joined = probes.join(by_name, [*scope, name], "left").join(at_path, [*scope, name, path], "left")
    joined = joined.withColumn(
        "join_level",
        F.when(F.col("__n_name") == 1, "class_fqcn")
        .when(F.col("__n_path") == 1, "class_fqcn+path")
        .when(F.col("__n_name") > 1, "class_fqcn_ambiguous_first_match"),
    )
    pick = F.when(F.col("join_level") == "class_fqcn+path", F.col("__at_path")).otherwise(F.col("__first"))
    return joined.withColumn("__pick", pick).select(
        *probes.columns, "join_level", *[F.col(f"__pick.{m}").alias(m) for m in metrics]
    )


def match_function_tiered(
    probes: DataFrame,
    catalogue: DataFrame,
    name: Sequence[str],
    arity: str,
    n_params: str,
    order: Sequence[str],
    metrics: Sequence[str],
    scope: Sequence[str] = (),
) -> DataFrame:
    """As above for functions, keyed by ``name`` columns: exact arity first, else the first of that name."""
    keys, order, metrics = [*scope, *name], list(order), list(metrics)
    rest = [m for m in metrics if m not in order]
    by_arity = catalogue.groupBy(*keys, arity).agg(F.min(F.struct(*order, *rest)).alias("__exact"))
    by_name = by_arity.groupBy(*keys).agg(F.min("__exact").alias("__first"))
    exact = by_arity.filter(F.col(arity).isNotNull()).withColumnRenamed(arity, n_params)
    exact = exact.withColumn(n_params, F.col(n_params).cast(probes.schema[n_params].dataType))
    joined = probes.join(by_name, keys, "left").join(exact, [*keys, n_params], "left")
    joined = joined.withColumn(
        "join_level",
        F.when(F.col("__exact").isNotNull(), "method_fqcn+name+arity").when(F.col("__first").isNotNull(), "method_fqcn+name_only"),
    ).withColumn("__pick", F.coalesce("__exact", "__first"))
    return joined.select(*probes.columns, "join_level", *[F.col(f"__pick.{m}").alias(m) for m in metrics])

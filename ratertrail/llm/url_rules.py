"""Allow and block rules for URLs, by digests of host-suffix and path-prefix expressions.

A rule is a host and a path. Each URL is expanded into the expressions a rule could have: the last labels of its
host, followed by a beginning of its path. Only the shapes (labels of the host, length of the path) that some rule has
are expanded, so a rule of whatever length is met by exactly one expression. Expressions and rules meet in an
equi-join on the first bytes of their SHA-256 digests; of what meets, only equal digests count, and the longest
rule decides. Before that, URLs are cut to what any rule can see of them and collapsed, so a host that holds a third
of all rows is judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratertrail.session import cut_lineage

#: Hexadecimal digits of a digest that the join goes by: four bytes.
PREFIX = 8
#: What a URL gets that no rule fits.
DEFAULT = "allow"

_UPPER = "".join(map(chr, range(65, 91)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z in lower case) and the path; both empty for null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _UPPER.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.char_length(host) - F.char_length(F.replace(host, F.lit("."))) + 1


def rule_digests(rules: DataFrame) -> DataFrame:
    """``labels, length, digest, prefix, rule, size, verdict`` of every distinct rule of ``host, path, verdict``.

    Hosts are put into lower case; rows with a null in any of the three are no rules; of two verdicts for one rule ``block`` holds.
    """
    given = rules.select(F.translate("host", _UPPER, _UPPER.lower()).alias("host"), "path", "verdict").dropna()
    written = F.concat("host", "path")
    one = given.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    digest = F.sha2(written.cast("binary"), 256)
    return one.select(
        _labels(F.col("host")).alias("labels"),
        F.char_length("path").alias("length"),
        digest.alias("digest"),
        F.substring(digest, 1, PREFIX).alias("prefix"),
        written.alias("rule"),
        F.char_length(written).alias("size"),
        F.char_length("host").alias("host_size"),
        "verdict",
    )


def expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """All expressions of a URL that have one of the shapes (labels of the host, length of the path)."""
    wanted = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("length")) for a, b in sorted(shapes)])
    has = F.filter(wanted, lambda s: (_labels(host) >= s["labels"]) & (F.char_length(path) >= s["length"]))
    return F.transform(has, lambda s: F.concat(F.call_function("substring_index", host, F.lit("."), -s["labels"]), F.substring(path, F.lit(1), s["length"])))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", into: str = "judged", default: str = DEFAULT) -> DataFrame:
    """The rows of ``pages`` with a struct ``into`` of ``host, path, rule, verdict``.

    A rule fits its host and all subdomains, if the path starts with the rule's; the longest rule (host and path
    together; ties: the longer host) decides. ``rule`` is null and the verdict ``default`` where none fits, so for null and
    empty URLs too. Repeated rows are judged alike and all kept; a column named like ``into`` is replaced, all others
    are passed on; an empty table gives an empty one, and without rules every row gets the default. The driver sees the
    shapes that rules have, which are bounded by the longest rule.
    """
    ruled = cut_lineage(rule_digests(rules))
    shapes = [(r["labels"], r["length"]) for r in ruled.select("labels", "length").distinct().collect()]
    others = [F.col(f"`{c}`") for c in pages.columns if c != into]
    host, path = host_and_path(F.col(f"`{url}`"))
    if not shapes:
        return pages.select(*others, F.struct(host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")).alias(into))
    # No rule sees more of a URL than these last labels and first letters.
    tail = F.call_function("substring_index", host, F.lit("."), F.lit(-max(a for a, _ in shapes)))
    head = F.substring(path, 1, max(b for _, b in shapes))
    seen = pages.select(tail.alias("tail"), head.alias("head")).distinct()
    asked = seen.select("tail", "head", F.explode(expressions(F.col("tail"), F.col("head"), shapes)).alias("expression"))
    digest = F.sha2(F.col("expression").cast("binary"), 256)
    asked = asked.select("tail", "head", digest.alias("asked_digest")).withColumn("prefix", F.substring("asked_digest", 1, PREFIX))
    met = asked.join(ruled, "prefix").filter("asked_digest = digest")
    longest = F.max(F.struct("size", "host_size", "rule", "verdict")).alias("best")
    judged = cut_lineage(met.groupBy("tail", "head").agg(longest).select("tail", "head", "best.rule", "best.verdict"))
    named = judged.select(F.struct("tail", "head").alias("judged_key"), F.struct("rule", "verdict").alias("judged_best"))
    rows = pages.select(F.struct(*others).alias("row"), F.struct(host.alias("host"), path.alias("path")).alias("parts"), F.struct(tail.alias("tail"), head.alias("head")).alias("key"))
    joined = rows.join(named, rows["key"] == named["judged_key"], "left")
    outcome = F.struct(F.col("parts.host"), F.col("parts.path"), F.col("judged_best.rule"), F.coalesce("judged_best.verdict", F.lit(default)).alias("verdict"))
    return joined.select(*[F.col("row")[c].alias(c) for c in pages.columns if c != into], outcome.alias(into))

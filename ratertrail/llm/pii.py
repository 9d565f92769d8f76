"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Fixed patterns with checks find the seed entities. The words around them become lexical patterns; a
graph links patterns to the identifier-like strings (instances) that they stand beside. Patterns
and instances are scored in turn for a few rounds: a pattern by the share of reliable instances
among all it stands beside, an instance by its patterns. Patterns that end up reliable, on enough
different seeds, mark the instances beside them as further identifiers.

Texts without a digit or ``@`` can't hold any and take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratertrail.session import cut_lineage

# The seed kinds in their order, and their patterns. A match that begins inside a run of its first
# class could only repeat one that failed at the run's start, so matches begin there or where the last one ended.
KINDS = ("email", "ip", "card", "phone")
SEED_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
FOUND = "id"
#: Strings that may be identifiers: unbroken, with a digit.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
#: An identifier has so many letters or digits at least, and two digits.
LEAST_LENGTH = 6
ROUNDS, SUPPORT, RELIABLE, DOUBT = 3, 3, 0.6, 1.0
#: Characters around a match in which its neighbouring words are looked for.
REACH = 48


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Of the digits from the right, every second one doubled (9 taken off where that has two digits), the sum ends in 0."""
    digits = F.transform(F.split(F.reverse(_digits(m)), ""), lambda d: d.cast("int"))
    digits = F.filter(digits, lambda d: d.isNotNull())
    counted = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(counted, F.lit(0), lambda s, d: s + d) % 10 == 0


def _valid(kind: Column, m: Column) -> Column:
    n = F.char_length(_digits(m))
    parts = F.transform(F.split(m, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    small = F.forall(parts, lambda p: (F.char_length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    return F.when(kind == "ip", small).when(kind == "card", n.between(12, 19) & _luhn(F.when(n.between(12, 19), m))).when(kind == "phone", n.between(9, 15)).otherwise(True)


def carriers(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row, doc``: the rows whose text has a digit or ``@``, numbered; a table in the shared folder, so the numbers stay."""
    held = docs.filter(F.rlike(F.col(f"`{text}`"), F.lit("[0-9@]")))
    return cut_lineage(held.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")))


def matches(rows: DataFrame, text: Column, patterns: dict[str, str]) -> DataFrame:
    """``row, kind, start, end, entity, left, right``: all matches of each pattern, in code points, end exclusive, with what stands around."""
    def of(kind: str, pattern: str) -> Column:
        # Matches and the pieces between them, in the order of the text.
        return F.struct(F.lit(kind).alias("kind"), F.split(text, pattern).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    each = rows.select("row", F.explode(F.array(*[of(k, p) for k, p in patterns.items()])).alias("m")).select("row", "m.*").filter(F.size("found") > 0)
    zipped = F.arrays_zip(F.col("found").alias("entity"), F.col("pieces").alias("left"), F.slice("pieces", F.lit(2), F.size("pieces")).alias("right"))
    one = each.select("row", "kind", F.posexplode(zipped).alias("pos", "m")).filter("m.entity is not null")
    one = one.select("row", "kind", "pos", F.col("m.entity").alias("entity"), F.char_length("m.left").alias("before"), F.right("m.left", F.lit(REACH)).alias("left"), F.left("m.right", F.lit(REACH)).alias("right"))
    size = F.char_length("entity")
    end = F.sum(F.col("before") + size).over(Window.partitionBy("row", "kind").orderBy("pos"))
    return one.select("row", "kind", (end - size).alias("start"), end.alias("end"), "entity", "left", "right")


def seeds(rows: DataFrame, text: Column) -> DataFrame:
    """The matches of the seed kinds that pass their checks."""
    return matches(rows, text, SEED_PATTERNS).filter(_valid(F.col("kind"), F.col("entity")))


def contexts(mentions: DataFrame) -> DataFrame:
    """``pattern, instance``: distinct lexical patterns of mentions: the word before, the word after, and a name before ``=`` or ``:``."""
    word = lambda c: F.lower(F.regexp_extract(F.col(c), {"left": r"([\p{L}_]+)[^\p{L}]*$", "right": r"^[^\p{L}]*([\p{L}_]+)"}[c], 1))
    name = F.lower(F.regexp_extract("entity", r"^([\p{L}_]+)[=:]", 1))
    made = [F.when(w != "", F.concat(F.lit(f"{side} "), w)) for side, w in (("before", word("left")), ("after", word("right")), ("name", name))]
    made.append(F.when((word("left") != "") & (word("right") != ""), F.concat(F.lit("both "), word("left"), F.lit(" "), word("right"))))
    keys = [c for c in mentions.columns if c in ("row", "start", "end")]
    return mentions.select(*keys, F.lower("entity").alias("instance"), F.explode(F.filter(F.array(*made), lambda p: p.isNotNull())).alias("pattern"))


def reliable_patterns(edges: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, reliable: float = RELIABLE) -> DataFrame:
    """``pattern``: the reliable ones of the graph ``pattern, instance, seed`` (distinct edges).

    A frequent word is a pattern with very many instances; sums per pattern combine before the
    shuffle, and the joins back can be split.
    """
    edges = cut_lineage(edges)
    trust = edges.select("pattern", "instance", "seed", F.when(F.col("seed"), 1.0).otherwise(0.0).alias("trust"))
    scores = None
    for _ in range(rounds):
        scores = trust.groupBy("pattern").agg(
            F.sum("trust").alias("sum"), F.count("*").alias("n"), F.sum(F.when(F.col("seed"), 1).otherwise(0)).alias("seeds")
        ).select("pattern", (F.col("sum") / (F.col("n") + DOUBT)).alias("score"), "seeds")
        scores = cut_lineage(scores)
        told = edges.join(scores, "pattern").groupBy("instance").agg(F.avg("score").alias("told"))
        trust = edges.join(told, "instance").select("pattern", "instance", "seed", F.when(F.col("seed"), 1.0).otherwise(F.col("told")).alias("trust"))
    return scores.filter((F.col("seeds") >= support) & (F.col("score") >= reliable)).select("pattern")


def spans_of(rows: DataFrame, text: Column) -> DataFrame:
    """``row, kind, start, end``: seeds and further identifiers (kind ``id``) of the rows."""
    sure = cut_lineage(seeds(rows, text))
    candidates = matches(rows, text, {FOUND: CANDIDATE})
    shape = F.regexp_replace("entity", r"[^\p{L}0-9]", "")
    candidates = candidates.filter((F.char_length(shape) >= LEAST_LENGTH) & (F.char_length(_digits(F.col("entity"))) >= 2))
    # Those that touch a seed are no new ones. Seeds of a row are merged to stretches first: each candidate meets the last one that begins before its end.
    marks = sure.select("row", F.col("start").alias("at"), F.lit(0).alias("is"), "end", F.lit(None).cast("string").alias("entity"), F.lit(None).cast("string").alias("left"), F.lit(None).cast("string").alias("right"), F.col("start"))
    asked = candidates.select("row", (F.col("end") - 1).alias("at"), F.lit(1).alias("is"), "end", "entity", "left", "right", "start")
    reach = F.max(F.when(F.col("is") == 0, F.col("end"))).over(Window.partitionBy("row").orderBy("at", "is").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fresh = marks.unionByName(asked).withColumn("reach", reach).filter("is = 1 and (reach is null or reach <= start)").drop("reach", "is", "at")
    fresh = cut_lineage(fresh)
    named = contexts(fresh)
    edges = contexts(sure).select("pattern", "instance", F.lit(True).alias("seed")).unionByName(named.select("pattern", "instance", F.lit(False).alias("seed")))
    edges = edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    marked = named.join(reliable_patterns(edges), "pattern", "left_semi").select("row", F.lit(FOUND).alias("kind"), "start", "end").distinct()
    return sure.select("row", "kind", "start", "end").unionByName(marked)


def find_spans(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """All columns of ``docs`` and an array ``into`` of spans (start, kind, end), by start, then kind.

    Null texts count as empty; repeated rows get their spans each; an empty table gives an empty one;
    a column named as ``into`` is replaced.
    """
    own = [c for c in docs.columns if c != into]
    docs = docs.select(*[F.col(f"`{c}`") for c in own])
    rows = carriers(docs, text)
    order = F.array_position(F.array(*[F.lit(k) for k in (*KINDS, FOUND)]), F.col("kind"))
    found = spans_of(rows, F.col(f"doc.`{text}`")).select(F.col("row").alias("span_row"), F.struct("start", order.alias("rank"), "kind", "end").alias("span"))
    found = found.groupBy("span_row").agg(F.array_sort(F.collect_list("span")).alias("found_spans"))
    kind = "array<struct<start:bigint,rank:bigint,kind:string,end:bigint>>"
    with_any = rows.join(found, F.col("row") == F.col("span_row"), "left").select(
        *[F.col(f"doc.`{c}`") for c in own], F.coalesce("found_spans", F.array().cast(kind)).cast(kind).alias(into)
    )
    without = docs.filter(~F.coalesce(F.rlike(F.col(f"`{text}`"), F.lit("[0-9@]")), F.lit(False))).select(*[F.col(f"`{c}`") for c in own], F.array().cast(kind).alias(into))
    return with_any.unionByName(without)


def written(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets; overlapping spans by that of the first.

    A column ``n_chars`` follows the new text.
    """
    mark = "pii_spans"
    while mark in docs.columns or f"{mark}_kept" in docs.columns:
        mark += "_"
    found = find_spans(docs, text, mark)
    t, s = F.col(f"`{text}`"), F.col(mark)
    # Ends so far, by a running maximum in the order of the spans.
    zero = F.struct(F.lit(0).cast("bigint").alias("upto"), F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>").alias("kept"))
    kept = F.aggregate(
        s, zero,
        lambda a, x: F.when(x["start"] >= a["upto"], F.struct(x["end"].alias("upto"), F.concat(a["kept"], F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))).alias("kept")))
        .otherwise(F.struct(F.greatest(a["upto"], x["end"]).alias("upto"), F.concat(F.slice(a["kept"], 1, F.size(a["kept"]) - 1), F.array(F.struct(F.element_at(a["kept"], -1)["start"].alias("start"), F.greatest(a["upto"], x["end"]).alias("end"), F.element_at(a["kept"], -1)["kind"].alias("kind")))).alias("kept"))),
    )["kept"]
    found = found.select("*", F.explode(F.array(kept)).alias(f"{mark}_kept"))
    k = F.col(f"{mark}_kept")
    piece = lambda x, i: F.concat(F.substring(t, (F.coalesce(F.get(k, i - 1)["end"], F.lit(0)) + 1).cast("int"), (x["start"] - F.coalesce(F.get(k, i - 1)["end"], F.lit(0))).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]"))
    rest = F.substring(t, (F.element_at(k, -1)["end"] + 1).cast("int"), F.char_length(t))
    new = F.when(F.size(k) > 0, F.concat(F.array_join(F.transform(k, piece), ""), rest)).otherwise(t)
    out = found.withColumn(text, new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(k) > 0, F.char_length(t).cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])

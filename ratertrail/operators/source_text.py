"""Finding entities in brace-language source text and testing their smell conditions.

A text is scanned once: comments and literals are blanked, and all declarations of types and functions are listed with
their places (``Declarations``). Whatever is asked of the text is looked up there. The scans run as Arrow-batched
pandas UDFs; the conditions on what they find are native expressions. ``status_by_revision`` brings each
distinct content to the scan once, with all entities that are asked of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratertrail.functions.scalar import CLASS_SMELLS, parse_class_name, parse_function_name
from ratertrail.operators.graph import content_digests
from ratertrail.session import cut_lineage

# Thresholds of the conditions, the look-ahead window, words before "(" that name
# no function, and the patterns of trivial accessors, branches and calls.
LONG_METHOD_LINES = 100
BLOB_LINES, BLOB_FUNCTIONS = 200, 20
TRIVIAL_FRACTION = 0.70
WINDOW = 300
NOT_FUNCTION_NAMES = {
    "if", "for", "while", "switch", "catch", "synchronized", "return", "new", "instanceof", "throw", "assert", "do", "else", "try",
}
TYPE_WORDS = ("class", "interface", "enum", "record")
TRIVIAL_GETTER = r"\{\s*return\s+[\w.]+\s*;\s*\}"
TRIVIAL_SETTER = r"\{\s*this\.\w+\s*=\s*\w+\s*;\s*\}"
CONTROL_FLOW = r"\b(if|for|while|switch)\s*\("
INTERNAL_CALL = r"\bthis\.\w+"
EXTERNAL_CALL = r"\b[a-z]\w*\.\w+\s*\("

SPAN_TYPE = T.StructType().add("start_line", "integer").add("end_line", "integer").add("body", "string")
FUNCTIONS_TYPE = T.ArrayType(T.StructType().add("name", "string").add("open_pos", "integer").add("snippet", "string"))

_LITERAL = re.compile(
    r'"(?:[^"\\]+|\\[\s\S])*\\?(?P<dq>"?)' r"|'(?:[^'\\]+|\\[\s\S])*\\?(?P<sq>'?)" r"|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
)
_TO_BRACE = re.compile(r"[\s\w.,<>\[\]]{0,%d}\{" % (WINDOW - 2))
# A name that is no plain word before "(", and the "." or ":" that makes it a call or a reference.
_NAMED = r"(?:(?P<member>[.:])[ \t]*)?\b(?P<name>{})\s*\("
_WORD = re.compile(r"\w+")
# A ")" with a brace behind it, and, read backwards from its "(", the name and the "." or ":" that makes it a call or a reference.
_CLOSED = re.compile(r"\)(?=[\s\w.,<>\[\]]{0,%d}(\{))" % (WINDOW - 2))
_BEFORE = re.compile(r"\s*(\w+)[ \t]*([.:]?)")
# What ends a line for str.splitlines besides a line feed.
_OTHER_LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_OPENERS, _CLOSERS = "<([{", ">)]}"


def _blank(m: re.Match) -> str:
    text = m.group()
    if text[:2] == "//":
        return " /" + " " * (len(text) - 2)
    if text[:2] == "/*":
        return re.sub(r"[^\n]", " ", text)
    closing = m.group("dq") or m.group("sq") or ""
    return text[0] + " " * (len(text) - 1 - len(closing)) + closing


def masked(text: str) -> str:
    """Same-length text with comments and the insides of literals blanked.

    Line ends survive in comments, quotes survive around literals, and of ``//`` the second slash stays.
    """
    return _LITERAL.sub(_blank, text)


def _parentheses(mask: str) -> dict[int, int]:
    """The closing one of each opening parenthesis that has one."""
    stack, pairs = [], {}
    for m in re.finditer(r"[()]", mask):
        if m.group() == "(":
            stack.append(m.start())
        elif stack:
            pairs[stack.pop()] = m.start()
    return pairs


def _closing_brace(mask: str, brace: int) -> int | None:
    depth, at = 0, brace
    while (end := mask.find("}", at)) >= 0:
        depth += mask.count("{", at, end) - 1
        if depth == 0:
            return end
        at = end + 1
    return None


def _ends_at_word(text: str, name: str) -> Iterator[tuple[int, int]]:
    """Start and end of each place of a name that a word boundary follows."""
    if not name:
        yield from (m.span() for m in re.finditer(r"\b", text))
        return
    inner, at = _is_word(name[-1]), text.find(name)
    while at >= 0:
        end = at + len(name)
        bounded = inner != (end < len(text) and _is_word(text[end]))
        if bounded:
            yield at, end
        at = text.find(name, end if bounded else at + 1)


def _is_word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def _is_blank(ch: str) -> bool:
    return ch in " \t"


def _skip_back(text: str, end: int, what: Callable[[str], bool]) -> int:
    """Where the run of such characters begins that ends at ``end``."""
    while end and what(text[end - 1]):
        end -= 1
    return end


def _declaring_word(mask: str, name_at: int) -> int | None:
    """Where the word begins that declares the type whose name is here, with the "@" of an annotation type that follows a word."""
    end = _skip_back(mask, name_at, str.isspace)
    if end == name_at or not mask.endswith(TYPE_WORDS, 0, end):
        return None
    for word in TYPE_WORDS:
        if mask.endswith(word, 0, end):
            start = end - len(word)
            if word == "interface":
                at = _skip_back(mask, start, str.isspace)
                if at > 1 and mask[at - 1] == "@" and _is_word(mask[at - 2]):
                    return at - 1
            if not start or not _is_word(mask[start - 1]):
                return start
    return None


def _n_arguments(args: str) -> int:
    if not args.strip():
        return 0
    depth, commas = 0, 0
    for ch in re.findall(r"[<(\[{>)\]},]", args):
        depth += (ch in _OPENERS) - (ch in _CLOSERS)
        commas += ch == "," and depth == 0
    return commas + 1


class Declarations:
    """All declarations of one text, found in one scan; whatever is not needed is not computed."""

    def __init__(self, text: str):
        self.text = text
        #: Literals and comments over several lines, by their ends.
        self.wide: list[tuple[int, int]] = []

    def _blanked(self, m: re.Match) -> str:
        if "\n" in m.group():
            self.wide.append(m.span())
        return _blank(m)

    @cached_property
    def mask(self) -> str:
        return _LITERAL.sub(self._blanked, self.text)

    @cached_property
    def closing(self) -> dict[int, int]:
        return _parentheses(self.mask)

    @cached_property
    def opening(self) -> dict[int, int]:
        return {end: start for start, end in self.closing.items()}

    @cached_property
    def other_line_ends(self) -> bool:
        return any(c in self.text for c in _OTHER_LINE_ENDS)

    @cached_property
    def functions(self) -> list[tuple[str, int, str, int]]:
        """``(name, its position, argument text, position of the body brace)`` of what looks like a declaration, in order."""
        found, mask = [], self.mask
        backwards, n = mask[::-1], len(mask)
        for m in _CLOSED.finditer(mask):
            end = m.start()
            start = mask.rfind("(", max(0, end - WINDOW), end)
            if start < 0 or mask.find(")", start, end) >= 0:
                # Far away, or others in between.
                start = self.opening.get(end, -1)
            before = _BEFORE.match(backwards, n - start) if start >= 0 else None
            if before and not before.group(2):
                low, high = n - before.end(1), n - before.start(1)
                found.append((start, (mask[low:high], low, mask[start + 1 : end], m.start(1))))
        return [f for _, f in sorted(found)]

    def _functions_named(self, name: str) -> list[tuple[str, int, str, int]]:
        """The same for a name that is not one plain word."""
        found = []
        for m in re.finditer(_NAMED.format(re.escape(name)), self.mask):
            end = None if m.group("member") else self.closing.get(m.end() - 1)
            if end is not None and (tail := _TO_BRACE.match(self.mask, end + 1)):
                found.append((name, m.start("name"), self.mask[m.end() : end], tail.end() - 1))
        return found

    @cached_property
    def by_name(self) -> dict[str, list[tuple[str, int, str, int]]]:
        found: dict[str, list] = {}
        for f in self.functions:
            found.setdefault(f[0], []).append(f)
        return found

    def span(self, start: int, brace: int) -> dict | None:
        end = _closing_brace(self.mask, brace)
        if end is None:
            return None
        first, last = self.text.count("\n", 0, start) + 1, self.text.count("\n", 0, end) + 1
        if self.other_line_ends:
            return {"start_line": first, "end_line": last, "body": "\n".join(self.text.splitlines()[first - 1 : last])}
        low, high = self._lines(start, end)
        return {"start_line": first, "end_line": last, "body": self.text[low:high]}

    def _lines(self, start: int, end: int) -> tuple[int, int]:
        """From the beginning of the line of ``start`` to the end of the line of ``end``."""
        high = self.text.find("\n", end)
        return self.text.rfind("\n", 0, start) + 1, len(self.text) if high < 0 else high

    def _type(self, name: str) -> tuple[int, int] | None:
        """Start and opening brace of the first type of that name."""
        for at, end in _ends_at_word(self.mask, name):
            start = _declaring_word(self.mask, at)
            if start is not None:
                brace = self.mask.find("{", end)
                return (start, brace) if brace >= 0 else None
        return None

    def class_span(self, name: str) -> dict | None:
        """First type declaration of that simple name, or None."""
        found = self._type(name) if name in self.text else None
        return self.span(*found) if found else None

    def class_functions(self, name: str, body: str) -> list[dict]:
        """The functions in the lines of a class that ``class_span`` has found."""
        start, brace = self._type(name)
        low, high = self._lines(start, _closing_brace(self.mask, brace))
        if self.other_line_ends or any(a < low < b for a, b in self.wide):
            # The lines read differently by themselves.
            return function_list(body)
        return [
            {"name": f, "open_pos": at - low, "snippet": self.text[at + 1 : min(high, at + 1 + WINDOW)]}
            for f, named, _, at in self.functions
            if named >= low and at < high and f not in NOT_FUNCTION_NAMES
        ]

    def function_span(self, name: str, n_params: int | None) -> dict | None:
        """First declaration of that name with ``n_params`` parameters, else the first of that name."""
        if name not in self.text:
            return None
        named = self.by_name.get(name, []) if _WORD.fullmatch(name) else self._functions_named(name)
        exact = (f for f in named if n_params is not None and _n_arguments(f[2]) == n_params)
        found = next(exact, named[0] if named else None)
        return self.span(found[1], found[3]) if found else None


def class_span(text: str, name: str) -> dict | None:
    """First type declaration of that simple name, or None."""
    return Declarations(text).class_span(name)


def function_span(text: str, name: str, n_params: int | None) -> dict | None:
    """First declaration of that name with ``n_params`` parameters, else the first of that name."""
    return Declarations(text).function_span(name, n_params)


def function_list(body: str) -> list[dict]:
    """Every function-shaped declaration at any depth, with the text after its opening brace."""
    return [
        {"name": name, "open_pos": brace, "snippet": body[brace + 1 : brace + 1 + WINDOW]}
        for name, _, _, brace in Declarations(body).functions
        if name not in NOT_FUNCTION_NAMES
    ]


def _spans(results: list[dict | None]) -> pd.DataFrame:
    columns = ["start_line", "end_line", "body"]
    frame = pd.DataFrame([r or dict.fromkeys(columns) for r in results], columns=columns)
    return frame.astype({"start_line": "Int32", "end_line": "Int32"})


#: Bytes of text that are turned into Python strings at once; an Arrow batch may hold many times that.
TEXT_AT_ONCE = 1 << 22


def _portions(texts: pa.Array) -> Iterator[pa.Array]:
    """An array of texts in slices of about ``TEXT_AT_ONCE`` bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // TEXT_AT_ONCE
    starts = np.flatnonzero(np.r_[len(part) > 0, part[1:] != part[:-1]])
    for low, high in zip(starts, np.r_[starts[1:], len(part)]):
        yield texts.slice(low, high - low)


@F.arrow_udf(T.StringType())
def mask_source(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        if not len(texts):
            yield pa.array([], pa.string())
        for part in _portions(texts):
            yield pa.array([None if t is None else masked(t) for t in part.to_pylist()], pa.string())


@F.pandas_udf(SPAN_TYPE)
def _find_class_span(text: pd.Series, name: pd.Series) -> pd.DataFrame:
    return _spans([class_span(t, n) if isinstance(t, str) and isinstance(n, str) else None for t, n in zip(text, name)])


@F.pandas_udf(SPAN_TYPE)
def _find_function_span(text: pd.Series, name: pd.Series, n_params: pd.Series) -> pd.DataFrame:
    return _spans([
        function_span(t, n, None if pd.isna(p) else int(p)) if isinstance(t, str) and isinstance(n, str) else None
        for t, n, p in zip(text, name, n_params)
    ])


def _or_null(span: Column) -> Column:
    return F.when(span["start_line"].isNotNull(), span)


def find_class_span(text: Column, name: Column) -> Column:
    """Span of a class, null when it is not there."""
    return _or_null(_find_class_span(text, name))


def find_function_span(text: Column, name: Column, n_params: Column) -> Column:
    return _or_null(_find_function_span(text, name, n_params))


@F.arrow_udf(FUNCTIONS_TYPE)
def list_functions(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        if not len(texts):
            yield _function_lists([])
        for part in _portions(texts):
            yield _function_lists([None if t is None else function_list(t) for t in part.to_pylist()])


def _function_lists(found: list[list[dict] | None]) -> pa.Array:
    """An Arrow array of ``FUNCTIONS_TYPE``, built column by column."""
    ends = np.cumsum([0, *[len(f or ()) for f in found]]).astype(np.int32)
    cells = [c for f in found for c in f or ()]
    columns = [pa.array([c[k] for c in cells], t) for k, t in (("name", pa.string()), ("open_pos", pa.int32()), ("snippet", pa.string()))]
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, ["name", "open_pos", "snippet"]))
    return pc.if_else(pa.array([f is not None for f in found], pa.bool_()), lists, None) if None in found else lists


#: What is asked of a text: a class, or else a function with a number of parameters (null: any).
ENTITY_TYPE = T.StructType().add("class_name", "string").add("function_name", "string").add("n_params", "integer")
#: What the conditions count: of a class its functions, those that only get or set, and those with branches; of a function its calls.
FACTS = ("n_functions", "n_trivial", "n_branching", "n_external", "n_internal")
READ_TYPE = T.StructType([*SPAN_TYPE, *[T.StructField(f, T.IntegerType()) for f in FACTS], T.StructField("functions", FUNCTIONS_TYPE)])
_ACCESSOR, _BRANCH = re.compile(f"{TRIVIAL_GETTER}|{TRIVIAL_SETTER}"), re.compile(CONTROL_FLOW)
_EXTERNAL, _INTERNAL = re.compile(EXTERNAL_CALL), re.compile(INTERNAL_CALL)


def read_entities(text: Column, entities: Column, texts_too: bool) -> Column:
    """For an array of ``ENTITY_TYPE``, an array of ``READ_TYPE``; the text is scanned once. Bodies and functions come with ``texts_too`` only."""

    @F.pandas_udf(T.ArrayType(READ_TYPE))
    def read(texts: pd.Series, asked: pd.Series) -> pd.Series:
        return pd.Series([_read(t, e, texts_too) for t, e in zip(texts, asked)], dtype=object)

    return read(text, entities)


def _read(text: str | None, asked: list[dict] | None, texts_too: bool) -> list[dict] | None:
    if asked is None:
        return None
    found, known = [], Declarations(text) if isinstance(text, str) else None
    for e in asked:
        span, functions, facts = None, None, {}
        if known and e["class_name"] is not None:
            if span := known.class_span(e["class_name"]):
                functions = known.class_functions(e["class_name"], span["body"])
                snippets = [f["snippet"] for f in functions]
                facts = {"n_functions": len(functions), "n_trivial": sum(1 for t in snippets if _ACCESSOR.search("{" + t)), "n_branching": sum(1 for t in snippets if _BRANCH.search(t))}
        elif known and e["function_name"] is not None:
            n = e["n_params"]
            if span := known.function_span(e["function_name"], None if pd.isna(n) else int(n)):
                facts = {"n_external": len(_EXTERNAL.findall(span["body"])), "n_internal": len(_INTERNAL.findall(span["body"]))}
        if span and not texts_too:
            span, functions = span | {"body": None}, None
        found.append({**dict.fromkeys(READ_TYPE.names), **(span or {}), **facts, "functions": functions})
    return found


def span_lines(span: Column) -> Column:
    return span["end_line"] - span["start_line"] + 1


def long_method_holds(span: Column, functions: Column | None = None) -> Column:
    return span_lines(span) >= LONG_METHOD_LINES


def blob_holds(span: Column, functions: Column | None = None) -> Column:
    return (span_lines(span) >= BLOB_LINES) & (span["n_functions"] >= BLOB_FUNCTIONS)


def data_class_holds(span: Column, functions: Column | None = None) -> Column:
    """Mostly trivial accessors and no branches, judged on the text after each opening brace."""
    n = span["n_functions"]
    return (n > 0) & (F.try_divide(span["n_trivial"], n) >= TRIVIAL_FRACTION) & (span["n_branching"] == 0)


def feature_envy_holds(span: Column, functions: Column | None = None) -> Column:
    return span["n_external"] > span["n_internal"]


# Condition per smell: a function of what was read of the entity (``READ_TYPE``) and its declared functions. Open to
# additions; these go by the counts alone, so the texts need not leave the scan.
CONDITIONS: dict[str, Callable[[Column, Column], Column]] = {
    "long method": long_method_holds,
    "blob": blob_holds,
    "data class": data_class_holds,
    "feature envy": feature_envy_holds,
}


def _entity(smell: str, code_name: str) -> Column:
    on_class = F.col(smell).isin(*CLASS_SMELLS)
    fn = parse_function_name(code_name)
    class_name = F.when(on_class, F.coalesce(parse_class_name(code_name), F.lit("")))
    return F.struct(class_name.alias("class_name"), F.when(~on_class, fn["function_name"]).alias("function_name"), fn["n_params"].cast("int").alias("n_params"))


def _judged(read: Column, smell: str, conditions: dict[str, Callable]) -> tuple[Column, Column]:
    """``alive, holds`` from what was read of an entity."""
    span, functions = _or_null(read), read["functions"]
    holds = F.lit(None).cast("boolean")
    for name, condition in conditions.items():
        holds = F.when(F.col(smell) == name, condition(span, functions)).otherwise(holds)
    return span.isNotNull(), F.when(span.isNotNull(), holds)


def entity_status(
    df: DataFrame, content: str, smell: str, code_name: str, conditions: dict[str, Callable] | None = None
) -> DataFrame:
    """Adds ``alive, holds``: whether the named entity is in the text, and whether its smell's condition holds.

    Own conditions are functions of a struct with the span, its body and the ``FACTS``, and of the functions found in it.
    """
    listed = df.withColumn("__read", read_entities(F.col(content), F.array(_entity(smell, code_name)), conditions is not None)[0])
    alive, holds = _judged(F.col("__read"), smell, CONDITIONS if conditions is None else conditions)
    return listed.withColumns({"alive": alive, "holds": holds}).drop("__read")


#: Entities that are asked of one content together; more of them are asked in several goes.
ENTITIES_AT_ONCE = 256


#: Characters of text that one task of the join with the texts gets, about.
TEXT_A_TASK = 1 << 26
#: With more lists than this the join is left to sort and merge: the size of texts that are made or compressed is misjudged, and they don't fit a broadcast.
LISTS_TO_MERGE = 100_000


def _with_texts(lists: DataFrame, blobs: DataFrame) -> DataFrame:
    """The rows with the ``content`` at their ``repo, sha, path``: the only join that moves texts.

    Texts may compress a hundredfold, so that partitions of a fair size on the wire are far too large; their number goes by the digests' lengths.
    """
    key = ["repo", "sha", "path"]
    lists = cut_lineage(lists)
    rows, length = lists.agg(F.count("*"), F.coalesce(F.sum("digest.length"), F.lit(0))).first()
    tasks = max(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), length // TEXT_A_TASK + 1)
    texts = blobs.select(*key, "content")
    return lists.repartition(tasks, *key).join(texts.hint("merge") if rows > LISTS_TO_MERGE else texts, key)


def status_by_revision(revisions: DataFrame, blobs: DataFrame, conditions: dict[str, Callable] | None = None) -> DataFrame:
    """Adds ``readable, alive, holds`` to revisions with ``repo, sha, path, smell, code_name``.

    Texts are compared by digest. Each distinct text is fetched and scanned once, and all entities asked of it are looked
    up in its declarations (in goes of about ``ENTITIES_AT_ONCE``, so that no list grows without bound).
    """
    key, what = ["repo", "sha", "path"], ["smell", "code_name"]
    # Digests are taken at the scan, so this join moves no text; the rows are read three times below.
    keyed = cut_lineage(revisions.join(content_digests(blobs), key, "left"))
    known = keyed.filter(F.col("digest").isNotNull())
    asked = known.select("digest", *what).distinct()
    holder = known.groupBy("digest").agg(F.min(F.struct(*key)).alias("at"), F.approx_count_distinct(F.struct(*what)).alias("n"))
    holder = holder.select("digest", "at", (F.floor(F.col("n") / ENTITIES_AT_ONCE) + 1).alias("goes"))
    lists = asked.join(holder, "digest").withColumn("go", F.pmod(F.xxhash64(*what), "goes").cast("int"))
    lists = lists.groupBy("digest", "go").agg(F.any_value("at").alias("at"), F.collect_list(F.struct(*what, _entity(*what).alias("entity"))).alias("asked"))
    read = _with_texts(lists.select("digest", "at.*", "asked"), blobs)
    read = read.withColumn("read", read_entities(F.col("content"), F.transform("asked", lambda a: a["entity"]), conditions is not None))
    each = read.select("digest", F.explode(F.arrays_zip("asked", "read")).alias("z")).select("digest", "z.asked.smell", "z.asked.code_name", F.col("z.read").alias("read"))
    alive, holds = _judged(F.col("read"), "smell", CONDITIONS if conditions is None else conditions)
    judged = each.select("digest", *what, alive.alias("alive"), holds.alias("holds"))
    return (
        keyed.join(judged, ["digest", *what], "left")
        .withColumn("readable", F.col("digest").isNotNull())
        .select(*revisions.columns, "readable", "alive", "holds")
    )

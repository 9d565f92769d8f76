"""Column expressions: recodes, name parsing, dates, labels for display."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grades from mildest to gravest, the grades counted as severe, the kinds of
# smell and the ones that describe a class.
GRADES = ("none", "minor", "major", "critical")
SEVERE_GRADES = ("major", "critical")
SMELLS = ("blob", "data class", "feature envy", "long method")
CLASS_SMELLS = ("blob", "data class")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def instance_key(*cols: Column | str, sep: str = "::") -> Column:
    """One string key out of several columns."""
    return F.concat_ws(sep, *[_col(c).cast("string") for c in cols])


def ordinal_rank(c: Column | str, order: Sequence[str], strict: bool = True) -> Column:
    """Position of a label in ``order``; null stays null, an unknown label is an error when strict."""
    c = _col(c)
    rank = F.when(c.isNull(), F.lit(None).cast("int"))
    for position, label in enumerate(order):
        rank = rank.when(c == label, F.lit(position))
    if not strict:
        return rank
    return rank.otherwise(F.raise_error(F.concat(F.lit("label outside the given order: "), c)).cast("int"))


def case_recode(branches: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """First true branch wins."""
    (cond, value), *rest = branches
    out = F.when(cond, value if isinstance(value, Column) else F.lit(value))
    for cond, value in rest:
        out = out.when(cond, value if isinstance(value, Column) else F.lit(value))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def binary_flag(c: Column | str, hit: str = "1", yes: str = "relevant", no: str = "other") -> Column:
    """Two-way recode of a text flag; everything but ``hit``, null included, is ``no``."""
    return F.when(_col(c) == hit, yes).otherwise(no)


def severe_flag(c: Column | str, severe: Sequence[str] = SEVERE_GRADES, yes: str = "severe", no: str = "not_severe") -> Column:
    return F.when(_col(c).isin(*severe), yes).otherwise(no)


def repo_slug(url: Column | str) -> Column:
    """``host:owner/name.git`` to ``owner__name``."""
    path = F.split(_col(url), ":", 2).getItem(1)
    return F.replace(F.regexp_replace(path, r"\.git$", ""), F.lit("/"), F.lit("__"))


def repo_https_url(url: Column | str, base: str = "https://github.com/") -> Column:
    return F.concat(F.lit(base), F.split(_col(url), ":", 2).getItem(1))


def parse_class_name(code_name: Column | str) -> Column:
    """Simple class name: last dotted part of what precedes ``#``."""
    return F.substring_index(F.substring_index(_col(code_name), "#", 1), ".", -1)


def parse_function_name(code_name: Column | str) -> Column:
    """``struct(class_name, function_name, n_params)`` of ``pkg.Type#name A|B`` or ``pkg.Type.name A|B``.

    The signature is split on its first space, because parameter types may hold spaces themselves.
    """
    c = _col(code_name)
    hashed = F.instr(c, "#") > 0
    tail = F.when(hashed, F.split(c, "#", 2).getItem(1)).otherwise(c)
    halves = F.split(tail, " ", 2)
    head = halves.getItem(0)
    params = F.when(F.size(halves) > 1, halves.getItem(1)).otherwise("")
    class_name = F.when(hashed, F.substring_index(c, "#", 1)).otherwise(F.regexp_replace(head, r"\.?[^.]*$", ""))
    function_name = F.when(hashed, head).otherwise(F.substring_index(head, ".", -1))
    n_params = F.size(F.filter(F.split(params, r"\|"), lambda p: p != ""))
    return F.when(
        c.isNotNull(),
        F.struct(class_name.alias("class_name"), function_name.alias("function_name"), n_params.alias("n_params")),
    )


def dotted_name(c: Column | str) -> Column:
    """Binary name of a nested type to its source form."""
    return F.replace(_col(c), F.lit("$"), F.lit("."))


def parse_signature(c: Column | str) -> Column:
    """``name/arity[...]`` to ``struct(name, arity)``; both null without a match."""
    c = _col(c)
    pattern = r"^([^/]+)/(\d+)"
    name = F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    arity = F.nullif(F.regexp_extract(c, pattern, 2), F.lit("")).try_cast("int")
    return F.struct(name.alias("name"), arity.alias("arity"))


def relative_path(path: Column | str, base: Column | str | None = None) -> Column:
    """Path without leading slashes; with ``base``, the part below it, or unchanged when outside."""
    p = _col(path)
    if base is None:
        return F.ltrim(p, F.lit("/"))
    b = F.concat(F.rtrim(F.lit(base) if isinstance(base, str) else base, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(p, b), F.substr(p, F.length(b) + 1)).otherwise(p)


def clip_detail(c: Column | str, head: int | None = 500, tail: int | None = None) -> Column:
    """Bound a message for a log: its first ``head`` or its last ``tail`` characters."""
    c = _col(c).cast("string")
    return F.right(c, F.lit(tail)) if tail is not None else F.substring(c, 1, head)


def parse_iso_ts(c: Column | str) -> Column:
    """ISO-8601 text with an offset or ``Z`` to a timestamp."""
    return F.to_timestamp(_col(c))


def elapsed_days(start: Column | str, end: Column | str) -> Column:
    """Whole days from start to end, rounded towards minus infinity."""
    micros = F.unix_micros(_col(end).cast("timestamp")) - F.unix_micros(_col(start).cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("long")


def flag_negative(c: Column | str) -> Column:
    return F.coalesce(_col(c) < 0, F.lit(False))


def pct(part: Column | str, whole: Column | str | None = None, digits: int = 2) -> Column:
    """Percentage rounded half to even."""
    p = _col(part).cast("double")
    return F.bround(100 * p if whole is None else 100 * p / _col(whole), digits)


def owner_group(repository: Column | str, first: str = "github.com:apache/", second: str = "github.com:eclipse") -> Column:
    """Owner class of a repository URL; ``first`` is matched as written, ``second`` in any case."""
    c = _col(repository)
    return case_recode(
        [(F.contains(c, F.lit(first)), "apache"), (F.contains(F.lower(c), F.lit(second.lower())), "eclipse")], "other"
    )


def human_bytes(n: Column | str) -> Column:
    """Byte count in the largest 1024-step unit below 1024 of it, one decimal."""
    n = _col(n).cast("double")
    label = lambda steps, unit: F.format_string(f"%.1f{unit}", F.bround(n / float(1024**steps), 1))
    return case_recode(
        [(n < 1024.0 ** (i + 1), label(i, u)) for i, u in enumerate(("B", "KB", "MB", "GB"))], label(4, "TB")
    )


def project_by_kind(kind: Column | str, metrics: dict[str, tuple[Column | None, Column | None]], class_kinds: Sequence[str] = CLASS_SMELLS) -> list[Column]:
    """One column per metric: its first expression on class rows, its second on function rows, null for ``None``."""
    on_class = _col(kind).isin(*class_kinds)
    null = F.lit(None).cast("double")
    return [
        F.when(on_class, null if c is None else c.cast("double")).otherwise(null if f is None else f.cast("double")).alias(name)
        for name, (c, f) in metrics.items()
    ]

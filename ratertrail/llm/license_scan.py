"""License scan by conditional compression.

A text with a license word is cut into words, line ends included as any white space. Around every
license word, all templates are sought by their exact wording: a template's words must stand
there, but for a bounded number of differences, and no other name or number in their place. All
places that don't overlap are reported, under the line they begin in. A line with a license word and
no license is reported with the template that leads: the text around the word is compressed by
Zstandard on its own and with each template as raw dictionary, and the leader makes it shrink most.
"""

from __future__ import annotations

import bisect
import difflib
import functools
import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# License ids and customary wordings.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This work is licensed under the Mozilla Public License, Version 2.0.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "ISC": "Released under the ISC License.",
    "LicenseRef-All-Rights-Reserved": "All rights reserved.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
}
# Passages that full license texts are known by.
_GRANT = "BSD-2-Clause"
_ENDORSE = "BSD-3-Clause"
FULL_TEXTS = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions:"""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    (_GRANT, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    (_ENDORSE, "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
)
#: Words after the grant of a BSD license within which the third clause makes it the other BSD license.
CLAUSES = 200
SPDX = "spdx-license-identifier"
#: Words that make a line a candidate.
CUES = r"(?i)licen[sc]e|public\W+domain|all\W+rights\W+reserved|permission\W+(?:is\W+hereby|to\W+use)|redistribution\W+and\W+use|endorse\W+or\W+promote"
#: Words before and after a license word among which templates are sought, and characters on either side that are compressed.
BEFORE, AFTER, AROUND = 100, 100, 200
#: Differing words that a confirmed block may have for each ten of the template; names and numbers may never differ.
SLACK = 1
_GENERIC = frozenset("a an and by for in is of on or the this that these those to under with work works code file program software project licensed license released version dedicated public general".split())


_WORD = re.compile(r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+|\.[0-9]+)*")
_CUE = re.compile(CUES, re.ASCII)


def wording(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


@functools.lru_cache(maxsize=4)
def _prepared(templates: tuple[tuple[str, str], ...]):
    made = []
    for name, text in templates:
        primed = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.append((name, wording(text), zstandard.ZstdCompressor(level=19, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)))
    return made, zstandard.ZstdCompressor(level=19, write_checksum=False, write_content_size=False), [(name, words) for name, words, _ in made]


def differences(template: list[str], block: list[str]) -> tuple[int, bool]:
    """Words of the template that the block's best stretch lacks or has more of, and whether a name or number is among them."""
    found = difflib.SequenceMatcher(None, template, block, autojunk=False)
    runs = [m for m in found.get_matching_blocks() if m.size]
    if not runs:
        return len(template), True
    low, high = max(0, runs[0].b - runs[0].a), min(len(block), runs[-1].b + len(template) - runs[-1].a)
    n, named = 0, False
    for tag, a, b, c, d in difflib.SequenceMatcher(None, template, block[low:high], autojunk=False).get_opcodes():
        if tag != "equal":
            words = template[a:b] + block[low:high][c:d]
            n += max(b - a, d - c)
            named |= any(w not in _GENERIC for w in words)
    return n, named


def _stretch(template: list[str], words: list[str], most: int) -> tuple[int, int, int] | None:
    """Differences, start and end of the stretch of ``words`` nearest to the template, if at most ``most`` words differ, no name or number among them."""
    out = most + 1
    free = [1 if w in _GENERIC else out for w in words]
    rows = [(0, k) for k in range(len(words) + 1)]  # by end: differences, start
    for t in template:
        lost = 1 if t in _GENERIC else out
        new = [(rows[0][0] + lost, 0)]
        for k, w in enumerate(words):
            here = rows[k] if w == t else (rows[k][0] + max(lost, free[k]), rows[k][1])
            new.append(min(here, (rows[k + 1][0] + lost, rows[k + 1][1]), (new[k][0] + free[k], new[k][1]), key=lambda x: (x[0], -x[1])))
        rows = new
    n, end = min((n, k) for k, (n, _) in enumerate(rows))
    return (n, rows[end][1], end) if n <= most else None


def find_templates(words: list[str], templates: tuple[tuple[str, str], ...]) -> list[tuple[int, int, str, int]]:
    """Start, end, license and differing words of all confirmed templates, without overlaps: fewer differences and longer ones first."""
    at: dict[str, list[int]] = {}
    for k, w in enumerate(words):
        at.setdefault(w, []).append(k)
    found = set()
    for name, own in _prepared(templates)[2]:
        named = [(len(at.get(w, ())), j) for j, w in enumerate(own) if w not in _GENERIC]
        if not own or (named and min(named)[0] == 0):
            continue
        # A name or number never differs, so every confirmed stretch holds the rarest one.
        most = SLACK * len(own) // 10
        places, j = (at[own[min(named)[1]]], min(named)[1]) if named else (range(len(words)), 0)
        for k in places:
            low = max(0, k - j - most)
            if got := _stretch(own, words[low : k - j + len(own) + most], most):
                found.add((got[0], low + got[1], low + got[2], name))
    ids = {name.lower(): name for name, _ in templates}
    for k in at.get(SPDX, ()):
        last = k
        while (i := last + 1) < len(words):
            name = ids.get(words[i].removesuffix("-only").removesuffix("-or-later"))
            if name:
                found.add((0, last, i + 1, name))
            last = i + 1 if i + 1 < len(words) and words[i + 1] in ("or", "and") else len(words)
    taken, out = [], []
    for n, start, end, name in sorted(found, key=lambda x: (x[0], x[1] - x[2], x[1], x[3])):
        # Taken stretches don't overlap, so their order by start is that by end.
        p = bisect.bisect_left(taken, (start,))
        if (p == 0 or taken[p - 1][1] <= start) and (p == len(taken) or taken[p][0] >= end):
            taken.insert(p, (start, end))
            out.append((start, end, name, n))
    return _one_bsd(sorted(out), words)


def _one_bsd(found: list[tuple[int, int, str, int]], words: list[str]) -> list[tuple[int, int, str, int]]:
    """A BSD grant and the third clause that follows are one license."""
    out = []
    for start, end, name, n in found:
        if name == _ENDORSE and "endorse" in words[start:end]:
            grant = next((k for k in range(len(out) - 1, -1, -1) if out[k][2] == _GRANT and "redistribution" in words[out[k][0] : out[k][1]]), None)
            if grant is not None and start - out[grant][1] <= CLAUSES:
                out[grant] = (out[grant][0], end, name, out[grant][3] + n)
                continue
        out.append((start, end, name, n))
    return out


@functools.lru_cache(maxsize=10_000)
def _ranked(block: str, templates: tuple[tuple[str, str], ...]) -> list[tuple[float, str]]:
    """Reduction (share of the size alone) of a block by each template, the leader first."""
    made, plain, _ = _prepared(templates)
    data = block.lower().encode()
    alone = len(plain.compress(data))
    return sorted(((alone - len(c.compress(data))) / alone, name) for name, _, c in made)[::-1]


def scan_text(text: str, templates: tuple[tuple[str, str], ...]) -> list[tuple[int, str | None, str, float, int]]:
    """Line, license (or none), leader, reduction and differing words of every license and of every other line with a license word."""
    cues = [m.start() for m in _CUE.finditer(text)]
    if not cues:
        return []
    spots = [(m.start(), m.group().lower()) for m in _WORD.finditer(text)]
    starts, breaks = [s for s, _ in spots], [m.start() for m in re.finditer("\n", text)]
    line_of = functools.partial(bisect.bisect_left, breaks)
    ranges: list[list[int]] = []
    for c in cues:
        k = bisect.bisect_right(starts, c)
        if ranges and k - BEFORE <= ranges[-1][1]:
            ranges[-1][1] = k + AFTER
        else:
            ranges.append([max(0, k - BEFORE), k + AFTER])
    matches = [(low + s, low + e, name, n) for low, high in ranges for s, e, name, n in find_templates([w for _, w in spots[low:high]], templates)]

    def block(line: int, around: int) -> str:
        low, high = breaks[line - 1] + 1 if line else 0, breaks[line] if line < len(breaks) else len(text)
        return text[low:high] if high - low <= 2 * AROUND else text[max(low, around - AROUND) : min(high, around + AROUND)]

    out, covered = [], set()
    for s, e, name, n in matches:
        line = line_of(starts[s])
        covered.update((line, line_of(starts[e - 1])))
        covered.update(line_of(c) for c in cues[bisect.bisect_left(cues, starts[s]) : bisect.bisect_left(cues, starts[e - 1])])
        out.append((line, name, name, max(r for r, other in _ranked(block(line, starts[s]), templates) if other == name), n))
    for c in cues:
        line = line_of(c)
        if line not in covered:
            covered.add(line)
            here = block(line, c)
            reduction, name = _ranked(here, templates)[0]
            out.append((line, None, name, reduction, min(differences(words, wording(here))[0] for other, words in _prepared(templates)[2] if other == name)))
    return sorted(out, key=lambda x: x[0])


def scan_block(block: str, templates: tuple[tuple[str, str], ...]) -> tuple[str | None, str, float, int]:
    """The first confirmed license or none, the leading template, its reduction (share of the size alone), its differing words."""
    found = scan_text(block, templates)
    best = next((x for x in found if x[1]), found[0] if found else None)
    if best:
        return best[1:]
    reduction, name = _ranked(block[: 2 * AROUND], templates)[0]
    return None, name, reduction, len(wording(dict(templates)[name]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", into: str = "licenses") -> DataFrame:
    """All columns of ``docs`` and an array ``into`` of its licenses and other candidate lines: line, license (null if not confirmed), leader, reduction, differing.

    Null and empty texts have none; repeated rows are scanned alike; an empty table gives an empty
    one; columns named ``blocks`` or as ``into`` are replaced. Templates are few and short: they go along with the code.
    """
    given = tuple(sorted(templates.items())) if templates else tuple(sorted([*TEMPLATES.items(), *FULL_TEXTS]))
    kind = "array<struct<line:int,license:string,leader:string,reduction:double,differing:int>>"

    @F.pandas_udf(kind)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([[dict(zip(("line", "license", "leader", "reduction", "differing"), x)) for x in (() if t is None else scan_text(t, given))] for t in rows], dtype=object)

    column = F.col(f"`{text}`")
    marked = docs.drop(into).withColumn("blocks", F.when(F.rlike(column, F.lit(CUES)), column))
    return marked.withColumn(into, F.coalesce(scan("blocks"), F.array().cast(kind))).drop("blocks")

"""Benchmark decontamination by winnowed fingerprints.

Texts become words (A-Z lowered, runs of other ASCII that is no digit or letter between them).
Of the hashes of five consecutive words, the least in every six consecutive ones is kept, on both
sides. A shared span of ten words holds six such hashes and both sides keep the same one, so every
such span shares a fingerprint. Hits are extended word by word to the full shared span.

The benchmark is a stated query set and goes to the tasks in blocks of bounded size; documents are
not shuffled. An item of fewer than ten words counts as one window: all hashes of its length are
compared.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 10
GRAM = 5
#: Bytes of benchmark text that a task holds at once (besides one item, which is never cut).
BLOCK_BYTES = 16_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
# The bytes of words, A-Z lowered; all others separate words.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return [] if text is None else text.translate(_FOLD).split()


class WordHashes(dict):
    """Hashes of words; forgets all when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` words."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n if len(out) else 0):
        out = (out ^ words[k : k + len(out)]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def winnow(hashes: np.ndarray, size: int) -> np.ndarray:
    """Positions of hashes that are least in some run of ``size``; equal ones are all kept."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = hashes[:n].copy()
    for k in range(1, size):
        np.minimum(least, hashes[k : k + n], out=least)
    # A hash is kept if the largest of its windows' minima is the hash itself.
    most = np.zeros(len(hashes), np.uint64)
    for k in range(size):
        np.maximum(most[k : k + n], least, out=most[k : k + n])
    return np.flatnonzero(most == hashes)


class BenchmarkBlock:
    """Fingerprints of distinct benchmark texts, with where they stand."""

    def __init__(self, items: list[tuple[str, bytes]]):
        ids = defaultdict(list)
        for item_id, text in items:
            if words := tuple(words_of(text)):
                ids[words].append(item_id)
        self.texts, self.ids = list(ids), list(ids.values())
        hashed = WordHashes()
        places: dict[int, dict[int, list]] = {}  # words of a gram -> hash -> (text, position)
        for t, words in enumerate(self.texts):
            codes = np.fromiter(map(hashed.__getitem__, words), np.uint64, len(words))
            long = len(words) >= WINDOW
            size = GRAM if long else len(words)
            grams = gram_hashes(codes, size)
            kept = winnow(grams, WINDOW - GRAM + 1) if long else np.zeros(1, np.int64)
            where = places.setdefault(size if long else -size, {})
            for at in kept.tolist():
                where.setdefault(int(grams[at]), []).append((t, at))
        self.places = {size: (np.sort(np.fromiter(where, np.uint64, len(where))), where) for size, where in places.items()}

    def hits(self, words: list[bytes], codes: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of ``words`` (end exclusive) inside shared windows, and the texts they are shared with."""
        spans, found = [], set()
        for size, (known, where) in self.places.items():
            grams = gram_hashes(codes, abs(size))
            at = winnow(grams, WINDOW - GRAM + 1) if size > 0 else np.arange(len(grams))
            mine = grams[at]
            i = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            upto: dict[tuple[int, int], int] = {}  # text and shift -> end of its last span
            for p, h in zip(at[(same := known[i] == mine)].tolist(), mine[same].tolist()):
                for t, q in where[h]:
                    if upto.get((t, p - q), -1) > p:
                        continue
                    text = self.texts[t]
                    a, b = 0, 0
                    while p - a > 0 and q - a > 0 and words[p - a - 1] == text[q - a - 1]:
                        a += 1
                    while p + b < len(words) and q + b < len(text) and words[p + b] == text[q + b]:
                        b += 1
                    upto[t, p - q] = p + b
                    if a + b >= min(WINDOW, len(text)):
                        spans.append((p - a, p + b))
                        found.add(t)
        return spans, found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in blocks, streamed through the driver one partition at a time."""
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{text}`").cast("binary").alias("text"))
    block, size = [], 0
    for row in rows.filter("item is not null and text is not null").toLocalIterator():
        block.append((row["item"], bytes(row["text"])))
        size += len(row["text"])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    into: str = "overlap", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All columns of ``docs`` and a struct ``into``: ``n_words``, ``spans`` of hit words (start, end exclusive) and ``items``.

    ``items`` are the ids of items with a window in the text, sorted as strings, each once. Null and
    empty texts have no words; items without id or words have no window; repeated items and rows
    count as they stand; a column named as ``into`` is replaced. Each block of the benchmark is a
    further step over the same rows, without a shuffle.
    """
    spark = docs.sparkSession
    kind = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"

    def step(block):
        sent = spark.sparkContext.broadcast(block)

        @F.pandas_udf(kind)
        def overlaps(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
            known, hashed = BenchmarkBlock(sent.value), WordHashes()
            for texts, earlier in batches:
                rows = []
                for raw, spans, items in zip(texts, earlier["spans"], earlier["items"]):
                    words = words_of(raw)
                    codes = np.fromiter(map(hashed.__getitem__, words), np.uint64, len(words))
                    more, found = known.hits(words, codes)
                    spans = [(s["start"], s["end"]) for s in spans] if spans is not None else []
                    names = set() if items is None else set(items)
                    names.update(x for t in found for x in known.ids[t])
                    rows.append((len(words), [{"start": a, "end": b} for a, b in _merged(spans + more)], sorted(names)))
                yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

        return overlaps

    out, earlier = docs, F.lit(None).cast(kind)
    for block in _blocks(benchmark, item, item_text, block_bytes):
        out = out.withColumn(into, step(block)(F.col(f"`{text}`").cast("binary"), earlier))
        earlier = F.col(f"`{into}`")
    if out is docs:  # an empty benchmark: words are counted all the same
        out = docs.withColumn(into, step([])(F.col(f"`{text}`").cast("binary"), earlier))
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark."""
    mark = "overlap"
    while mark in docs.columns:
        mark += "_"
    found = find_overlaps(docs, benchmark, text, item, item_text, into=mark)
    return found.filter(F.size(F.col(f"{mark}.spans")) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])

"""Byte-level BPE: encoding by replaying the merges over a block's distinct pre-tokens, and decoding.

A block is what one Arrow batch brings: its distinct pre-tokens form one array of symbols, an
inverted index maps every merge to the positions where it applies, and the merges are replayed in
rank order over all words at once; only the neighbours of a merged pair get new index entries.
Blocks need no shuffle, so a lost executor only repeats its own.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratertrail.llm.pretokens import PretokenValues

NONE = np.iinfo(np.int64).max


class MergeTable:
    """The merges of a rank file: pairs of token ids that join to a longer token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.base = max(ranks.values()) + 1
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = i
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.joined = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair joins to, NONE where it joins to none."""
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.joined[at], NONE)

    def one_word(self, word: bytes) -> list[int]:
        """The merges of a single word, lowest rank first, leftmost among equals."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[k] + parts[k + 1], NONE), k) for k in range(len(parts) - 1))
            if rank == NONE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [self.ranks[w].to_bytes(4, "little") if w in self.ranks else None if w else b"" for w in words]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._replay([words[i] for i in rest])):
            out[i] = ids
        return out

    def _replay(self, words: list[bytes]) -> list[bytes]:
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        symbol = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        following = np.arange(1, len(symbol) + 1, dtype=np.int32)
        before = np.arange(-1, len(symbol) - 1, dtype=np.int32)
        following[ends - 1] = -1
        before[starts] = -1
        word_of = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        index: dict[int, list[np.ndarray]] = {}
        due: list[int] = []

        def enter(at: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, group in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts)):
                if rank in index:
                    index[rank].append(group)
                else:
                    index[rank] = [group]
                    heapq.heappush(due, rank)

        at = np.flatnonzero(following >= 0).astype(np.int32)
        ranks = self.lookup(symbol[at], symbol[at + 1])
        if (ok := ranks != NONE).any():
            enter(at[ok], ranks[ok])
        backwards: set[int] = set()  # words in which a merge made a pair of lower rank
        while due:
            rank = heapq.heappop(due)
            at = np.unique(np.concatenate(index.pop(rank)))
            at = at[(symbol[at] >= 0) & (following[at] >= 0)]
            at = at[self.lookup(symbol[at], symbol[following[at]]) == rank]
            if not len(at):
                continue
            after = following[at]
            if (after[:-1] == at[1:]).any():  # overlapping pairs: from the left, every other one
                keep, last = [], -1
                for k, (p, q) in enumerate(zip(at.tolist(), after.tolist())):
                    if p != last:
                        keep.append(k)
                        last = q
                at, after = at[keep], after[keep]
            beyond = following[after]
            symbol[at] = rank
            symbol[after] = -1
            following[at] = beyond
            inside = beyond >= 0
            before[beyond[inside]] = at[inside]
            ahead = before[at]
            touched = np.concatenate((at[inside], ahead[ahead >= 0]))
            ranks = self.lookup(symbol[touched], symbol[following[touched]])
            ok = ranks != NONE
            if ok.any():
                touched, ranks = touched[ok], ranks[ok]
                if (low := ranks < rank).any():
                    backwards.update(word_of[touched[low]].tolist())
                enter(touched, ranks)
        alive = symbol >= 0
        ids = symbol[alive].astype("<u4").tobytes()
        upto = np.cumsum(np.add.reduceat(alive.astype(np.int64), starts)) * 4
        out = [ids[a:b] for a, b in zip([0, *upto[:-1].tolist()], upto.tolist())]
        for i in backwards:  # there rank order over all words isn't the order within the word
            out[i] = np.array(self.one_word(words[i]), "<u4").tobytes()
        return out


def read_rank_file(path: str) -> bytes:
    """The content of a rank file (a base64 token and its rank per line), read on the driver; about 1 MB."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}


@functools.lru_cache(maxsize=2)
def _table(content: bytes) -> MergeTable:
    return MergeTable(parse_ranks(content))


@functools.lru_cache(maxsize=2)
def _tokens(content: bytes) -> dict[int, bytes]:
    return {i: t for t, i in parse_ranks(content).items()}


def encoded(text: Column, rank_file: str, pattern: str) -> Column:
    """Token ids of a text as binary, little-endian unsigned 32-bit; null counts as empty, no special tokens."""
    content = read_rank_file(rank_file)

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = _table(content)
        values = PretokenValues(pattern, lambda names: table.replay([n.encode() for n in names]), b"".join)
        for texts in batches:
            yield pd.Series(list(values.of_block(["" if t is None else t for t in texts])), dtype=object)

    return encode(text)


def decoded(ids: Column, rank_file: str) -> Column:
    """The bytes that token ids stand for; null stays null. An id outside the vocabulary raises KeyError."""
    content = read_rank_file(rank_file)

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        token = _tokens(content).__getitem__
        for packed in batches:
            yield pd.Series([None if x is None else b"".join(map(token, np.frombuffer(x, "<u4").tolist())) for x in packed], dtype=object)

    return decode(ids)


def round_trip(text: Column, rank_file: str, pattern: str) -> Column:
    """A struct of a text's ids (``token_ids``) and of the bytes that these ids decode to (``decoded``), made in one worker."""
    content = read_rank_file(rank_file)

    @F.pandas_udf("struct<token_ids:binary,decoded:binary>")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table, token = _table(content), _tokens(content).__getitem__
        values = PretokenValues(pattern, lambda names: table.replay([n.encode() for n in names]), b"".join)
        for texts in batches:
            ids = list(values.of_block(["" if t is None else t for t in texts]))
            yield pd.DataFrame({"token_ids": ids, "decoded": [b"".join(map(token, np.frombuffer(x, "<u4").tolist())) for x in ids]})

    return both(text)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", into: str = "token_ids") -> DataFrame:
    """All columns of ``docs`` and the ids of ``text``; a column named as ``into`` is replaced.

    A null or empty text has no ids (empty binary); repeated rows are encoded alike; an empty
    table gives an empty one.
    """
    return docs.withColumn(into, encoded(F.col(f"`{text}`"), rank_file, pattern))


def decode_documents(docs: DataFrame, rank_file: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """All columns of ``docs`` and the bytes of the ids; a column named as ``into`` is replaced."""
    return docs.withColumn(into, decoded(F.col(f"`{ids}`"), rank_file))

"""Token counts of a unigram model, by dynamic programming over a trie of distinct pre-tokens.

Each token has a cost; the count of a pre-token is the number of tokens of its cheapest
segmentation, the fewest among equally cheap ones. The distinct pre-tokens of a block share their
prefixes in a trie, so the forward cost of every prefix is computed once, level by level; counts
stand at the nodes where a pre-token ends.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratertrail.llm.byte_bpe import parse_ranks, read_rank_file
from ratertrail.llm.pretokens import PretokenValues

#: Costs are whole numbers in this part of a nat, so ties are exact.
UNITS = 65536
FAR = np.int64(1) << 60


def zipf_costs(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Costs by Zipf's law: the token of rank r has probability in proportion to 1 / (r + 1)."""
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {t: round((math.log(r + 1) + total) * UNITS) for t, r in ranks.items()}


class UnigramTrie:
    """Costs of tokens, as a trie of the reversed tokens to walk back from the end of a prefix."""

    def __init__(self, costs: dict[bytes, int]):
        step: dict[tuple[int, int], int] = {}
        cost = [FAR]
        for token, c in costs.items():
            state = 0
            for b in reversed(token):
                nxt = step.get((state, b))
                if nxt is None:
                    nxt = step[state, b] = len(cost)
                    cost.append(FAR)
                state = nxt
            cost[state] = c
        keys = np.array([s * 256 + b for s, b in step], np.int64)
        order = np.argsort(keys)
        self.keys, self.to, self.cost = keys[order], np.array(list(step.values()), np.int64)[order], np.array(cost, np.int64)

    def walk(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next state, -1 where no token goes on."""
        key = state * 256 + byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)

    def counts(self, words: list[bytes]) -> list[int]:
        """Tokens of each word. ``words`` are distinct; bytes order makes shared prefixes neighbours."""
        order = sorted(range(len(words)), key=words.__getitem__)
        lengths = np.fromiter((len(words[i]) for i in order), np.int64, len(order))
        text = np.frombuffer(b"".join(words[i] for i in order), np.uint8).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        parent, byte = [np.array([-1])], [np.array([0])]
        best, tokens = [np.array([0], np.int64)], [np.array([0], np.int64)]
        result = np.zeros(len(order), np.int64)
        live, node, size, level = np.arange(len(order)), np.zeros(len(order), np.int64), 1, 0
        # Levels are kept apart: a node is known by its number in its level.
        while len(live := live[(more := lengths[live] > level)]):
            node = node[more]
            b = text[starts[live] + level]
            new = np.ones(len(live), bool)
            new[1:] = (node[1:] != node[:-1]) | (b[1:] != b[:-1])
            number = np.cumsum(new) - 1
            parent.append(node[new])
            byte.append(b[new])
            size, level = int(number[-1]) + 1, level + 1
            low, few = np.full(size, FAR, np.int64), np.zeros(size, np.int64)
            here, at, state = np.arange(size), np.arange(size), np.zeros(size, np.int64)
            for back in range(level, 0, -1):  # one more byte of the token that ends here
                state = self.walk(state, byte[back][at])
                on = state >= 0
                if not on.all():
                    here, at, state = here[on], at[on], state[on]
                if not len(here):
                    break
                at = parent[back][at]
                cost, n = best[back - 1][at] + self.cost[state], tokens[back - 1][at] + 1
                better = (cost < low[here]) | (cost == low[here]) & (n < few[here])
                low[here[better]], few[here[better]] = cost[better], n[better]
            best.append(low)
            tokens.append(few)
            ended = lengths[live] == level
            result[live[ended]] = few[number[ended]]
            node = number
        out = np.zeros(len(order), np.int64)
        out[order] = result
        return out.tolist()


@functools.lru_cache(maxsize=2)
def _trie(content: bytes) -> UnigramTrie:
    return UnigramTrie(zipf_costs(parse_ranks(content)))


def token_count(text: Column, rank_file: str, pattern: str) -> Column:
    """Tokens of a text: those of its pre-tokens added up; null counts as empty."""
    content = read_rank_file(rank_file)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = _trie(content)
        values = PretokenValues(pattern, lambda names: trie.counts([n.encode() for n in names]), sum)
        for texts in batches:
            yield pd.Series(list(values.of_block(["" if t is None else t for t in texts])), dtype="int64")

    return count(text)


def count_tokens(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """All columns of ``docs`` and the token count; a column named as ``into`` is replaced.

    A null or empty text counts 0; repeated rows count alike; an empty table gives an empty one.
    """
    return docs.withColumn(into, token_count(F.col(f"`{text}`"), rank_file, pattern))

"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Each position of a text carries two inputs: an embedding of the word (if the training sample has it
often enough) and the mean embedding of its hashed character trigrams. The network reads
overlapping windows of words; a text's score comes from its most toxic window. It is trained in
numpy on the driver, on a bounded sample of labelled rows, and scores all windows of all texts in
the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, STRIDE = 40, 20
WORD_DIM, CHAR_DIM, HIDDEN = 4, 16, 8
BUCKETS = 4096
#: Words of the training sample with an embedding of their own: the most frequent, seen in this many texts at least.
VOCABULARY, MIN_TEXTS = 5000, 5
#: Bounds of the training sample: rows of either class, and the longest text used for training.
TOXIC_ROWS, OTHER_ROWS, TRAIN_CHARS = 1500, 2500, 20_000
EPOCHS, OPENING, BATCH, RATE, SEED = 14, 6, 256, 0.01, 11
THRESHOLD = 0.7
#: Distinct words kept between the batches of a task.
KEEP = 250_000
#: Weight decay, and the share of words hidden in training.
DECAY, HIDE = 0.1, 0.2
_EDGES = ".,;:!?|\"'()[]{}<>*$%#&"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sums(rows: np.ndarray, by: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by group number."""
    return np.stack([np.bincount(by, rows[:, c], n) for c in range(rows.shape[1])], axis=1)


def tokens_of(text: str | None) -> list[str]:
    return [] if text is None else text.lower().split()


def trigram_buckets(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of all words, with edges marked, and where each word's begin."""
    marked = ["\x02\x02" + w + "\x03" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(lengths)
    hashed = codes[:-2] * np.uint32(961) + codes[1:-1] * np.uint32(31) + codes[2:]
    hashed = (hashed * np.uint32(2654435761)) >> np.uint32(20)
    inside = np.ones(len(codes), bool)
    inside[ends - 1] = inside[ends - 2] = False
    counts = lengths - 2
    return hashed[inside[:-2]] % BUCKETS, np.cumsum(counts) - counts


def windows_of(n: int) -> list[int]:
    """Starts of the windows that cover ``n`` words; a text without words has one empty window."""
    if n <= WINDOW:
        return [0]
    starts = list(range(0, n - WINDOW, STRIDE))
    return [*starts, n - WINDOW]


class Network:
    """Parameters, forward pass and gradients."""

    def __init__(self, vocabulary: Sequence[str], seed: int = SEED):
        rnd = np.random.default_rng(seed)
        self.words = {w: i + 1 for i, w in enumerate(vocabulary)}  # 0: any other word
        small = lambda *shape, by=0.1: (rnd.standard_normal(shape) * by).astype(np.float32)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.p = {
            "word": small(len(self.words) + 1, WORD_DIM), "char": small(BUCKETS, CHAR_DIM),
            "in": small(d, 6 * h, by=d**-0.5), "in_b": np.zeros(6 * h, np.float32),
            "fwd": small(h, 3 * h, by=h**-0.5), "bwd": small(h, 3 * h, by=h**-0.5),
            "attend": small(2 * h), "out": small(2 * h, by=0.3), "out_b": np.zeros(1, np.float32),
        }
        self.p["word"][0] = 0
        self.scale, self.shift = 1.0, 0.0  # from the highest window's logit to the text's

    def embed(self, words: Sequence[str]) -> tuple[np.ndarray, tuple]:
        """Input vectors of words, and what the gradient needs."""
        stems = [w.strip(_EDGES) for w in words]
        ids = np.fromiter((self.words.get(w, 0) for w in stems), np.int64, len(stems))
        grams, starts = trigram_buckets(stems)
        counts = np.diff(np.append(starts, len(grams)))[:, None]
        mean = np.add.reduceat(self.p["char"][grams], starts, axis=0) / counts
        return np.concatenate([self.p["word"][ids], mean], axis=1).astype(np.float32), (ids, grams, counts)

    def project(self, words: Sequence[str]) -> np.ndarray:
        """What words add to all gates of both directions."""
        if not words:
            return np.zeros((0, 6 * HIDDEN), np.float32)
        parts = [self.embed(words[i : i + 20_000])[0] @ self.p["in"] + self.p["in_b"] for i in range(0, len(words), 20_000)]
        return np.concatenate(parts)

    def read(self, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray | None, backward: bool, keep: bool = False):
        """States of one direction, (steps, windows, hidden); ``gates`` are looked up by ``ids`` step by step."""
        h = HIDDEN
        u = self.p["bwd" if backward else "fwd"]
        cols = slice(3 * h, 6 * h) if backward else slice(0, 3 * h)
        gates = np.ascontiguousarray(gates[:, cols])
        n, steps = ids.shape
        state, states, cache = np.zeros((n, h), np.float32), np.zeros((steps, n, h), np.float32), []
        for t in range(steps - 1, -1, -1) if backward else range(steps):
            x, own = gates[ids[:, t]], state @ u
            zr = x[:, : 2 * h] + own[:, : 2 * h]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * own[:, 2 * h :])
            after = new + z * (state - new)
            if mask is not None:
                after = np.where(mask[:, t, None], after, state)
            if keep:
                cache.append((t, state, z, r, new, own[:, 2 * h :]))
            state = states[t] = after
        return states, cache

    def logits(self, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """The logit of each window."""
        both = np.concatenate([self.read(gates, ids, mask, b)[0] for b in (False, True)], axis=2)
        weight = self._attention(both, mask)[0]
        return (weight[:, :, None] * both).sum(axis=0) @ self.p["out"] + self.p["out_b"][0]

    def _attention(self, both: np.ndarray, mask: np.ndarray | None):
        score = both @ self.p["attend"]
        if mask is not None:
            score = np.where(mask.T, score, -30)
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        if mask is not None:
            weight = weight * mask.T
        return weight, score

    def gradients(self, words: Sequence[str], ids: np.ndarray, mask: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss of windows; ``ids`` index ``words``."""
        p, h = self.p, HIDDEN
        x, (word_ids, grams, counts) = self.embed(words)
        gates = x @ p["in"] + p["in_b"]
        reads = [self.read(gates, ids, mask, b, keep=True) for b in (False, True)]
        both = np.concatenate([s for s, _ in reads], axis=2)
        weight, _ = self._attention(both, mask)
        pooled = (weight[:, :, None] * both).sum(axis=0)
        error = ((_sigmoid(pooled @ p["out"] + p["out_b"][0]) - label) / len(label)).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"], g["out_b"] = pooled.T @ error, error.sum(keepdims=True)
        d_pooled = error[:, None] * p["out"]
        d_both = weight[:, :, None] * d_pooled
        d_weight = (both * d_pooled).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["attend"] = np.tensordot(d_score, both, axes=([0, 1], [0, 1]))
        d_both += d_score[:, :, None] * p["attend"]
        d_gates = np.zeros_like(gates)
        for side, (_, cache) in enumerate(reads):
            u, name = (p["bwd"], "bwd") if side else (p["fwd"], "fwd")
            cols = slice(side * 3 * h, side * 3 * h + 3 * h)
            carried, given = np.zeros((len(ids), h), np.float32), []
            for t, state, z, r, new, own in reversed(cache):
                d = d_both[t, :, side * h : side * h + h] + carried
                live = mask[:, t, None]
                d_in = np.where(live, d, 0)
                d_new = d_in * (1 - z) * (1 - new**2)
                d_z = d_in * (state - new) * z * (1 - z)
                d_r = d_new * own * r * (1 - r)
                d_x = np.concatenate([d_z, d_r, d_new], axis=1)
                d_own = np.concatenate([d_z, d_r, d_new * r], axis=1)
                g[name] += state.T @ d_own
                carried = d_own @ u.T + d_in * z + np.where(live, 0, d)
                given.append(d_x)
            at = ids[:, [c[0] for c in reversed(cache)]].T.ravel()
            d_gates[:, cols] = _sums(np.concatenate(given), at, len(gates))
        g["in"], g["in_b"] = x.T @ d_gates, d_gates.sum(axis=0)
        d_words = d_gates @ p["in"].T
        g["word"] = _sums(d_words[:, :WORD_DIM], word_ids, len(p["word"]))
        g["word"][0] = 0
        g["char"] = _sums(np.repeat(d_words[:, WORD_DIM:] / counts, counts[:, 0], axis=0), grams, BUCKETS)
        return g


class Scorer:
    """Scores texts batch by batch; words met before keep their projection."""

    def __init__(self, net: Network):
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}  # number 0 pads
        self.gates = self.net.project([""])

    def ids_of(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        if len(self.known) > KEEP:
            self._forget()
        known, before, out = self.known, len(self.known), []
        for text in texts:
            tokens = tokens_of(text)
            for w in set(tokens).difference(known):
                known[w] = len(known)
            out.append(np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens)))
        if len(known) > before:
            self.gates = np.concatenate([self.gates, self.net.project(list(known)[before:])])
        return out

    def window_logits(self, numbered: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of all windows of all texts, with the text and the start of each."""
        text, start = [], []
        for i, ids in enumerate(numbered):
            s = windows_of(len(ids))
            start += s
            text += [i] * len(s)
        text, start = np.array(text, np.int64), np.array(start, np.int64)
        lengths = np.fromiter(map(len, numbered), np.int64, len(numbered))
        flat = np.concatenate([*numbered, np.zeros(WINDOW, np.int32)])
        first = (np.cumsum(lengths) - lengths)[text] + start
        have = np.minimum(lengths[text] - start, WINDOW)
        logits = np.zeros(len(text), np.float32)
        steps = np.arange(WINDOW)
        for full in (True, False):
            rows = np.flatnonzero((have == WINDOW) == full)
            for at in range(0, len(rows), 4096):
                k = rows[at : at + 4096]
                mask = None if full else steps < have[k, None]
                ids = flat[first[k, None] + steps]
                logits[k] = self.net.logits(self.gates, ids if full else np.where(mask, ids, 0), mask)
        return logits, text, start

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        logits, text, _ = self.window_logits(self.ids_of(texts))
        highest = np.maximum.reduceat(logits, np.flatnonzero(np.diff(text, prepend=-1)))
        return _sigmoid(self.net.scale * highest.astype(np.float64) + self.net.shift)


def train(texts: Sequence[str], labels: Sequence[int], epochs: int = EPOCHS, seed: int = SEED) -> Network | float:
    """A network trained on labelled texts; without both classes, the share of toxic ones instead.

    Only texts are labelled, not windows. The opening epochs draw a window from each text by chance; the later
    ones take the highest window of each, and as many others of texts that aren't toxic.
    """
    y = np.array(labels, np.float32)
    if len(y) == 0 or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    seen: dict[str, int] = {}
    for t in texts:
        for w in {w.strip(_EDGES) for w in tokens_of(t)} - {""}:
            seen[w] = seen.get(w, 0) + 1
    frequent = sorted((w for w, n in seen.items() if n >= MIN_TEXTS), key=lambda w: (-seen[w], w))[:VOCABULARY]
    net, rnd = Network(frequent, seed), np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    scorer = Scorer(net)
    numbered = scorer.ids_of(texts)
    names = list(scorer.known)
    steps, turn = np.arange(WINDOW), 0

    def rescored():
        scorer.gates = net.project(names)
        return scorer.window_logits(numbered)

    starts = [windows_of(len(ids)) for ids in numbered]
    text = np.repeat(np.arange(len(starts)), [len(x) for x in starts])
    start = np.concatenate(starts)
    first = np.flatnonzero(np.diff(text, prepend=-1))
    count = np.diff(np.append(first, len(text)))
    for epoch in range(epochs):
        if epoch < OPENING:
            toxic = np.flatnonzero(np.repeat(y == 1, np.minimum(count, 4)))
            owner = np.repeat(np.arange(len(y)), np.minimum(count, 4))
            drawn = first[owner] + rnd.integers(0, count[owner])
            other = drawn[rnd.permutation(np.flatnonzero(y[owner] == 0))[: 2 * max(len(toxic), 500)]]
            chosen = np.concatenate([drawn[toxic], other])
        else:
            logits, _, _ = rescored()
            highest = np.lexsort((-logits, text))[first]
            mine = highest[y == 1]
            more = max(1, min(6, (y == 0).sum() // max(1, len(mine)) // 2))
            extra = rnd.permutation(np.flatnonzero(y[text] == 0))[: 2 * len(highest)]
            chosen = np.concatenate([np.repeat(mine, more), highest[y == 0], extra])
        chosen = rnd.permutation(chosen)
        for at in range(0, len(chosen), BATCH):
            k = chosen[at : at + BATCH]
            ids = np.zeros((len(k), WINDOW), np.int64)
            mask = np.zeros((len(k), WINDOW), bool)
            for row, (i, s) in enumerate(zip(text[k], start[k])):
                own = numbered[i][s : s + WINDOW]
                ids[row, : len(own)], mask[row, : len(own)] = np.where(rnd.random(len(own)) < HIDE, 0, own), True
            used, inverse = np.unique(ids, return_inverse=True)
            grads = net.gradients([names[u] for u in used], inverse.reshape(ids.shape), mask, y[text[k]])
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            turn += 1
            for name, g in grads.items():
                g = g * min(1, 5 / max(norm, 1e-9))
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                pace = RATE * (0.3 if epoch > epochs * 0.7 else 1)
                step = (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8) + DECAY * net.p[name]
                net.p[name] -= (pace * step).astype(np.float32)
    # From the highest window's logit to the text's: logistic regression, both classes weighing alike.
    logits, text, _ = rescored()
    top = np.maximum.reduceat(logits, np.flatnonzero(np.diff(text, prepend=-1))).astype(np.float64)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * top + b)
        e, q = weight * (p - y), weight * p * (1 - p) + 1e-9
        grad = np.array([(e * top).sum() + 1e-3 * (a - 1), e.sum() + 1e-4 * b])
        hess = np.array([[(q * top * top).sum() + 1e-3, (q * top).sum()], [(q * top).sum(), q.sum() + 1e-4]])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = max(0.05, a - step[0]), b - step[1]
    net.scale, net.shift = float(a), float(b)
    return net


def training_sample(docs: DataFrame, labels: DataFrame, usable: Column, toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS) -> tuple[list[str], list[int]]:
    """Texts and labels of at most so many labelled rows of either class, those with the least hashed ids.

    ``usable`` is a condition on ``doc_id``; texts of over ``TRAIN_CHARS`` characters are left out of the sample.
    """
    rows = labels.select("doc_id", "toxic").filter(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    chosen = None
    for flag, most in ((F.col("toxic") == 1, toxic_rows), (F.col("toxic") != 1, other_rows)):
        part = rows.filter(flag).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    # The ids are bounded by the two limits, the texts by these and the length.
    short = docs.select("doc_id", "text").filter(F.char_length("text") <= TRAIN_CHARS)
    found = short.join(F.broadcast(chosen.dropDuplicates(["doc_id"])), "doc_id").dropDuplicates(["doc_id"]).collect()
    found.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in found], [int(r["toxic"] == 1) for r in found]


def score(docs: DataFrame, net: Network | float, text: str = "text", into: str = "score") -> DataFrame:
    """All columns of ``docs`` and the toxicity of ``text``, 0 to 1; a column named as ``into`` is replaced.

    Null and empty texts are scored as one window without words; repeated rows score alike; an empty
    table gives an empty one.
    """
    if isinstance(net, float):
        return docs.withColumn(into, F.lit(net))
    sent = docs.sparkSession.sparkContext.broadcast(net)  # under 1 MB, whatever the corpus

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(sent.value)
        for texts in batches:
            yield pd.Series(scorer.scores(list(texts)), dtype="float64")

    return docs.withColumn(into, toxicity(F.col(f"`{text}`")))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def drop_toxic(docs: DataFrame, documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``; trained on labelled rows of ``documents`` that aren't held out."""
    net = train(*training_sample(documents, labels, ~held_out(F.col("doc_id"))))
    mark = "toxicity"
    while mark in docs.columns:
        mark += "_"
    return score(docs, net, into=mark).filter(F.col(mark) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])

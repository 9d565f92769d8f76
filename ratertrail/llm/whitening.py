"""Whitening of embeddings from the exact characteristic polynomial of their integer scatter.

Vectors are quantised to integers, so sums and products over any number of rows are exact and the scatter is an
integer matrix. Spark adds it up; what the driver then holds is bounded by the square of the dimension. Its characteristic
polynomial is computed modulo many primes, by reduction to Hessenberg form, and put together by the Chinese
remainder theorem. All roots are real, so the sign changes of the shifted polynomial count the roots above
any point exactly (Descartes' rule is an equality then), which isolates them; bisection takes them as far as wished.
Each component comes from inverse iteration at its root, which goes for the null space of the scatter minus the root.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal, getcontext, localcontext
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps of the quantised values to one, and what every value is raised by.
SCALE = 1024
SHIFT = 100000
COMPONENTS = 8
#: Bits of the roots and decimal digits of the components while they are computed.
ROOT_BITS = 256
DIGITS = 120
#: Quantised values are held within this many steps of zero, so that sums of products fit a decimal of 38 digits.
LIMIT = 1 << 40
#: Products are formed in doubles, which are exact for whole numbers of up to 53 bits: limbs of 20 bits, 4,096 rows at once.
_LIMB = 20
_ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """What whitening needs, as plain numbers: rows, sums, unit components, eigenvalues, their share of the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


def quantised(vectors: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """``rows, steps``: the rows that hold ``dimension`` finite numbers, and floor(1024 c) of them as 64-bit integers."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    offsets = vectors.offsets.to_numpy()
    starts, sizes = offsets[:-1], np.diff(offsets)
    values = vectors.values
    finite = np.isfinite(values.to_numpy(zero_copy_only=False)) & values.is_valid().to_numpy(zero_copy_only=False) if len(values) else np.zeros(0, bool)
    bad = np.concatenate([[0], np.cumsum(~finite)])
    valid = vectors.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(valid & (sizes == dimension) & (bad[offsets[1:]] == bad[starts]))
    if not len(rows):
        return rows, np.zeros((0, dimension), np.int64)
    entries = values.to_numpy(zero_copy_only=False)[(starts[rows][:, None] + np.arange(dimension)[None, :])]
    return rows, np.clip(np.floor(SCALE * entries), -LIMIT, LIMIT).astype(np.int64)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Parts of 20 bits, least first, the last one signed; as doubles."""
    parts = []
    while True:
        low = x & ((1 << _LIMB) - 1)
        high = x >> _LIMB
        if len(parts) and not high.any() or (x >= -(1 << _LIMB)).all() and (x < (1 << _LIMB)).all():
            parts.append(x.astype(np.float64))
            return parts
        parts.append(low.astype(np.float64))
        x = high


def exact_products(x: np.ndarray) -> np.ndarray:
    """``x.T @ x`` of 64-bit integers as an array of Python integers."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), _ROWS):
        parts = _limbs(x[at : at + _ROWS])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total = total + ((a.T @ b).astype(np.int64).astype(object) << (_LIMB * (i + j)))
    return total


def _entries(dimension: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(dimension) for j in range(i, dimension)]


def _partial_sums(dimension: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dimension, object), np.zeros((dimension, dimension), object)
        for batch in batches:
            _, steps = quantised(batch.column(0), dimension)
            if len(steps):
                n, sums, products = n + len(steps), sums + steps.astype(object).sum(axis=0), products + exact_products(steps)
        values = [n, *sums, *(products[i, j] for i, j in _entries(dimension))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))], names=["place", "value"])

    return add


def _dimension(vectors: DataFrame) -> int | None:
    """The most frequent length of the valid vectors; of equally frequent ones the largest."""
    v = F.col("vector")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    found = vectors.filter(v.isNotNull() & (F.size(v) > 0) & ~bad).groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else None


def scatter(vectors: DataFrame, dimension: int) -> tuple[int, list[int], list[list[int]]]:
    """Rows n, sums S and n * sum(x x') - S S', all exact, of the vectors in column ``vector``; the sums are of floor(1024 c)."""
    partial = vectors.mapInArrow(_partial_sums(dimension), "place int, value decimal(38,0)")
    found = {r["place"]: int(r["value"]) for r in partial.groupBy("place").agg(F.sum("value").alias("value")).collect()}
    n, sums = found[0], [found[1 + k] for k in range(dimension)]
    matrix = [[0] * dimension for _ in range(dimension)]
    for k, (i, j) in enumerate(_entries(dimension)):
        matrix[i][j] = matrix[j][i] = n * found[1 + dimension + k] - sums[i] * sums[j]
    return n, sums, matrix


def _is_prime(p: int) -> bool:
    """Miller and Rabin's test; these bases decide all numbers below 2 ** 32."""
    d, twos = p - 1, 0
    while d % 2 == 0:
        d, twos = d // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, d, p)
        if x in (1, p - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % p
            if x == p - 1:
                break
        else:
            return False
    return True


def _primes(bits: int) -> list[int]:
    """Primes below 2 ** 31 whose product has more than ``bits`` bits."""
    primes, product, p = [], 1, (1 << 31) - 1
    while product.bit_length() <= bits:
        if _is_prime(p):
            primes.append(p)
            product *= p
        p -= 2
    return primes


def _modular_polynomials(matrix: list[list[int]], primes: list[int]) -> np.ndarray:
    """Coefficients, constant first, of the characteristic polynomial modulo each prime: one row a prime."""
    d, count = len(matrix), len(primes)
    h = np.array([[[v % p for v in row] for row in matrix] for p in primes], np.int64).reshape(count, d, d)
    p = np.array(primes, np.int64)
    p1, p2, every = p[:, None], p[:, None, None], np.arange(count)
    for c in range(d - 2):
        pivot = c + 1 + np.argmax(h[:, c + 1 :, c] != 0, axis=1)
        # A similarity: rows swapped and then columns, rows reduced and then columns added back.
        rows = h[every, pivot].copy()
        h[every, pivot], h[every, c + 1] = h[:, c + 1].copy(), rows
        columns = h[every, :, pivot].copy()
        h[every, :, pivot], h[every, :, c + 1] = h[:, :, c + 1].copy(), columns
        inverse = np.array([pow(int(v), -1, q) if v else 0 for v, q in zip(h[:, c + 1, c], primes)], np.int64)
        factor = h[:, c + 2 :, c] * inverse[:, None] % p1
        h[:, c + 2 :] = (h[:, c + 2 :] - factor[:, :, None] * h[:, c + 1][:, None, :] % p2) % p2
        for k in range(d - c - 2):
            h[:, :, c + 1] = (h[:, :, c + 1] + h[:, :, c + 2 + k] * factor[:, k][:, None]) % p1
    polynomials = [np.zeros((count, d + 1), np.int64)]
    polynomials[0][:, 0] = 1
    for k in range(d):
        last = polynomials[k]
        new = (np.roll(last, 1, axis=1) - h[:, k, k][:, None] * last) % p1
        run = np.ones(count, np.int64)
        for i in range(k - 1, -1, -1):
            run = run * h[:, i + 1, i] % p
            new = (new - (h[:, i, k] * run % p)[:, None] * polynomials[i]) % p1
        polynomials.append(new)
    return polynomials[d]


def characteristic_polynomial(matrix: list[list[int]]) -> list[int]:
    """Coefficients, constant first, of det(t - M) for a symmetric integer matrix without negative eigenvalues."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    # The k-th elementary symmetric function of such eigenvalues is greatest where all are equal.
    bound = max(comb(d, k) * (-(-trace // d)) ** k for k in range(d + 1))
    primes = _primes(bound.bit_length() + 1)
    residues = _modular_polynomials(matrix, primes)
    product = 1
    for p in primes:
        product *= p
    parts = [product // p for p in primes]
    weights = [part * pow(part % p, -1, p) for part, p in zip(parts, primes)]
    found = []
    for k in range(d + 1):
        value = sum(int(r) * w for r, w in zip(residues[:, k], weights)) % product
        found.append(value - product if 2 * value > product else value)
    return found


def _roots_above(polynomial: list[int], numerator: int, bits: int) -> int:
    """How many roots, each as often as it is one, lie above numerator / 2 ** bits; exact if all roots are real."""
    d = len(polynomial) - 1
    shifted = [c << (bits * (d - k)) for k, c in enumerate(polynomial)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            shifted[k] += numerator * shifted[k + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign_at(polynomial: list[int], numerator: int, bits: int) -> int:
    value = 0
    for k, c in enumerate(reversed(polynomial)):
        value = value * numerator + (c << (bits * k))
    return (value > 0) - (value < 0)


def largest_roots(polynomial: list[int], count: int) -> list[Fraction]:
    """The ``count`` largest positive roots, falling, each as often as it is one, to ``ROOT_BITS`` bits; fewer if there are fewer."""
    top = max(1, -polynomial[-2])  # no root is above the sum of all
    positive = _roots_above(polynomial, 0, 0)
    roots: list[Fraction] = []
    while len(roots) < min(count, positive):
        wanted = len(roots) + 1
        # The k-th largest root lies in (low, high]: above low there are at least k roots, above high fewer.
        low, high, bits = 0, top, 0
        while True:
            above_low, above_high = _roots_above(polynomial, low, bits), _roots_above(polynomial, high, bits)
            if above_low - above_high == 1 and above_low == wanted or low and high - low <= low >> ROOT_BITS:
                break
            if high - low <= 1:
                low, high, bits = low << 32, high << 32, bits + 32
            middle = (low + high) // 2
            low, high = (middle, high) if _roots_above(polynomial, middle, bits) >= wanted else (low, middle)
        multiple = above_low - above_high
        if multiple == 1:
            below = _sign_at(polynomial, high, bits)
            if below == 0:
                low = high
            # Below the root the sign is the other one; a zero is the root itself.
            while high != low and (not low or high - low > low >> ROOT_BITS):
                if high - low <= 1:
                    low, high, bits = low << 32, high << 32, bits + 32
                middle = (low + high) // 2
                sign = _sign_at(polynomial, middle, bits)
                low, high = (middle, middle) if sign == 0 else (low, middle) if sign == below else (middle, high)
        roots += [Fraction(low + high, 2 << bits)] * min(multiple, min(count, positive) - len(roots))
    return roots


def _inverse_iteration(matrix: np.ndarray, root: Decimal, others: list[np.ndarray], seed: int, tiny: Decimal) -> np.ndarray:
    """A unit vector that matrix minus root sends to almost nothing, orthogonal to ``others``."""
    d = len(matrix)
    a = matrix.copy()
    a[np.arange(d), np.arange(d)] -= root
    order = np.arange(d)
    for c in range(d):
        best = c + max(range(d - c), key=lambda k: abs(a[c + k, c]))
        if best != c:
            a[[c, best]] = a[[best, c]]
            order[[c, best]] = order[[best, c]]
        if abs(a[c, c]) < tiny:
            a[c, c] = tiny
        a[c + 1 :, c] = a[c + 1 :, c] / a[c, c]
        a[c + 1 :, c + 1 :] -= np.outer(a[c + 1 :, c], a[c, c + 1 :])
    # Any start will do that isn't orthogonal to what is sought; whole numbers from a fixed rule.
    v = np.array([Decimal((k * 7919 + seed * 104729) % 1009 + 1) for k in range(d)], object)
    for _ in range(3):
        for o in others:
            v = v - o * (o @ v)
        v = v[order] if _ == 0 else (v / (v @ v).sqrt())[order]
        for c in range(d):
            v[c] -= a[c, :c] @ v[:c] if c else 0
        for c in range(d - 1, -1, -1):
            v[c] = (v[c] - (a[c, c + 1 :] @ v[c + 1 :] if c < d - 1 else 0)) / a[c, c]
    for o in others:
        v = v - o * (o @ v)
    return v / (v @ v).sqrt()


def fit_scatter(n: int, sums: list[int], matrix: list[list[int]], components: int = COMPONENTS) -> Whitening:
    """Components with an eigenvalue above zero of the scatter ``n * n * covariance``, at most ``components`` of them."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    found = largest_roots(characteristic_polynomial(matrix), components) if trace else []
    vectors: list[np.ndarray] = []
    with localcontext(getcontext()) as context:
        context.prec = DIGITS
        context.Emin, context.Emax = -999999, 999999
        exact = np.array([[Decimal(v) for v in row] for row in matrix], object)
        tiny = Decimal(max(1, trace)).scaleb(-DIGITS)
        for k, root in enumerate(found):
            value = Decimal(root.numerator) / Decimal(root.denominator)
            vectors.append(_inverse_iteration(exact, value, vectors, k + 1, tiny))
    lead = [np.array([float(x) for x in v]) for v in vectors]
    # Either sign is right; the largest entry is made positive, so that all tasks and runs agree.
    rows = [v if v[np.argmax(np.abs(v))] > 0 else -v for v in lead]
    return Whitening(n, sums, np.array(rows).reshape(len(rows), d), np.array([float(r / (n * n)) for r in found]), np.array([float(r / trace) for r in found]))


def _projected(steps: np.ndarray, fit: Whitening) -> tuple[list[int], np.ndarray]:
    """The exact squared deviation, and the whitened coordinates, of each row."""
    largest = fit.n * int(np.abs(steps).max(initial=0)) + max(map(abs, fit.sums), default=0)
    if largest < 1 << 52:
        moved = fit.n * steps - np.array(fit.sums, np.int64)
        high, low = moved >> 24, moved & ((1 << 24) - 1)
        parts = [(a * b).sum(axis=1).astype(object) for a, b in ((high, high), (high, low), (low, low))]
        squares = (parts[0] << 48) + (parts[1] << 25) + parts[2]
        centred = moved / fit.n
    else:
        moved = steps.astype(object) * fit.n - np.array(fit.sums, object)
        squares = (moved * moved).sum(axis=1)
        centred = np.array([[float(Fraction(v, fit.n)) for v in row] for row in moved]).reshape(steps.shape)
    return list(squares), centred @ fit.components.T / np.sqrt(fit.eigenvalues)


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all valid vectors; None without any. The driver sees one scatter matrix."""
    vectors = rows.select(F.col(f"`{vector}`").alias("vector"))
    dimension = _dimension(vectors)
    return fit_scatter(*scatter(vectors, dimension), components) if dimension else None


def identity_error(rows: DataFrame, fitted: Whitening, vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity; 0 without components."""
    k, dimension = len(fitted.components), len(fitted.sums)
    if not k:
        return 0.0

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            _, steps = quantised(batch.column(0), dimension)
            if len(steps):
                _, w = _projected(steps, fitted)
                sums, products = sums + w.sum(axis=0), products + w.T @ w
        values = np.concatenate([sums, products.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["place", "value"])

    partial = rows.select(F.col(f"`{vector}`").alias("vector")).mapInArrow(add, "place int, value double")
    found = {r["place"]: r["value"] for r in partial.groupBy("place").agg(F.sum("value").alias("value")).collect()}
    values = np.array([found[i] for i in range(k + k * k)]) / fitted.n
    # The vectors are centred before they are projected, so what is left of the mean is rounding.
    mean, second = values[:k], values[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for every valid vector and component.

    Values become floor(1024 c), held within 2 ** 40 of zero (the shift of 100,000 changes nothing here and is left out), so sums,
    scatter and ``deviation`` (decimal; sum over dimensions of (n x - S) ** 2) are exact. Rows whose vector is null, empty, holds null or
    non-finite entries, or has another length than most valid vectors (ties: the longest) are dropped. Components number
    at most ``components`` and at most as many as there are eigenvalues above zero: one vector, or equal vectors only, give no rows, like
    an empty table. Equal eigenvalues get orthogonal components. Repeated rows and null keys count and are returned like others;
    other columns are not read.
    """
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double"
    given = rows.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("vector"))
    fitted = fit(given, "vector", components)
    if fitted is None or not len(fitted.components):
        return rows.sparkSession.createDataFrame([], schema + ", identity_error double")
    error, k, dimension = identity_error(given, fitted, "vector"), len(fitted.components), len(fitted.sums)
    types = [pa.int64(), pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.float64(), pa.float64()]
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, steps = quantised(batch.column(1), dimension)
            if not len(at):
                continue
            squares, w = _projected(steps, fitted)
            keys = batch.column(0).take(pa.array(np.repeat(at, k)))
            deviations = pa.array([Decimal(int(s)) for s in squares], types[3]).take(pa.array(np.repeat(np.arange(len(at)), k)))
            numbers = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at)))
            columns = [keys, numbers, pa.array(np.full(len(keys), fitted.n, np.int64)), deviations, pa.array(w.ravel()), pa.array(np.tile(fitted.explained, len(at)))]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types)], names=names)

    return given.mapInArrow(project, schema).withColumn("identity_error", F.lit(error))

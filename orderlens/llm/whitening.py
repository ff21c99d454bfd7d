"""Whitening of embeddings: projection on the leading principal components, scaled to unit variance.

1. Every usable vector's entries become whole numbers, ``floor(SCALE * c) + SHIFT``. The distinct whole vectors are
   the fit list, a written table; copies are combined before the shuffle.
2. One pass over the fit list gives its size n and the exact sums S per dimension, a second one the covariance,
   centred by S / n before multiplying. A task returns one matrix; the matrices are added in two rounds of at most
   ``ADDED`` rows each, and only the sum, whose size is the square of the dimension, reaches the driver.
3. There the matrix is made tridiagonal by Householder reflections, the leading eigenvalues are found by bisection on
   Sturm counts, and their vectors by inverse iteration, reorthogonalised within clusters.
4. The components are sent to all tasks (dimension x components numbers) and project every row. A third pass over the
   fit list measures how far the covariance of what comes out is from the identity.

Defined results: rows whose vector is null or holds a null or non-finite entry, or one of ``LARGEST`` or more, are
dropped; so are vectors of another dimension than the most frequent one (ties: the larger). Components whose
eigenvalue is 0 to double precision don't exist, so a table with a single distinct vector, or none, gives no rows.
Repeated rows and ids are projected row by row and count once in the fit; a null id stays null. A deviation that no
long holds is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import written

SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 50)  # entries from here on have no exact place in sums
ADDED = 1000  # matrices that one group adds
EPS = float(np.finfo(float).eps)
CLUSTER = 1e-3  # eigenvalues nearer than this share of the norm are reorthogonalised


# -- the symmetric eigenproblem

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflections): Householder's form of a symmetric matrix."""
    a = matrix.astype(float).copy()
    reflections = []
    for k in range(len(a) - 2):
        v = a[k + 1:, k].copy()
        alpha = -np.copysign(np.linalg.norm(v), v[0])
        v[0] -= alpha
        length = np.linalg.norm(v)
        if length > 0:
            v /= length
            rest = a[k + 1:, k + 1:]
            p = rest @ v
            w = p - (v @ p) * v
            rest -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1:, k] = a[k, k + 1:] = 0
            a[k + 1, k] = a[k, k + 1] = alpha
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def eigenvalues_below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The Sturm count at every ``x``: how many eigenvalues are smaller."""
    least = EPS * EPS * max(1.0, float((off * off).max(initial=0.0)))
    q = diagonal[0] - x
    count = (q < 0).astype(int)
    for d, e in zip(diagonal[1:], off, strict=True):
        q = np.where(np.abs(q) < least, -least, q)
        q = d - x - e * e / q
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected to the last bits that the norm allows."""
    n = len(diagonal)
    around = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    low = np.full(k, (diagonal - around).min())
    high = np.full(k, (diagonal + around).max())
    wanted = np.arange(1, k + 1)
    for _ in range(200):
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        above = n - eigenvalues_below(diagonal, off, middle) >= wanted
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return (low + high) / 2


def shifted_solver(diagonal: np.ndarray, off: np.ndarray, shift: float, least: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves (T - shift) x = b, by elimination with row exchanges; tiny pivots become ``least``."""
    n = len(diagonal)
    main, up, second = diagonal - shift, np.append(off, 0.0), np.zeros(n)
    steps = []
    for i in range(n - 1):
        below, after, behind = off[i], main[i + 1], up[i + 1]
        swap = abs(below) > abs(main[i])
        if swap:
            main[i], below = below, main[i]
            up[i], after = after, up[i]
            second[i], behind = behind, 0.0
        if abs(main[i]) < least:
            main[i] = least
        factor = below / main[i]
        main[i + 1] = after - factor * up[i]
        up[i + 1] = behind - factor * second[i]
        steps.append((swap, factor))
    if abs(main[-1]) < least:
        main[-1] = least

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.copy()
        for i, (swap, factor) in enumerate(steps):
            if swap:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= factor * x[i]
        for i in range(n - 1, -1, -1):
            later = (up[i] * x[i + 1] if i + 1 < n else 0.0) + (second[i] * x[i + 2] if i + 2 < n else 0.0)
            x[i] = (x[i] - later) / main[i]
        return x

    return solve


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of the ``k`` largest eigenvalues above 0, by double precision."""
    norm = float(np.abs(matrix).max(initial=0.0))
    if not norm:
        return np.zeros(0), np.zeros((len(matrix), 0))
    diagonal, off, reflections = tridiagonal(matrix / norm)
    values = leading_eigenvalues(diagonal, off, min(k, len(matrix)))
    values = values[values > 8 * len(matrix) * EPS * values[0]]
    size, rng, found = float(values[0]), np.random.default_rng(0), []
    shift = np.inf
    for i, value in enumerate(values):
        shift = min(value, shift - 10 * EPS * size)  # equal values are told apart a little
        solve = shifted_solver(diagonal, off, shift, EPS * size)
        start = i
        while start and values[start - 1] - values[start] < CLUSTER * size:
            start -= 1
        x = rng.standard_normal(len(diagonal))
        for _ in range(4):
            x = solve(x / np.linalg.norm(x))
            x /= np.abs(x).max()
            for _ in range(2):
                for y in found[start:i]:
                    x -= (y @ x) * y
        found.append(x / np.linalg.norm(x))
    vectors = np.stack(found, axis=1)
    for k in range(len(reflections) - 1, -1, -1):
        v = reflections[k]
        vectors[k + 1:] -= 2 * np.outer(v, v @ vectors[k + 1:])
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(found))])
    return values * norm, vectors


# -- the passes over the tables

@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: its size, its sums per dimension, the components and how far they are from exact."""
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """S / n as its whole part and the fraction beside it."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole, strict=True)])

    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """((_id, x), dimension): the usable rows' whole numbers."""
    entries = F.col(vec_col).cast("array<double>")
    rows = rows.select(F.col(id_col).alias("_id"), entries.alias("_v"))
    rows = rows.filter(F.col("_v").isNotNull() & F.forall("_v", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False))))
    size = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = size["d"] if size else 0
    x = F.transform("_v", lambda c: F.floor(c * SCALE) + SHIFT)
    return rows.filter(F.size("_v") == d).select("_id", x.alias("x")), d


def matrix_of(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def exact_sums(fit: DataFrame, d: int) -> tuple[int, tuple[int, ...]]:
    """(n, sums per dimension), exact at any size: high and low halves are added apart."""
    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = matrix_of(batch.column(0), d)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(high),
                                          pa.array(low)], ["i", "n", "high", "low"])

    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = fit.mapInArrow(halves, "i int, n long, high long, low long").groupBy("i").agg(big("n"), big("high"), big("low"))
    found = sorted(rows.collect())
    if not found:
        return 0, ()
    return int(found[0].n), tuple((int(r.high) << 32) + int(r.low) for r in found)


def product_sums(fit: DataFrame, d: int, numbers: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum over the fit list of every vector's products of ``numbers`` (``width`` of them), in double precision."""
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            y = numbers(matrix_of(batch.column(0), d))
            total += y.T @ y
        part = np.full(width, TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(part),
                                          pa.array(list(total), pa.list_(pa.float64()))], ["i", "part", "row"])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": rows["i"].iloc[:1], "part": rows["part"].iloc[:1] // ADDED,
                             "row": [np.sum(np.stack(rows.sort_values("part")["row"].to_list()), axis=0)]})

    schema = "i int, part int, row array<double>"
    rows = fit.mapInArrow(products, schema)
    rows = rows.groupBy("i", F.expr(f"part div {ADDED}")).applyInPandas(added, schema)
    rows = rows.groupBy("i").applyInPandas(added, schema)
    out = np.zeros((width, width))
    for r in rows.collect():
        out[r.i] = r.row
    return (out + out.T) / 2


def fitted(x: DataFrame, d: int, components: int) -> Whitening | None:
    """The whitening of the distinct vectors of ``x``; None if no component has variance."""
    fit = written(x.select("x").distinct(), "whitening-fit")
    n, sums = exact_sums(fit, d) if d else (0, ())
    if not n:
        return None
    blank = Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), np.zeros(0), 0.0)
    whole, fraction = blank.centre()
    covariance = product_sums(fit, d, lambda x: (x - whole) - fraction, d) / n
    values, vectors = leading_components(covariance, components)
    if not len(values):
        return None
    project = vectors / np.sqrt(values)
    again = product_sums(fit, d, lambda x: ((x - whole) - fraction) @ project, len(values)) / n
    error = float(np.abs(again - np.eye(len(values))).max())
    return Whitening(n, sums, values, vectors, values / np.trace(covariance), error)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """The exact sum of (n * x - S) ** 2 per vector; None where no long holds it."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    far = x - whole
    if (float(np.abs(far).max(initial=0)) + 1) ** 2 * float(n) ** 2 * len(sums) < 2.0 ** 62:
        return ((n * far - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * c - r) ** 2 for c, r in zip(row, rest, strict=True)) for row in far.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def whitened(rows: DataFrame, components: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per usable row and component."""
    x, d = whole_vectors(rows, id_col, vec_col)
    schema = (f"`{id_col}` {x.schema['_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    model = fitted(x, d, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    whole, fraction = model.centre()
    project, k = model.projection(), len(model.values)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column(1), d)
            m = len(x)
            scores = ((x - whole) - fraction) @ project
            every = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(every), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n)), pa.array(deviations(x, model.n, model.sums), pa.int64()).take(every),
                pa.array(scores.ravel()), pa.array(np.tile(model.explained, m)),
                pa.array(np.full(m * k, model.identity_error))],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(projected, schema)

import math
import random

import numpy as np
import pytest

from orderlens.llm.whitening import deviations, eigenvalues_below, leading_components, tridiagonal, whitened

COLS = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


def brute(rows, components=16):
    """(id, x) rows and per component the expected values, by numpy's own eigenvectors."""
    usable = [(i, [math.floor(64 * float(c)) + 1000000 for c in v]) for i, v in rows
              if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted(set(tuple(x) for _, x in usable))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit])
    covariance = centred.T @ centred / n
    e, p = np.linalg.eigh(covariance)
    e, p = e[::-1][:components], p[:, ::-1][:, :components]
    out = []
    for i, x in usable:
        r = [n * c - s for c, s in zip(x, sums, strict=True)]
        out.append((i, n, sum(c * c for c in r), (np.array(r) / n) @ p / np.sqrt(e), e / np.trace(covariance)))
    return out


def compare(got, want):
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    signs = None
    for i, n, deviation, scores, explained in want:
        rows = sorted(by.pop(i), key=lambda r: r.component)
        assert [r.component for r in rows] == list(range(1, len(scores) + 1))
        assert {(r.n, r.deviation) for r in rows} == {(n, deviation)}
        assert [r.explained for r in rows] == pytest.approx(list(explained), rel=1e-9)
        mine = np.array([r.whitened for r in rows])
        if signs is None:
            signs = np.sign(mine * scores)
        assert mine == pytest.approx(signs * scores, abs=1e-7)
        assert max(r.identity_error for r in rows) < 1e-9
    assert not by


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, x int, n string")


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    compare(whitened(table).collect(), brute(rows))


def test_odd_rows_and_copies(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) * (j + 1) for j in range(6)]) for i in range(60)]
    copies = [(100 + i, rows[0][1]) for i in range(200)]  # count once in the fit
    odd = [(500, None), (501, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (502, [math.nan] * 6), (503, [math.inf] + [0.0] * 5)]
    other = [(504, []), (505, [1.0, 2.0])]
    got = whitened(frame(spark, rows + copies + odd + other, "double"))
    assert got.columns == ["vec_id", *COLS]
    compare(got.collect(), brute(rows + copies))
    twice = whitened(frame(spark, [*rows, rows[3], (None, rows[4][1])], "double")).collect()
    assert sum(r.vec_id == 3 for r in twice) == 12 and sum(r.vec_id is None for r in twice) == 6


def test_no_variance(spark):
    assert whitened(frame(spark, [])).count() == 0
    assert whitened(frame(spark, [(1, None), (2, [])])).count() == 0
    assert whitened(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = whitened(frame(spark, [(i, [float(i), 1.0, -2.0 * i]) for i in range(5)])).collect()
    assert {r.component for r in line} == {1} and line[0].explained == pytest.approx(1)


def test_equal_eigenvalues(spark):
    """Corners of a cube: every direction is an eigenvector, so only the covariance of the result is told."""
    rows = [(i, [float(2 * (i >> b & 1) - 1) for b in range(5)]) for i in range(32)]
    got = whitened(frame(spark, rows)).collect()
    table = np.array([[r.whitened for r in sorted(got, key=lambda r: (r.vec_id, r.component))]]).reshape(32, 5)
    assert table.T @ table / 32 == pytest.approx(np.eye(5), abs=1e-9)
    assert max(r.identity_error for r in got) < 1e-9


@pytest.mark.parametrize("n", [1, 2, 3, 8, 40])
def test_components(n):
    rng = np.random.default_rng(n)
    for spread in ("wide", "equal", "low rank"):
        q, _ = np.linalg.qr(rng.standard_normal((n, n)))
        e = {"wide": 10.0 ** rng.uniform(-6, 6, n), "equal": np.repeat([5.0, 3.0, 1.0], n)[:: max(1, n // 3)][:n],
             "low rank": np.maximum(rng.standard_normal(n), 0)}[spread]
        e = np.resize(e, n)
        matrix = (q * e) @ q.T
        matrix = (matrix + matrix.T) / 2
        values, vectors = leading_components(matrix, 16)
        want = np.sort(np.linalg.eigvalsh(matrix))[::-1][:len(values)]
        top = max(want, default=0)
        assert np.allclose(values, want, rtol=0, atol=1e-13 * top * n)
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-10)
        assert np.allclose(matrix @ vectors, vectors * values, atol=1e-12 * top * n)


def test_sturm_counts():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((12, 12))
    diagonal, off, _ = tridiagonal(a + a.T)
    e = np.linalg.eigvalsh(a + a.T)
    x = np.linspace(-8, 8, 41)
    assert eigenvalues_below(diagonal, off, x).tolist() == [int((e < v).sum()) for v in x]


def test_deviations_beyond_a_long():
    x = np.array([[1 << 40, 0], [0, 0]])
    assert deviations(x, 2, (1 << 40, 0)) == [None, None]
    assert deviations(np.array([[1 << 28, 3], [1, 5]]), 4, (2, 7)) == [(4 * (1 << 28) - 2) ** 2 + 25, 4 + 169]

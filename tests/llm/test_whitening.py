"""Whitening against NumPy's own eigenvectors and plain sums, and on edge rows."""

import math

import numpy as np
import pytest

pytest.importorskip("settlerank.llm")


def symmetric(rng, values):
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("values", [
    [5.0], [3.0, 1.0], [2.0, 2.0, 1.0], list(range(1, 41)), [1.0] * 12, [4.0] * 5 + [1.0] * 20, [1e8, 1.0, 1e-6, 0.0, 0.0],
    [10 ** -k for k in range(20)], [1.0 + 1e-13 * k for k in range(10)] + [0.5] * 10, [7.0] + [0.0] * 30])
def test_leading_eigenvectors(values):
    from settlerank.llm.whitening import leading_eigenvectors
    matrix = symmetric(np.random.default_rng(len(values)), values)
    found, vectors = leading_eigenvectors(matrix, 16)
    k, norm = min(16, len(values)), max(values)
    assert np.allclose(found, np.sort(np.linalg.eigvalsh(matrix))[::-1][:k], atol=1e-13 * norm * len(values), rtol=0)
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-12 * norm * len(values)


def test_matrices_that_are_tridiagonal_or_zero():
    from settlerank.llm.whitening import leading_eigenvectors
    for matrix in (np.zeros((4, 4)), np.diag([1.0, 3.0, 2.0]), np.diag([2.0] * 6) + np.diag([1.0] * 5, 1) + np.diag([1.0] * 5, -1)):
        found, vectors = leading_eigenvectors(matrix, 16)
        assert np.allclose(found, np.linalg.eigvalsh(matrix)[::-1])
        assert np.allclose(matrix @ vectors, vectors * found, atol=1e-13) and np.allclose(vectors.T @ vectors, np.eye(len(matrix)))


def brute(rows):
    """(id, deviation, whitened) rows by Python integers and NumPy's solver."""
    sound = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows
             if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in sound}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit * n - sums).astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    out = []
    for i, x in sound:
        apart = np.array(x, dtype=object) * n - sums
        out.append((i, int((apart ** 2).sum()), (apart.astype(float) / n) @ vectors / np.sqrt(values)))
    return n, out, values / np.trace(centred.T @ centred / n)


def result(spark, rows, **options):
    from settlerank.llm.whitening import fit, whiten
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    return df, whiten(df, fit(df, **options)).collect()


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    mix = rng.standard_normal((20, 20)) * np.linspace(3, 0.3, 20)
    rows = [(i, [float(np.float32(c)) for c in rng.standard_normal(20) @ mix]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]                  # copies count once in the fit
    rows += [(7, rows[8][1]), (None, rows[9][1]), (5001, None), (5002, [None] * 20), (5003, [float("nan")] * 20),
             (5004, rows[1][1][:19] + [float("inf")]), (5005, []), (5006, [1.0, 2.0])]
    df, got = result(spark, rows)
    n, expected, shares = brute([r for r in rows if r[0] != 5006])        # another length than most
    assert len(got) == 16 * len(expected)
    by = {}
    for r in got:
        assert r["n"] == n and r["identity_error"] < 1e-9 and abs(r["explained"] / shares[r["component"] - 1] - 1) < 1e-9
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], r["whitened"])
    signs = None
    for i, deviation, values in expected:
        found = np.array([by[i, deviation][k] for k in range(1, 17)])
        signs = np.sign(found * values) if signs is None else signs
        assert np.allclose(found, values * signs, atol=1e-8)


def test_edge_rows(spark):
    assert result(spark, [])[1] == []
    assert result(spark, [(1, None), (2, []), (3, [None])])[1] == []
    assert result(spark, [(1, [1.0, 2.0])])[1] == []                       # no variance
    assert result(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])[1] == []
    _, got = result(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (None, [5.0, 2.0])])
    assert [r["component"] for r in got] == [1, 1, 1] and all(abs(r["explained"] - 1) < 1e-12 for r in got)
    assert {r["vec_id"]: r["deviation"] for r in got} == {1: 384 ** 2, 2: 0, None: 384 ** 2}
    _, got = result(spark, [(1, [3e38, 1.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])])   # beyond a long
    assert {r["vec_id"]: r["deviation"] for r in got} == {1: None, 2: None, 3: 128 ** 2}


def test_columns_with_clashing_names(spark):
    from settlerank.llm.whitening import fit, whiten
    rows = [(i, [float(i), float(i * i % 7)], "a", 1.0, 5) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, x string, `n` double, `_id` int")
    got = whiten(df, fit(df)).collect()
    assert len(got) == 18 and {r["n"] for r in got} == {9}


def test_exact_sums_of_large_numbers(spark):
    from settlerank.llm.whitening import exact_sums
    big = np.array([[(1 << 62) + k, -(1 << 62) - k] for k in range(50)], np.int64)
    df = spark.createDataFrame([(bytearray(x.tobytes()),) for x in big], "x binary")
    n, sums = exact_sums(df, 2)
    assert n == 50 and sums == [sum(int(v) for v in big[:, 0]), sum(int(v) for v in big[:, 1])]

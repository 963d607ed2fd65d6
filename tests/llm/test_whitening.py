"""Whitening by spectrum slicing against numpy's eigenvectors and whole-number arithmetic."""

import math

import numpy as np
import pytest

from palisade.llm import queries, whitening

NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def kept(rows):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    size = max((len(v) for _, v in good), key=lambda d: (sum(len(v) == d for _, v in good), d), default=0)
    return [(i, [math.floor(1024 * max(-(2.0**30), min(2.0**30, c))) + 100000 for c in v]) for i, v in good if len(v) == size]


def brute(rows, most=8):
    """{(vec_id, component): (n, deviation, |whitened|, explained)}, by whole numbers and numpy's eigh."""
    good = kept(rows)
    if not good:
        return {}
    x, n, d = [v for _, v in good], len(good), len(good[0][1])
    sums = [sum(v[i] for v in x) for i in range(d)]
    z = [[n * v[i] - sums[i] for i in range(d)] for v in x]
    exact = [[sum(row[i] * row[j] for row in z) for j in range(d)] for i in range(d)]
    e, u = np.linalg.eigh(np.array([[c / n**3 for c in row] for row in exact], float))
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for k in range(min(most, d)):
        if e[k] > 1e-12 * max(e[0], 1e-300):
            for (i, _), row in zip(good, z):
                w = sum(c / n * u[j, k] for j, c in enumerate(row)) / math.sqrt(e[k])
                out.setdefault((i, k + 1), []).append((n, sum(c * c for c in row), abs(w), e[k] / e.sum()))
    return out


def compare(df, rows, most=8):
    got = {}
    for r in whitening.whiten(df, components=most).collect():
        got.setdefault((r["vec_id"], r["component"]), []).append(r)
    want = brute(rows, most)
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    for key, expected in want.items():
        for r, (n, deviation, w, share) in zip(sorted(got[key], key=lambda r: r["deviation_exact"]), sorted(expected, key=lambda x: x[1])):
            assert r["n"] == n and int(r["deviation_exact"]) == deviation
            assert r["deviation"] == (deviation if deviation < 2**63 else None)
            assert abs(r["whitened"]) == pytest.approx(w, rel=1e-9, abs=1e-9) and r["explained"] == pytest.approx(share, rel=1e-9)
            assert 0 <= r["identity_error"] < 1e-9
    return got


def test_matches_brute_force(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = compare(df, rows)
    query = queries.op11_spectrum_slices(spark, small)
    assert query.columns[:3] == ["vec_id", "component", "n"] and set(NAMES) <= set(query.columns)
    assert query.count() == sum(map(len, got.values())) == 8 * len(kept(rows))
    signs = {}  # one sign a component
    x = {i: np.array(v, float) for i, v in kept(rows)}
    for k in range(1, 9):
        w = np.array([got[i, k][0]["whitened"] for i in sorted(x)])
        centred = np.array([x[i] for i in sorted(x)])
        centred -= centred.mean(axis=0)
        direction = centred.T @ w / len(w)
        signs[k] = np.abs(centred @ direction / np.linalg.norm(direction) / math.sqrt(direction @ direction) - w).max()
    assert max(signs.values()) < 1e-9


ROWS = [
    (1, [0.5, -1.25, 3.0]), (2, [1.5, 2.0, -0.125]), (2, [1.5, 2.0, -0.125]), (None, [0.0, 4.0, 1.0]), (3, None), (4, []),
    (5, [1.0, None, 2.0]), (6, [1.0, float("nan"), 2.0]), (7, [float("inf"), 0.0, 2.0]), (8, [1.0, 2.0]), (9, [7.0, 1e-30, -2.5]),
]
SCHEMA = "vec_id long, embedding array<float>, component string, `odd name` string"


def test_odd_rows(spark):
    """Nulls, non-finite and missing entries, repeated rows, another dimension, clashing columns."""
    df = spark.createDataFrame([(*r, "own", "kept") for r in ROWS], SCHEMA)
    compare(df, ROWS)
    got = whitening.whiten(df)
    assert {r["odd name"] for r in got.collect()} == {"kept"} and dict(got.dtypes)["component"] == "int"


@pytest.mark.parametrize("rows", [[], ROWS[4:7], ROWS[:1], [(1, [2.0, 3.0])] * 5])
def test_nothing_to_whiten(spark, rows):
    """Empty tables, tables that lose all rows, single and equal vectors."""
    got = whitening.whiten(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA))
    assert got.collect() == [] and set(NAMES) <= set(got.columns)


def test_large_entries_stay_exact(spark):
    """Products beyond 53 bits and deviations beyond 64."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.standard_normal(3) * 10.0**k]) for i, k in enumerate([1, 5, 8, 12, 30] * 8)]
    compare(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows, 2)


@pytest.mark.parametrize("seed", range(6))
def test_leading_eigenpairs(seed):
    rng = np.random.default_rng(seed)
    d = [1, 2, 5, 24, 64, 40][seed]
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    e = np.sort(rng.random(d) * 100)[::-1]
    if seed >= 4:
        e[1] = e[0] * (1 - 1e-9)  # nearly equal
        e[5:] = 0
    c = (q * e) @ q.T
    c = ((c + c.T) / 2).astype(np.longdouble)
    values, vectors = whitening.leading(c)
    want = np.linalg.eigvalsh(c.astype(float))[::-1][: len(values)]
    assert len(values) == min(8, (e > 0).sum()) and np.allclose(values.astype(float), want, rtol=1e-12)
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-13
    assert np.abs(vectors @ c - values[:, None] * vectors).max() < 1e-13 * e[0]


def test_equal_eigenvalues_give_an_orthonormal_basis():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.standard_normal((10, 10)))
    c = (q * [5, 5, 5, 2, 2, 1, 0, 0, 0, 0]) @ q.T
    values, vectors = whitening.leading(((c + c.T) / 2).astype(np.longdouble))
    assert np.allclose(values.astype(float), [5, 5, 5, 2, 2, 1]) and np.abs(vectors @ vectors.T - np.eye(6)).max() < 1e-13
    assert len(whitening.leading(np.zeros((3, 3), np.longdouble))[0]) == 0


def test_factorisation_counts_and_solves():
    rng = np.random.default_rng(9)
    for d in (1, 2, 7, 30):
        m = rng.standard_normal((d, d))
        m = (m + m.T) * (rng.random((d, 1)) < 0.8) * (rng.random((1, d)) < 0.8)
        m = m + m.T
        factored = whitening.Factored(m + 1e-3 * np.eye(d))
        assert factored.positive() == (np.linalg.eigvalsh(m + 1e-3 * np.eye(d)) > 0).sum()
        v = rng.standard_normal(d)
        assert np.allclose((m + 1e-3 * np.eye(d)) @ factored.solve(v), v)


def test_products_are_exact():
    rng = np.random.default_rng(4)
    for top in (1, 2000, 1 << 20, 1 << 41):
        y = rng.integers(-top, top + 1, (3000, 3))
        assert (whitening.products(y) == y.astype(object).T @ y.astype(object)).all()

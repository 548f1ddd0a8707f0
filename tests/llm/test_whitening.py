"""Operator 12 against NumPy."""

import math

import numpy as np
import pytest

from topicspark.llm import whitening as W


def sets():
    rng = np.random.default_rng(0)
    for trial in range(60):
        d, n = int(rng.integers(1, 30)), int(rng.integers(1, 70))
        yield [rng.normal(size=(n, d)) * 10.0 ** rng.integers(-3, 3, size=d), rng.integers(-3, 4, size=(n, d)).astype(float),
               np.repeat(rng.normal(size=(n, 1)), d, 1), np.tile(rng.normal(size=(1, d)), (n, 1))][trial % 4]


def test_spectra_of_parts_combine():
    """Scatter from rank-one updates and combination, rank-deficient and repeated eigenvalues included."""
    for x in sets():
        n, d = x.shape
        parts = [W.Spectrum.empty(d) for _ in range(3)]
        for i, v in enumerate(x):
            parts[i % 3].add(v)
        s = parts[0].combine(parts[1]).combine(parts[2])
        away = x - x.mean(0)
        want = away.T @ away
        size = max(np.abs(want).max(), np.abs(x).max() ** 2 * 1e-3)
        assert np.abs((s.vectors * s.values) @ s.vectors.T - want).max() <= 1e-12 * size * max(n, d)
        assert np.abs(s.vectors.T @ s.vectors - np.eye(d)).max() < 1e-12
        assert s.n == n and np.allclose(s.mean, x.mean(0))


def test_secular_roots():
    rng = np.random.default_rng(1)
    for _ in range(50):
        m = int(rng.integers(1, 20))
        d, z, rho = np.sort(rng.normal(size=m)), rng.normal(size=m) * 10.0 ** rng.integers(-4, 1, size=m), 10.0 ** rng.integers(-3, 3)
        roots, q = W.secular(d, z, rho)
        assert np.allclose(roots, np.linalg.eigvalsh(np.diag(d) + rho * np.outer(z, z)), atol=1e-13 * max(1, rho * (z @ z)))
        assert np.abs(q.T @ q - np.eye(m)).max() < 1e-13


def brute(rows, k=4):
    """{(vec_id, component): values} with exact integers and numpy's solver."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in good]
    dims = max(set(lengths), key=lambda d: (lengths.count(d), d)) if lengths else 0
    whole = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in good if len(v) == dims]
    fit = sorted({x for _, x in whole})
    if not fit:
        return [], None
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    away = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    cov = away.T @ away / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, int((e > 16 * dims * W.EPS * np.trace(cov)).sum()))
    out = []
    for i, x in whole:
        w = np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)]) @ u[:, :k] / np.sqrt(e[:k])
        out += [(i, j + 1, n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), w[j], e[j] / np.trace(cov)) for j in range(k)]
    return out, u


def same(got, want):
    got = [tuple(r) for r in got]
    key = lambda r: (r[0] is None, r[0], r[1], r[3], abs(r[4]))
    assert len(got) == len(want)
    sign = {}
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:4] == w[:4]
        if abs(w[4]) > 1e-6:
            sign.setdefault(g[1], np.sign(g[4] * w[4]))
            assert abs(g[4] * sign[g[1]] - w[4]) < 1e-9 * max(1, abs(w[4]))
        assert abs(g[5] / w[5] - 1) < 1e-9 and g[6] < 1e-9


def rows_of(seed, n, d):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) * np.linspace(2, 0.2, d)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(n + i, rows[7][1]) for i in range(n // 3)]  # a third of all rows are one vector
    return rows + [(n + n, None), (n + n + 1, []), (n + n + 2, [None] * d), (n + n + 3, [float("nan")] + [0.0] * (d - 1)),
                   (n + n + 4, [float("-inf")] + [0.0] * (d - 1)), (n + n + 5, [0.0] * (d + 1)), (3, rows[9][1]), (None, rows[5][1]), (n + n + 6, [-0.0] * d)]


SCHEMA = "vec_id bigint, embedding array<double>, label int, x string, n string, slot string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, 0, None, "n", "s") for r in rows], schema).repartition(3)


@pytest.mark.parametrize("n, d", [(90, 6), (40, 12), (5, 9), (1, 3)])
def test_op12_against_numpy(spark, n, d):
    rows = rows_of(n, n, d) if n > 10 else [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(n).normal(size=(n, d)))]
    same(W.whitening_report(frame(spark, rows)).collect(), brute(rows)[0])


def test_op12_large_numbers(spark):
    """Offsets beyond machine integers stay exact; a deviation that no long holds is null."""
    rows = [(i, [float(i) * 2.0 ** 40, 1.0 * i * i]) for i in range(6)]
    got = {(r["vec_id"], r["component"]): r for r in W.whitening_report(frame(spark, rows)).collect()}
    assert all(r["deviation"] is None for r in got.values())
    same([(*r[:3], 0, *r[4:]) for r in got.values()], [(*r[:3], 0, *r[4:]) for r in brute(rows)[0]])


def test_op12_empty_and_equal(spark):
    assert W.whitening_report(frame(spark, [])).count() == 0
    assert W.whitening_report(frame(spark, [(1, None), (2, [])])).count() == 0
    assert W.whitening_report(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0


def test_op12_on_the_given_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in e.collect()]
    same(W.whitening_report(e).collect(), brute(rows)[0])

"""Neighbours stay together, better than under principal components, and rounds on tables equal rounds on arrays."""

import numpy as np

from topicspark.operators import layout as L
from topicspark.operators import model as K


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "docid bigint, embedding array<double>").repartition(parts)


def planted():
    rng = np.random.default_rng(42)
    at = rng.normal(size=(12, 32))
    return [(i, (at[i % 12] + 0.35 * rng.normal(size=32)).tolist()) for i in range(360)]


def kept(rows, places, k=10):
    """Share of each vector's k nearest (cosine) that are among its k nearest in the plane."""
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    xy = np.array([places[i] for i, _ in rows])
    far = 1 - x @ x.T
    flat = ((xy[:, None] - xy[None]) ** 2).sum(2)
    np.fill_diagonal(far, np.inf)
    np.fill_diagonal(flat, np.inf)
    one, two = np.argsort(far, 1)[:, :k], np.argsort(flat, 1)[:, :k]
    return np.mean([len(set(a) & set(b)) / k for a, b in zip(one.tolist(), two.tolist(), strict=True)])


def places(frame):
    return {r["docid"]: (r["x"], r["y"]) for r in frame.collect()}


def test_layout_keeps_more_neighbours_than_components(spark):
    rows = planted()
    got = places(L.neighbour_layout(table(spark, rows)))
    pca = places(K.reduce_2d(table(spark, rows)))
    assert got.keys() == {i for i, _ in rows}
    assert kept(rows, got) > kept(rows, pca) + 0.1
    again = places(L.neighbour_layout(table(spark, rows, 7)))
    assert np.allclose([got[i] for i in sorted(got)], [again[i] for i in sorted(got)], atol=1e-3)


def test_rounds_on_tables(spark):
    """A few rounds, as tables and as arrays, from one graph."""
    rng = np.random.default_rng(1)
    n = 30
    pairs = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, n, size=(90, 2)).tolist() if a != b} | {(a, a + 1) for a in range(n - 1)})
    links = [(a, b, 0.1 + 0.05 * ((a * 7 + b) % 17)) for a, b in pairs]
    links += [(b, a, w) for a, b, w in links]
    xy = rng.normal(size=(n, 2))
    i, j, w = (np.array(c) for c in zip(*sorted(links), strict=True))
    start = L._start_arrays(i, j, w, xy, 2)
    want = L._layout_arrays(i, j, w, start, 2)
    t = spark.createDataFrame(links, "i bigint, j bigint, w double")
    p = spark.createDataFrame([(r, *v) for r, v in enumerate(xy.tolist())], "i bigint, x double, y double")
    begun = L._start_tables(t, p, 2)
    assert np.allclose([(r["x"], r["y"]) for r in begun.orderBy("i").collect()], start, atol=1e-9)
    assert np.allclose([(r["x"], r["y"]) for r in L._layout_tables(t, begun, 2, n).orderBy("i").collect()], want, atol=1e-8)


def test_draws_are_even():
    j = np.concatenate([L._drawn(np.arange(1000), t, 1000, np.mod) for t in range(50)])
    count = np.bincount(j, minlength=1000)
    assert count.min() > 15 and count.max() < 100 and j.max() < 1000


def test_layout_of_few_and_equal_rows(spark):
    assert L.neighbour_layout(table(spark, [])).count() == 0
    assert places(L.neighbour_layout(table(spark, [(1, [1.0, 0.0]), (2, None)]))).keys() == {1}
    rows = [(i, v) for i, v in enumerate([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [1.0, 0.0, 0.0], [0.5, 0.5, 0.0]])]
    got = places(L.neighbour_layout(table(spark, rows), epochs=5))
    assert got[0] == got[3] and len(got) == 5 and all(np.isfinite(v).all() for v in got.values())

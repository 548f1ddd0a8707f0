"""Operator 11 against brute force."""

import numpy as np
import pytest

from topicspark.llm import ann as A

SCHEMA = "vec_id bigint, embedding array<double>, label int, q bigint, part int, v string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, None, 1, "v") for r in rows], SCHEMA).repartition(3)


def brute(rows, k, every):
    """{query_id: [(vec_id, score)]} over distinct rows, ties to the smaller id."""
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    lengths = [len(v) for _, v in good]
    dims = max(set(lengths), key=lambda d: (lengths.count(d), d)) if lengths else 0
    good = sorted(r for r in good if len(r[1]) == dims)
    out = {}
    for i, q in good:
        if i % every == 0:
            near = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if (j, v) != (i, q))
            out.setdefault(i, []).append([(j, -s) for s, j in near[:k]])
    return out


def lists(frame):
    got = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return got


def clusters(seed, n, d, centres=12, spread=0.35):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, d))
    x = at[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, d))
    return x


def test_op11_awkward_rows_are_searched_whole(spark):
    """A small table is one part: exact, with ties, a hot vector, odd vectors, repeated rows and ids."""
    rng = np.random.default_rng(0)
    rows = [(i, [float(c) for c in rng.integers(-2, 3, size=4)]) for i in range(150)]  # whole numbers: many ties
    rows += [(1000 + i, [1.0, 2.0, 0.0, -1.0]) for i in range(70)]
    rows += [(2, rows[2][1]), (2000, None), (2020, []), (2040, [0.0] * 4), (2060, [-0.0, 0.0, 0.0, 0.0]), (2080, [1.0, None, 1.0, 1.0]),
             (2100, [1.0, float("nan"), 1.0, 1.0]), (2120, [float("inf"), 1.0, 1.0, 1.0]), (2140, [1.0] * 5), (None, [9.0] * 4), (-20, [1.0, -1.0, 2.0, 2.0])]
    got, want = lists(A.neighbour_report(frame(spark, rows))), brute(rows, 20, 20)
    assert got.keys() == want.keys() and all(len(w) == 1 for w in want.values())
    for i, near in got.items():
        assert [(v, s) for _, v, s in near] == want[i][0] and [r for r, *_ in near] == list(range(1, len(near) + 1))


def test_op11_fewer_rows_than_asked_for(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.0, 1.0])]
    got = lists(A.neighbour_report(frame(spark, rows)))
    assert got == {0: [(1, 20, 1.0), (2, 3, 0.0)], 20: [(1, 0, 1.0), (2, 3, 0.0)]}
    assert A.neighbour_report(frame(spark, [])).count() == 0
    assert A.neighbour_report(frame(spark, [(0, [1.0])])).count() == 0
    assert A.neighbour_report(frame(spark, [(20, None), (40, [0.0])])).count() == 0


def test_op11_one_id_with_two_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.25])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in A.neighbour_report(frame(spark, rows)).collect())
    assert got == [(0, 1, 1, 0.25), (0, 1, 1, 0.5), (0, 2, 0, 0.0), (0, 2, 0, 0.0)]


@pytest.mark.parametrize("lengths", ["one", "wide"])
def test_op11_recall_through_parts(spark, lengths):
    x = clusters(1, 4000, 16)
    if lengths == "wide":  # inner products of vectors of very different lengths
        x *= np.random.default_rng(2).lognormal(0, 0.7, size=(len(x), 1))
        x[17] *= 50
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    points = A.usable(frame(spark, rows))
    asked = points.filter("vec_id % 20 = 0")
    got = lists(A.neighbours(points, asked, 20, rows_per_part=128))
    want = {i: A.nearest(x[i:i + 1], x, 20, np.array([i]))[0] for i in range(0, 4000, 20)}
    hits = sum(len(set(want[i].tolist()) & {v for _, v, _ in got[i]}) for i in want)
    assert hits >= 0.9 * 20 * len(want)
    assert all(len(near) == 20 and all(abs(s - x[i] @ x[v]) < 1e-9 for _, v, s in near) for i, near in got.items())
    whole = lists(A.neighbours(points, asked, 20, rows_per_part=128, exhaustive=True))
    assert all({v for _, v, _ in whole[i]} == set(want[i].tolist()) for i in want)


def test_op11_visits_few_parts_of_clustered_vectors(spark):
    x = clusters(3, 6000, 16, centres=40, spread=0.15)
    points = A.usable(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]))
    distinct = A.classes(points, 20)
    router = A.fit(distinct, points.filter("vec_id % 20 = 0").select("v"), 20, 0.95, rows_per_part=128)
    assert router.parts == 32 and router.probes <= 8
    home = np.bincount(router.home(x), minlength=33)
    assert home.max() < 4 * 6000 / 32


def test_balanced_parts_cut_fewer_links():
    x = clusters(4, 2000, 8)
    links = A.nearest(x, x, 10, np.arange(len(x)))
    first = A.halves(A.direction(x), 16)
    label = A.balanced_parts(links, first, 16)
    assert np.bincount(first, minlength=16).max() == 125 and np.bincount(label, minlength=16).max() <= np.ceil(1.05 * 125)
    assert (label[links] == label[:, None]).mean() > (first[links] == first[:, None]).mean()


def test_cells_of_a_large_part(spark, monkeypatch):
    """Parts are dealt into cells on both sides; the result is the same."""
    monkeypatch.setattr(A, "CELL_BYTES", 64 * 8 * 3)
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.integers(-3, 4, size=3)]) for i in range(400)]
    got, want = lists(A.neighbour_report(frame(spark, rows), k=5, every=2)), brute(rows, 5, 2)
    assert got.keys() == want.keys()
    assert all([(v, s) for _, v, s in near] == want[i][0] for i, near in got.items())

"""Invariants of the trained / iterative operators on planted clusters."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicspark.operators import model as K


@pytest.fixture(scope="module")
def planted(spark):
    """5 well-separated centres in 64 dimensions, seeded noise, 5 % far points."""
    rng = np.random.default_rng(42)
    centres = np.eye(64)[:5] * 10
    rows, i = [], 0
    for c in range(5):
        for _ in range(60):
            v = centres[c] + rng.normal(0, 0.3, 64)
            rows.append((i, [float(x) for x in v], c))
            i += 1
    for _ in range(15):
        v = rng.normal(0, 1, 64)
        v[5 + rng.integers(0, 59)] += 10
        rows.append((i, [float(x) for x in v], -1))
        i += 1
    return spark.createDataFrame(rows, "docid long, embedding array<double>, truth int")


def test_kmeans_topics_dense_by_size(spark, planted):
    out = K.kmeans_topics(planted, 5, seed=42)
    assert out.count() == planted.count()
    assert out.select("docid").distinct().count() == planted.count()
    sizes = [r["size"] for r in K.topic_sizes(out).orderBy("topic").collect()]
    assert sizes == sorted(sizes, reverse=True)
    assert sorted(r["topic"] for r in out.select("topic").distinct().collect()) == list(range(5))


def test_probs_sum_to_one_and_assign(spark, planted):
    emb = planted.select("docid", "embedding")
    dt = planted.select("docid", F.col("truth").alias("topic"))
    from topicspark.operators import encode as E
    cents = K.centroid_array(K.topic_centroids(E.to_long(emb), dt), 64)
    p = K.topic_probs(emb, cents)
    sums = p.groupBy("docid").agg(F.sum("prob").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in sums)
    a = K.assign_new(emb, cents, "docid").join(planted.select("docid", "truth"), "docid")
    assert a.where((F.col("truth") >= 0) & (F.col("topic") != F.col("truth"))).count() == 0


def test_reduce_hierarchy_similarity(spark):
    scores = spark.createDataFrame(
        [(0, "a", 1.0), (0, "b", 1.0), (1, "a", 1.0), (1, "b", 0.9), (2, "z", 1.0), (-1, "q", 1.0)],
        "topic int, term string, score double")
    sim = K.topic_similarity(scores, blocks=3)
    s = {(r["topic_a"], r["topic_b"]): r["similarity"] for r in sim.collect()}
    assert abs(s[(0, 0)] - 1) < 1e-12 and s[(0, 1)] > 0.99 and (0, 2) not in s
    sizes = spark.createDataFrame([(0, 10), (1, 3), (2, 5), (-1, 4)], "topic int, size long")
    plan = {r["old_topic"]: r["new_topic"] for r in K.reduce_topics_plan(sim, sizes, 2).collect()}
    assert plan[1] == plan[0] and plan[-1] == -1 and len({plan[0], plan[2]}) == 2
    h = K.topic_hierarchy(sim, sizes).orderBy("step").collect()
    assert len(h) == 2 and {h[0]["left"], h[0]["right"]} == {0, 1}


def test_reduce_2d_shape(spark, planted):
    xy = K.reduce_2d(planted.select("docid", "embedding"))
    assert xy.count() == planted.count() and set(xy.columns) == {"docid", "x", "y"}


def test_average_linkage_against_all_pairs():
    """Every merge is the nearest pair of clusters by the mean of all distances between members."""
    rng = np.random.default_rng(7)
    for k in (1, 2, 5, 17, 40):
        x = rng.normal(size=(k, 3))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        clusters, want = {i: [i] for i in range(k)}, []
        while len(clusters) > 1:
            best = min((float(np.mean(d[np.ix_(clusters[a], clusters[b])])), a, b) for a in clusters for b in clusters if a < b)
            clusters[k + len(want)] = clusters.pop(best[1]) + clusters.pop(best[2])
            want.append((best[1], best[2], best[0]))
        got = K.average_linkage(d)
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_hierarchy_of_many_topics_is_quick():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 8))
    start = time.time()
    assert len(K.average_linkage(1 - x @ x.T / 100)) == 1999
    assert time.time() - start < 60


def test_cut_topics_and_counts(spark):
    sim = spark.createDataFrame([(a, b, 1.0 if a == b else s) for a, b, s in [(0, 0, 1), (1, 1, 1), (2, 2, 1), (-1, -1, 1), (0, 1, .9), (1, 0, .9), (0, 2, .1), (2, 0, .1)]],
                                "topic_a int, topic_b int, similarity double")
    sizes = spark.createDataFrame([(0, 3), (1, 4), (2, 9), (-1, 5)], "topic int, size long")
    plan = K.cut_topics(sim, sizes, 2)
    assert {tuple(r) for r in plan.collect()} == {(0, 1), (1, 1), (2, 0), (-1, -1)}
    counts = spark.createDataFrame([(0, "a", 2), (1, "a", 3), (2, "b", 1), (-1, "a", 7)], "topic int, term string, n long")
    assert {tuple(r) for r in K.merged_counts(counts, plan).collect()} == {(1, "a", 5), (0, "b", 1), (-1, "a", 7)}
    assert {tuple(r) for r in K.cut_topics(sim, sizes, 0).collect()} == {(2, 0), (1, 1), (0, 2), (-1, -1)}


def test_divergence_and_coordinates(spark):
    """Against the dense formula; coordinates give back the distances of points in a plane."""
    rng = np.random.default_rng(9)
    p = rng.random((7, 40)) * (rng.random((7, 40)) < 0.3)
    p[6] = 0
    p[6, 39], p[:6, 39] = 1.0, 0  # shares no word with the others
    p /= p.sum(1, keepdims=True)
    phi = spark.createDataFrame([(t, f"w{w}", float(p[t, w])) for t, w in zip(*np.nonzero(p), strict=True) for t, w in [(int(t), int(w))]], "topic int, term string, phi double")

    def js(a, b):
        m = (a + b) / 2
        part = lambda x: sum(x[i] * np.log(x[i] / m[i]) for i in range(len(x)) if x[i] > 0)
        return (part(a) + part(b)) / 2

    got = {(r["topic_a"], r["topic_b"]): r["divergence"] for r in K.topic_divergence(phi, blocks=3).collect()}
    assert got.keys() == {(a, b) for a in range(7) for b in range(a + 1, 7)}
    assert all(abs(got[a, b] - js(p[a], p[b])) < 1e-12 for a, b in got) and abs(got[0, 6] - np.log(2)) < 1e-12
    at = rng.normal(size=(9, 2))
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    xy = K.principal_coordinates(d)
    assert np.allclose(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2)), d)
    assert xy[:, 0].var() >= xy[:, 1].var() and K.principal_coordinates(np.zeros((0, 0))).shape == (0, 2)
    assert K.topic_coordinates(phi).count() == 7


def test_words_of_a_topic_are_not_shuffled_by_topic(spark):
    from topicspark.operators import ctfidf as G
    from topicspark.plans import q_topics as QT
    sf, key = "/root/testdata/sf0.001", "spark.sql.autoBroadcastJoinThreshold"
    counts = spark.createDataFrame([(0, "a", 2), (0, "b", 1), (1, "b", 3)], "topic int, term string, n bigint")
    old = spark.conf.get(key)
    spark.conf.set(key, -1)
    try:
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (G.ctfidf(counts, 2), QT.keybert_scores(spark, sf))]
    finally:
        spark.conf.set(key, old)
    assert not re.search(r"SortMergeJoin \[topic#\d+\]", plans[0])
    assert not re.search(r"SortMergeJoin \[topic#\d+, dim#\d+\]", plans[1])


def test_aspects_are_made_once_and_texts_tagged_once(spark):
    from topicspark.functions.tagging import TAG_TOKEN
    from topicspark.plans import q_topics as QT
    from topicspark.plans.catalog import query_scope
    sf = "/root/testdata/sf0.001"
    plan = QT.pos_scores(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(TAG_TOKEN[:20]) == 1
    with query_scope():
        assert QT.aspects_table(spark, sf) is QT.aspects_table(spark, sf)

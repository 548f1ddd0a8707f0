"""Term counts and E1 vectors against plain Python: units that rows share, and terms beyond the broadcast ones."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from topicspark.operators import encode as E
from topicspark.operators import model as K
from topicspark.operators import vectorize as V

ROWS = [(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["a"]), (4, ["a", "c"]), (None, ["z"]), (None, ["z", "a"]), (5, ["é", "e", "é", "", "é"])]


def expected(rows):
    out = Counter()
    for unit, tokens in rows:
        out.update((unit, t) for t in tokens or [])
    return out


def exchanges(df):
    """Exchanges in the plan, as the query would run."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("rows", [ROWS, ROWS[:4], ROWS[:4] + ROWS[7:]])
def test_term_counts(spark, rows):
    df = spark.createDataFrame(rows, "docid bigint, tokens array<string>").repartition(3)
    got = V.term_counts(df, "docid").collect()
    assert Counter({(r["docid"], r["term"]): r["n"] for r in got}) == expected(rows) and len(got) == len(expected(rows))
    pairs = V.term_counts(df.select(F.lit(7).alias("a"), F.col("docid").alias("b"), "tokens"), ["a", "b"]).collect()
    assert Counter({(r["b"], r["term"]): r["n"] for r in pairs}) == expected(rows) and {r["a"] for r in pairs} == {7}


def test_counts_of_single_rows_are_not_shuffled(spark):
    df = spark.createDataFrame(ROWS[:4], "docid bigint, tokens array<string>")
    counts = V.term_counts(df, "docid")
    assert exchanges(counts) == 0
    # nor are they dealt by term when few terms go: the one exchange counts the units of each term
    assert exchanges(V.count_vectorize(counts, "docid", 4, max_df=0.5)) == 1


def test_count_vectorize_by_share(spark):
    rows = [(i, ["all"] + ["half"] * (i % 2) + [f"t{i}"]) for i in range(10)]
    counts = V.term_counts(spark.createDataFrame(rows, "docid bigint, tokens array<string>"), "docid")
    for share, gone in ((0.8, {"all"}), (0.5, {"all"}), (0.4, {"all", "half"}), (1.0, set())):
        got = {(r["docid"], r["term"]) for r in V.count_vectorize(counts, "docid", 10, max_df=share).collect()}
        assert got == {(i, t) for i, tokens in rows for t in tokens if t not in gone}


@pytest.mark.parametrize("frequent", [0, 3, 40, 1000])
def test_hash_rows_whatever_is_broadcast(spark, frequent):
    rows = [(i, [f"w{j}" for j in range(30) if (i * 7 + j * j) % (j + 1) == 0 for _ in range(1 + j % 2)]) for i in range(25)] + [(100, ["unknown"]), (None, ["w1"])]
    known = [r for r in rows if r[0] is not None and r[0] < 100]
    counts = expected(rows)
    df = Counter(t for (u, t) in expected(known))
    raw = defaultdict(lambda: defaultdict(float))
    for (u, t), n in counts.items():
        if t in df and u is not None:
            h = hashlib.md5(t.encode()).hexdigest()
            raw[u][int(h[:12], 16) % 8] += n * math.log(1 + 25 / df[t]) * (1 if int(h[12], 16) % 2 == 0 else -1)
    want = {}
    for u, dims in raw.items():
        length = math.sqrt(sum(x * x for x in dims.values()))
        if length > 0:
            want[u] = [dims[d] / length if d in dims else None for d in range(8)]
    schema = "docid bigint, tokens array<string>"
    idf = E.fit_idf(V.term_counts(spark.createDataFrame(known, schema), "docid"))
    vectors = E.hash_rows(V.term_counts(spark.createDataFrame(rows, schema), "docid"), idf, dims=8, frequent=frequent)
    got = {r["docid"]: r["vec"] for r in vectors.collect()}
    assert got.keys() == want.keys() and vectors.count() == len(want)
    for u, v in want.items():
        assert [x is None for x in got[u]] == [x is None for x in v]
        assert all(abs((x or 0) - (y or 0)) < 1e-12 for x, y in zip(got[u], v, strict=True))
    units = spark.createDataFrame(rows, schema).select("docid").distinct()
    dense = {r["docid"]: r["embedding"] for r in E.rows_to_dense(vectors, dims=8, units=units).collect()}
    assert dense[100] == [0.0] * 8 and dense[None] == [0.0] * 8 and len(dense) == 27 and all(len(v) == 8 for v in dense.values())
    topics = spark.createDataFrame([(i, i % 3) for i in range(25)] + [(100, 1)], "docid bigint, topic int")
    a = {(r["topic"], r["dim"]): r["value"] for r in K.row_centroids(vectors, topics).collect()}
    b = {(r["topic"], r["dim"]): r["value"] for r in K.topic_centroids(E.rows_to_long(vectors), topics).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)

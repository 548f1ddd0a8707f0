"""Window vectors in rows (I3): against the oracle on odd turns, and how many rows carry them."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from topicspark.operators import encode as EN
from topicspark.operators import model as K
from topicspark.operators import vectorize as V

SF = "/root/testdata/sf0.001"


def test_distribution_of_odd_turns_matches_oracle(spark, tmp_path):
    """Turns that are null, empty, short or without a known term, keys that repeat with other texts, null keys."""
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        p = f"{SF}/{t}.parquet"
        odd = "" if t != "conversations" else f""" UNION ALL SELECT * FROM (VALUES (900001, 0, 'user', NULL), (900001, 1, 'user', ''), (900002, 0, 'user', 'zzqqxx yyvvkk'))
          UNION ALL SELECT 900003, 0, role, text FROM read_parquet('{p}') WHERE conv_id < 4
          UNION ALL SELECT 900004, 0, role, left(text, 9) FROM read_parquet('{p}') WHERE conv_id < 4
          UNION ALL SELECT NULL, 0, role, text FROM read_parquet('{p}') WHERE conv_id < 2
          UNION ALL SELECT * FROM read_parquet('{p}') WHERE conv_id = 3"""
        con.execute(f"COPY (SELECT * FROM read_parquet('{p}'){odd}) TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    got = {(r["conv_id"], r["turn"], r["topic"]): r["share"] for r in E.queries()["approx_distribution_emb"](spark, str(tmp_path)).collect()}
    want = {(c, n, t): s for c, n, t, s in con.execute("SELECT conv_id, turn, topic, share FROM (" + E.oracle_sql()["approx_distribution_emb"] + ")").fetchall()}
    assert any(c == 900003 for c, _, _ in got) and any(c == 900004 for c, _, _ in got)
    assert got == pytest.approx(want, abs=2e-6)


@pytest.mark.parametrize("frequent", [0, 100])
def test_a_token_is_sent_once_not_once_a_window(spark, frequent):
    rows = [(1, "a b c d e f g h".split()), (2, ["a", "b"]), (3, ["x"]), (4, []), (5, None), (6, ["a", "c", "e", "g", "b"]), (6, ["h", "c"])]
    docs = spark.createDataFrame(rows, "docid bigint, tokens array<string>")
    idf = EN.fit_idf(V.term_counts(docs.where("docid in (1, 2, 6)"), "docid"))
    windows = EN.hash_windows(docs, idf, "docid", 4, dims=8, frequent=frequent)
    entries = {r["docid"]: r["entries"] for r in windows.collect()}
    assert {d: len(e) for d, e in entries.items() if d != 6} == {1: 8, 2: 2}
    assert sorted((e["lo"], e["hi"]) for e in entries[1]) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 4), (2, 4), (3, 4), (4, 4)]
    # the windows one by one: counts by window, as vectors, as cosines
    pos = docs.select("docid", F.size("tokens").alias("m"), F.posexplode("tokens").alias("pos", "term"))
    wins = pos.select("docid", F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - 3), F.least("pos", F.greatest(F.col("m") - 4, F.lit(0))))).alias("win"), "term")
    counts = wins.groupBy(F.struct("docid", "win").alias("unit"), "term").agg(F.count(F.lit(1)).alias("n"))
    cents = spark.createDataFrame([(t, d, float((t * 5 + d * 3) % 7) - 3) for t in (0, 2) for d in range(8)], "topic int, dim int, value double")
    array = K.centroid_array(cents, 8)
    dense = EN.to_dense(EN.hash_encode(counts, idf, unit="unit", dims=8), unit="unit", dims=8)
    each = K.cosine_to_topics(dense, array).select("unit.docid", F.explode("sims").alias("s")).where("s.sim >= 0.001")
    want = {(r["docid"], r["topic"]): r["sim"] for r in each.groupBy("docid", F.col("s.topic").alias("topic")).agg(F.sum("s.sim").alias("sim")).collect()}
    got = {(r["docid"], r["topic"]): r["sim"] for r in K.window_similarity(windows, array, "docid", 8, 0.001).collect()}
    assert want and got == pytest.approx(want)

"""Registered queries against their DuckDB oracles on the smallest data set, and the entry point."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from topicspark.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
FAST = ["topic_top_words", "ctfidf", "code_frequencies", "is_katakana_sentence", "paragraphs", "tokenize_word",
        "pos_filter", "chunk_paragraphs", "chunk_paragraphs_ja", "chunk_sentences", "meta_left_join", "corpus_metrics",
        "length_box", "topic_probs", "stratified_docs", "embed_docs", "assign_new", "topic_similarity",
        "topics_per_class", "find_topics", "approx_distribution", "token_topics", "dictionary_extremes", "doc2bow",
        "generate_labels", "labels_import", "corpus_fingerprint", "load_run", "transpose_topics", "rep_keybert", "rep_mmr",
        "knn_graph", "topic_hierarchy", "reduced_top_words", "ldavis_topics"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["topic", "rank", "term", "score"]


def test_every_query_has_docstring():
    for name, fn in E.queries().items():
        assert fn.__doc__, name


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, srows) == _rows(dcols, res.fetchall())


def test_new_texts_of_any_kind_match_oracle(spark, tmp_path):
    """assign_new on turns that are null, empty, unknown or repeated: a row each, as in SQL."""
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        odd = "" if t != "conversations" else """ UNION ALL SELECT * FROM (VALUES (900001, 0, 'user', NULL), (900001, 1, 'user', ''), (900002, 0, 'user', 'zzqqxx yyvvkk'),
          (900003, 0, 'user', '...'))"""
        con.execute(f"COPY (SELECT * FROM read_parquet('{SF}/{t}.parquet'){odd}) TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    df = E.queries()["assign_new"](spark, str(tmp_path))
    res = con.execute(E.oracle_sql()["assign_new"])
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == _rows([d[0] for d in res.description], res.fetchall())
    assert df.where("conv_id > 900000 AND topic = -1").count() == 4

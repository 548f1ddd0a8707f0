"""Registered queries: corpus files, saved runs and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicspark.plans import common as C
from topicspark.plans import fixtures as fx
from topicspark.plans.catalog import query, with_ctes
from topicspark.session import scratch_path
from topicspark.sources import runs as R
from topicspark.sources.tables import read_text_corpus, write_text_corpus

SETTINGS = {"embedding_model": "hash-e1-64", "representations": sorted(["KeyBERT", "Main", "POS"]), "nr_topics": 0,
            "tokenizer": "word", "ngram_range": [1, 1], "max_df": C.MAX_DF, "features": [], "pos_filter": [],
            "surface_filter": ""}


@query("corpus_read", with_ctes(fx.SQL_CORPUS) + r"""
SELECT filename, regexp_replace(filename, '\.[^.]*$', '') AS title, md5(text) AS text_md5 FROM corpus""")
def q_corpus_read(spark, sf):
    """Every document written as its own .txt file in the shared folder, read back one file per row."""
    folders = write_text_corpus(fx.corpus(spark, sf), scratch_path(spark, "corpus_txt"))
    raw = read_text_corpus(spark, folders, written=True)
    return raw.select("filename", "title", F.md5("text").alias("text_md5"))


SQL_FP = f"""SELECT count(*) AS n_docs,
  bit_xor(CAST(('0x' || substr(md5(CAST(docid AS VARCHAR) || ':' || text), 1, 15)) AS BIGINT)) AS docs_hash,
  '{R.settings_hash(SETTINGS)}' AS settings_hash FROM corpus"""


@query("corpus_fingerprint", with_ctes(fx.SQL_CORPUS) + f"""
SELECT n_docs, docs_hash, settings_hash,
       md5(CAST(n_docs AS VARCHAR) || ':' || CAST(docs_hash AS VARCHAR) || ':' || settings_hash) AS key FROM ({SQL_FP})""")
def q_corpus_fingerprint(spark, sf):
    """Cache key of the corpus and settings (order-insensitive digest of every document)."""
    return R.corpus_fingerprint(fx.corpus(spark, sf), SETTINGS)


@query("model_fingerprint", C.sql_fix_ctes() + f""",
v AS (SELECT count(*) AS n_terms, bit_xor(CAST(('0x' || substr(md5(term), 1, 15)) AS BIGINT)) AS vocab_hash FROM (SELECT DISTINCT term FROM ctfidf)),
t AS (SELECT count(DISTINCT topic) AS n_topics,
             bit_xor(CAST(('0x' || substr(md5(CAST(docid AS VARCHAR) || ':' || CAST(topic AS VARCHAR)), 1, 15)) AS BIGINT)) AS topics_hash FROM doc_topic)
SELECT t.n_topics, v.n_terms, '1-1' AS ngram_range, CAST({C.MAX_DF} AS DOUBLE) AS max_df, v.vocab_hash, t.topics_hash, 0 AS nr_topics FROM v, t""")
def q_model_fingerprint(spark, sf):
    """Fingerprint of the fitted model: shape, settings, vocabulary and assignment digests."""
    return R.model_fingerprint(C.fix_ctfidf(spark, sf), fx.doc_topic(spark, sf), (1, 1), C.MAX_DF, 0)


def _save(spark, sf):
    path = scratch_path(spark, "run")
    fp = R.corpus_fingerprint(fx.corpus(spark, sf), SETTINGS).first()["key"]
    tables = {"topic_terms": C.fix_top_words(spark, sf), "doc_topic": fx.doc_topic(spark, sf),
              "ctfidf": C.fix_ctfidf(spark, sf)}
    manifest = R.save_run(spark, path, tables, SETTINGS, fp)
    return path, fp, manifest


@query("save_run", with_ctes(fx.SQL_CORPUS, fx.SQL_DOC_TOPIC, C.SQL_TOKS, C.SQL_CTFIDF, C.SQL_TOPWORDS) + """
SELECT 'ctfidf' AS "table", count(*) AS n_rows FROM ctfidf
UNION ALL SELECT 'doc_topic', count(*) FROM doc_topic
UNION ALL SELECT 'topic_terms', count(*) FROM topw""")
def q_save_run(spark, sf):
    """The model tables saved as Parquet with the manifest written last; rows per saved table."""
    _, _, manifest = _save(spark, sf)
    rows = sorted(manifest["tables"].items())
    return spark.createDataFrame(rows, "table string, n_rows bigint")


@query("load_run", C.sql_fix_ctes(C.SQL_TOPWORDS) + f"""
SELECT topic, CAST(rank AS INTEGER) AS rank, term, {fx.sql_r6('score')} AS score FROM topw""")
def q_load_run(spark, sf):
    """A finished run loaded back (fingerprint checked); its topic words equal the computed ones."""
    path, fp, _ = _save(spark, sf)
    run = R.load_run(spark, path, fp)
    if run is None:
        raise RuntimeError("saved run not found")
    t = run["topic_terms"]
    return t.select("topic", "rank", "term", fx.r6(F.col("score")).alias("score"))

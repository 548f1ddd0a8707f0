"""Shared building blocks of the registered queries (Spark side and SQL side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.functions import text as T
from topicspark.operators import ctfidf as G
from topicspark.plans import fixtures as fx
from topicspark.plans.catalog import reused

MAX_DF = 0.9       # topic-level max_df of the presets
TOP_N = 10         # words per topic


@reused("doc_tokens", write=False)
def doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """(docid, tokens) with the default analytical tokenizer."""
    return fx.corpus(spark, sf).select("docid", T.tokenize_word("text").alias("tokens"))


def n_topics(spark: SparkSession, sf: str):
    return fx.doc_topic(spark, sf).select(F.countDistinct("topic")).scalar()


@reused("topic_term_counts")
def topic_term_counts(spark: SparkSession, sf: str) -> DataFrame:
    """(topic, term, n) of the given topic model, written once per query."""
    return G.topic_term_counts(doc_tokens(spark, sf), fx.doc_topic(spark, sf))


@reused("ctfidf")
def fix_ctfidf(spark: SparkSession, sf: str, max_df: float | None = MAX_DF) -> DataFrame:
    return G.ctfidf(topic_term_counts(spark, sf), n_topics(spark, sf), max_df=max_df)


def fix_top_words(spark: SparkSession, sf: str, n: int = TOP_N) -> DataFrame:
    return G.top_words(fix_ctfidf(spark, sf), n)


# --- SQL side -----------------------------------------------------------------

SQL_TOKS = r"""toks AS (
  SELECT docid, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM corpus)"""

SQL_CTFIDF = f"""tc AS (
  SELECT dt.topic, t.term, count(*) AS n FROM toks t JOIN doc_topic dt USING (docid) GROUP BY 1, 2),
ntop AS (SELECT count(DISTINCT topic) AS k FROM doc_topic),
keep AS (SELECT term FROM tc GROUP BY term HAVING count(*) <= (SELECT k FROM ntop) * {MAX_DF}),
tcv AS (SELECT * FROM tc WHERE term IN (SELECT term FROM keep)),
words AS (SELECT topic, sum(n) AS words FROM tcv GROUP BY topic),
freq AS (SELECT term, sum(n) AS f FROM tcv GROUP BY term),
avgw AS (SELECT floor(sum(n) / (SELECT k FROM ntop)) AS a FROM tcv),
ctfidf AS (
  SELECT tcv.topic, tcv.term, tcv.n, tcv.n / words.words AS tf, ln(1 + (SELECT a FROM avgw) / freq.f) AS idf,
         tcv.n / words.words * ln(1 + (SELECT a FROM avgw) / freq.f) AS score
  FROM tcv JOIN words USING (topic) JOIN freq USING (term))"""

SQL_TOPWORDS = f"""topw AS (
  SELECT * FROM (
    SELECT topic, term, score, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS rank
    FROM ctfidf) WHERE rank <= {TOP_N})"""


def sql_fix_ctes(*extra: str) -> str:
    from topicspark.plans.catalog import with_ctes
    return with_ctes(fx.SQL_CORPUS, fx.SQL_DOC_TOPIC, SQL_TOKS, SQL_CTFIDF, *extra)

"""Stand-in inputs built from the given tables, with the same rows in Spark and SQL.

They only rename and reshape the test tables into the schemas the operators

* ``corpus``: one work per document: filename ``doc<doc_id>.txt``, title/label
  ``<source>_<doc_id>``, author = source, genre = lang.
* ``metadata``: corpus metadata for the documents that have a ``labels`` row,
  year = 2000 + doc_id % 20; author_ja/title_ja are the kana renderings below.
* ``doc_topic``: the given topic model: every document, topic = the label of
  its embedding, -1 (outlier) where the document has no embedding.
* ``kana``: a Japanese-script rendering of a text (Latin letters to kana/kanji,
  '.' to '。'), so the Japanese operators see Japanese characters.
* ``xy``: 2-D coordinates of a document = the first two embedding components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.sources.tables import table

# Fixed values of the kana rendering (same in Spark and DuckDB).
KANA_FROM = "aeioustnr."
KANA_TO = "アイウエオかき世界。"


def kana(col):
    return F.translate(F.lower(col), KANA_FROM, KANA_TO)


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    title = F.concat_ws("_", F.col("source"), F.col("doc_id").cast("string"))
    return d.select(
        F.col("doc_id").alias("docid"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        title.alias("title"),
        title.alias("label"),
        F.col("source").alias("author"),
        F.col("lang").alias("genre"),
        F.col("text"),
    )


def metadata(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels").select("doc_id").distinct()
    m = d.join(lab, "doc_id")
    title = F.concat_ws("_", F.col("source"), F.col("doc_id").cast("string"))
    return m.select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.col("source").alias("author"),
        kana(F.col("source")).alias("author_ja"),
        title.alias("title"),
        kana(title).alias("title_ja"),
        F.col("lang").alias("genre"),
        (F.lit(2000) + F.col("doc_id") % 20).cast("int").alias("year"),
    )


def doc_topic(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id")
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return (d.join(e, d.doc_id == e.vec_id, "left")
            .select(F.col("doc_id").alias("docid"), F.coalesce(F.col("label"), F.lit(-1)).cast("int").alias("topic")))


def doc_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings of the documents that have one: emb(docid, embedding)."""
    e = table(spark, sf, "embeddings")
    d = table(spark, sf, "documents").select("doc_id")
    return e.join(d, e.vec_id == d.doc_id, "left_semi").select(F.col("vec_id").alias("docid"), "embedding")


def xy(spark: SparkSession, sf: str) -> DataFrame:
    return doc_embedding(spark, sf).select(
        "docid", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


# --- the same stand-ins as DuckDB CTEs -------------------------------------------

SQL_CORPUS = """corpus AS (
  SELECT doc_id AS docid, 'doc' || CAST(doc_id AS VARCHAR) || '.txt' AS filename,
         source || '_' || CAST(doc_id AS VARCHAR) AS title,
         source || '_' || CAST(doc_id AS VARCHAR) AS label,
         source AS author, lang AS genre, text
  FROM documents)"""

SQL_METADATA = f"""metadata AS (
  SELECT 'doc' || CAST(doc_id AS VARCHAR) || '.txt' AS filename, source AS author,
         translate(lower(source), '{KANA_FROM}', '{KANA_TO}') AS author_ja,
         source || '_' || CAST(doc_id AS VARCHAR) AS title,
         translate(lower(source || '_' || CAST(doc_id AS VARCHAR)), '{KANA_FROM}', '{KANA_TO}') AS title_ja,
         lang AS genre, CAST(2000 + doc_id % 20 AS INTEGER) AS year
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"""

SQL_DOC_TOPIC = """doc_topic AS (
  SELECT d.doc_id AS docid, CAST(COALESCE(e.label, -1) AS INTEGER) AS topic
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""

SQL_DOC_EMB = """doc_emb AS (
  SELECT vec_id AS docid, embedding FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))"""

SQL_XY = """xy AS (
  SELECT vec_id AS docid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y
  FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))"""


def r6(col):
    """Round a double to 6 places with IEEE arithmetic only (identical in DuckDB)."""
    return (F.floor(col * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)).cast("double")


def sql_r6(expr: str) -> str:
    return f"(floor(({expr}) * 1e6 + 0.5) / 1e6)"

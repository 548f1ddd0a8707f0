"""Registered queries: sources S2-S5 and relational operators R1-R16, R18, R20."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicspark.operators import metadata as M
from topicspark.plans import common as C
from topicspark.plans import fixtures as fx
from topicspark.plans import q_chunk as QC
from topicspark.plans.catalog import query, with_ctes
from topicspark.session import scratch_path
from topicspark.sources import files as S
from topicspark.sources.tables import table

SQL_DOCS_AS_CHUNKS = """dchunks AS (
  SELECT docid, filename, author, label, CAST(length(text) AS INTEGER) AS length FROM corpus)"""


def _docs_as_chunks(spark, sf):
    return fx.corpus(spark, sf).select("docid", "filename", "author", "label", F.length("text").cast("int").alias("length"))


def _chunks_with_author(spark, sf, settings=QC.FULL):
    ch = QC._chunks(spark, sf, settings)
    authors = fx.corpus(spark, sf).select("filename", "author", "title")
    return ch.join(authors, "filename")


def _sql_chunks_with_author(settings=QC.FULL):
    return with_ctes(fx.SQL_CORPUS, QC.sql_chunks(settings), """cwa AS (
  SELECT ch.*, c.author, c.title FROM chunks ch JOIN corpus c USING (filename))""")


@query("metadata_read", with_ctes(fx.SQL_METADATA) + "\nSELECT * FROM metadata")
def q_metadata_read(spark, sf):
    """The corpus metadata written as TSV to the shared folder and read back with the fixed schema."""
    path = scratch_path(spark, "metadata_tsv")
    S.write_metadata(fx.metadata(spark, sf), path, "Japanese")
    return S.read_metadata(spark, path, "Japanese")


@query("metadata_localize", with_ctes(fx.SQL_METADATA) + """
SELECT filename, author_ja AS author, title_ja AS title, genre, year FROM metadata""")
def q_metadata_localize(spark, sf):
    """S3: author/title replaced by their Japanese columns."""
    path = scratch_path(spark, "metadata_tsv")
    S.write_metadata(fx.metadata(spark, sf), path, "Japanese")
    return S.localize_metadata(S.read_metadata(spark, path, "Japanese"))


@query("meta_left_join", with_ctes(fx.SQL_CORPUS, fx.SQL_METADATA, SQL_DOCS_AS_CHUNKS) + """
SELECT c.*, m.title, m.genre, m.year FROM dchunks c LEFT JOIN metadata m USING (filename)""")
def q_meta_left_join(spark, sf):
    """Every chunk with title, genre and year of its work (NULL without metadata)."""
    return M.meta_left_join(_docs_as_chunks(spark, sf), fx.metadata(spark, sf), with_year=True)


@query("meta_default", with_ctes(fx.SQL_CORPUS, SQL_DOCS_AS_CHUNKS) + """
SELECT *, label AS title, 'all' AS genre FROM dchunks""")
def q_meta_default(spark, sf):
    """R2: title = label and genre 'all' when there is no metadata."""
    return M.meta_default(_docs_as_chunks(spark, sf))


@query("author_lookup", with_ctes(fx.SQL_CORPUS, fx.SQL_METADATA) + """
SELECT w.filename, w.title, coalesce(m.author, split_part(w.title, '_', 1)) AS author
FROM (SELECT DISTINCT filename, title FROM corpus) w
LEFT JOIN (SELECT filename, min(author) AS author FROM metadata GROUP BY filename) m USING (filename)""")
def q_author_lookup(spark, sf):
    """Author of every work from metadata, else the title before the first '_'."""
    works = fx.corpus(spark, sf).select("filename", "title").distinct()
    return M.author_lookup(works, fx.metadata(spark, sf))


@query("meta_inner_join", with_ctes(fx.SQL_CORPUS, fx.SQL_METADATA, SQL_DOCS_AS_CHUNKS) + """
SELECT m.filename, m.genre, m.year, m.author_ja AS author, m.title_ja AS title, c.label, c.docid, c.length
FROM metadata m JOIN dchunks c USING (filename)""")
def q_meta_inner_join(spark, sf):
    """LDA-path metadata (Japanese author/title) inner-joined to the chunks."""
    return M.meta_inner_join(_docs_as_chunks(spark, sf), fx.metadata(spark, sf))


@query("corpus_metrics", with_ctes(fx.SQL_CORPUS, fx.SQL_METADATA, SQL_DOCS_AS_CHUNKS, fx.SQL_DOC_TOPIC) + """,
j AS (SELECT c.*, m.title, m.genre FROM dchunks c LEFT JOIN metadata m USING (filename))
SELECT CAST(count(DISTINCT title) + max(CASE WHEN title IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_works,
       CAST(count(DISTINCT author) + max(CASE WHEN author IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_authors,
       CAST(count(DISTINCT genre) + max(CASE WHEN genre IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_genres,
       count(*) AS n_docs, (SELECT count(DISTINCT topic) FROM doc_topic) AS n_topics FROM j""")
def q_corpus_metrics(spark, sf):
    """Distinct works, authors, genres (NULL is one value), documents and topics."""
    j = M.meta_left_join(_docs_as_chunks(spark, sf), fx.metadata(spark, sf))
    return M.corpus_metrics(j, fx.doc_topic(spark, sf))


@query("distinct_sorted", with_ctes(fx.SQL_CORPUS) + "\nSELECT DISTINCT author FROM corpus ORDER BY author")
def q_distinct_sorted(spark, sf):
    """Sorted distinct authors."""
    return M.distinct_sorted(fx.corpus(spark, sf), "author")


@query("works_of_author", with_ctes(fx.SQL_CORPUS) + "\nSELECT DISTINCT title FROM corpus WHERE author = (SELECT min(author) FROM corpus)")
def q_works_of_author(spark, sf):
    """Sorted works of the first author."""
    d = fx.corpus(spark, sf)
    return M.works_of_author(d, d.select(F.min("author")).first()[0])


@query("work_doc_range", _sql_chunks_with_author() + """
SELECT title, min(docid) AS first_docid, max(docid) AS last_docid, count(*) AS n_chunks FROM cwa GROUP BY title""")
def q_work_doc_range(spark, sf):
    """first/last docid and number of chunks of every work."""
    return M.work_doc_range(_chunks_with_author(spark, sf))


@query("doc_lookup", with_ctes(fx.SQL_CORPUS) + """,
req AS (SELECT conv_id, turn, conv_id * 10 + turn - 5 AS requested FROM conversations),
n AS (SELECT count(*) AS n FROM corpus)
SELECT r.docid, r.conv_id, r.turn, r.requested, c.author, c.title FROM (
  SELECT *, CAST(least(greatest(0, requested), (SELECT n FROM n) - 1) AS BIGINT) AS docid FROM req) r
LEFT JOIN corpus c USING (docid)""")
def q_doc_lookup(spark, sf):
    """Navigation requests (from conversation ids) clamped into the docid range and looked up."""
    req = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("conv_id") * 10 + F.col("turn") - 5).alias("requested"))
    return M.doc_lookup(fx.corpus(spark, sf), req).select("docid", "conv_id", "turn", "requested", "author", "title")


@query("chunk_position", _sql_chunks_with_author() + """
SELECT docid, filename, CAST(row_number() OVER (PARTITION BY filename ORDER BY docid) AS BIGINT) AS position,
       count(*) OVER (PARTITION BY filename) AS total FROM cwa""")
def q_chunk_position(spark, sf):
    """Position i and total n of every chunk within its file."""
    return M.chunk_position(_chunks_with_author(spark, sf)).select("docid", "filename", "position", "total")


@query("hover_text", _sql_chunks_with_author() + """
SELECT docid, md5(author || ' | ' || title || ' | chunk ' || CAST(row_number() OVER (PARTITION BY filename ORDER BY docid) AS VARCHAR)
       || '/' || CAST(count(*) OVER (PARTITION BY filename) AS VARCHAR) || chr(10) || text) AS hover_md5 FROM cwa""")
def q_hover_text(spark, sf):
    """Hover text 'author | title | chunk i/n' + newline + chunk text of every chunk."""
    return M.hover_text(M.chunk_position(_chunks_with_author(spark, sf))).select("docid", F.md5("hover").alias("hover_md5"))


def _box_sql(dim):
    return f"""SELECT '{dim}' AS dimension, q.v AS value, q.n, q.q1, q.median, q.q3, w.lower_whisker, w.upper_whisker, w.n_outliers
FROM (SELECT {dim} AS v, count(*) AS n, quantile_cont(length, 0.25) AS q1, quantile_cont(length, 0.5) AS median,
             quantile_cont(length, 0.75) AS q3 FROM cwa GROUP BY {dim}) q
JOIN (SELECT c.{dim} AS v,
        min(CASE WHEN length BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN length END) AS lower_whisker,
        max(CASE WHEN length BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN length END) AS upper_whisker,
        CAST(sum(CASE WHEN length BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
      FROM cwa c JOIN (SELECT {dim} AS v, quantile_cont(length, 0.25) AS q1, quantile_cont(length, 0.75) AS q3 FROM cwa GROUP BY {dim}) qq
        ON c.{dim} = qq.v GROUP BY c.{dim}) w USING (v)"""


def _with_genre(settings):
    return _sql_chunks_with_author(settings).replace(
        "SELECT ch.*, c.author, c.title FROM", "SELECT ch.*, c.author, c.title, c.genre FROM")


@query("length_box", _with_genre(QC.FAST) + "\n" + _box_sql("author") + "\nUNION ALL\n" + _box_sql("genre"))
def q_length_box(spark, sf):
    """Box-plot statistics of chunk length by author and by genre."""
    ch = QC._chunks(spark, sf, QC.FAST).join(fx.corpus(spark, sf).select("filename", "author", "genre"), "filename")
    parts = []
    for dim in ("author", "genre"):
        b = M.length_box(ch, dim)
        parts.append(b.select(F.lit(dim).alias("dimension"), F.col(dim).alias("value"), "n", "q1", "median", "q3",
                              "lower_whisker", "upper_whisker", "n_outliers"))
    return parts[0].unionByName(parts[1])


@query("histogram_count", _with_genre(QC.FAST) + """
SELECT 'author' AS dimension, author AS value, count(*) AS n FROM cwa GROUP BY author
UNION ALL SELECT 'genre', genre, count(*) FROM cwa GROUP BY genre""")
def q_histogram_count(spark, sf):
    """Number of chunks per author and per genre."""
    ch = QC._chunks(spark, sf, QC.FAST).join(fx.corpus(spark, sf).select("filename", "author", "genre"), "filename")
    a = M.histogram_count(ch, "author").select(F.lit("author").alias("dimension"), F.col("author").alias("value"), "n")
    g = M.histogram_count(ch, "genre").select(F.lit("genre").alias("dimension"), F.col("genre").alias("value"), "n")
    return a.unionByName(g)


@query("group_mean", with_ctes(fx.SQL_CORPUS, fx.SQL_XY) + f"""
SELECT author AS color_group, {fx.sql_r6('avg(x)')} AS x, {fx.sql_r6('avg(y)')} AS y
FROM xy JOIN corpus USING (docid) GROUP BY author""")
def q_group_mean(spark, sf):
    """Mean 2-D position per colour group (author)."""
    pts = fx.xy(spark, sf).join(fx.corpus(spark, sf).select("docid", F.col("author").alias("color_group")), "docid")
    g = M.group_mean(pts)
    return g.select("color_group", fx.r6(F.col("x")).alias("x"), fx.r6(F.col("y")).alias("y"))


SQL_TOP5 = """top5 AS (SELECT topic FROM (SELECT topic, row_number() OVER (ORDER BY count(*) DESC, topic) AS r
                        FROM doc_topic GROUP BY topic) WHERE r <= 5)"""


def _top5(spark, sf):
    from topicspark.operators.topk import top_k
    sizes = fx.doc_topic(spark, sf).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    return top_k(sizes, [], [F.desc("n"), F.asc("topic")], 5).select("topic")


@query("case_remap", with_ctes(fx.SQL_DOC_TOPIC, SQL_TOP5) + """
SELECT docid, CASE WHEN topic IN (SELECT topic FROM top5) THEN topic ELSE -1 END AS topic FROM doc_topic""")
def q_case_remap(spark, sf):
    """Topics outside the 5 largest become -1."""
    return M.case_remap(fx.doc_topic(spark, sf), _top5(spark, sf)).select("docid", "topic")


@query("map_lookup", C.sql_fix_ctes(C.SQL_TOPWORDS, SQL_TOP5) + """,
labels AS (SELECT topic, CAST(topic AS VARCHAR) || ': ' || string_agg(term, '_' ORDER BY rank) AS label
           FROM topw WHERE rank <= 3 AND topic <> -1 GROUP BY topic)
SELECT d.docid, d.topic, coalesce(l.label, CASE WHEN d.topic = -1 THEN 'Other' ELSE 'Unknown' END) AS label
FROM doc_topic d LEFT JOIN labels l USING (topic)""")
def q_map_lookup(spark, sf):
    """Label of every document's topic; outliers are 'Other'."""
    from topicspark.operators import labels as L
    lab = L.generate_labels(C.fix_top_words(spark, sf)).where(F.col("topic") != -1)
    return M.map_lookup(fx.doc_topic(spark, sf), lab).select("docid", "topic", "label")


@query("drop_outliers", with_ctes(fx.SQL_DOC_TOPIC) + "\nSELECT docid, topic FROM doc_topic WHERE topic <> -1")
def q_drop_outliers(spark, sf):
    """Documents of topic -1 removed."""
    return M.drop_outliers(fx.doc_topic(spark, sf))


@query("list_compact", """
SELECT doc_id AS docid, CAST(len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS BIGINT) AS n_items,
       md5(array_to_string(list_filter(string_split(text, ' '), lambda x: x <> ''), '|')) AS items_md5 FROM documents""")
def q_list_compact(spark, sf):
    """Empty strings removed from every document's single-space split."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("docid"), F.split("text", " ", -1).alias("a"))
    c = M.list_compact("a")
    return d.select("docid", F.size(c).cast("bigint").alias("n_items"), F.md5(F.array_join(c, "|")).alias("items_md5"))


@query("transpose_topics", C.sql_fix_ctes() + """,
phi AS (SELECT topic, term, tf AS prob, row_number() OVER (PARTITION BY topic ORDER BY tf DESC, term) AS rank FROM ctfidf),
cells AS (SELECT topic, rank, printf('%s*%.2f', term, floor(prob * 100 + 0.5) / 100) AS cell FROM phi WHERE rank <= 10)
SELECT topic, """ + ", ".join(f"max(CASE WHEN rank = {i} THEN cell END) AS w{i}" for i in range(1, 11)) + " FROM cells GROUP BY topic")
def q_transpose_topics(spark, sf):
    """One row per topic with its 10 most probable words as 'word*0.00' columns."""
    from topicspark.operators.topk import top_k
    phi = C.fix_ctfidf(spark, sf).select("topic", "term", F.col("tf").alias("prob"))
    top = top_k(phi, ["topic"], [F.desc("prob"), F.asc("term")], 10, salt_col="term")
    return M.transpose_topics(top)

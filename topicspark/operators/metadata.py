"""Corpus metadata and the relational steps the reference performs.

Joins to per-work metadata are plain equi-joins; AQE turns them into
broadcast joins when the metadata side turns out small at run time and keeps
a sort-merge join otherwise, so no side is broadcast on a guess.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedupe_by(df: DataFrame, key: str, order_cols) -> DataFrame:
    """One row per key, the first by ``order_cols`` (deterministic; replaces list order)."""
    w = Window.partitionBy(key).orderBy(*order_cols)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def meta_left_join(chunks: DataFrame, metadata: DataFrame, with_year: bool = False) -> DataFrame:
    """Add title, genre (and year) of the work by filename; NULL when missing."""
    cols = ["filename", "title", "genre"] + (["year"] if with_year else [])
    meta = dedupe_by(metadata.select(*cols), "filename", [F.asc_nulls_last(c) for c in cols[1:]])
    return chunks.join(meta, "filename", "left")


def meta_default(chunks: DataFrame) -> DataFrame:
    """R2: no metadata: title = label, genre = 'all'."""
    return chunks.withColumn("title", F.col("label")).withColumn("genre", F.lit("all"))


def author_lookup(works: DataFrame, metadata: DataFrame | None) -> DataFrame:
    """Author of each work from metadata (first match), else the title up to the first '_'."""
    fallback = F.split_part(F.col("title"), F.lit("_"), F.lit(1))
    if metadata is None:
        return works.withColumn("author", fallback)
    meta = (metadata.groupBy("filename").agg(F.min_by("author", F.struct("author")).alias("_meta_author")))
    return (works.join(meta, "filename", "left")
            .withColumn("author", F.coalesce(F.col("_meta_author"), fallback)).drop("_meta_author"))


def meta_inner_join(base: DataFrame, metadata: DataFrame) -> DataFrame:
    """R4 (LDA path): author/title from their Japanese columns, inner join on filename."""
    meta = metadata.select("filename", "genre", "year", F.col("author_ja").alias("author"), F.col("title_ja").alias("title"))
    return meta.join(base.select("filename", "label", "docid", "length"), "filename")


def count_distinct_with_null(col: str):
    """Distinct values, NULL counted as one value (as the reference's n_unique does)."""
    return (F.countDistinct(col) + F.max(F.when(F.col(col).isNull(), 1).otherwise(0))).cast("bigint")


def corpus_metrics(chunks: DataFrame, doc_topic: DataFrame | None = None) -> DataFrame:
    """Works, authors, genres, documents (and topics) in one row."""
    m = chunks.agg(count_distinct_with_null("title").alias("n_works"),
                   count_distinct_with_null("author").alias("n_authors"),
                   count_distinct_with_null("genre").alias("n_genres"),
                   F.count(F.lit(1)).alias("n_docs"))
    if doc_topic is not None:
        m = m.withColumn("n_topics", doc_topic.select(F.countDistinct("topic")).scalar())
    return m


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values of a column."""
    return df.select(col).distinct().orderBy(col)


def works_of_author(df: DataFrame, author: str) -> DataFrame:
    """Sorted works (titles) of one author (the filter reaches the scan)."""
    return df.where(F.col("author") == F.lit(author)).select("title").distinct().orderBy("title")


def work_doc_range(chunks: DataFrame) -> DataFrame:
    """First and last docid and chunk count per work."""
    return chunks.groupBy("title").agg(F.min("docid").alias("first_docid"), F.max("docid").alias("last_docid"),
                                       F.count(F.lit(1)).alias("n_chunks"))


def doc_lookup(chunks: DataFrame, requests: DataFrame, req_col: str = "requested") -> DataFrame:
    """Requested docid clamped into [0, n-1], then author and title of that chunk."""
    n = chunks.select(F.count(F.lit(1))).scalar()
    req = requests.withColumn("docid", F.least(F.greatest(F.lit(0), F.col(req_col)), n - 1).cast("bigint"))
    return req.join(chunks.select("docid", "author", "title"), "docid", "left")


def chunk_position(chunks: DataFrame) -> DataFrame:
    """R9: 'chunk i/total' of every chunk within its file, in docid order.

    Docids of a file are contiguous (C7), so i = docid - first docid of the file
    + 1; the per-file first docid and count come from a partially aggregated
    groupBy, so a file holding many chunks is never sorted in one task.
    """
    per_file = chunks.groupBy("filename").agg(F.min("docid").alias("_first"), F.count(F.lit(1)).alias("total"))
    out = chunks.join(per_file, "filename")
    return out.withColumn("position", (F.col("docid") - F.col("_first") + 1).cast("bigint")).drop("_first")


def hover_text(positions: DataFrame) -> DataFrame:
    """R10: 'author | title | chunk i/n' line followed by the chunk text."""
    return positions.withColumn("hover", F.concat(
        F.col("author"), F.lit(" | "), F.col("title"), F.lit(" | chunk "), F.col("position").cast("string"),
        F.lit("/"), F.col("total").cast("string"), F.lit("\n"), F.col("text")))


def length_box(chunks: DataFrame, by: str, value: str = "length") -> DataFrame:
    """Box-plot statistics of ``value`` per group: quartiles (linear interpolation),
    whiskers = extreme values inside 1.5 IQR fences, and the number of outliers.

    ``percentile`` keeps a value -> count map per group, merged map-side, so
    its state grows with the distinct lengths, not with the rows.
    """
    q = chunks.groupBy(by).agg(F.percentile(F.col(value), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"),
                               F.count(F.lit(1)).alias("n"))
    q = q.select(by, "n", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    q = q.withColumn("_lo", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn(
        "_hi", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    j = chunks.select(by, value).join(q.select(by, "_lo", "_hi"), by)
    inside = (F.col(value) >= F.col("_lo")) & (F.col(value) <= F.col("_hi"))
    w = j.groupBy(by).agg(F.min(F.when(inside, F.col(value))).alias("lower_whisker"),
                          F.max(F.when(inside, F.col(value))).alias("upper_whisker"),
                          F.sum(F.when(inside, 0).otherwise(1)).cast("bigint").alias("n_outliers"))
    return q.drop("_lo", "_hi").join(w, by)


def histogram_count(chunks: DataFrame, by: str) -> DataFrame:
    """Number of chunks per value."""
    return chunks.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def group_mean(points: DataFrame, group_col: str = "color_group") -> DataFrame:
    """Mean position of each colour group (label anchor)."""
    return points.groupBy(group_col).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def case_remap(doc_topic: DataFrame, keep_topics: DataFrame) -> DataFrame:
    """Topic kept if it is in the list, else -1 (list given as a table, joined)."""
    k = keep_topics.select("topic").distinct().withColumn("_keep", F.lit(True))
    return (doc_topic.join(k, "topic", "left")
            .withColumn("topic", F.when(F.col("_keep"), F.col("topic")).otherwise(F.lit(-1))).drop("_keep"))


def map_lookup(doc_topic: DataFrame, labels: DataFrame) -> DataFrame:
    """Label of the topic; -1 without a label -> 'Other'; other unknown topics -> 'Unknown'."""
    j = doc_topic.join(labels.select("topic", F.col("label").alias("_lab")), "topic", "left")
    return j.withColumn("label", F.coalesce(F.col("_lab"), F.when(F.col("topic") == -1, F.lit("Other")).otherwise(F.lit("Unknown")))).drop("_lab")


def drop_outliers(df: DataFrame, topic_col: str = "topic") -> DataFrame:
    """Rows of topic -1 removed."""
    return df.where(F.col(topic_col) != -1)


def list_compact(arr_col) -> "F.Column":
    """Empty strings removed from a list column."""
    c = F.col(arr_col) if isinstance(arr_col, str) else arr_col
    return F.filter(c, lambda x: x != F.lit(""))


def pivot_dense(sparse: DataFrame, docs: DataFrame, topics: DataFrame, unit: str = "docid") -> DataFrame:
    """Sparse (unit, topic, prob) -> dense (unit, topic, prob) with 0.0 for missing topics.

    No cross join: the sorted topic list (K values, a scalar subquery) is
    expanded inside each unit's row against that unit's own map of probabilities.
    """
    topic_list = topics.select(F.array_sort(F.collect_set("topic"))).scalar()
    per_unit = sparse.groupBy(unit).agg(F.map_from_entries(F.collect_list(F.struct("topic", "prob"))).alias("_m"))
    d = docs.select(unit).distinct().join(per_unit, unit, "left").withColumn("_tl", topic_list)
    dense = d.select(unit, F.explode(F.transform("_tl", lambda t: F.struct(
        t.alias("topic"), F.coalesce(F.col("_m")[t], F.lit(0.0)).cast("double").alias("prob")))).alias("_p"))
    return dense.select(unit, "_p.topic", "_p.prob")


def transpose_topics(words: DataFrame, n: int = 10) -> DataFrame:
    """One row per topic, word n in column w<n> as 'token*0.00'."""
    cell = F.format_string("%s*%.2f", F.col("term"), F.floor(F.col("prob") * 100 + 0.5) / 100)
    p = words.groupBy("topic").pivot("rank", list(range(1, n + 1))).agg(F.first(cell))
    return p.select("topic", *[F.col(str(i)).alias(f"w{i}") for i in range(1, n + 1)])

"""Class-based TF-IDF (G1) and top words per topic.

score(t, c) = tf(t, c) * ln(1 + A / f(t)), A = average number of words per
topic (whole part), f(t) = frequency of t over all topics; tf is divided by the
topic's word total unless ``normalize=False`` (Grootendorst 2022, and the
L1-normalized form of the library the reference calls).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicspark.operators.topk import top_k


def topic_term_counts(tokens: DataFrame, doc_topic: DataFrame, tokens_col: str = "tokens",
                      class_cols=("topic",)) -> DataFrame:
    """V1 by topic: (topic, term, n) from token arrays joined to hard assignments."""
    cls = list(class_cols)
    return (tokens.join(doc_topic, "docid")
            .select(*cls, F.posexplode_outer(tokens_col).alias("_pos", "term")).where(F.col("_pos").isNotNull())
            .groupBy(*cls, "term").agg(F.count(F.lit(1)).alias("n")))


def ctfidf(counts: DataFrame, n_topics, max_df: float | None = None, normalize: bool = True,
           integer_avg: bool = True) -> DataFrame:
    """G1: (topic, term, n, tf, idf, score) from (topic, term, n).

    ``n_topics`` is the number of topics (units of ``max_df``); a Column
    (scalar subquery) or an int.  One groupBy(term) gives both the topic
    frequency (for max_df) and the corpus frequency f; removing a term removes
    it from every topic, so f of the kept terms is unchanged by the filter.
    The topic totals are K rows, sent to every task, as a shuffle by topic would
    make K partitions; the corpus total is a window over them.
    """
    n_t = n_topics if not isinstance(n_topics, int) else F.lit(n_topics)
    terms = counts.groupBy("term").agg(F.count(F.lit(1)).alias("_df"), F.sum("n").alias("f"))
    if max_df is not None:
        terms = terms.where(F.col("_df") <= n_t * F.lit(float(max_df)))
    kept = counts.join(terms.select("term", "f"), "term")
    words = (kept.groupBy("topic").agg(F.sum("n").alias("words"))
             .withColumn("_total", F.sum("words").over(Window.partitionBy())))
    avg = F.col("_total") / n_t
    words = words.withColumn("_a", F.floor(avg) if integer_avg else avg).drop("_total")
    out = kept.join(F.broadcast(words), "topic")
    tf = (F.col("n") / F.col("words")) if normalize else F.col("n").cast("double")
    idf = F.log(F.lit(1.0) + F.col("_a") / F.col("f"))
    return out.select("topic", "term", "n", tf.alias("tf"), idf.alias("idf"), (tf * idf).alias("score"))


def top_words(scores: DataFrame, n: int = 10, group_cols=("topic",)) -> DataFrame:
    """Best n terms per topic by score, ties by term (rank 1..n)."""
    return top_k(scores, list(group_cols), [F.desc("score"), F.asc("term")], n, salt_col="term")

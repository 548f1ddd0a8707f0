"""Representative documents and per-topic samples.

Random draws are keyed by md5(seed:docid), so a draw depends only on the
seed and the document, never on partitioning or task order.  Weighted draws
without replacement take the smallest -ln(u)/w keys (Efraimidis & Spirakis
2006).  Per-group limits use the salted two-phase top-k, so a topic holding a
third of all documents is not ranked in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicspark.operators.topk import top_k

TWO48 = float(2 ** 48)


def uniform_key(seed, docid_col: str = "docid"):
    """u in (0, 1) from the first 12 hex digits of md5('<seed>:<docid>')."""
    h = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(docid_col).cast("string")))
    return (F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(TWO48)


def stratified_docs(docs: DataFrame, nr_docs: int = 5, stratify_by: str | None = "genre", seed: int = 0,
                    weight_col: str = "w") -> DataFrame:
    """``nr_docs`` representative documents per topic.

    ``docs`` is (docid, topic, <stratum column>, w) with w = probability of the
    document for its topic.  Quotas per stratum: nr // S, +1 for the first
    nr % S strata in order of first appearance (smallest docid).  Weighted
    draw without replacement per stratum; a stratum whose weights are all 0 is
    drawn uniformly; zero weights sort last.  Shortfalls are topped up by the
    highest weight (then highest docid) among the rest of the topic.  The
    chosen documents are sorted by docid and the first nr kept.
    Returns (topic, docid, rank).
    """
    s = docs.withColumn("_stratum", F.coalesce(F.col(stratify_by).cast("string"), F.lit("")) if stratify_by and stratify_by in docs.columns else F.lit(""))
    strata = s.groupBy("topic", "_stratum").agg(F.min("docid").alias("_first"),
                                                F.sum(F.col(weight_col)).alias("_wsum"))
    w_order = Window.partitionBy("topic").orderBy("_first", "_stratum")
    strata = (strata.withColumn("_r", F.row_number().over(w_order))
              .withColumn("_S", F.count(F.lit(1)).over(Window.partitionBy("topic"))))
    quota = (F.floor(F.lit(nr_docs) / F.col("_S")) + F.when(F.col("_r") <= F.lit(nr_docs) % F.col("_S"), 1).otherwise(0)).cast("int")
    strata = strata.select("topic", "_stratum", quota.alias("_quota"), (F.col("_wsum") <= 0).alias("_uniform"))
    j = s.join(strata, ["topic", "_stratum"])
    w = F.when(F.col("_uniform"), F.lit(1.0)).otherwise(F.col(weight_col).cast("double"))
    key = F.when(w > 0, -F.log(uniform_key(seed)) / w)
    j = j.withColumn("_key", key)
    drawn = top_k(j, ["topic", "_stratum"], [F.asc_nulls_last("_key"), F.asc("docid")], nr_docs, salt_col="docid",
                  rank_col="_dr")
    chosen = drawn.where(F.col("_dr") <= F.col("_quota")).select("topic", "docid")
    n_chosen = chosen.groupBy("topic").agg(F.count(F.lit(1)).alias("_c"))
    rest = s.join(chosen, ["topic", "docid"], "left_anti").join(n_chosen, "topic", "left").withColumn(
        "_need", F.lit(nr_docs) - F.coalesce(F.col("_c"), F.lit(0)))
    rest = rest.where(F.col("_need") > 0)
    topup = top_k(rest, ["topic"], [F.desc(weight_col), F.desc("docid")], nr_docs, salt_col="docid", rank_col="_tr")
    topup = topup.where(F.col("_tr") <= F.col("_need")).select("topic", "docid")
    allc = chosen.unionByName(topup)
    return top_k(allc, ["topic"], [F.asc("docid")], nr_docs, rank_col="rank")


def representative_for_topic(docs: DataFrame, topic: int, nr_docs: int = 5, stratify_by: str | None = "genre",
                             seed: int = 0) -> DataFrame:
    """X1 for one topic (the topic filter is applied before any work), with the
    display order by weight desc; ids are carried, never matched back by text."""
    one = docs.where(F.col("topic") == F.lit(topic))
    picked = stratified_docs(one, nr_docs, stratify_by, seed)
    out = picked.join(one.select("docid", "w"), "docid")
    return out.select("topic", "docid", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("w"), F.asc("docid"))).alias("display_rank"))


def sample_per_topic(doc_topic: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Per topic a sample of max(1, floor(n * fraction)) documents without replacement.

    ``fraction`` is clipped to [0, 1].  The order is the md5 key, so the sample
    is a fixed-size uniform draw (not a Bernoulli one).  A topic's documents
    are ranked inside 4,096 bins of the key and the bins' counts are summed, so
    a topic of any size is spread over as many tasks as its bins.
    """
    f = min(max(float(fraction), 0.0), 1.0)
    j = doc_topic.withColumn("_u", uniform_key(seed)).withColumn("_bin", F.floor(F.col("_u") * 4096).cast("int"))
    bins = j.groupBy("topic", "_bin").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy("topic")
    before = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_k", F.greatest(F.lit(1), F.floor(F.sum("_c").over(whole) * F.lit(f))).cast("bigint"))
    bins = bins.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).where(F.col("_before") < F.col("_k"))
    j = j.join(bins.select("topic", "_bin", "_k", "_before"), ["topic", "_bin"])
    r = F.row_number().over(Window.partitionBy("topic", "_bin").orderBy("_u", "docid"))
    return j.withColumn("_r", r).where(F.col("_before") + F.col("_r") <= F.col("_k")).select(*doc_topic.columns)

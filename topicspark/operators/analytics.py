"""Analytics on a fitted topic model.

Inputs are long tables (doc_topic, doc probabilities, c-TF-IDF scores,
vectors); every step is a join or an aggregation keyed by document, topic or
term, so each one is partitioned by the data, not collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicspark.operators.topk import top_k
from topicspark.session import materialize

PAIRS = 400_000  # terms x topics of the most frequent terms that every task gets, about 10 MB


def topics_per_class(class_counts: DataFrame, doc_topic: DataFrame, classes: DataFrame, scores: DataFrame,
                     class_col: str = "class", n_words: int = 5) -> DataFrame:
    """A1: per (class, topic): frequency (documents), share of the class, top words.

    ``class_counts`` is (class, topic, term, n): a frequent term meets its idf once per (class, topic), not once per token.
    score(class, topic, term) = tf * ln(1 + A / f(term)) with A, f of the global
    c-TF-IDF (its kept vocabulary); tf = count / words of the (class, topic).
    """
    idf = scores.groupBy("term").agg(F.first("idf").alias("_idf"))
    dc = doc_topic.join(classes, "docid")
    freq = dc.groupBy(class_col, "topic").agg(F.count(F.lit(1)).alias("frequency"))
    per_class = dc.groupBy(class_col).agg(F.count(F.lit(1)).alias("_ndocs"))
    counts = class_counts.join(idf, "term")
    tot = counts.groupBy(class_col, "topic").agg(F.sum("n").alias("_w"))
    sc = counts.join(tot, [class_col, "topic"]).select(class_col, "topic", "term",
                                                        (F.col("n") / F.col("_w") * F.col("_idf")).alias("score"))
    top = top_k(sc, [class_col, "topic"], [F.desc("score"), F.asc("term")], n_words, salt_col="term")
    words = top.groupBy(class_col, "topic").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("words"))
    out = freq.join(per_class, class_col).join(words, [class_col, "topic"], "left")
    return out.select(class_col, "topic", "frequency", (F.col("frequency") / F.col("_ndocs")).alias("share"), "words")


def find_topics(sims: DataFrame, unit_cols, k: int = 5) -> DataFrame:
    """A5: best k topics of each query by similarity (ties by topic)."""
    units = [unit_cols] if isinstance(unit_cols, str) else list(unit_cols)
    e = sims.select(*units, F.explode("sims").alias("s")).select(*units, "s.topic", F.col("s.sim").alias("similarity"))
    e = e.where(F.col("similarity").isNotNull())
    return top_k(e, units, [F.desc("similarity"), F.asc("topic")], k)


def doc_topic_profile(probs: DataFrame, min_probability: float = 0.0) -> DataFrame:
    """Each document's topics ordered by probability (ties by topic), at least ``min_probability``."""
    p = probs.where(F.col("prob") >= F.lit(min_probability))
    w = Window.partitionBy("docid").orderBy(F.desc("prob"), F.asc("topic"))
    return p.withColumn("rank", F.row_number().over(w))


def author_topic_mean(probs: DataFrame, authors: DataFrame, topics: DataFrame) -> DataFrame:
    """Mean topic probability per author over all their documents, a topic a document lacks counting 0.

    The sum over the sparse rows (docid, topic, prob) by the number of documents
    in ``authors`` (docid, author); nothing is made dense but the result.
    """
    sums = probs.join(authors, "docid").groupBy("author", "topic").agg(F.sum("prob").alias("_s"))
    every = topics.select(F.sort_array(F.collect_set("topic"))).scalar()  # K values
    docs = authors.groupBy("author").agg(F.count(F.lit(1)).alias("_n")).withColumn("_t", every).select("author", "_n", F.explode("_t").alias("topic"))
    return docs.join(sums, ["author", "topic"], "left").select("author", "topic", (F.coalesce("_s", F.lit(0.0)) / F.col("_n")).alias("mean_prob"))


def topic_term_phi(counts: DataFrame) -> DataFrame:
    """phi(topic, term) = n(topic, term) / words of the topic."""
    w = counts.groupBy("topic").agg(F.sum("n").alias("_w"))
    return counts.join(w, "topic").select("topic", "term", (F.col("n") / F.col("_w")).alias("phi"))


def ldavis_relevance(phi: DataFrame, prevalence: DataFrame, lam: float = 0.6, n: int = 10) -> DataFrame:
    """Term relevance per topic, lambda * ln(phi) + (1 - lambda) * ln(phi / p(term)),
    with p(term) = sum over topics of phi * prevalence (Sievert & Shirley 2014); top n."""
    p = phi.join(prevalence, "topic").groupBy("term").agg(F.sum(F.col("phi") * F.col("prevalence")).alias("_p"))
    r = phi.join(p, "term").select("topic", "term", (F.lit(lam) * F.log("phi") + F.lit(1 - lam) * F.log(F.col("phi") / F.col("_p"))).alias("relevance"))
    # rank on the value rounded to 1e-9: terms with equal counts tie exactly,
    # whatever order the sums of p(term) were added in
    r = r.withColumn("_rr", F.floor(F.col("relevance") * F.lit(1e9) + F.lit(0.5)))
    return top_k(r, ["topic"], [F.desc("_rr"), F.asc("term")], n, salt_col="term").drop("_rr")


def ldavis_saliency(phi: DataFrame, prevalence: DataFrame) -> DataFrame:
    """saliency(term) = p(term) * sum_t P(t|term) ln(P(t|term) / P(t))."""
    j = phi.join(prevalence, "topic")
    p = j.groupBy("term").agg(F.sum(F.col("phi") * F.col("prevalence")).alias("_p"))
    j = j.join(p, "term").withColumn("_pt", F.col("phi") * F.col("prevalence") / F.col("_p"))
    kl = j.groupBy("term", "_p").agg(F.sum(F.when(F.col("_pt") > 0, F.col("_pt") * F.log(F.col("_pt") / F.col("prevalence"))).otherwise(0.0)).alias("_d"))
    return kl.select("term", (F.col("_p") * F.col("_d")).alias("saliency"))


def token_topics(docs: DataFrame, phi: DataFrame, doc_topics: DataFrame | None, tokens: Column, pairs: int = PAIRS) -> DataFrame:
    """(docid, pos, term, best_topic): best topic (by phi, ties by topic) of every token; with ``doc_topics``
    (docid, topic) only topics inferred for that document count (assigned_only); tokens
    without a candidate keep a NULL topic.

    ``tokens`` is the array of tokens by the columns of ``docs``.  A document's
    text moves once, to its topics, and is split after that.  A token meets one
    array of its term's topics, best first: those of the most frequent terms
    (at most ``pairs`` topics in all) are sent to every task, and only tokens
    of other terms, in documents with topics, are dealt by term.
    """
    by = phi.groupBy("term").agg(F.sort_array(F.collect_list(F.struct((-F.col("phi")).alias("o"), "topic"))).alias("_t"), F.sum("phi").alias("_all"))
    ranked = materialize(by.select("term", F.transform("_t", lambda x: x["topic"]).alias("_topics"), "_all"), "ranked-topics")
    longest = ranked.agg(F.max(F.size("_topics"))).first()[0] or 1
    often = materialize(ranked.orderBy(F.desc("_all"), "term").limit(max(1, pairs // longest)).select("term", "_topics"), "frequent-topics")
    if doc_topics is None:
        given = docs.withColumn("_own", F.lit(None).cast(phi.select(F.array("topic")).schema[0].dataType))
        asked, best = F.lit(True), F.get("_topics", F.lit(0))
    else:
        given = docs.join(doc_topics.groupBy("docid").agg(F.collect_set("topic").alias("_own")), "docid", "left")
        asked, best = F.col("_own").isNotNull(), F.get(F.filter("_topics", lambda t: F.array_contains("_own", t)), F.lit(0))
    every = given.select("docid", "_own", F.posexplode_outer(tokens).alias("pos", "term")).where(F.col("pos").isNotNull())
    out = ["docid", "pos", "term", best.alias("best_topic")]
    met = every.join(F.broadcast(often), "term", "left").where(F.col("_topics").isNotNull() | ~asked).select(*out)
    known = F.broadcast(often.select("term"))
    others = every.where(asked).join(known, "term", "left_anti").join(ranked.join(known, "term", "left_anti").drop("_all"), "term", "left")
    return met.unionAll(others.select(*out))


def window_topic_similarity(tokens: DataFrame, scores: DataFrame, unit_cols, size: int = 4, stride: int = 1,
                            min_similarity: float = 0.001) -> DataFrame:
    """I1/I2 core: cosine of each token window (idf-weighted counts) to each topic's c-TF-IDF row.

    Returns (unit..., win, topic, sim) with sim >= min_similarity.  Each token is
    expanded to the (at most ``size``) windows that contain it, then counted per
    window; unknown terms are ignored.
    """
    units = [unit_cols] if isinstance(unit_cols, str) else list(unit_cols)
    idf = scores.groupBy("term").agg(F.first("idf").alias("_idf"))
    tnorm = scores.groupBy("topic").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("_tn"))
    t = tokens.select(*units, "tokens", F.size("tokens").alias("_m"))
    pos = t.select(*units, "_m", F.posexplode_outer("tokens").alias("pos", "term"))  # no position has no window
    last = F.greatest(F.col("_m") - size, F.lit(0))
    lo = F.greatest(F.lit(0), F.col("pos") - size + 1)
    hi = F.least(F.col("pos"), last)
    w = pos.where(lo <= hi).select(*units, "term", F.explode(F.sequence(lo, hi)).alias("win"))
    if stride > 1:
        w = w.where(F.col("win") % stride == 0)
    wc = w.join(idf, "term").groupBy(*units, "win", "term", "_idf").agg(F.count(F.lit(1)).alias("n"))
    wc = wc.withColumn("wt", F.col("n") * F.col("_idf"))
    wn = wc.groupBy(*units, "win").agg(F.sqrt(F.sum(F.col("wt") * F.col("wt"))).alias("_wn"))
    dots = wc.join(scores.select("topic", "term", "score"), "term").groupBy(*units, "win", "topic").agg(
        F.sum(F.col("wt") * F.col("score")).alias("_dot"))
    sims = dots.join(wn, units + ["win"]).join(tnorm, "topic").select(
        *units, "win", "topic", (F.col("_dot") / (F.col("_wn") * F.col("_tn"))).alias("sim"))
    return sims.where(F.col("sim") >= F.lit(min_similarity))


def approx_distribution(win_sims: DataFrame, unit_cols) -> DataFrame:
    """Topic share of each text = sum of window similarities, divided by the text's total."""
    units = [unit_cols] if isinstance(unit_cols, str) else list(unit_cols)
    s = win_sims.groupBy(*units, "topic").agg(F.sum("sim").alias("_s"))
    tot = s.groupBy(*units).agg(F.sum("_s").alias("_t"))
    return s.join(tot, units).select(*units, "topic", (F.col("_s") / F.col("_t")).alias("share"))


def token_distribution(win_sims: DataFrame, tokens: DataFrame, unit_cols, size: int = 4) -> DataFrame:
    """Per token position and topic, the sum of similarities of the windows covering it."""
    units = [unit_cols] if isinstance(unit_cols, str) else list(unit_cols)
    m = tokens.select(*units, F.size("tokens").alias("_m"))
    w = win_sims.join(m, units)
    cover = w.select(*units, "topic", "sim", F.explode(F.sequence(F.col("win"), F.least(F.col("win") + size, F.col("_m")) - 1)).alias("pos"))
    return cover.groupBy(*units, "pos", "topic").agg(F.sum("sim").alias("value"))

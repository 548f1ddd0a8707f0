"""Topic labels (G6-G12) and the labeler plug-in point.

All tables here are topic-sized (one row per topic or per topic and word);
they are produced from the large tables by aggregation, never collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.functions.text import strip_topic_prefix

# Fixed value: the label-suggestion prompt template ({language} is filled in).
DEFAULT_PROMPT = """I have a topic that contains the following representative documents:

[DOCUMENTS]

The topic is described by the following keywords: [KEYWORDS]

Based the keywords and the documents that show their context, return a short label of the topic in {language} in less than 30 characters and nothing else.
The documents are only a sample for reference and may come from different works.
Greater weight should be put on explaining the keywords with common themes."""


def default_prompt(language: str) -> str:
    return DEFAULT_PROMPT.replace("{language}", language)


def _ordered_words(top_words: DataFrame, n: int, group_cols=("topic",)) -> DataFrame:
    g = list(group_cols)
    return (top_words.where(F.col("rank") <= n).groupBy(*g)
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("words")))


def generate_labels(top_words: DataFrame, nr_words: int = 3, topics: DataFrame | None = None) -> DataFrame:
    """G8: '{topic}: w1_w2_w3' (trailing '_' removed); a topic without words gets its id.

    ``top_words`` is (topic, rank, term); ``topics`` lists all topics (default:
    those in top_words).  Returns (topic, label).
    """
    words = _ordered_words(top_words, nr_words)
    base = topics.select("topic").distinct() if topics is not None else top_words.select("topic").distinct()
    j = base.join(words, "topic", "left")
    body = F.when(F.size(F.coalesce("words", F.array())) > 0,
                  F.regexp_replace(F.array_join("words", "_"), "_+$", "")).otherwise(F.col("topic").cast("string"))
    return j.select("topic", F.concat(F.col("topic").cast("string"), F.lit(": "), body).alias("label"))


def topic_names(top_words: DataFrame) -> DataFrame:
    """Default topic name: '{topic}_' + first four words joined by '_'."""
    words = _ordered_words(top_words, 4)
    return words.select("topic", F.concat(F.col("topic").cast("string"), F.lit("_"), F.array_join("words", "_")).alias("name"))


def label_fallback(suggestions: DataFrame, top_words: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """Labeler suggestion (topic, suggestion) or, when missing/empty, the 3-word label."""
    base = generate_labels(top_words, 3, topics)
    s = suggestions.select("topic", F.regexp_replace(F.col("suggestion"), "_+$", "").alias("_s"))
    j = base.join(s, "topic", "left")
    return j.select("topic", F.coalesce(
        F.when(F.coalesce(F.col("_s"), F.lit("")) != "", F.concat(F.col("topic").cast("string"), F.lit(": "), F.col("_s"))),
        F.col("label")).alias("label"))


def custom_label_overlay(labels: DataFrame, custom: DataFrame) -> DataFrame:
    """Attach custom labels (topic, custom_label, version); the latest version wins.

    An edit is one more row with a higher version; a reset is a row with a
    NULL label.  Returns (topic, label, custom_label).
    """
    latest = custom.groupBy("topic").agg(F.max_by("custom_label", "version").alias("custom_label"))
    return labels.join(latest, "topic", "left")


def topic_label_map(info: DataFrame) -> DataFrame:
    """Display label: CustomName, else Name, else ''; prefix stripped; empty -> topic id."""
    raw = F.coalesce(F.nullif(F.col("custom_name"), F.lit("")), F.nullif(F.col("name"), F.lit("")), F.lit(""))
    clean = strip_topic_prefix(raw, "topic")
    return info.select("topic", F.when(clean == "", F.col("topic").cast("string")).otherwise(clean).alias("display_label"))


def aspect_fill(aspects: DataFrame, main_top: DataFrame, topics: DataFrame, aspect_names) -> DataFrame:
    """Every (aspect, topic) without words gets the topic's best main word with score 1.0.

    ``aspects`` is (aspect, topic, rank, term, score); ``main_top`` the main
    top words (topic, rank, term, score).  A topic without any word stays empty.
    """
    have = aspects.select("aspect", "topic").distinct()
    seeds = main_top.where(F.col("rank") == 1).select("topic", "term")
    # (aspect, topic) pairs = aspects declared x topics: aspects are a handful of names,
    # so this is an explode of a literal array per topic, not a join of two tables
    pairs = topics.select("topic").distinct().select(
        F.explode(F.array(*[F.lit(a) for a in aspect_names])).alias("aspect"), "topic")
    missing = pairs.join(have, ["aspect", "topic"], "left_anti")
    fill = missing.join(seeds, "topic").select("aspect", "topic", F.lit(1).alias("rank"), "term",
                                              F.lit(1.0).alias("score"))
    return aspects.select("aspect", "topic", "rank", "term", "score").unionByName(fill)


def llm_prompt_table(rep_docs: DataFrame, top_words: DataFrame, language: str = "English",
                     prompt: str | None = None, nr_docs: int = 8, doc_length: int = 100, n_keywords: int = 10) -> DataFrame:
    """The labeler prompt of every topic.

    ``rep_docs`` is (topic, docid, tokens) of representative documents (X1);
    the first ``nr_docs`` by docid are used, each cut to ``doc_length`` tokens.
    [DOCUMENTS] becomes one '- doc' line per document, [KEYWORDS] the top
    words joined by ', '.  Returns (topic, prompt).
    """
    template = prompt or default_prompt(language)
    docs = (rep_docs.groupBy("topic")
            .agg(F.slice(F.array_sort(F.collect_list(F.struct("docid", F.array_join(F.slice("tokens", 1, doc_length), " ").alias("d")))),
                         1, nr_docs).alias("_docs")))
    docs = docs.select("topic", F.array_join(F.transform("_docs", lambda s: F.concat(F.lit("- "), s["d"], F.lit("\n"))), "").alias("_doctext"))
    kw = _ordered_words(top_words, n_keywords).select("topic", F.array_join("words", ", ").alias("_kw"))
    j = kw.join(docs, "topic", "left")
    filled = F.replace(F.replace(F.lit(template), F.lit("[DOCUMENTS]"), F.coalesce(F.col("_doctext"), F.lit(""))),
                       F.lit("[KEYWORDS]"), F.col("_kw"))
    return j.select("topic", filled.alias("prompt"))


_LABELERS: dict[str, Callable] = {}


def register_labeler(name: str, fn: Callable) -> None:
    """A labeler maps the prompt table (topic, prompt) to (topic, suggestion).

    A model-backed labeler should be an Iterator pandas_udf over the prompt
    column; failures must return '' so that G9's fallback applies.
    """
    _LABELERS[name] = fn


def labeler(name: str) -> Callable:
    if name not in _LABELERS:
        raise ValueError(f"no labeler {name!r}; registered: {', '.join(sorted(_LABELERS))}")
    return _LABELERS[name]


def longest_keyword(prompts: DataFrame, least: int = 8) -> DataFrame:
    """A labeler by rule: the longest keyword of a prompt (ties: the first), or '' where none has ``least`` letters."""
    words = F.split(F.regexp_extract("prompt", r"described by the following keywords: ([^\n]*)", 1), ", ")
    best = F.aggregate(words, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    return prompts.select("topic", F.when(F.length(best) >= least, best).otherwise("").alias("suggestion"))


register_labeler("longest_keyword", longest_keyword)


def topic_info(doc_topic: DataFrame, top_words: DataFrame, custom: DataFrame | None = None,
               aspects: DataFrame | None = None, nr_words: int = 3) -> DataFrame:
    """Topic, count, name, custom_name and (optionally) one word list per aspect."""
    sizes = doc_topic.groupBy("topic").agg(F.count(F.lit(1)).alias("count"))
    names = topic_names(top_words)
    info = sizes.join(names, "topic", "left")
    if custom is not None:
        info = info.join(custom.select("topic", F.col("custom_label").alias("custom_name")), "topic", "left")
    else:
        info = info.withColumn("custom_name", F.lit(None).cast("string"))
    if aspects is not None:
        reps = _ordered_words(aspects, 10, ("aspect", "topic"))
        per = reps.groupBy("topic").agg(F.map_from_entries(F.collect_list(F.struct("aspect", "words"))).alias("representation"))
        info = info.join(per, "topic", "left")
    return info

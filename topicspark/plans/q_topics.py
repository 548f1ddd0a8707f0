"""Registered queries: topic representations, labels, sampling (G, X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicspark.plans import common as C
from topicspark.plans.catalog import query, reused
from topicspark.plans.fixtures import r6, sql_r6


@query("ctfidf", C.sql_fix_ctes() + f"""
SELECT topic, term, n, {sql_r6('tf')} AS tf, {sql_r6('score')} AS score FROM ctfidf""")
def q_ctfidf(spark, sf):
    """G1: c-TF-IDF of every (topic, term) of the given topic model, topic-level max_df 0.9."""
    s = C.fix_ctfidf(spark, sf)
    return s.select("topic", "term", "n", r6(F.col("tf")).alias("tf"), r6(F.col("score")).alias("score"))


@query("topic_top_words", C.sql_fix_ctes(C.SQL_TOPWORDS) + f"""
SELECT topic, CAST(rank AS INTEGER) AS rank, term, {sql_r6('score')} AS score FROM topw""")
def q_topic_top_words(spark, sf):
    """The 10 most distinctive words of each topic (the flagship query)."""
    t = C.fix_top_words(spark, sf)
    return t.select("topic", "rank", "term", r6(F.col("score")).alias("score"))


# --- representations, labels, label files ----------------------------------------------

import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402

from topicspark.fitted import fit_topics, preset  # noqa: E402
from topicspark.functions import tagging as TG  # noqa: E402
from topicspark.operators import ctfidf as G  # noqa: E402
from topicspark.operators import encode as E  # noqa: E402
from topicspark.operators import labels as L  # noqa: E402
from topicspark.operators import model as K  # noqa: E402
from topicspark.operators import sample as X  # noqa: E402
from topicspark.operators.topk import top_k  # noqa: E402
from topicspark.plans import fixtures as fx  # noqa: E402
from topicspark.plans import q_model as QM  # noqa: E402
from topicspark.session import materialize, scratch_path  # noqa: E402
from topicspark.sources import files as S  # noqa: E402


def _x1(spark, sf, nr=QM.NR_DOCS):
    return X.stratified_docs(QM.doc_weights(spark, sf), nr, "genre", QM.SEED)


def keybert_scores(spark, sf, candidates: int | None = None):
    """(topic, term, score, weight, dim, sign): cosine of the word's E1 vector to the mean E1 vector of the
    topic's representative documents, and the word's c-TF-IDF weight.

    All words of a topic are candidates, or its best ``candidates`` by weight.
    A word has one signed dimension, so a topic's words share 2 x 64 scores; words of equal score go by weight.
    """
    cand = C.fix_ctfidf(spark, sf) if candidates is None else G.top_words(C.fix_ctfidf(spark, sf), candidates)
    rep = materialize(_x1(spark, sf).select("docid", "topic"), "representatives")
    # only the representatives are encoded, with the term statistics of all documents
    vectors = E.hash_rows(QM.corpus_counts(spark, sf).join(rep.select("docid").distinct(), "docid", "left_semi"), QM.corpus_idf(spark, sf))
    tv = K.row_centroids(vectors, rep)
    norms = tv.groupBy("topic").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_norm"))
    dim, sign = E.term_dim("term")
    c = cand.select("topic", "term", F.col("score").alias("weight"), dim.alias("dim"), sign.alias("sign"))
    # at most 64 rows a topic go to every task: a shuffle of all words by topic would end in a task a topic
    j = c.join(F.broadcast(tv), ["topic", "dim"], "left").join(F.broadcast(norms), "topic", "left")
    sim = F.try_divide(F.col("sign") * F.coalesce(F.col("value"), F.lit(0.0)), F.col("_norm"))
    return j.select("topic", "term", F.coalesce(sim, F.lit(0.0)).alias("score"), "weight", "dim", "sign")


def keybert_words(kb, n: int = 10):
    """The n best words of each topic by (score, weight, term)."""
    return top_k(kb, ["topic"], [F.desc(F.floor(F.col("score") * 1e9 + 0.5)), F.desc("weight"), F.asc("term")], n, salt_col="term")


SQL_KEYBERT = f"""repd AS (SELECT docid, topic FROM x1),
rsize AS (SELECT topic, count(*) AS m FROM repd WHERE docid IN (SELECT docid FROM e1) GROUP BY topic),
tvec AS (SELECT topic, dim, sum(value) / any_value(m) AS value FROM e1 JOIN repd USING (docid) JOIN rsize USING (topic) GROUP BY topic, dim),
tnorm AS (SELECT topic, sqrt(sum(value * value)) AS norm FROM tvec GROUP BY topic),
kw AS (SELECT topic, term, score AS weight, {QM.SQL_TERMDIM} AS dim, {QM.SQL_TERMSIGN} AS sign FROM ctfidf),
kb AS (SELECT c.*, coalesce(CASE WHEN n.norm > 0 THEN c.sign * coalesce(v.value, 0.0) / n.norm END, 0.0) AS score
       FROM kw c LEFT JOIN tvec v ON v.topic = c.topic AND v.dim = c.dim LEFT JOIN tnorm n ON n.topic = c.topic),
kbr AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY floor(score * 1e9 + 0.5) DESC, weight DESC, term) AS rank FROM kb)"""

SQL_KB_CTES = QM.sql_model_ctes(QM.sql_x1(), C.SQL_TOKS, C.SQL_CTFIDF, QM.SQL_E1, SQL_KEYBERT)


@query("rep_keybert", SQL_KB_CTES + f"""
SELECT topic, CAST(rank AS INTEGER) AS rank, term, {sql_r6('score')} AS score FROM kbr WHERE rank <= 10""")
def q_rep_keybert(spark, sf):
    """All words of each topic ranked by similarity to its representative documents; the 10 best."""
    top = keybert_words(keybert_scores(spark, sf), 10)
    return top.select("topic", "rank", "term", r6(F.col("score")).alias("score"))


def mmr_select(scores, n: int = 10, diversity: float = 0.5):
    """Greedy maximal marginal relevance per topic over its candidates (topic, term, score, weight, dim, sign).

    Word-word similarity is the cosine of the words' E1 vectors (one signed
    dimension each).  Words of one dimension and sign have one relevance and
    one redundancy, so the best ``n`` of them by (weight, term) are all that can
    be chosen: a topic's selection sees at most n x 128 rows, whatever its words.
    """
    best = top_k(scores, ["topic", "dim", "sign"], [F.desc("weight"), F.asc("term")], n, salt_col="term").drop("rank")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "term"], ascending=[False, True])
        rel, dim, sign = pdf["score"].to_numpy(float), pdf["dim"].to_numpy(), pdf["sign"].to_numpy(float)
        free, redundancy, rows = np.ones(len(pdf), bool), np.full(len(pdf), -np.inf), []
        while free.any() and len(rows) < n:
            value = (1 - diversity) * rel - diversity * redundancy if rows else rel
            at = int(np.where(free, np.floor(value * 1e9 + 0.5), -np.inf).argmax())
            rows.append((int(pdf["topic"].iloc[at]), len(rows) + 1, pdf["term"].iloc[at], float(value[at])))
            free[at] = False
            redundancy = np.maximum(redundancy, np.where(dim == dim[at], sign * sign[at], 0.0))
        return pd.DataFrame(rows, columns=["topic", "rank", "term", "score"])

    return best.groupBy("topic").applyInPandas(pick, "topic int, rank int, term string, score double")


def sql_mmr(n=10, diversity=0.5):
    """CTE mmr (topic, rank, term, score): one word after the other."""
    out = []
    for s in range(n):
        value = "b.score" if s == 0 else f"{1 - diversity} * b.score - {diversity} * r.red"
        red = "" if s == 0 else f"""JOIN (SELECT b.topic, b.term, max(CASE WHEN b.dim = p.dim THEN b.sign * p.sign ELSE 0 END) AS red
    FROM mb b JOIN pick{s - 1} p ON p.topic = b.topic GROUP BY 1, 2) r ON r.topic = b.topic AND r.term = b.term
  WHERE NOT EXISTS (SELECT 1 FROM pick{s - 1} p WHERE p.topic = b.topic AND p.term = b.term)"""
        before = "" if s == 0 else f"SELECT * FROM pick{s - 1} UNION ALL "
        out.append(f"""pick{s} AS MATERIALIZED ({before}SELECT topic, term, dim, sign, {s + 1} AS rank, v AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY floor(v * 1e9 + 0.5) DESC, weight DESC, term) AS o
  FROM (SELECT b.topic, b.term, b.dim, b.sign, b.weight, {value} AS v FROM mb b {red})) WHERE o = 1)""")
    return ["mb AS MATERIALIZED (SELECT * FROM kb)", *out, f"mmr AS (SELECT topic, rank, term, score FROM pick{n - 1})"]


@query("rep_mmr", SQL_KB_CTES + ",\n" + ",\n".join(sql_mmr()) + f"""
SELECT topic, CAST(rank AS INTEGER) AS rank, term, {sql_r6('score')} AS score FROM mmr""")
def q_rep_mmr(spark, sf):
    """10 diverse keywords per topic by maximal marginal relevance (diversity 0.5) over all its words."""
    m = mmr_select(keybert_scores(spark, sf), 10, 0.5)
    return m.select("topic", "rank", "term", r6(F.col("score")).alias("score"))


def pos_scores(spark, sf):
    """C-TF-IDF words of a topic restricted to lemmas tagged as proper nouns in its documents."""
    d = fx.corpus(spark, sf).select("docid", TG.default_tagger("text").alias("tg"))
    names = F.array_distinct(F.transform(F.filter("tg", lambda t: t["pos2"] == "固有名詞"), lambda t: t["lemma"]))
    # outer, so that texts aren't tagged again for a condition
    pn = (d.select("docid", F.explode_outer(names).alias("term")).where(F.col("term").isNotNull()).join(fx.doc_topic(spark, sf), "docid")
          .select("topic", "term").distinct())
    return C.fix_ctfidf(spark, sf).join(pn, ["topic", "term"], "left_semi")


SQL_POS = """pn AS (SELECT DISTINCT dt.topic, t.lemma AS term FROM (
    SELECT docid, unnest(""" + TG.sql_tagger("text") + """) AS t FROM corpus) x JOIN doc_topic dt USING (docid)
  WHERE t.pos2 = '固有名詞'),
posw AS (SELECT c.* FROM ctfidf c JOIN pn USING (topic, term))"""


@query("rep_pos", C.sql_fix_ctes(SQL_POS) + f"""
SELECT topic, CAST(rank AS INTEGER) AS rank, term, {sql_r6('score')} AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS rank FROM posw) WHERE rank <= 10""")
def q_rep_pos(spark, sf):
    """Keywords restricted by part of speech (proper nouns) per topic."""
    top = G.top_words(pos_scores(spark, sf), 10)
    return top.select("topic", "rank", "term", r6(F.col("score")).alias("score"))


@reused("aspects")
def aspects_table(spark, sf):
    """(aspect, topic, rank, term, score): at most 10 words of each aspect of each topic, written once per query."""
    main = C.fix_top_words(spark, sf).select(F.lit("Main").alias("aspect"), "topic", "rank", "term", "score")
    kb = keybert_words(keybert_scores(spark, sf), 10).select(F.lit("KeyBERT").alias("aspect"), "topic", "rank", "term", "score")
    pos = G.top_words(pos_scores(spark, sf), 10).select(F.lit("POS").alias("aspect"), "topic", "rank", "term", "score")
    return main.unionByName(kb).unionByName(pos)


SQL_ASPECTS = """asp AS (
  SELECT 'Main' AS aspect, topic, rank, term, score FROM topw
  UNION ALL SELECT 'KeyBERT', topic, rank, term, score FROM kbr WHERE rank <= 10
  UNION ALL SELECT 'POS', topic, rank, term, score FROM (
    SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS rank FROM posw) WHERE rank <= 10),
pairs AS (SELECT a.aspect, t.topic FROM (VALUES ('Main'), ('KeyBERT'), ('POS')) a(aspect), (SELECT DISTINCT topic FROM doc_topic) t),
filled AS (
  SELECT * FROM asp
  UNION ALL
  SELECT p.aspect, p.topic, 1, tw.term, 1.0 FROM pairs p JOIN topw tw ON tw.topic = p.topic AND tw.rank = 1
  WHERE NOT EXISTS (SELECT 1 FROM asp WHERE asp.aspect = p.aspect AND asp.topic = p.topic))"""

SQL_ASPECT_CTES = SQL_KB_CTES + ",\n" + C.SQL_TOPWORDS + ",\n" + SQL_POS + ",\n" + SQL_ASPECTS


@query("aspect_fill", SQL_ASPECT_CTES + f"""
SELECT aspect, topic, CAST(rank AS INTEGER) AS rank, term, {sql_r6('score')} AS score FROM filled""")
def q_aspect_fill(spark, sf):
    """Every (aspect, topic) has words: an empty one is seeded with the topic's best word (score 1)."""
    asp = aspects_table(spark, sf)
    f = L.aspect_fill(asp, C.fix_top_words(spark, sf), fx.doc_topic(spark, sf), ["Main", "KeyBERT", "POS"])
    return f.select("aspect", "topic", F.col("rank").cast("int"), "term", r6(F.col("score")).alias("score"))


@query("struct_flatten", SQL_ASPECT_CTES + """
SELECT topic, string_agg(CASE WHEN aspect = 'KeyBERT' THEN term END, ',' ORDER BY rank) AS keybert,
       string_agg(CASE WHEN aspect = 'Main' THEN term END, ',' ORDER BY rank) AS main,
       string_agg(CASE WHEN aspect = 'POS' THEN term END, ',' ORDER BY rank) AS pos
FROM filled GROUP BY topic""")
def q_struct_flatten(spark, sf):
    """One column per aspect (words joined by ','); aspects empty for every topic are dropped
    (here the label-model aspect, whose labeler is not installed)."""
    asp = L.aspect_fill(aspects_table(spark, sf), C.fix_top_words(spark, sf), fx.doc_topic(spark, sf),
                        ["Main", "KeyBERT", "POS"])
    # the emptiness check and the final select both read the aspects: write them once
    asp = materialize(asp, "aspects")
    llm = asp.limit(0).withColumn("aspect", F.lit("LLM"))
    allasp = asp.unionByName(llm)
    names = ["KeyBERT", "LLM", "Main", "POS"]
    wide = (allasp.groupBy("topic").pivot("aspect", names)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]), ",")))
    nonempty = wide.select(*[F.max(F.coalesce(F.length(F.col(n)), F.lit(0)) > 0).alias(n) for n in names]).first()
    keep = [n for n in names if nonempty[n]]
    return wide.select("topic", *[F.col(n).alias(n.lower()) for n in keep])


@query("llm_prompt_table", QM.sql_model_ctes(QM.sql_x1(8), C.SQL_TOKS, C.SQL_CTFIDF, C.SQL_TOPWORDS) + f""",
dt AS (SELECT x1.topic, x1.docid, array_to_string(regexp_extract_all(lower(c.text), '[\\p{{L}}\\p{{N}}]+')[1:100], ' ') AS d
       FROM x1 JOIN corpus c USING (docid)),
dtext AS (SELECT topic, string_agg('- ' || d || chr(10), '' ORDER BY docid) AS doctext FROM dt GROUP BY topic),
kw AS (SELECT topic, string_agg(term, ', ' ORDER BY rank) AS kw FROM topw GROUP BY topic)
SELECT kw.topic, md5(replace(replace($${L.default_prompt('English')}$$, '[DOCUMENTS]', coalesce(dtext.doctext, '')), '[KEYWORDS]', kw.kw)) AS prompt_md5
FROM kw LEFT JOIN dtext USING (topic)""")
def q_llm_prompt_table(spark, sf):
    """Label prompt of every topic (8 representative documents cut to 100 tokens, 10 keywords)."""
    rep = _x1(spark, sf, 8).join(C.doc_tokens(spark, sf), "docid").select("topic", "docid", "tokens")
    p = L.llm_prompt_table(rep, C.fix_top_words(spark, sf), "English")
    return p.select("topic", F.md5("prompt").alias("prompt_md5"))


SQL_LABELS = """lab3 AS (SELECT topic, CAST(topic AS VARCHAR) || ': ' || regexp_replace(string_agg(term, '_' ORDER BY rank), '_+$', '') AS label
                FROM topw WHERE rank <= 3 GROUP BY topic),
lab1 AS (SELECT topic, CAST(topic AS VARCHAR) || ': ' || regexp_replace(string_agg(term, '_' ORDER BY rank), '_+$', '') AS label
         FROM topw WHERE rank <= 1 GROUP BY topic),
names AS (SELECT topic, CAST(topic AS VARCHAR) || '_' || string_agg(term, '_' ORDER BY rank) AS name FROM topw WHERE rank <= 4 GROUP BY topic),
custom AS (SELECT topic, CASE WHEN topic = -1 THEN NULL ELSE label END AS custom_label FROM lab1)"""


@query("generate_labels", C.sql_fix_ctes(C.SQL_TOPWORDS, SQL_LABELS) + "\nSELECT topic, label FROM lab3")
def q_generate_labels(spark, sf):
    """G8: '{topic}: w1_w2_w3' label of every topic."""
    return L.generate_labels(C.fix_top_words(spark, sf), 3, fx.doc_topic(spark, sf))


@query("label_fallback", C.sql_fix_ctes(C.SQL_TOPWORDS, SQL_LABELS) + """,
sug AS (SELECT topic, arg_min(term, (-length(term), rank)) AS s FROM topw GROUP BY topic HAVING max(length(term)) >= 8)
SELECT topic, coalesce(CAST(topic AS VARCHAR) || ': ' || s, label) AS label FROM lab3 LEFT JOIN sug USING (topic)""")
def q_label_fallback(spark, sf):
    """Suggestions of the rule-based labeler on the prompts, the 3-word label where it has none."""
    top = C.fix_top_words(spark, sf)
    prompts = L.llm_prompt_table(_x1(spark, sf, 8).join(C.doc_tokens(spark, sf), "docid").select("topic", "docid", "tokens"), top, "English")
    return L.label_fallback(L.labeler("longest_keyword")(prompts), top, fx.doc_topic(spark, sf))


def _custom_edits(spark, sf):
    one = L.generate_labels(C.fix_top_words(spark, sf), 1)
    v1 = one.select("topic", F.col("label").alias("custom_label"), F.lit(1).alias("version"))
    v2 = one.where(F.col("topic") == -1).select("topic", F.lit(None).cast("string").alias("custom_label"), F.lit(2).alias("version"))
    return v1.unionByName(v2)


@query("custom_label_overlay", C.sql_fix_ctes(C.SQL_TOPWORDS, SQL_LABELS) + """
SELECT l.topic, l.label, c.custom_label FROM lab3 l LEFT JOIN custom c USING (topic)""")
def q_custom_label_overlay(spark, sf):
    """Custom labels (an edit to 1-word labels, then a reset of the outlier topic) over the generated ones."""
    base = L.generate_labels(C.fix_top_words(spark, sf), 3)
    return L.custom_label_overlay(base, _custom_edits(spark, sf))


@query("topic_label_map", C.sql_fix_ctes(C.SQL_TOPWORDS, SQL_LABELS) + """,
info AS (SELECT n.topic, n.name, c.custom_label AS custom_name FROM names n LEFT JOIN custom c USING (topic)),
raw AS (SELECT topic, coalesce(nullif(custom_name, ''), nullif(name, ''), '') AS r FROM info),
clean AS (SELECT topic, CASE WHEN starts_with(r, CAST(topic AS VARCHAR) || ': ') THEN substr(r, length(CAST(topic AS VARCHAR) || ': ') + 1) ELSE r END AS c FROM raw)
SELECT topic, CASE WHEN c = '' THEN CAST(topic AS VARCHAR) ELSE c END AS display_label FROM clean""")
def q_topic_label_map(spark, sf):
    """Display label of every topic (custom name, else name; prefix stripped)."""
    top = C.fix_top_words(spark, sf)
    ov = L.custom_label_overlay(L.topic_names(top), _custom_edits(spark, sf))
    info = ov.select("topic", "name", F.col("custom_label").alias("custom_name"))
    return L.topic_label_map(info)


@query("topic_info", SQL_ASPECT_CTES + ",\n" + SQL_LABELS + """,
sizes AS (SELECT topic, count(*) AS count FROM doc_topic GROUP BY topic),
reps AS (SELECT topic, string_agg(CASE WHEN aspect = 'Main' THEN term END, ',' ORDER BY rank) AS main,
                string_agg(CASE WHEN aspect = 'KeyBERT' THEN term END, ',' ORDER BY rank) AS keybert,
                string_agg(CASE WHEN aspect = 'POS' THEN term END, ',' ORDER BY rank) AS pos FROM asp GROUP BY topic)
SELECT s.topic, s.count, n.name, c.custom_label AS custom_name, r.main, r.keybert, r.pos
FROM sizes s LEFT JOIN names n USING (topic) LEFT JOIN custom c USING (topic) LEFT JOIN reps r USING (topic)""")
def q_topic_info(spark, sf):
    """Topic, count, name, custom name and the words of every aspect of every topic."""
    top = C.fix_top_words(spark, sf)
    custom = L.custom_label_overlay(top.select("topic").distinct(), _custom_edits(spark, sf))
    info = L.topic_info(fx.doc_topic(spark, sf), top, custom, aspects_table(spark, sf))
    words = F.col("representation")
    return info.select("topic", "count", "name", "custom_name", *[F.array_join(words[a], ",").alias(a.lower()) for a in ("Main", "KeyBERT", "POS")])


@query("labels_export", C.sql_fix_ctes(C.SQL_TOPWORDS, SQL_LABELS) + """
SELECT topic AS topic_id, substr(label, length(CAST(topic AS VARCHAR) || ': ') + 1) AS custom_label FROM lab3""")
def q_labels_export(spark, sf):
    """Generated labels written as a (topic_id, custom_label) CSV in the shared folder, read back."""
    path = scratch_path(spark, "labels_csv")
    S.export_labels(L.generate_labels(C.fix_top_words(spark, sf), 3), path)
    return spark.read.schema(S.LABELS_CSV).option("header", True).csv(path)


@query("labels_import", C.sql_fix_ctes(C.SQL_TOPWORDS, SQL_LABELS) + """
SELECT l.topic, l.label, coalesce(nullif(substr(o.label, length(CAST(o.topic AS VARCHAR) || ': ') + 1), ''), l.label) AS custom_label
FROM lab3 l LEFT JOIN lab1 o USING (topic)""")
def q_labels_import(spark, sf):
    """A labels CSV (1-word labels) imported over the 3-word labels; unknown topics ignored."""
    path = scratch_path(spark, "labels_csv")
    top = C.fix_top_words(spark, sf)
    S.export_labels(L.generate_labels(top, 1), path)
    return S.import_labels(spark, path, L.generate_labels(top, 3))


@query("fitted_topics")
def q_fitted_topics(spark, sf):
    """All documents in one fit: chunks, vectors, density topics, reduction to 20, words and labels of every topic."""
    docs = fx.corpus(spark, sf).select("filename", "title", "text")
    return fit_topics(docs, preset("English (full)", min_chunksize=0, nr_topics=20)).info()

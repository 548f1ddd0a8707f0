"""Registered queries: analytics and inference on the fitted model
(A1, A5-A8, L5-L7, I1-I3, S10)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from topicspark.functions import text as T
from topicspark.operators import analytics as A
from topicspark.operators import ctfidf as G
from topicspark.operators import encode as E
from topicspark.operators import labels as L
from topicspark.operators import metadata as M
from topicspark.operators import model as K
from topicspark.operators import vectorize as V
from topicspark.plans import common as C
from topicspark.plans import fixtures as fx
from topicspark.plans import q_model as QM
from topicspark.plans.catalog import query, with_ctes
from topicspark.plans.fixtures import r6, sql_r6
from topicspark.session import materialize
from topicspark.sources.tables import table

WIN = 4
MIN_SIM = 0.001


# --- SQL pieces -----------------------------------------------------------------------

def sql_text_vectors(src: str, units: list[str], name: str) -> str:
    """E1 vectors of new texts (dense lists) and the E1 topic vectors; needs e1 and idf CTEs."""
    u = ", ".join(units)
    return rf"""{name}toks AS (SELECT {u}, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM {src}),
{name}counts AS (SELECT {u}, term, count(*) AS n FROM {name}toks GROUP BY ALL),
{name}raw AS (SELECT {u}, {QM.SQL_TERMDIM} AS dim, sum(n * ln(1 + n_units / df) * {QM.SQL_TERMSIGN}) AS raw
              FROM {name}counts JOIN idf USING (term) GROUP BY ALL),
{name}norm AS (SELECT {u}, sqrt(sum(raw * raw)) AS norm FROM {name}raw GROUP BY ALL),
{name}vec AS (SELECT {u}, list(coalesce(v.value, 0.0) ORDER BY g.dim) AS vec FROM
           (SELECT {u}, dim, raw / norm AS value FROM {name}raw JOIN {name}norm USING ({u}) WHERE norm > 0) v
           RIGHT JOIN (SELECT DISTINCT {u}, CAST(d AS INTEGER) AS dim FROM {name}norm, range(0, 64) t(d) WHERE norm > 0) g
           USING ({u}, dim) GROUP BY ALL),
tsize AS (SELECT topic, count(*) AS m FROM doc_topic WHERE docid IN (SELECT docid FROM e1) GROUP BY topic),
tcent AS (SELECT topic, dim, sum(value) / any_value(m) AS value FROM e1 JOIN doc_topic USING (docid) JOIN tsize USING (topic)
          WHERE topic <> -1 GROUP BY topic, dim),
tv AS (SELECT t.topic, list(coalesce(tcent.value, 0.0) ORDER BY t.dim) AS vec FROM
         (SELECT DISTINCT topic, CAST(d AS INTEGER) AS dim FROM tcent, range(0, 64) r(d)) t LEFT JOIN tcent USING (topic, dim) GROUP BY t.topic),
{name}sims AS (SELECT {", ".join("c." + x for x in units)}, t.topic,
                 list_dot_product(c.vec, t.vec) / (sqrt(list_dot_product(c.vec, c.vec)) * sqrt(list_dot_product(t.vec, t.vec))) AS sim
          FROM {name}vec c, tv t)"""


SQL_WINDOWS = rf"""ct AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS tokens FROM conversations),
cp AS (SELECT conv_id, turn, len(tokens) AS m, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM ct),
cw AS (SELECT conv_id, turn, term, unnest(range(greatest(0, pos - {WIN - 1}), least(pos, greatest(m - {WIN}, 0)) + 1)) AS win FROM cp
       WHERE greatest(0, pos - {WIN - 1}) <= least(pos, greatest(m - {WIN}, 0))),
idfc AS (SELECT term, any_value(idf) AS idf FROM ctfidf GROUP BY term),
wc AS (SELECT conv_id, turn, win, term, count(*) * any_value(i.idf) AS wt FROM cw JOIN idfc i USING (term) GROUP BY 1, 2, 3, 4),
wn AS (SELECT conv_id, turn, win, sqrt(sum(wt * wt)) AS wn FROM wc GROUP BY 1, 2, 3),
tn AS (SELECT topic, sqrt(sum(score * score)) AS tn FROM ctfidf GROUP BY topic),
dots AS (SELECT conv_id, turn, win, topic, sum(wt * score) AS dot FROM wc JOIN ctfidf USING (term) GROUP BY 1, 2, 3, 4),
wsim AS (SELECT conv_id, turn, win, topic, dot / (wn * tn) AS sim FROM dots JOIN wn USING (conv_id, turn, win) JOIN tn USING (topic)
         WHERE dot / (wn * tn) >= {MIN_SIM})"""


# --- Spark pieces ---------------------------------------------------------------------

def _conv_tokens(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.tokenize_word("text").alias("tokens"))


def _labels(spark, sf):
    return L.generate_labels(C.fix_top_words(spark, sf), 3)


@query("topics_per_class", C.sql_fix_ctes() + f""",
idfc AS (SELECT term, any_value(idf) AS idf FROM ctfidf GROUP BY term),
dc AS (SELECT dt.docid, dt.topic, c.genre AS class FROM doc_topic dt JOIN corpus c USING (docid)),
cfreq AS (SELECT class, topic, count(*) AS frequency FROM dc GROUP BY 1, 2),
pc AS (SELECT class, count(*) AS nd FROM dc GROUP BY 1),
cc AS (SELECT dc.class, dc.topic, t.term, any_value(i.idf) AS idf, count(*) AS n FROM toks t JOIN dc USING (docid) JOIN idfc i USING (term)
       GROUP BY 1, 2, 3),
tot AS (SELECT class, topic, sum(n) AS w FROM cc GROUP BY 1, 2),
sc AS (SELECT cc.class, cc.topic, cc.term, n / w * idf AS score FROM cc JOIN tot USING (class, topic)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY class, topic ORDER BY score DESC, term) AS rank FROM sc) WHERE rank <= 5),
cwords AS (SELECT class, topic, string_agg(term, ',' ORDER BY rank) AS words FROM top GROUP BY 1, 2)
SELECT f.class, f.topic, f.frequency, {sql_r6('f.frequency / pc.nd')} AS share, w.words
FROM cfreq f JOIN pc USING (class) LEFT JOIN cwords w USING (class, topic)""")
def q_topics_per_class(spark, sf):
    """A1: frequency, share and top 5 words of every topic within every genre."""
    classes = fx.corpus(spark, sf).select("docid", F.col("genre").alias("class"))
    # the texts are counted once; the counts by topic are sums of those by class
    counts = materialize(G.topic_term_counts(C.doc_tokens(spark, sf), fx.doc_topic(spark, sf).join(classes, "docid"), class_cols=("class", "topic")), "class-counts")
    scores = G.ctfidf(counts.groupBy("topic", "term").agg(F.sum("n").alias("n")), C.n_topics(spark, sf), max_df=C.MAX_DF)
    t = A.topics_per_class(counts, fx.doc_topic(spark, sf), classes, scores, "class", 5)
    return t.select("class", "topic", "frequency", r6(F.col("share")).alias("share"), F.array_join("words", ",").alias("words"))


def _bench_vectors(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", T.tokenize_word("text").alias("tokens"))
    counts = V.term_counts(b, "item_id")
    return E.rows_to_dense(E.hash_rows(counts, QM.corpus_idf(spark, sf), unit="item_id"), unit="item_id")


@query("find_topics", with_ctes(fx.SQL_CORPUS, fx.SQL_DOC_TOPIC, C.SQL_TOKS, C.SQL_CTFIDF, C.SQL_TOPWORDS, QM.SQL_E1,
                                sql_text_vectors("benchmark", ["item_id"], "b")) + f""",
lab AS (SELECT topic, CAST(topic AS VARCHAR) || ': ' || regexp_replace(string_agg(term, '_' ORDER BY rank), '_+$', '') AS label
        FROM topw WHERE rank <= 3 GROUP BY topic),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, topic) AS rank FROM bsims WHERE sim IS NOT NULL)
SELECT r.item_id, CAST(r.rank AS INTEGER) AS rank, r.topic, l.label, {sql_r6('r.sim')} AS similarity
FROM ranked r LEFT JOIN lab l USING (topic) WHERE r.rank <= 5""")
def q_find_topics(spark, sf):
    """A5: the 5 topics most similar to every benchmark query text, with labels."""
    cents = QM._topic_vectors_e1(spark, sf)
    sims = K.cosine_to_topics(_bench_vectors(spark, sf), cents)
    top = A.find_topics(sims, "item_id", 5).join(_labels(spark, sf), "topic", "left")
    return top.select("item_id", F.col("rank").cast("int"), "topic", "label", r6(F.col("similarity")).alias("similarity"))


@query("scatter_table", with_ctes(fx.SQL_CORPUS, fx.SQL_DOC_TOPIC, fx.SQL_XY, C.SQL_TOKS, C.SQL_CTFIDF, C.SQL_TOPWORDS) + f""",
lab AS (SELECT topic, regexp_replace(string_agg(term, '_' ORDER BY rank), '_+$', '') AS label FROM topw WHERE rank <= 3 GROUP BY topic)
SELECT x.docid AS chunk_id, {sql_r6('x.x')} AS x, {sql_r6('x.y')} AS y, d.topic,
       coalesce(l.label, CASE WHEN d.topic = -1 THEN 'Other' ELSE 'Unknown' END) AS label, c.author, c.title AS work
FROM xy x JOIN doc_topic d USING (docid) JOIN corpus c USING (docid) LEFT JOIN lab l USING (topic)""")
def q_scatter_table(spark, sf):
    """Every embedded document's 2-D point with topic, display label, author and work."""
    lab = _labels(spark, sf).select("topic", T.strip_topic_prefix("label", "topic").alias("label"))
    pts = fx.xy(spark, sf).join(fx.doc_topic(spark, sf), "docid")
    pts = M.map_lookup(pts, lab).join(fx.corpus(spark, sf).select("docid", "author", F.col("title").alias("work")), "docid")
    return pts.select(F.col("docid").alias("chunk_id"), r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"),
                      "topic", "label", "author", "work")


@query("doc_topic_profile", QM.sql_model_ctes() + f"""
SELECT docid, topic, {sql_r6('prob')} AS prob, CAST(row_number() OVER (PARTITION BY docid ORDER BY prob DESC, topic) AS INTEGER) AS rank
FROM probs""")
def q_doc_topic_profile(spark, sf):
    """Every document's topic probabilities, ordered."""
    p = A.doc_topic_profile(QM.given_probs(spark, sf), 0.0)
    return p.select("docid", "topic", r6(F.col("prob")).alias("prob"), "rank")


@query("datamap_table", with_ctes(fx.SQL_CORPUS, fx.SQL_DOC_TOPIC, fx.SQL_XY, C.SQL_TOKS, C.SQL_CTFIDF, C.SQL_TOPWORDS) + f""",
lab AS (SELECT topic, regexp_replace(string_agg(term, '_' ORDER BY rank), '_+$', '') AS label FROM topw WHERE rank <= 3 GROUP BY topic),
pos AS (SELECT docid, row_number() OVER (PARTITION BY filename ORDER BY docid) AS i, count(*) OVER (PARTITION BY filename) AS n FROM corpus)
SELECT x.docid, {sql_r6('x.x')} AS x, {sql_r6('x.y')} AS y,
       coalesce(l.label, CASE WHEN d.topic = -1 THEN 'Other' ELSE 'Unknown' END) AS label,
       md5(c.author || ' | ' || c.title || ' | chunk ' || CAST(p.i AS VARCHAR) || '/' || CAST(p.n AS VARCHAR) || chr(10) || c.text) AS hover_md5
FROM xy x JOIN doc_topic d USING (docid) JOIN corpus c USING (docid) JOIN pos p USING (docid) LEFT JOIN lab l USING (topic)
WHERE (SELECT count(*) FROM xy) >= 10""")
def q_datamap_table(spark, sf):
    """Data-map rows (point, label, hover text) for every embedded document; needs >= 10 documents."""
    pts = fx.xy(spark, sf)
    n = pts.select(F.count(F.lit(1))).scalar()
    lab = _labels(spark, sf).select("topic", T.strip_topic_prefix("label", "topic").alias("label"))
    hov = M.hover_text(M.chunk_position(fx.corpus(spark, sf))).select("docid", F.md5("hover").alias("hover_md5"))
    j = M.map_lookup(pts.join(fx.doc_topic(spark, sf), "docid"), lab).join(hov, "docid")
    return j.where(n >= 10).select("docid", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), "label", "hover_md5")


@query("author_topic_mean", QM.sql_model_ctes() + f""",
tl AS (SELECT DISTINCT topic FROM doc_topic WHERE topic <> -1),
dense AS (SELECT e.docid, tl.topic, coalesce(p.prob, 0.0) AS prob FROM doc_emb e CROSS JOIN tl LEFT JOIN probs p ON p.docid = e.docid AND p.topic = tl.topic)
SELECT c.author, d.topic, {sql_r6('avg(d.prob)')} AS mean_prob FROM dense d JOIN corpus c USING (docid) GROUP BY c.author, d.topic""")
def q_author_topic_mean(spark, sf):
    """Mean topic probability of every author over their documents."""
    topics = fx.doc_topic(spark, sf).where(F.col("topic") != -1)
    authors = fx.corpus(spark, sf).select("docid", "author").join(fx.doc_embedding(spark, sf).select("docid"), "docid", "left_semi")
    m = A.author_topic_mean(QM.given_probs(spark, sf), authors, topics)
    return m.select("author", "topic", r6(F.col("mean_prob")).alias("mean_prob"))


def _phi(spark, sf):
    counts = C.topic_term_counts(spark, sf)
    return A.topic_term_phi(counts), counts


SQL_PHI = """tcall AS (SELECT dt.topic, t.term, count(*) AS n FROM toks t JOIN doc_topic dt USING (docid) GROUP BY 1, 2),
tw AS (SELECT topic, sum(n) AS w FROM tcall GROUP BY topic),
phi AS (SELECT topic, term, n / w AS phi FROM tcall JOIN tw USING (topic)),
prev AS (SELECT topic, w / (SELECT sum(w) FROM tw) AS prevalence FROM tw)"""


@query("ldavis_tables", with_ctes(fx.SQL_CORPUS, fx.SQL_DOC_TOPIC, C.SQL_TOKS, SQL_PHI) + f""",
pw AS (SELECT term, sum(phi * prevalence) AS p FROM phi JOIN prev USING (topic) GROUP BY term),
rel AS (SELECT topic, term, 0.6 * ln(phi) + 0.4 * ln(phi / p) AS relevance FROM phi JOIN pw USING (term))
SELECT topic, CAST(rank AS INTEGER) AS rank, term, {sql_r6('relevance')} AS relevance FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY floor(relevance * 1e9 + 0.5) DESC, term) AS rank FROM rel) WHERE rank <= 10""")
def q_ldavis_tables(spark, sf):
    """The 10 most relevant terms of every topic at lambda 0.6 (prevalence = share of words)."""
    phi, counts = _phi(spark, sf)
    w = counts.groupBy("topic").agg(F.sum("n").alias("_w"))
    prev = w.select("topic", (F.col("_w") / F.sum("_w").over(Window.partitionBy())).alias("prevalence"))
    r = A.ldavis_relevance(phi, prev, 0.6, 10)
    return r.select("topic", F.col("rank").cast("int"), "term", r6(F.col("relevance")).alias("relevance"))


@query("ldavis_saliency", with_ctes(fx.SQL_CORPUS, fx.SQL_DOC_TOPIC, C.SQL_TOKS, SQL_PHI) + f""",
j AS (SELECT phi.topic, phi.term, phi.phi, prev.prevalence FROM phi JOIN prev USING (topic)),
pw AS (SELECT term, sum(phi * prevalence) AS p FROM j GROUP BY term),
kl AS (SELECT j.term, any_value(pw.p) AS p, sum(CASE WHEN phi * prevalence / pw.p > 0
         THEN phi * prevalence / pw.p * ln(phi * prevalence / pw.p / prevalence) ELSE 0 END) AS d
       FROM j JOIN pw USING (term) GROUP BY j.term)
SELECT term, {sql_r6('p * d')} AS saliency FROM kl""")
def q_ldavis_saliency(spark, sf):
    """Saliency of every term."""
    phi, counts = _phi(spark, sf)
    w = counts.groupBy("topic").agg(F.sum("n").alias("_w"))
    prev = w.select("topic", (F.col("_w") / F.sum("_w").over(Window.partitionBy())).alias("prevalence"))
    return A.ldavis_saliency(phi, prev).select("term", r6(F.col("saliency")).alias("saliency"))


@query("token_topics", QM.sql_model_ctes(C.SQL_TOKS.replace("toks AS", "toks0 AS"), SQL_PHI.replace("FROM toks t", "FROM toks0 t")) + r""",
tp AS (SELECT docid, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM (
         SELECT docid, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM corpus)),
inferred AS (SELECT docid, topic FROM probs WHERE prob > 0),
best AS (SELECT tp.docid, tp.pos, arg_min(phi.topic, (-phi.phi, phi.topic)) AS best_topic
         FROM tp JOIN inferred USING (docid) JOIN phi ON phi.topic = inferred.topic AND phi.term = tp.term GROUP BY 1, 2)
SELECT tp.docid, CAST(tp.pos AS INTEGER) AS pos, tp.term, best.best_topic FROM tp LEFT JOIN best USING (docid, pos)""")
def q_token_topics(spark, sf):
    """Topic of every token of every document (best phi among the document's inferred topics)."""
    phi, _ = _phi(spark, sf)
    inferred = QM.given_probs(spark, sf).where(F.col("prob") > 0).select("docid", "topic")
    texts = fx.corpus(spark, sf).select("docid", "text")
    return A.token_topics(texts, phi, inferred, T.tokenize_word("text")).select("docid", F.col("pos").cast("int"), "term", "best_topic")


def _win_sims(spark, sf):
    return A.window_topic_similarity(_conv_tokens(spark, sf), C.fix_ctfidf(spark, sf), ["conv_id", "turn"], WIN, 1, MIN_SIM)


@query("approx_distribution", C.sql_fix_ctes(SQL_WINDOWS) + f""",
s AS (SELECT conv_id, turn, topic, sum(sim) AS s FROM wsim GROUP BY 1, 2, 3),
t AS (SELECT conv_id, turn, sum(s) AS t FROM s GROUP BY 1, 2)
SELECT conv_id, turn, topic, {sql_r6('s / t')} AS share FROM s JOIN t USING (conv_id, turn)""")
def q_approx_distribution(spark, sf):
    """Topic distribution of every conversation turn from 4-token windows against c-TF-IDF."""
    d = A.approx_distribution(_win_sims(spark, sf), ["conv_id", "turn"])
    return d.select("conv_id", "turn", "topic", r6(F.col("share")).alias("share"))


@query("token_distribution", C.sql_fix_ctes(SQL_WINDOWS) + f""",
cover AS (SELECT w.conv_id, w.turn, w.topic, w.sim, unnest(range(w.win, least(w.win + {WIN}, ct.m))) AS pos
          FROM wsim w JOIN (SELECT conv_id, turn, len(tokens) AS m FROM ct) ct USING (conv_id, turn))
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, topic, {sql_r6('sum(sim)')} AS value FROM cover GROUP BY 1, 2, 3, 4""")
def q_token_distribution(spark, sf):
    """Per token of every conversation turn, the summed similarity of the windows covering it."""
    d = A.token_distribution(_win_sims(spark, sf), _conv_tokens(spark, sf), ["conv_id", "turn"], WIN)
    return d.select("conv_id", "turn", F.col("pos").cast("int"), "topic", r6(F.col("value")).alias("value"))


@query("approx_distribution_emb", with_ctes(fx.SQL_CORPUS, fx.SQL_DOC_TOPIC, C.SQL_TOKS, QM.SQL_E1) + ",\n" + rf"""
ct AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS tokens FROM conversations),
cp AS (SELECT conv_id, turn, len(tokens) AS m, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM ct),
wins AS (SELECT conv_id, turn, term, unnest(range(greatest(0, pos - {WIN - 1}), least(pos, greatest(m - {WIN}, 0)) + 1)) AS win FROM cp
         WHERE greatest(0, pos - {WIN - 1}) <= least(pos, greatest(m - {WIN}, 0))),
""" + sql_text_vectors("wins", ["conv_id", "turn", "win"], "w").replace(
    "wtoks AS (SELECT conv_id, turn, win, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM wins),",
    "wtoks AS (SELECT conv_id, turn, win, term FROM wins),") + f""",
ws AS (SELECT * FROM wsims WHERE sim >= {MIN_SIM}),
s AS (SELECT conv_id, turn, topic, sum(sim) AS s FROM ws GROUP BY 1, 2, 3),
t AS (SELECT conv_id, turn, sum(s) AS t FROM s GROUP BY 1, 2)
SELECT conv_id, turn, topic, {sql_r6('s / t')} AS share FROM s JOIN t USING (conv_id, turn)""")
def q_approx_distribution_emb(spark, sf):
    """Topic distribution of every conversation turn from E1 vectors of its 4-token windows."""
    units = ["conv_id", "turn"]
    windows = E.hash_windows(_conv_tokens(spark, sf), QM.corpus_idf(spark, sf), units, WIN)
    sims = K.window_similarity(windows, QM._topic_vectors_e1(spark, sf), units, QM.DIMS, MIN_SIM)
    d = A.approx_distribution(sims, units)
    return d.select("conv_id", "turn", "topic", r6(F.col("share")).alias("share"))


@query("ingest_new_text", C.sql_fix_ctes() + r""",
vocab AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS term_id FROM (SELECT DISTINCT term FROM ctfidf)),
nt AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM conversations)
SELECT conv_id, turn, term_id, count(*) AS n FROM nt JOIN vocab USING (term) GROUP BY 1, 2, 3""")
def q_ingest_new_text(spark, sf):
    """New texts (conversation turns) -> tokens -> bag of words over the model's vocabulary."""
    vocab = V.vocab_index(C.fix_ctfidf(spark, sf).select("term").distinct())
    t = _conv_tokens(spark, sf).select(F.struct("conv_id", "turn").alias("u"), F.explode("tokens").alias("term"))
    bow = V.doc2bow(t, vocab, unit_col="u")
    return bow.select("u.conv_id", "u.turn", "term_id", "n")

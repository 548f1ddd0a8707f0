"""Registered queries: encoder, topic vectors, probabilities, clustering, sampling
(E1, E2, K2-K8, A2-A4, X1-X3, R19)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from topicspark.operators import analytics as A
from topicspark.operators import ctfidf as G
from topicspark.operators import density as D
from topicspark.operators import encode as E
from topicspark.operators import layout as Y
from topicspark.operators import metadata as M
from topicspark.operators import model as K
from topicspark.operators import neighbours as N
from topicspark.operators import sample as X
from topicspark.operators import vectorize as V
from topicspark.plans import common as C
from topicspark.plans import fixtures as fx
from topicspark.plans.catalog import query, reused, with_ctes
from topicspark.plans.fixtures import r6, sql_r6
from topicspark.sources.tables import table

DIMS = 64
SEED = 42
NR_DOCS = 5

# --- Spark building blocks ------------------------------------------------------------


def given_centroids(spark, sf):
    emb_long = E.to_long(fx.doc_embedding(spark, sf))
    return K.topic_centroids(emb_long, fx.doc_topic(spark, sf))


@reused("given_probs")
def given_probs(spark, sf):
    cents = K.centroid_array(given_centroids(spark, sf), DIMS)
    return K.topic_probs(fx.doc_embedding(spark, sf), cents)


def doc_weights(spark, sf):
    """(docid, topic, genre, w): w = probability of the document for its own topic; 1 for outliers."""
    dt = fx.doc_topic(spark, sf)
    p = given_probs(spark, sf)
    g = fx.corpus(spark, sf).select("docid", "genre")
    j = dt.join(g, "docid").join(p, ["docid", "topic"], "left")
    return j.select("docid", "topic", "genre",
                    F.when(F.col("topic") == -1, F.lit(1.0)).otherwise(F.coalesce(F.col("prob"), F.lit(0.0))).alias("w"))


@reused("corpus_counts")
def corpus_counts(spark, sf):
    return V.term_counts(C.doc_tokens(spark, sf), "docid")


@reused("corpus_idf")
def corpus_idf(spark, sf):
    return E.fit_idf(corpus_counts(spark, sf))


@reused("doc_vectors")
def doc_vectors(spark, sf):
    """E1 vectors of all documents, one row a document."""
    return E.hash_rows(corpus_counts(spark, sf), corpus_idf(spark, sf))


# --- SQL building blocks --------------------------------------------------------------

SQL_CENTROIDS = """el AS (SELECT docid, unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS dim FROM doc_emb),
members AS (SELECT * FROM doc_topic WHERE docid IN (SELECT docid FROM doc_emb)),
msize AS (SELECT topic, count(*) AS m FROM members GROUP BY topic),
cent AS (SELECT topic, dim, sum(CAST(value AS DOUBLE)) / any_value(m) AS value
         FROM el JOIN members USING (docid) JOIN msize USING (topic) GROUP BY topic, dim),
centv AS (SELECT topic, list(value ORDER BY dim) AS vec FROM cent WHERE topic <> -1 GROUP BY topic)"""

SQL_PROBS = """sims AS (
  SELECT e.docid, c.topic,
         list_dot_product(CAST(e.embedding AS DOUBLE[]), c.vec)
           / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(c.vec, c.vec))) AS sim
  FROM doc_emb e, centv c),
clip AS (SELECT docid, topic, greatest(coalesce(sim, 0.0), 0.0) AS c FROM sims),
tot AS (SELECT docid, sum(c) AS t FROM clip GROUP BY docid),
probs AS (SELECT docid, topic, c / t AS prob FROM clip JOIN tot USING (docid) WHERE t > 0 AND c > 0)"""


def sql_model_ctes(*extra):
    return with_ctes(fx.SQL_CORPUS, fx.SQL_DOC_TOPIC, fx.SQL_DOC_EMB, SQL_CENTROIDS, SQL_PROBS, *extra)


SQL_TERMDIM = """CAST(('0x' || substr(md5(term), 1, 12))::BIGINT % 64 AS INTEGER)"""
SQL_TERMSIGN = """CASE WHEN CAST(('0x' || substr(md5(term), 13, 1)) AS INTEGER) % 2 = 0 THEN 1.0 ELSE -1.0 END"""
SQL_E1 = r"""dcounts AS (SELECT docid, term, count(*) AS n FROM toks GROUP BY docid, term),
idf AS (SELECT term, count(*) AS df, (SELECT count(DISTINCT docid) FROM dcounts) AS n_units FROM dcounts GROUP BY term),
e1raw AS (SELECT docid, """ + SQL_TERMDIM + """ AS dim, sum(n * ln(1 + n_units / df) * """ + SQL_TERMSIGN + """) AS raw
          FROM dcounts JOIN idf USING (term) GROUP BY 1, 2),
e1norm AS (SELECT docid, sqrt(sum(raw * raw)) AS norm FROM e1raw GROUP BY docid),
e1 AS (SELECT docid, dim, raw / norm AS value FROM e1raw JOIN e1norm USING (docid) WHERE norm > 0)"""

SQL_X1 = f"""xd AS (
  SELECT dt.docid, dt.topic, coalesce(c.genre, '') AS stratum,
         CASE WHEN dt.topic = -1 THEN 1.0 ELSE coalesce(p.prob, 0.0) END AS w
  FROM doc_topic dt JOIN corpus c USING (docid) LEFT JOIN probs p ON p.docid = dt.docid AND p.topic = dt.topic),
xst AS (SELECT topic, stratum, min(docid) AS first, sum(w) AS wsum FROM xd GROUP BY 1, 2),
xst2 AS (SELECT topic, stratum, wsum <= 0 AS uniform,
                row_number() OVER (PARTITION BY topic ORDER BY first, stratum) AS r, count(*) OVER (PARTITION BY topic) AS s
         FROM xst),
xq AS (SELECT topic, stratum, uniform, CAST(floor({{nr}} / s) + CASE WHEN r <= {{nr}} % s THEN 1 ELSE 0 END AS INTEGER) AS quota FROM xst2),
xk AS (SELECT xd.*, xq.quota, CASE WHEN xq.uniform THEN 1.0 ELSE xd.w END AS ww,
              (CAST(('0x' || substr(md5('{SEED}:' || CAST(docid AS VARCHAR)), 1, 12)) AS BIGINT) + 0.5) / 281474976710656.0 AS u
       FROM xd JOIN xq USING (topic, stratum)),
xk2 AS (SELECT *, CASE WHEN ww > 0 THEN -ln(u) / ww END AS key FROM xk),
xdrawn AS (SELECT topic, docid FROM (
             SELECT *, row_number() OVER (PARTITION BY topic, stratum ORDER BY key ASC NULLS LAST, docid) AS dr FROM xk2)
           WHERE dr <= quota),
xnc AS (SELECT topic, count(*) AS c FROM xdrawn GROUP BY topic),
xrest AS (SELECT xd.*, {{nr}} - coalesce(xnc.c, 0) AS need FROM xd LEFT JOIN xnc USING (topic)
          WHERE NOT EXISTS (SELECT 1 FROM xdrawn x WHERE x.topic = xd.topic AND x.docid = xd.docid)),
xtop AS (SELECT topic, docid FROM (
           SELECT *, row_number() OVER (PARTITION BY topic ORDER BY w DESC, docid DESC) AS tr FROM xrest WHERE need > 0)
         WHERE tr <= need),
x1 AS (SELECT topic, docid, CAST(rank AS INTEGER) AS rank FROM (
         SELECT topic, docid, row_number() OVER (PARTITION BY topic ORDER BY docid) AS rank
         FROM (SELECT * FROM xdrawn UNION ALL SELECT * FROM xtop)) WHERE rank <= {{nr}})"""


def sql_x1(nr=NR_DOCS):
    return SQL_X1.replace("{nr}", str(nr))


# --- queries ---------------------------------------------------------------------------


@query("topic_centroids", sql_model_ctes() + f"""
SELECT topic, CAST(dim AS INTEGER) AS dim, {sql_r6('value')} AS value FROM cent""")
def q_topic_centroids(spark, sf):
    """K5: mean embedding of every topic's documents (long form)."""
    c = given_centroids(spark, sf)
    return c.select("topic", "dim", r6(F.col("value")).alias("value"))


@query("topic_sizes", with_ctes(fx.SQL_DOC_TOPIC) + "\nSELECT topic, count(*) AS size FROM doc_topic GROUP BY topic")
def q_topic_sizes(spark, sf):
    """K6: documents per topic, -1 included."""
    return K.topic_sizes(fx.doc_topic(spark, sf))


@query("topic_probs", sql_model_ctes() + f"\nSELECT docid, topic, {sql_r6('prob')} AS prob FROM probs")
def q_topic_probs(spark, sf):
    """K4: probability of each document for each topic (clipped cosine to the centroid, normalised)."""
    return given_probs(spark, sf).select("docid", "topic", r6(F.col("prob")).alias("prob"))


@query("pivot_dense", sql_model_ctes() + f""",
tl AS (SELECT DISTINCT topic FROM doc_topic WHERE topic <> -1)
SELECT e.docid, tl.topic, {sql_r6('coalesce(p.prob, 0.0)')} AS prob
FROM doc_emb e CROSS JOIN tl LEFT JOIN probs p ON p.docid = e.docid AND p.topic = tl.topic""")
def q_pivot_dense(spark, sf):
    """The sparse probabilities as a dense document x topic table with 0.0 filled in."""
    topics = fx.doc_topic(spark, sf).where(F.col("topic") != -1)
    d = M.pivot_dense(given_probs(spark, sf), fx.doc_embedding(spark, sf), topics)
    return d.select("docid", "topic", r6(F.col("prob")).alias("prob"))


@query("embed_docs", with_ctes(fx.SQL_CORPUS, C.SQL_TOKS, SQL_E1) + f"""
SELECT docid, dim, {sql_r6('value')} AS value FROM e1""")
def q_embed_docs(spark, sf):
    """Hashed TF-IDF vector (64 dims, L2-normalised) of every document."""
    return E.rows_to_long(doc_vectors(spark, sf)).select("docid", "dim", r6(F.col("value")).alias("value"))


SQL_NEW_TEXT = r"""ctoks AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM conversations),
ccounts AS (SELECT conv_id, turn, term, count(*) AS n FROM ctoks GROUP BY 1, 2, 3),
craw AS (SELECT conv_id, turn, """ + SQL_TERMDIM + """ AS dim, sum(n * ln(1 + n_units / df) * """ + SQL_TERMSIGN + """) AS raw
         FROM ccounts JOIN idf USING (term) GROUP BY 1, 2, 3),
cnorm AS (SELECT conv_id, turn, sqrt(sum(raw * raw)) AS norm FROM craw GROUP BY 1, 2),
cvec AS (SELECT conv_id, turn, list(coalesce(v.value, 0.0) ORDER BY g.dim) AS vec FROM
           (SELECT conv_id, turn, dim, raw / norm AS value FROM craw JOIN cnorm USING (conv_id, turn) WHERE norm > 0) v
           RIGHT JOIN (SELECT DISTINCT conv_id, turn, CAST(d AS INTEGER) AS dim FROM cnorm, range(0, 64) t(d) WHERE norm > 0) g
           USING (conv_id, turn, dim) GROUP BY conv_id, turn),
tsize AS (SELECT topic, count(*) AS m FROM doc_topic WHERE docid IN (SELECT docid FROM e1) GROUP BY topic),
tc AS (SELECT topic, dim, sum(value) / any_value(m) AS value FROM e1 JOIN doc_topic USING (docid) JOIN tsize USING (topic)
       WHERE topic <> -1 GROUP BY topic, dim),
tv AS (SELECT t.topic, list(coalesce(tc.value, 0.0) ORDER BY t.dim) AS vec FROM
         (SELECT DISTINCT topic, CAST(d AS INTEGER) AS dim FROM tc, range(0, 64) r(d)) t LEFT JOIN tc USING (topic, dim) GROUP BY t.topic),
csims AS (SELECT c.conv_id, c.turn, t.topic,
                 list_dot_product(c.vec, t.vec) / (sqrt(list_dot_product(c.vec, c.vec)) * sqrt(list_dot_product(t.vec, t.vec))) AS sim
          FROM cvec c, tv t)"""


@reused("topic_centroids_e1")
def topic_centroids_e1(spark, sf):
    """Topic vectors in the encoder's space, written once: batches and streams only read them."""
    return K.row_centroids(doc_vectors(spark, sf), fx.doc_topic(spark, sf))


def _topic_vectors_e1(spark, sf):
    return K.centroid_array(topic_centroids_e1(spark, sf), DIMS)


def _conv_vectors(spark, sf):
    """E1 vectors of all conversation turns; a turn without a known term has the zero vector."""
    conv = table(spark, sf, "conversations").select("conv_id", "turn", C.T.tokenize_word("text").alias("tokens"))
    counts = V.term_counts(conv, ["conv_id", "turn"])
    idf = corpus_idf(spark, sf)
    rows = E.hash_rows(counts.withColumn("unit", F.struct("conv_id", "turn")).drop("conv_id", "turn"), idf, unit="unit")
    dense = E.rows_to_dense(rows, unit="unit", units=conv.select(F.struct("conv_id", "turn").alias("unit")).distinct())
    return dense.select("unit.conv_id", "unit.turn", "embedding")


@query("assign_new", with_ctes(fx.SQL_CORPUS, fx.SQL_DOC_TOPIC, C.SQL_TOKS, SQL_E1, SQL_NEW_TEXT) + f"""
SELECT conv_id, turn, CAST(CASE WHEN max(sim) >= 0 THEN arg_max(topic, sim) ELSE -1 END AS INTEGER) AS topic,
       {sql_r6('max(sim)')} AS similarity
FROM (SELECT DISTINCT conv_id, turn FROM conversations) LEFT JOIN csims USING (conv_id, turn) GROUP BY conv_id, turn""")
def q_assign_new(spark, sf):
    """K8: topic of every conversation turn (new text) by cosine of its E1 vector to the topic vectors."""
    a = K.assign_new(_conv_vectors(spark, sf), _topic_vectors_e1(spark, sf), ["conv_id", "turn"])
    return a.select("conv_id", "turn", "topic", r6(F.col("similarity")).alias("similarity"))


@query("kmeans_topics")
def q_kmeans_topics(spark, sf):
    """K3: k-means (cosine, k = 10, seed 42) topics of the given embeddings, numbered by size."""
    return K.kmeans_topics(fx.doc_embedding(spark, sf), 10, seed=SEED)


KNN = 10


@query("knn_graph", f"""
WITH u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM u),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, greatest(1 - list_dot_product(a.v, b.v) / (a.norm * b.norm), 0.0) AS d
      FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND a.norm > 0 AND b.norm > 0)
SELECT a, CAST(rank AS INTEGER) AS rank, b, {sql_r6('d')} AS d
FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM p) WHERE rank <= {KNN}""")
def q_knn_graph(spark, sf):
    """K1: the 10 nearest of all embeddings (cosine distance) for every embedding whose id is divisible by 20, exact."""
    units = N.unit_vectors(table(spark, sf, "embeddings"), "vec_id")
    g = N.knn_graph(units, units.where(F.col("vec_id") % 20 == 0), KNN, "vec_id")
    return g.select("a", "rank", "b", r6(F.col("d")).alias("d"))


@query("density_cluster")
def q_density_cluster(spark, sf):
    """K2: density topics with outliers (-1) of the given embeddings of documents, from the hierarchy of mutual reachability."""
    return D.density_topics(fx.doc_embedding(spark, sf), min_topic_size=10)


@query("density_documents")
def q_density_documents(spark, sf):
    """K2 on text: density topics of all documents by their E1 vectors; documents without a known term are outliers."""
    emb = fx.corpus(spark, sf).select("docid").join(E.rows_to_dense(doc_vectors(spark, sf)), "docid", "left")
    return D.density_topics(emb, min_topic_size=10)


@query("cluster_membership")
def q_cluster_membership(spark, sf):
    """K4 by membership: probability of every document for every density topic of all documents (E1 vectors)."""
    emb = E.rows_to_dense(doc_vectors(spark, sf))
    return D.membership(D.fit(emb, 10), emb).select("docid", "topic", r6(F.col("prob")).alias("prob"))


@query("reduce_2d")
def q_reduce_2d(spark, sf):
    """2-D coordinates of every embedded document that keep its neighbours together."""
    return Y.neighbour_layout(fx.doc_embedding(spark, sf))


@query("pca_2d")
def q_pca_2d(spark, sf):
    """E2 by principal components: 2-D coordinates of every embedded document."""
    return K.reduce_2d(fx.doc_embedding(spark, sf))


def fix_similarity(spark, sf):
    return K.topic_similarity(C.fix_ctfidf(spark, sf))


@query("topic_similarity", C.sql_fix_ctes() + f""",
nrm AS (SELECT topic, sqrt(sum(score * score)) AS norm FROM ctfidf GROUP BY topic)
SELECT a.topic AS topic_a, b.topic AS topic_b, {sql_r6('sum(a.score * b.score) / (any_value(na.norm) * any_value(nb.norm))')} AS similarity
FROM ctfidf a JOIN ctfidf b USING (term) JOIN nrm na ON na.topic = a.topic JOIN nrm nb ON nb.topic = b.topic
GROUP BY a.topic, b.topic""")
def q_topic_similarity(spark, sf):
    """A2: topic x topic cosine similarity of the c-TF-IDF rows."""
    return fix_similarity(spark, sf).select("topic_a", "topic_b", r6(F.col("similarity")).alias("similarity"))


# The given topics are 0 to 9 at most: average linkage, one step after the other.
GIVEN_TOPICS = 10
NR_TOPICS = 5


def sql_merges(steps):
    """CTEs c0, m0, c1, m1, ...: the clusters before each merge, and the merge."""
    out = ["""sims AS MATERIALIZED (SELECT a.topic AS a, b.topic AS b, sum(a.score * b.score) / (any_value(na.norm) * any_value(nb.norm)) AS sim
  FROM ctfidf a JOIN ctfidf b USING (term) JOIN nrm na ON na.topic = a.topic JOIN nrm nb ON nb.topic = b.topic GROUP BY 1, 2)""",
           "c0 AS MATERIALIZED (SELECT topic AS cluster, topic FROM nrm WHERE topic <> -1)"]
    for s in range(steps):
        out += [f"""m{s} AS MATERIALIZED (SELECT x.cluster AS l, y.cluster AS r, avg(1 - coalesce(sim, 0)) AS d
  FROM c{s} x JOIN c{s} y ON x.cluster < y.cluster LEFT JOIN sims ON sims.a = x.topic AND sims.b = y.topic GROUP BY 1, 2 ORDER BY 3, 1, 2 LIMIT 1)""",
                f"""c{s + 1} AS MATERIALIZED (SELECT CASE WHEN c.cluster IN (m.l, m.r) THEN {s + 1} + (SELECT max(topic) FROM c0) ELSE c.cluster END AS cluster, c.topic
  FROM c{s} c LEFT JOIN m{s} m ON true)"""]
    return ["nrm AS MATERIALIZED (SELECT topic, sqrt(sum(score * score)) AS norm FROM ctfidf GROUP BY topic)", *out]


@query("topic_hierarchy", C.sql_fix_ctes(*sql_merges(GIVEN_TOPICS - 1), "size AS (SELECT topic, count(*) AS n FROM doc_topic GROUP BY topic)") + " UNION ALL ".join(f"""
SELECT CAST({s} AS INTEGER) AS step, CAST(l AS INTEGER) AS left, CAST(r AS INTEGER) AS right, {sql_r6('d')} AS distance,
       (SELECT CAST(sum(n) AS BIGINT) FROM c{s} JOIN size USING (topic) WHERE cluster IN (l, r)) AS size FROM m{s}""" for s in range(GIVEN_TOPICS - 1)))
def q_topic_hierarchy(spark, sf):
    """A3: average-linkage merges of the topics from their c-TF-IDF similarity."""
    h = K.topic_hierarchy(fix_similarity(spark, sf), K.topic_sizes(fx.doc_topic(spark, sf)))
    return h.withColumn("distance", r6(F.col("distance")))


SQL_CUT = [*sql_merges(GIVEN_TOPICS - NR_TOPICS), f"""cut AS MATERIALIZED (SELECT topic AS old_topic, CAST(dense_rank() OVER (ORDER BY n DESC, first) - 1 AS INTEGER) AS new_topic FROM (
  SELECT topic, count(*) OVER (PARTITION BY cluster) AS k, sum(n) OVER (PARTITION BY cluster) AS n, min(topic) OVER (PARTITION BY cluster) AS first
  FROM c{GIVEN_TOPICS - NR_TOPICS} JOIN (SELECT topic, count(*) AS n FROM doc_topic GROUP BY topic) USING (topic)) UNION ALL SELECT -1, -1)"""]


@reused("topic_cut")
def topic_cut(spark, sf):
    return K.cut_topics(fix_similarity(spark, sf), K.topic_sizes(fx.doc_topic(spark, sf)), NR_TOPICS)


@query("reduce_topics", C.sql_fix_ctes(*SQL_CUT) + "\nSELECT docid, new_topic AS topic FROM doc_topic JOIN cut ON old_topic = topic")
def q_reduce_topics(spark, sf):
    """K7: topics of every document once the hierarchy is cut at 5 topics, numbered by size."""
    return K.apply_plan(fx.doc_topic(spark, sf), topic_cut(spark, sf))


@query("reduced_top_words", C.sql_fix_ctes(*SQL_CUT, f"""rc AS (SELECT new_topic AS topic, term, sum(n) AS n FROM tc JOIN cut ON old_topic = topic GROUP BY 1, 2),
rk AS (SELECT term, sum(n) AS f FROM rc GROUP BY term HAVING count(*) <= (SELECT count(DISTINCT new_topic) FROM cut) * {C.MAX_DF}),
rv AS (SELECT rc.*, rk.f FROM rc JOIN rk USING (term)),
rw AS (SELECT topic, sum(n) AS words FROM rv GROUP BY topic),
ra AS (SELECT floor(sum(n) / (SELECT count(DISTINCT new_topic) FROM cut)) AS a FROM rv),
rs AS (SELECT rv.topic, rv.term, rv.n / rw.words * ln(1 + (SELECT a FROM ra) / rv.f) AS score FROM rv JOIN rw USING (topic)),
rt AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS rank FROM rs),
rz AS (SELECT new_topic AS topic, count(*) AS size FROM doc_topic JOIN cut ON old_topic = topic GROUP BY 1)""") + f"""
SELECT t.topic, z.size, CAST(t.rank AS INTEGER) AS rank, t.term, {sql_r6('t.score')} AS score FROM rt t JOIN rz z USING (topic) WHERE rank <= 10""")
def q_reduced_top_words(spark, sf):
    """K7 refitted: sizes and c-TF-IDF words of the 5 topics that are left, from the added counts of the old ones."""
    plan = topic_cut(spark, sf)
    counts = K.merged_counts(C.topic_term_counts(spark, sf), plan)
    top = G.top_words(G.ctfidf(counts, plan.select(F.countDistinct("new_topic")).scalar(), max_df=C.MAX_DF), 10)
    sizes = K.topic_sizes(K.apply_plan(fx.doc_topic(spark, sf), plan))
    return top.join(sizes, "topic").select("topic", "size", F.col("rank").cast("int"), "term", r6(F.col("score")).alias("score"))


def sql_coordinates(phi, squarings=24):
    """CTEs dist (a, b, d) and xy (topic, x, y) of phi (topic, term, phi): classical scaling in SQL.

    The doubly centred matrix, shifted to be positive, is squared again and
    again until one direction is left; that axis is taken out, then the next.
    """
    def power(name, matrix, tables):
        out = [f"{name}0 AS MATERIALIZED (SELECT k, {matrix} AS m FROM {tables})"]
        for i in range(squarings):
            out += [f"""{name}q{i} AS MATERIALIZED (SELECT k, list_transform(m, lambda u: list_transform(range(k), lambda j: list_dot_product(u, m[j + 1]))) AS m FROM {name}{i})""",
                    f"""{name}{i + 1} AS MATERIALIZED (SELECT k, list_transform(m, lambda u: list_transform(u, lambda z: z / list_max(list_transform(flatten(m), lambda y: abs(y))))) AS m FROM {name}q{i})"""]
        last = f"{name}{squarings}"
        return [*out, f"{name}c AS MATERIALIZED (SELECT list_transform(list_sort(list_transform(m, lambda u: {{'n': list_dot_product(u, u), 'u': u}}), 'DESC')[1].u, lambda z: z) AS v FROM {last})",
                f"""{name}v AS MATERIALIZED (SELECT list_transform(v, lambda z: z / sqrt(list_dot_product(v, v)) * CASE WHEN list_max(v) >= -list_min(v) THEN 1 ELSE -1 END) AS v FROM {name}c)""",
                f"""{name}e AS MATERIALIZED (SELECT v, list_dot_product(v, list_transform(sh.m, lambda u: list_dot_product(u, v))) AS e FROM {name}v, sh)"""]

    return [f"""ph AS MATERIALIZED ({phi})""",
            "tt AS MATERIALIZED (SELECT topic, row_number() OVER (ORDER BY topic) AS i FROM (SELECT DISTINCT topic FROM ph))",
            """gain AS MATERIALIZED (SELECT x.topic AS a, y.topic AS b, sum(x.phi * ln(2 * x.phi / (x.phi + y.phi)) + y.phi * ln(2 * y.phi / (x.phi + y.phi)) - ln(2) * (x.phi + y.phi)) / 2 AS g
  FROM ph x JOIN ph y ON x.term = y.term AND x.topic <> y.topic GROUP BY 1, 2)""",
            """dist AS MATERIALIZED (SELECT x.topic AS a, y.topic AS b, x.i, y.i AS j, CASE WHEN x.topic = y.topic THEN 0 ELSE greatest(ln(2) + coalesce(g, 0), 0) END AS d
  FROM tt x CROSS JOIN tt y LEFT JOIN gain ON gain.a = x.topic AND gain.b = y.topic)""",
            "d2 AS (SELECT i, j, d * d AS d, avg(d * d) OVER (PARTITION BY i) AS r, avg(d * d) OVER (PARTITION BY j) AS c, avg(d * d) OVER () AS t FROM dist)",
            "bm AS MATERIALIZED (SELECT list(u ORDER BY i) AS m, count(*) AS k FROM (SELECT i, list((r + c - d - t) / 2 ORDER BY j) AS u FROM d2 GROUP BY i))",
            """sh AS MATERIALIZED (SELECT k, s, list_transform(m, lambda u, i: list_transform(u, lambda z, j: z + CASE WHEN i = j THEN s ELSE 0 END)) AS m
  FROM (SELECT *, list_max(list_transform(m, lambda u: list_sum(list_transform(u, lambda z: abs(z))))) AS s FROM bm))""",
            *power("p", "m", "sh"),
            *power("o", "list_transform(m, lambda u, i: list_transform(u, lambda z, j: z - e * v[i] * v[j]))", "sh, pe"),
            """xy AS (SELECT topic, pe.v[i] * sqrt(greatest(pe.e - s, 0)) AS x, oe.v[i] * sqrt(greatest(oe.e - s, 0)) AS y FROM tt, pe, oe, sh)"""]


SQL_TERM_COUNTS = "tcall AS (SELECT dt.topic, t.term, count(*) AS n FROM toks t JOIN doc_topic dt USING (docid) GROUP BY 1, 2)"
SQL_PHI_TOPICS = """SELECT topic, term, n / sum(n) OVER (PARTITION BY topic) AS phi FROM tcall WHERE topic <> -1"""


def given_phi(spark, sf):
    return A.topic_term_phi(C.topic_term_counts(spark, sf).where(F.col("topic") != -1))


@query("topic_divergence", with_ctes(fx.SQL_CORPUS, fx.SQL_DOC_TOPIC, C.SQL_TOKS, SQL_TERM_COUNTS, *sql_coordinates(SQL_PHI_TOPICS)[:4]) + f"""
SELECT a AS topic_a, b AS topic_b, {sql_r6('d')} AS divergence FROM dist WHERE a < b""")
def q_topic_divergence(spark, sf):
    """Jensen-Shannon divergence of the word distributions of all pairs of topics."""
    return K.topic_divergence(given_phi(spark, sf)).select("topic_a", "topic_b", r6(F.col("divergence")).alias("divergence"))


@query("intertopic_map", with_ctes(fx.SQL_CORPUS, fx.SQL_DOC_TOPIC, C.SQL_TOKS, SQL_TERM_COUNTS, *sql_coordinates(SQL_PHI_TOPICS)) + f"""
SELECT topic, {sql_r6('x')} AS x, {sql_r6('y')} AS y, (SELECT count(*) FROM doc_topic d WHERE d.topic = xy.topic) AS size FROM xy""")
def q_intertopic_map(spark, sf):
    """A4: 2-D map of the topics (principal coordinates of their divergences) with their sizes."""
    xy = K.intertopic_map(given_phi(spark, sf), K.topic_sizes(fx.doc_topic(spark, sf)))
    return xy.select("topic", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), "size")


@query("ldavis_topics", with_ctes(fx.SQL_CORPUS, fx.SQL_DOC_TOPIC, C.SQL_TOKS, SQL_TERM_COUNTS, *sql_coordinates(SQL_PHI_TOPICS),
                                  "w AS (SELECT topic, sum(n) AS n FROM tcall WHERE topic <> -1 GROUP BY topic)") + f"""
SELECT topic, {sql_r6('x')} AS x, {sql_r6('y')} AS y, CAST(row_number() OVER (ORDER BY n DESC, topic) AS INTEGER) AS rank,
       {sql_r6('n / (SELECT sum(n) FROM w)')} AS prevalence FROM xy JOIN w USING (topic)""")
def q_ldavis_topics(spark, sf):
    """Topic coordinates and prevalence (share of words), the topics' table of the browser."""
    counts = C.topic_term_counts(spark, sf).where(F.col("topic") != -1)
    xy = K.topic_coordinates(A.topic_term_phi(counts))
    # a row a topic
    w = counts.groupBy("topic").agg(F.sum("n").alias("n")).select("topic", F.row_number().over(Window.orderBy(F.desc("n"), "topic")).alias("rank"),
                                                                  (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("prevalence"))
    return xy.join(w, "topic").select("topic", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), F.col("rank").cast("int").alias("rank"),
                                      r6(F.col("prevalence")).alias("prevalence"))


@query("stratified_docs", sql_model_ctes(sql_x1()) + "\nSELECT topic, docid, rank FROM x1")
def q_stratified_docs(spark, sf):
    """5 representative documents per topic, stratified by genre, weighted by topic probability."""
    return X.stratified_docs(doc_weights(spark, sf), NR_DOCS, "genre", SEED).select("topic", "docid", F.col("rank").cast("int"))


@query("representative_for_topic", sql_model_ctes(sql_x1().replace("FROM doc_topic dt JOIN", "FROM (SELECT * FROM doc_topic WHERE topic = 0) dt JOIN")) + """,
xw AS (SELECT x1.docid, xd.w FROM x1 JOIN xd USING (docid))
SELECT 0 AS topic, docid, CAST(row_number() OVER (ORDER BY w DESC, docid) AS INTEGER) AS display_rank FROM xw""")
def q_representative_for_topic(spark, sf):
    """Representative documents of topic 0, by weight."""
    return X.representative_for_topic(doc_weights(spark, sf), 0, NR_DOCS, "genre", SEED)


@query("sample_per_topic", with_ctes(fx.SQL_DOC_TOPIC) + f""",
s AS (SELECT topic, count(*) AS n FROM doc_topic GROUP BY topic),
k AS (SELECT d.docid, d.topic, greatest(1, floor(s.n * 0.1)) AS kk,
             (CAST(('0x' || substr(md5('{SEED}:' || CAST(docid AS VARCHAR)), 1, 12)) AS BIGINT) + 0.5) / 281474976710656.0 AS u
      FROM doc_topic d JOIN s USING (topic))
SELECT docid, topic FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY u, docid) AS r FROM k) WHERE r <= kk""")
def q_sample_per_topic(spark, sf):
    """A 10 % sample of every topic (at least one document), without replacement."""
    return X.sample_per_topic(fx.doc_topic(spark, sf), 0.1, SEED).select("docid", "topic")


@query("stream_assign", with_ctes(fx.SQL_CORPUS, fx.SQL_DOC_TOPIC, C.SQL_TOKS, SQL_E1, SQL_NEW_TEXT) + f"""
SELECT conv_id, turn, CAST(CASE WHEN max(sim) >= 0 THEN arg_max(topic, sim) ELSE -1 END AS INTEGER) AS topic,
       {sql_r6('max(sim)')} AS similarity
FROM (SELECT DISTINCT conv_id, turn FROM conversations) LEFT JOIN csims USING (conv_id, turn) GROUP BY conv_id, turn""")
def q_stream_assign(spark, sf):
    """K8 as a Structured Streaming job: conversation turns arrive as 4 Parquet files, one file
    per micro-batch; every batch is assigned to topics; the result is the union of the batch outputs."""
    from topicspark.session import ensure_checkpoint_dir, scratch_path
    from topicspark.streaming.assign import start_assignment_stream
    ensure_checkpoint_dir(spark)
    src = scratch_path(spark, "stream_in")
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    conv.repartition(4, "conv_id").write.parquet(src)
    out, ckpt = scratch_path(spark, "stream_out"), scratch_path(spark, "stream_ckpt")
    q = start_assignment_stream(spark, src, conv.schema, out, ckpt, corpus_idf(spark, sf),
                                _topic_vectors_e1(spark, sf), ["conv_id", "turn"])
    q.awaitTermination()
    res = spark.read.parquet(out)
    return res.select("conv_id", "turn", "topic", r6(F.col("similarity")).alias("similarity"))

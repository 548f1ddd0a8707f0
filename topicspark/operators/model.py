"""Topic model operators: centroids, sizes, probabilities, assignment, clustering,
topic similarity, hierarchy, reduction and 2-D projections (K2-K8, E2, A2-A4).

Documents and terms stay distributed.  Only topic-sized tables (K rows, or
K x K for similarity) are ever held as one value: as a scalar subquery
expanded inside each document's row, or on the driver for the merge plans
(K7, A3).  Their size is checked against ``MAX_TOPICS`` when they are built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicspark.session import materialize

MAX_TOPICS = 2000
WINDOWS = 16_384  # window vectors that a task holds at once


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def topic_sizes(doc_topic: DataFrame) -> DataFrame:
    """K6: documents per topic, outliers (-1) included."""
    return doc_topic.groupBy("topic").agg(F.count(F.lit(1)).alias("size"))


def topic_centroids(emb_long: DataFrame, doc_topic: DataFrame, unit: str = "docid") -> DataFrame:
    """K5: mean member vector of each topic, long form (topic, dim, value).

    Sums per (topic, dim) are divided by the topic's member count, so sparse
    long vectors (zero dims omitted) give the same mean as dense ones.
    """
    members = doc_topic.join(emb_long.select(unit).distinct(), unit, "left_semi")
    sizes = members.groupBy("topic").agg(F.count(F.lit(1)).alias("_m"))
    s = (emb_long.join(members, unit).groupBy("topic", "dim")
         .agg(F.sum(F.col("value").cast("double")).alias("_s")))
    return s.join(sizes, "topic").select("topic", "dim", (F.col("_s") / F.col("_m")).alias("value"))


def row_centroids(rows: DataFrame, doc_topic: DataFrame, unit: str = "docid", vec_col: str = "vec") -> DataFrame:
    """K5 of vectors in rows, one a unit, null in dims that count as 0: a unit meets its topic once, not once a dim."""
    members = rows.select(unit, vec_col).join(doc_topic.select(unit, "topic"), unit)
    sizes = members.groupBy("topic").agg(F.count(F.lit(1)).alias("_m"))
    s = (members.select("topic", F.posexplode(vec_col).alias("dim", "value")).where(F.col("value").isNotNull())
         .groupBy("topic", "dim").agg(F.sum("value").alias("_s")))
    return s.join(sizes, "topic").select("topic", "dim", (F.col("_s") / F.col("_m")).alias("value"))


def centroid_array(centroids_long: DataFrame, dims: int, max_topics: int = MAX_TOPICS, include_outliers: bool = False):
    """All topic vectors as one checked scalar: array<struct<topic, vec, norm>>."""
    c = centroids_long if include_outliers else centroids_long.where(F.col("topic") != -1)
    per = c.groupBy("topic").agg(F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("_m"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0)))
    per = per.select("topic", vec.alias("vec")).withColumn("norm", F.sqrt(_dot(F.col("vec"), F.col("vec"))))
    arr = per.select(F.array_sort(F.collect_list(F.struct("topic", "vec", "norm"))).alias("a")).scalar()
    return F.when(F.size(arr) <= max_topics, arr).otherwise(
        F.raise_error(F.lit(f"more than {max_topics} topics: raise MAX_TOPICS or reduce topics first")))


def cosine_to_topics(docs: DataFrame, cents, vec_col: str = "embedding") -> DataFrame:
    """(unit..., sims array<struct<topic, sim>>): cosine of each vector to every topic vector."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    # the topic vectors (a scalar subquery) become a column first: subqueries
    # cannot sit inside a lambda
    d = docs.withColumn("_v", v).withColumn("_n", F.sqrt(_dot(F.col("_v"), F.col("_v")))).withColumn("_cents", cents)
    sims = F.transform("_cents", lambda c: F.struct(c["topic"].alias("topic"),
                                                    F.try_divide(_dot(F.col("_v"), c["vec"]), F.col("_n") * c["norm"]).alias("sim")))
    # second references outside the lambda keep _v and _n computed once per row
    sims = F.when((F.size("_v") >= 0) & (F.col("_n") >= 0), sims)
    return d.withColumn("sims", sims).drop("_v", "_n", "_cents")


def window_similarity(windows: DataFrame, cents, unit_cols, dims: int, min_similarity: float) -> DataFrame:
    """(unit..., topic, sim): cosines of a unit's windows to every topic vector, summed over the windows where they are
    ``min_similarity`` or more.

    ``windows`` is that of :func:`encode.hash_windows`, ``cents`` the checked
    scalar of :func:`centroid_array`.  Window vectors are made in matrices of
    ``WINDOWS`` rows inside tasks and never leave them; a window without a
    direction has no similarity.
    """
    units = [unit_cols] if isinstance(unit_cols, str) else list(unit_cols)
    spark = windows.sparkSession
    topics = [t for t in spark.range(1).select(cents.alias("c")).first()["c"] if t["norm"] > 0]
    names = np.array([t["topic"] for t in topics], np.int32)
    directions = np.array([np.array(t["vec"]) / t["norm"] for t in topics], float).reshape(len(topics), dims).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            lists = b.column(len(units))
            lo, hi, dim, w = (c.to_numpy() for c in lists.flatten().flatten())
            text = lists.value_parent_indices().to_numpy().astype(np.int64)
            last = np.zeros(b.num_rows, np.int64)
            np.maximum.at(last, text, hi)
            first = np.concatenate([[0], np.cumsum(last + 1)])  # windows are numbered through the batch
            times = (hi - lo + 1).astype(np.int64)
            number = np.repeat(first[text] + lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            cell, value = number * dims + np.repeat(dim, times), np.repeat(w, times)
            order = np.argsort(cell, kind="stable")
            cell, value = cell[order], value[order]
            sums = np.zeros((b.num_rows, len(names)))
            for at in range(0, int(first[-1]), WINDOWS):
                n = min(WINDOWS, int(first[-1]) - at)
                a, z = np.searchsorted(cell, (at * dims, (at + n) * dims))
                v = np.bincount(cell[a:z] - at * dims, value[a:z], n * dims).reshape(n, dims)
                length = np.sqrt((v * v).sum(axis=1, keepdims=True))
                sim = np.divide(v, length, out=v, where=length > 0) @ directions
                owner = np.searchsorted(first, np.arange(at, at + n), "right") - 1
                begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                sums[owner[begins]] += np.add.reduceat(np.where((sim >= min_similarity) & (length > 0), sim, 0.0), begins, axis=0)
            row, col = np.nonzero(sums)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(len(units))), pa.array(names[col]), pa.array(sums[row, col])], names=[*units, "topic", "sim"])

    schema = windows.select(*units, F.lit(0).alias("topic"), F.lit(0.0).alias("sim")).schema
    return windows.select(*units, "entries").mapInArrow(run, schema)


def topic_probs(docs: DataFrame, cents, unit: str = "docid", vec_col: str = "embedding") -> DataFrame:
    """K4: (unit, topic, prob): cosine to each topic centroid clipped at 0, divided by the
    document's sum; rows with prob 0 omitted; documents with no positive cosine get none."""
    s = cosine_to_topics(docs.select(unit, vec_col), cents, vec_col)
    s = s.select(unit, F.transform("sims", lambda x: F.struct(x["topic"].alias("topic"),
                                                              F.greatest(F.coalesce(x["sim"], F.lit(0.0)), F.lit(0.0)).alias("c"))).alias("c"))
    s = s.withColumn("_tot", F.aggregate("c", F.lit(0.0), lambda acc, x: acc + x["c"]))
    e = s.where(F.col("_tot") > 0).select(unit, "_tot", F.explode("c").alias("x"))
    return e.where(F.col("x.c") > 0).select(unit, F.col("x.topic").alias("topic"), (F.col("x.c") / F.col("_tot")).alias("prob"))


def assign_new(docs: DataFrame, cents, unit_cols, vec_col: str = "embedding", threshold: float = 0.0) -> DataFrame:
    """K8: best topic of each new vector by cosine; below ``threshold`` (or no vector) -> -1."""
    units = [unit_cols] if isinstance(unit_cols, str) else list(unit_cols)
    s = cosine_to_topics(docs.select(*units, vec_col), cents, vec_col)
    best = F.aggregate("sims", F.struct(F.lit(-1).alias("topic"), F.lit(None).cast("double").alias("sim")),
                       lambda acc, x: F.when(x["sim"].isNotNull() & (acc["sim"].isNull() | (x["sim"] > acc["sim"])),
                                             F.struct(x["topic"].alias("topic"), x["sim"].alias("sim"))).otherwise(acc))
    s = s.withColumn("_b", best)
    topic = F.when(F.col("_b.sim") >= F.lit(threshold), F.col("_b.topic")).otherwise(F.lit(-1))
    return s.select(*units, topic.cast("int").alias("topic"), F.col("_b.sim").alias("similarity"))


def renumber_by_size(assign: DataFrame, cluster_col: str = "cluster", unit: str = "docid") -> DataFrame:
    """Topics 0..K-1 by size (largest first, ties by smallest member), -1 kept."""
    stats = (assign.where(F.col(cluster_col) != -1).groupBy(cluster_col)
             .agg(F.count(F.lit(1)).alias("_n"), F.min(unit).alias("_first")))
    ranked = stats.withColumn("topic", (F.row_number().over(Window.orderBy(F.desc("_n"), F.asc("_first"))) - 1).cast("int"))
    j = assign.join(ranked.select(cluster_col, "topic"), cluster_col, "left")
    return j.select(*[c for c in assign.columns if c != cluster_col], F.coalesce(F.col("topic"), F.lit(-1)).alias("topic"))


def kmeans_topics(emb: DataFrame, k: int, seed: int = 42, unit: str = "docid", vec_col: str = "embedding",
                  max_iter: int = 20) -> DataFrame:
    """K3: k-means topics (cosine via normalised vectors), numbered by size."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    data = emb.select(unit, array_to_vector(F.transform(vec_col, lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, distanceMeasure="cosine").fit(data)
    pred = model.transform(data).select(unit, F.col("prediction").cast("int").alias("cluster"))
    return renumber_by_size(pred, "cluster", unit)


def reduce_2d(emb: DataFrame, unit: str = "docid", vec_col: str = "embedding", k: int = 2) -> DataFrame:
    """E2 (re-aimed): 2-D coordinates by PCA (distributed covariance), (unit, x, y)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    data = emb.select(unit, array_to_vector(F.transform(vec_col, lambda x: x.cast("double"))).alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(data)
    out = model.transform(data).select(unit, vector_to_array("pc").alias("pc"))
    return out.select(unit, F.col("pc")[0].alias("x"), F.col("pc")[1].alias("y"))


# --- topic x topic -------------------------------------------------------------------

TERMS_PER_BLOCK = 5000


def topic_similarity(scores: DataFrame, blocks: int | None = None) -> DataFrame:
    """A2: cosine similarity of topics over their c-TF-IDF rows, (topic_a, topic_b, similarity).

    A distributed sparse product: terms are hashed into ``blocks``; each block's
    topic x term slice is multiplied in one task (NumPy), giving partial K x K
    products that are summed by a groupBy.  No per-term pair lists are built.
    By default there are enough blocks for about ``TERMS_PER_BLOCK`` terms
    each, so a block's dense slice stays within MAX_TOPICS x TERMS_PER_BLOCK
    doubles however large the vocabulary is (one count of distinct terms).
    """
    spark = scores.sparkSession
    if blocks is None:
        n_terms = scores.select(F.countDistinct("term")).first()[0] or 0
        blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_terms // TERMS_PER_BLOCK))
    b = blocks
    norms = scores.groupBy("topic").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))
    s = scores.select("topic", "term", F.col("score").cast("double").alias("score")).withColumn(
        "block", F.pmod(F.xxhash64("term"), F.lit(b)).cast("int"))

    def block_product(pdf: pd.DataFrame) -> pd.DataFrame:
        topics, t_idx = np.unique(pdf["topic"].to_numpy(), return_inverse=True)
        terms, w_idx = np.unique(pdf["term"].to_numpy(), return_inverse=True)
        m = np.zeros((len(topics), len(terms)))
        np.add.at(m, (t_idx, w_idx), pdf["score"].to_numpy())
        g = m @ m.T
        ia, ib = np.nonzero(g)
        return pd.DataFrame({"topic_a": topics[ia].astype("int32"), "topic_b": topics[ib].astype("int32"), "dot": g[ia, ib]})

    partial = s.groupBy("block").applyInPandas(block_product, "topic_a int, topic_b int, dot double")
    dots = partial.groupBy("topic_a", "topic_b").agg(F.sum("dot").alias("dot"))
    na = norms.select(F.col("topic").alias("topic_a"), F.col("norm").alias("na"))
    nb = norms.select(F.col("topic").alias("topic_b"), F.col("norm").alias("nb"))
    return (dots.join(na, "topic_a").join(nb, "topic_b")
            .select("topic_a", "topic_b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("similarity")))


def _collect_similarity(sim: DataFrame, max_topics: int = MAX_TOPICS):
    """(topics, K x K similarities); the number of topics is checked before anything is collected."""
    topics = sorted(r[0] for r in sim.select("topic_a").union(sim.select("topic_b")).distinct().limit(max_topics + 1).collect())
    if len(topics) > max_topics:
        raise ValueError(f"more than {max_topics} topics: too many for a merge plan")
    pos = {t: i for i, t in enumerate(topics)}
    m = np.zeros((len(topics), len(topics)))
    for a, b, v in sim.select("topic_a", "topic_b", "similarity").collect():
        m[pos[a], pos[b]] = v
    return topics, m


def average_linkage(d: np.ndarray) -> list[tuple[int, int, float]]:
    """(left, right, distance) of all merges by distance; a new cluster's number is K + its merge's.

    Follows chains of nearest clusters: two that are each other's nearest merge
    at once, as average linkage never brings a third one nearer to either
    (distances after a merge are the mean, weighted by members).  K**2 steps.
    """
    k = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, live = np.ones(k), np.ones(k, bool)
    chain, merges = [], []
    for _ in range(k - 1):
        if not chain:
            chain = [int(np.flatnonzero(live)[0])]
        while True:
            row = np.where(live, d[chain[-1]], np.inf)
            near = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[near]:
                near = chain[-2]
            if len(chain) > 1 and near == chain[-2]:
                break
            chain.append(near)
        a, b = sorted((chain.pop(), chain.pop()))
        merges.append((float(d[a, b]), a, b))
        joined = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        live[b] = False
        size[a] += size[b]
        d[a], d[:, a] = joined, joined
        d[a, a] = np.inf
    # numbers in the order of the distances; a slot's cluster is the last merge into it
    now, out = list(range(k)), []
    for distance, a, b in sorted(merges, key=lambda m: m[0]):
        left, right = sorted((now[a], now[b]))
        out.append((left, right, distance))
        now[a] = k + len(out) - 1
    return out


def merge_forest(sim: DataFrame) -> tuple[list[int], list[tuple[int, int, float]]]:
    """(topics, average-linkage merges on 1 - similarity) without outliers; at most MAX_TOPICS topics, on the driver."""
    topics, m = _collect_similarity(sim.where((F.col("topic_a") != -1) & (F.col("topic_b") != -1)))
    return topics, average_linkage(1.0 - m)


def topic_hierarchy(sim: DataFrame, sizes: DataFrame) -> DataFrame:
    """A3: agglomerative merges (average linkage on 1 - similarity) of the topics (outliers excluded).

    Returns (step, left, right, distance, size); new clusters get ids
    max(topic)+1, +2, ... as in a dendrogram, in the order of the distances.
    """
    topics, merges = merge_forest(sim)
    size = dict(sizes.where(F.col("topic") != -1).collect())
    number = topics + [max(topics, default=-1) + 1 + i for i in range(len(merges))]
    count, out = [size.get(t, 0) for t in topics], []
    for step, (a, b, distance) in enumerate(merges):
        count.append(count[a] + count[b])
        out.append((step, int(number[a]), int(number[b]), distance, int(count[-1])))
    return sim.sparkSession.createDataFrame(out, "step int, left int, right int, distance double, size bigint")


def cut_topics(sim: DataFrame, sizes: DataFrame, nr_topics: int) -> DataFrame:
    """K7: (old_topic, new_topic) of the hierarchy cut where ``nr_topics`` topics are left (0: no reduction).

    Outliers stay -1; new topics are numbered by size, ties by their smallest old topic.
    """
    topics, merges = merge_forest(sim)
    size = dict(sizes.collect())
    members = {i: [t] for i, t in enumerate(topics)}
    for step, (a, b, _) in enumerate(merges[:max(0, len(topics) - nr_topics)] if nr_topics > 0 else []):
        members[len(topics) + step] = members.pop(a) + members.pop(b)
    order = sorted(members.values(), key=lambda m: (-sum(size.get(t, 0) for t in m), min(m)))
    rows = [(int(t), new) for new, m in enumerate(order) for t in m] + [(-1, -1)]
    return sim.sparkSession.createDataFrame(rows, "old_topic int, new_topic int")


def merged_counts(counts: DataFrame, plan: DataFrame) -> DataFrame:
    """(topic, term, n) of the new topics: counts add up, so a cut's c-TF-IDF, words and labels need no text."""
    j = counts.join(F.broadcast(plan), counts["topic"] == plan["old_topic"])
    return j.groupBy(F.col("new_topic").alias("topic"), "term").agg(F.sum("n").alias("n"))


def reduce_topics_plan(sim: DataFrame, sizes: DataFrame, nr_topics: int) -> DataFrame:
    """K7: merge plan (old_topic, new_topic) down to ``nr_topics`` topics (+ outliers).

    Repeatedly the smallest topic joins its most similar other topic (sizes
    add up); -1 never merges; the survivors are renumbered by size.
    """
    spark = sim.sparkSession
    topics, m = _collect_similarity(sim.where((F.col("topic_a") != -1) & (F.col("topic_b") != -1)))
    size = {r[0]: r[1] for r in sizes.collect()}
    owner = {t: t for t in topics}
    cur = {t: size.get(t, 0) for t in topics}
    pos = {t: i for i, t in enumerate(topics)}
    members = {t: [t] for t in topics}
    while nr_topics > 0 and len(cur) > nr_topics:
        small = min(cur, key=lambda t: (cur[t], t))
        others = [t for t in cur if t != small]
        target = max(others, key=lambda t: (max(m[pos[x], pos[y]] for x in members[small] for y in members[t]), -t))
        for x in members[small]:
            owner[x] = target
        members[target] += members.pop(small)
        cur[target] += cur.pop(small)
    for t in topics:
        while owner[t] != owner[owner[t]]:
            owner[t] = owner[owner[t]]
    order = sorted(cur, key=lambda t: (-cur[t], t))
    new_id = {t: i for i, t in enumerate(order)}
    rows = [(int(t), int(new_id[owner[t]])) for t in topics] + [(-1, -1)]
    return spark.createDataFrame(rows, "old_topic int, new_topic int")


def apply_plan(doc_topic: DataFrame, plan: DataFrame) -> DataFrame:
    """Map documents through a (bounded, broadcast) old -> new topic plan."""
    j = doc_topic.join(F.broadcast(plan), doc_topic.topic == plan.old_topic, "left")
    return j.select(*[c for c in doc_topic.columns if c != "topic"],
                    F.coalesce(F.col("new_topic"), F.col("topic")).cast("int").alias("topic"))


def topic_divergence(phi: DataFrame, blocks: int | None = None) -> DataFrame:
    """(topic_a, topic_b, divergence), topic_a < topic_b: Jensen-Shannon divergence of the topics' words.

    A sparse sum: a term adds to a pair only where both topics have it; what the
    others add follows from the shared terms' shares, as each topic's sum to 1.
    Blocks of terms are summed inside tasks, as in :func:`topic_similarity`.
    """
    spark = phi.sparkSession
    if blocks is None:
        n_terms = phi.select(F.countDistinct("term")).first()[0] or 0
        blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_terms // TERMS_PER_BLOCK))
    s = phi.select("topic", "term", "phi", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"))

    def block_sum(pdf: pd.DataFrame) -> pd.DataFrame:
        topics, t = np.unique(pdf["topic"].to_numpy(), return_inverse=True)
        terms, w = np.unique(pdf["term"].to_numpy(), return_inverse=True)
        p = np.zeros((len(topics), len(terms)))
        p[t, w] = pdf["phi"].to_numpy()
        out = []
        for i in range(len(topics) - 1):
            own = np.flatnonzero(p[i])
            a, b = p[i, own], p[i + 1:, own]
            both = b > 0
            half = (a + b) / 2
            with np.errstate(all="ignore"):
                gain = np.where(both, a * np.log(a / half) + b * np.log(b / half) - np.log(2.0) * (a + b), 0.0).sum(1)
            near = np.flatnonzero(both.any(1))
            out.append(pd.DataFrame({"topic_a": topics[i], "topic_b": topics[i + 1 + near], "gain": gain[near] / 2}))
        return pd.concat(out) if out else pd.DataFrame({"topic_a": topics[:0], "topic_b": topics[:0], "gain": np.zeros(0)})

    parts = s.groupBy("block").applyInPandas(block_sum, "topic_a int, topic_b int, gain double")
    gains = parts.groupBy("topic_a", "topic_b").agg(F.sum("gain").alias("gain"))
    topics = phi.select(F.col("topic").cast("int").alias("topic")).distinct()
    # every pair of topics, for those that share no term: a topic-sized list in each topic's row
    every = topics.select(F.col("topic").alias("topic_a"), topics.select(F.sort_array(F.collect_list("topic"))).scalar().alias("_all"))
    pairs = every.select("topic_a", F.explode(F.filter("_all", lambda t: t > F.col("topic_a"))).alias("topic_b"))
    total = F.lit(float(np.log(2.0))) + F.coalesce("gain", F.lit(0.0))
    return pairs.join(gains, ["topic_a", "topic_b"], "left").select("topic_a", "topic_b", F.greatest(total, F.lit(0.0)).alias("divergence"))


def principal_coordinates(distance: np.ndarray, axes: int = 2) -> np.ndarray:
    """Classical scaling: coordinates on the axes of greatest variance; the largest entry of an axis is positive."""
    k = len(distance)
    centre = np.eye(k) - 1.0 / max(k, 1)
    values, vectors = np.linalg.eigh(-0.5 * centre @ (distance ** 2) @ centre)
    xy = np.zeros((k, axes))
    for i in range(min(axes, k)):
        v = vectors[:, -1 - i] * np.sqrt(max(values[-1 - i], 0.0))
        xy[:, i] = -v if v[np.abs(v).argmax()] < 0 else v
    return xy


def topic_coordinates(phi: DataFrame) -> DataFrame:
    """(topic, x, y): principal coordinates of the Jensen-Shannon divergences; at most MAX_TOPICS topics."""
    topics = sorted(r[0] for r in phi.select("topic").distinct().limit(MAX_TOPICS + 1).collect())
    if len(topics) > MAX_TOPICS:
        raise ValueError(f"more than {MAX_TOPICS} topics: reduce topics first")
    pos, d = {t: i for i, t in enumerate(topics)}, np.zeros((len(topics), len(topics)))
    for a, b, v in topic_divergence(phi).collect():
        d[pos[a], pos[b]] = d[pos[b], pos[a]] = v
    xy = principal_coordinates(d)
    return phi.sparkSession.createDataFrame([(int(t), float(x), float(y)) for t, (x, y) in zip(topics, xy, strict=True)], "topic int, x double, y double")


def intertopic_map(phi: DataFrame, sizes: DataFrame) -> DataFrame:
    """A4: (topic, x, y, size) of all topics but the outliers."""
    return topic_coordinates(phi.where(F.col("topic") != -1)).join(sizes, "topic")

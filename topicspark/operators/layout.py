"""A 2-D layout that keeps neighbours together.

1. *Graph.*  Each vector's ``k`` nearest (K1, exact, cosine) get fuzzy weights
   exp(-(d - nearest) / s), where s makes them sum to log2(k); the weights of
   both directions join as p + q - p q.
2. *Start.*  Power iteration with the lazy random walk on the graph, from two
   principal components: the slowest varying directions of the graph, constant
   direction taken out, orthonormal after every step.
3. *Layout.*  In every epoch all vectors move at once: toward their neighbours
   by the weighted mean attraction, and away from ``NEGATIVES`` other vectors
   each, drawn by a hash of (vector, epoch, draw).  Nothing depends on
   partitions or on the order of rows.

Start and layout are rounds of Spark joins over (vector, x, y); a graph of at
most ``LAST_NODES`` vectors takes the same rounds as arrays in one process.
Equal vectors share one place.  Vectors without a direction have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.operators import neighbours as N
from topicspark.operators.numbering import dense_number
from topicspark.session import materialize

# fixed values: the curve 1 / (1 + A d^2B) that fits exp(-d), for a least distance of 0
A, B = 1.93, 0.79
NEGATIVES = 5
MOST_FORCE = 4.0
SPREAD = 10.0
LAST_NODES = 100_000
PRIME = (1 << 31) - 1


def fuzzy_graph(near: DataFrame, k: int) -> DataFrame:
    """(i, j, w), both directions, from the neighbours (q, c, d, rank) of all vectors."""
    rows = near.where(F.col("q") != F.col("c")).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("d", "c"))).alias("x"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for ds in b.column(1).to_pylist():
                away = np.maximum(np.array(ds) - ds[0], 0.0)
                want, low, high = np.log2(max(2, min(k, len(ds)))), 0.0, np.inf
                s = 1.0
                for _ in range(64):
                    total = np.exp(-away / s).sum()
                    low, high = (low, s) if total > want else (s, high)
                    s = (low + high) / 2 if high < np.inf else 2 * s
                s = max(s, 1e-3 * float(np.mean(ds)), 1e-12)
                out.append(np.exp(-away / s).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float64()))], names=["q", "d", "c", "w"])

    top = rows.select("q", F.transform(F.slice("x", 1, k), lambda r: r["d"]).alias("d"), F.transform(F.slice("x", 1, k), lambda r: r["c"]).alias("c"))
    one = top.mapInArrow(weigh, "q bigint, d array<double>, c array<bigint>, w array<double>").select("q", F.explode(F.arrays_zip("c", "w")).alias("e"))
    one = one.select(F.col("q").alias("i"), F.col("e.c").alias("j"), F.col("e.w").alias("w"))
    both = one.unionAll(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    # p + q - p q of the one or two weights of a pair
    return both.groupBy("i", "j").agg((F.sum("w") - F.when(F.count("w") > 1, F.min("w") * F.max("w")).otherwise(0.0)).alias("w"))


def _turn(s: dict) -> tuple[np.ndarray, np.ndarray]:
    """(mean, matrix): (xy - mean) @ matrix has weighted mean 0 and identity covariance."""
    n = s["n"]
    mean = np.array([s["x"], s["y"]]) / n
    cov = np.array([[s["xx"], s["xy"]], [s["xy"], s["yy"]]]) / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    values = np.maximum(values, max(values.max(), 1e-300) * 1e-12)
    for c in range(2):  # one sign whatever the solver
        if vectors[np.abs(vectors[:, c]).argmax(), c] < 0:
            vectors[:, c] = -vectors[:, c]
    return mean, (vectors / np.sqrt(values))[:, ::-1]


def _drawn(i, t, n, mod):
    """The vector that draw t gives vector i: the same arithmetic for columns and arrays (nothing exceeds 63 bits)."""
    def one(seed):
        r = mod(mod(i, PRIME) * 48271 + mod(t, PRIME) * seed + 11, PRIME)
        r = mod(r * r, PRIME)
        return mod(r * 16807 + mod(i, PRIME) * 7 + 3, PRIME)
    return mod(one(69621) * (PRIME + 1) + one(39373), n)


# rounds on arrays

def _sum(at, values, n):
    return np.bincount(at, values, n)


def _start_arrays(i, j, w, xy, rounds):
    n = len(xy)
    degree = _sum(i, w, n)
    for step in range(rounds + 1):
        x, y = xy.T
        s = {"n": degree.sum(), "x": degree @ x, "y": degree @ y, "xx": degree @ (x * x), "xy": degree @ (x * y), "yy": degree @ (y * y)}
        mean, turn = _turn(s)
        xy = (xy - mean) @ turn
        if step < rounds:
            xy = (xy + np.stack([_sum(i, w * xy[j, c], n) for c in range(2)], 1) / degree[:, None]) / 2
    return SPREAD * xy


def _layout_arrays(i, j, w, xy, epochs):
    n = len(xy)
    degree = _sum(i, w, n)
    me = np.arange(n)
    for epoch in range(epochs):
        d = xy[i] - xy[j]
        d2 = np.maximum((d * d).sum(1), 1e-12)
        pull = (-2 * A * B * d2 ** (B - 1) / (1 + A * d2 ** B))[:, None] * d
        pull = np.clip(pull, -MOST_FORCE, MOST_FORCE) * w[:, None]
        move = 2 * np.stack([_sum(i, pull[:, c], n) for c in range(2)], 1) / degree[:, None]
        for draw in range(NEGATIVES):
            other = _drawn(me, epoch * NEGATIVES + draw, n, np.mod)
            d = xy - xy[other]
            d2 = (d * d).sum(1)
            push = np.clip((2 * B / ((0.001 + d2) * (1 + A * d2 ** B)))[:, None] * d, -MOST_FORCE, MOST_FORCE)
            move += np.where((other == me)[:, None], 0.0, push)
        xy = xy + (1 - epoch / epochs) * move
    return xy


# the same rounds on tables: links (i, j, w), places (i, x, y)

def _start_tables(links, xy, rounds):
    for step in range(rounds + 1):
        at = xy.join(links.groupBy("i").agg(F.sum("w").alias("g")), "i")
        x, y, g = F.col("x"), F.col("y"), F.col("g")
        s = at.agg(F.sum(g).alias("n"), F.sum(g * x).alias("x"), F.sum(g * y).alias("y"), F.sum(g * x * x).alias("xx"), F.sum(g * x * y).alias("xy"),
                   F.sum(g * y * y).alias("yy")).first().asDict()
        mean, turn = _turn(s)
        a, b = x - float(mean[0]), y - float(mean[1])
        xy = at.select("i", (a * float(turn[0, 0]) + b * float(turn[1, 0])).alias("x"), (a * float(turn[0, 1]) + b * float(turn[1, 1])).alias("y"))
        if step < rounds:
            other = xy.select(F.col("i").alias("j"), F.col("x").alias("u"), F.col("y").alias("v"))
            step_to = links.join(other, "j").groupBy("i").agg((F.sum(F.col("w") * F.col("u")) / F.sum("w")).alias("u"), (F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))
            xy = materialize(xy.join(step_to, "i").select("i", ((x + F.col("u")) / 2).alias("x"), ((y + F.col("v")) / 2).alias("y")), "walk")
    return materialize(xy.select("i", (SPREAD * F.col("x")).alias("x"), (SPREAD * F.col("y")).alias("y")), "start")


def _layout_tables(links, xy, epochs, n):
    def clipped(force, d):
        return F.greatest(F.lit(-MOST_FORCE), F.least(F.lit(MOST_FORCE), force * d))

    a, b = F.col("x") - F.col("u"), F.col("y") - F.col("v")
    for epoch in range(epochs):
        other = xy.select(F.col("i").alias("j"), F.col("x").alias("u"), F.col("y").alias("v"))
        near = links.join(xy, "i").join(other, "j")
        d2 = F.greatest(a * a + b * b, F.lit(1e-12))
        force = -2 * A * B * F.pow(d2, B - 1) / (1 + A * F.pow(d2, F.lit(B)))
        pull = near.groupBy("i").agg((2 * F.sum(F.col("w") * clipped(force, a)) / F.sum("w")).alias("a"), (2 * F.sum(F.col("w") * clipped(force, b)) / F.sum("w")).alias("b"))
        draws = xy.select("*", F.explode(F.sequence(F.lit(epoch * NEGATIVES).cast("bigint"), F.lit(epoch * NEGATIVES + NEGATIVES - 1).cast("bigint"))).alias("t"))
        draws = draws.withColumn("j", _drawn(F.col("i"), F.col("t"), F.lit(n), F.pmod)).where(F.col("i") != F.col("j"))
        d2 = a * a + b * b
        force = 2 * B / ((0.001 + d2) * (1 + A * F.pow(d2, F.lit(B))))
        push = draws.join(other, "j").groupBy("i").agg(F.sum(clipped(force, a)).alias("c"), F.sum(clipped(force, b)).alias("d"))
        rate, nothing = 1 - epoch / epochs, F.lit(0.0)
        xy = materialize(xy.join(pull, "i", "left").join(push, "i", "left").select(
            "i", (F.col("x") + rate * (F.coalesce("a", nothing) + F.coalesce("c", nothing))).alias("x"),
            (F.col("y") + rate * (F.coalesce("b", nothing) + F.coalesce("d", nothing))).alias("y")), "layout")
    return xy


def neighbour_layout(emb: DataFrame, unit: str = "docid", vec_col: str = "embedding", k: int = 10, epochs: int = 100, rounds: int = 20,
                     pivots: int = N.MOST_PIVOTS) -> DataFrame:
    """(unit, x, y) of every row with a direction; fewer than three distinct vectors get the places of their components."""
    from topicspark.operators.model import reduce_2d
    spark = emb.sparkSession
    units = materialize(N.unit_vectors(emb, unit, vec_col), "unit-vectors")
    classes, members = N.vector_classes(units, unit, k)
    n = classes.count()
    if n == 0:
        return members.select(unit, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    first = reduce_2d(classes.select("c", "v"), "c", "v") if n > 1 and units.select(F.size("v")).first()[0] > 1 else classes.select("c", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    place = materialize(dense_number(first, "c", "i").select("i", "c", "x", "y"), "places")
    if n > 2:
        number = place.select("i", "c")
        graph = fuzzy_graph(N.class_neighbours(classes, classes, k, pivots), k)
        links = materialize(graph.withColumnRenamed("i", "c").join(number, "c").drop("c").join(number.select(F.col("i").alias("to"), F.col("c").alias("j")), "j")
                            .select("i", F.col("to").alias("j"), "w"), "fuzzy-links")
        if n <= LAST_NODES:
            e, p = links.toArrow(), place.select("i", "x", "y").toArrow()
            i, j, w = (e.column(c).to_numpy() for c in "ijw")
            order = np.lexsort((j, i))
            i, j, w = i[order], j[order], w[order]
            xy = np.stack([p.column("x").to_numpy(), p.column("y").to_numpy()], 1)[np.argsort(p.column("i").to_numpy())]
            xy = _layout_arrays(i, j, w, _start_arrays(i, j, w, xy, rounds), epochs)
            done = spark.createDataFrame(pa.table({"i": np.arange(n), "x": xy[:, 0], "y": xy[:, 1]}))
        else:
            done = _layout_tables(links, _start_tables(links, place.select("i", "x", "y"), rounds), epochs, n)
        place = done.join(number, "i")
    return members.join(place.select("c", "x", "y"), "c").select(unit, "x", "y")

"""Approximate nearest neighbours by learned partitions (operator 11).

Nearness is the inner product.  A sample of at most about ``FIT_ROWS`` vectors
(chosen by a hash of the vector) gives the model:

1. its neighbour graph: each vector's ``LINKS`` nearest in the sample, found in
   blocks by Spark tasks;
2. a balanced partitioning of that graph: parts start as halves along principal
   directions, then vectors move to the part that most of their neighbours are
   in while no part exceeds ``SLACK`` times the mean;
3. a small classifier (softmax regression on directions) learns which parts
   hold a vector's neighbours;
4. ``probes``: the least number of most probable parts that holds ``recall`` of
   the nearest in the sample, for a sample of the queries.

Every vector of the table is then indexed under its most probable part, and
each query is compared, exactly and in double precision, with all vectors of
its ``probes`` most probable parts - more where those hold fewer than it asks
for, so a table smaller than that is searched whole.  Vectors much longer than
the sample's (``LOUD``) are near to many queries whatever their direction; they
form a part of their own that every query visits.

Equal vectors are indexed and searched once, with the least ids that any
answer can need.  Parts in order share a cell up to a size, and a larger part
is dealt into several, on both sides, so no part is one task's work; a query is
sent once to a cell with the parts it visits there, and the cell returns
``k + 1`` rows for it.  Driver: the sample, the model, and part sizes.

Defined cases: vectors that are null, zero, empty, or hold null or non-finite
components take no part, nor do those whose length is not the most frequent
(ties: the longer) or that have no id; rows that repeat id and vector count as
one; rows of one id with different vectors are different rows, and each is a
candidate for the other; an empty table gives an empty result; other columns
are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicspark.session import materialize

FIT_ROWS = 16_384     # sample of the fit, in rows ...
FIT_BYTES = 64 << 20  # ... and in bytes
TRY_ROWS = 1_024      # sample of the queries that set the probes
LINKS = 10
SLACK = 1.05
ROWS_PER_PART = 512
MOST_PARTS = 256
LOUD = 1.25           # times the length that 95 percent of the sample don't exceed
CELL_BYTES = 4 << 20


# model, on the sample

def halves(x: np.ndarray, parts: int) -> np.ndarray:
    """Equal parts by repeated halving along the principal direction of each piece; ``parts`` is a power of two."""
    label = np.zeros(len(x), np.int64)
    width = 1
    while width < parts:
        for p in range(width):
            own = np.flatnonzero(label == p)
            y = x[own] - x[own].mean(0)
            along = y @ np.linalg.eigh(y.T @ y)[1][:, -1]
            label[own[np.argsort(along, kind="stable")[len(own) // 2:]]] += width
        width *= 2
    return label


def balanced_parts(links: np.ndarray, label: np.ndarray, parts: int, slack: float = SLACK) -> np.ndarray:
    """Move vectors to the part of most of their neighbours, parts staying balanced, until fewer links can't be cut."""
    n, g = links.shape
    room = int(np.ceil(slack * n / parts))
    a = np.r_[np.repeat(np.arange(n), g), links.ravel()]
    b = np.r_[links.ravel(), np.repeat(np.arange(n), g)]

    def inside(label):
        return int((label[a] == label[b]).sum())

    best, held = label, inside(label)
    while True:
        label = best.copy()
        near = np.bincount(a * parts + label[b], minlength=n * parts).reshape(n, parts)
        want = near.argmax(1)
        gain = near[np.arange(n), want] - near[np.arange(n), label]
        size = np.bincount(label, minlength=parts)
        waiting = [i for i in np.argsort(-gain, kind="stable").tolist() if gain[i] > 0]
        moved = True
        while waiting and moved:  # a move makes room for others
            later = []
            for i in waiting:
                if size[want[i]] < room:
                    size[label[i]] -= 1
                    size[want[i]] += 1
                    label[i] = want[i]
                else:
                    later.append(i)
            moved = len(later) < len(waiting)
            waiting = later
        now = inside(label)
        if now <= held:
            return best
        best, held = label, now


def direction(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)
    x = x / top
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def train(x: np.ndarray, share: np.ndarray, epochs: int = 30, batch: int = 512, rate: float = 0.1) -> np.ndarray:
    """Weights of a softmax regression from directions (and 1) to the shares of the parts, by Adam in a fixed order."""
    x = np.c_[direction(x), np.ones(len(x))]
    w, first, second, step = np.zeros((x.shape[1], share.shape[1])), 0.0, 0.0, 0
    rng = np.random.default_rng(0)
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            own = order[at:at + batch]
            z = x[own] @ w
            z = np.exp(z - z.max(1, keepdims=True))
            grad = x[own].T @ (z / z.sum(1, keepdims=True) - share[own]) / len(own)
            step += 1
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad * grad
            w = w - rate * (1 - epoch / epochs) * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return w


@dataclass
class Router:
    """The classifier, the length above which a vector is loud, and how many parts a query visits."""

    weights: np.ndarray
    loud: float
    probes: int

    @property
    def parts(self) -> int:
        return self.weights.shape[1]

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts from the most to the least probable, for each vector."""
        return np.argsort(-(np.c_[direction(x), np.ones(len(x))] @ self.weights), axis=1, kind="stable")

    def home(self, x: np.ndarray) -> np.ndarray:
        """The part a vector is indexed under; ``parts`` for the loud ones."""
        return np.where(np.sqrt((x * x).sum(1)) > self.loud, self.parts, self.order(x)[:, 0])


def nearest(q: np.ndarray, x: np.ndarray, k: int, same: np.ndarray | None = None, block: int = 128) -> np.ndarray:
    """Places in x of the k largest inner products of each q, without place same[i] of q[i] (-1: none)."""
    out = []
    for at in range(0, len(q), block):
        s = q[at:at + block] @ x.T
        if same is not None:
            own = same[at:at + block]
            s[np.flatnonzero(own >= 0), own[own >= 0]] = -np.inf
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
    return np.concatenate(out) if out else np.zeros((0, k), np.int64)


def fit_parts(x: np.ndarray, links: np.ndarray, parts: int) -> np.ndarray:
    """Weights of the classifier over a balanced partitioning of the neighbour graph."""
    label = balanced_parts(links, halves(direction(x), parts), parts)
    near = np.c_[label[links], label]  # a vector's own part counts as a neighbour's
    share = np.bincount((np.arange(len(x))[:, None] * parts + near).ravel(), minlength=len(x) * parts).reshape(-1, parts) / near.shape[1]
    return train(x, share)


def probes_for(router: Router, q: np.ndarray, x: np.ndarray, near: np.ndarray, recall: float) -> int:
    """The least number of parts that hold this share of the nearest."""
    home = router.home(x)
    place = np.argsort(router.order(q), axis=1)
    place = np.c_[place, np.full(len(q), -1)]  # the loud part is always visited
    depth = place[np.arange(len(q))[:, None], home[near]].ravel()
    held = np.cumsum(np.bincount(depth + 1, minlength=router.parts + 1)) / max(1, len(depth))
    return max(1, int(np.argmax(held >= recall)))


# tables

def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    c = F.col(vec_col)
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    good = vectors.filter(F.col(id_col).isNotNull() & c.isNotNull() & ~bad & F.exists(c, lambda v: v != 0))
    top = good.groupBy(F.size(c).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    v = F.transform(c, lambda v: v.cast("double") + F.lit(0.0))
    return good.filter(F.size(c) == (top["dims"] if top else 0)).select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"))


def _matrix(column, dims: int | None = None) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(flat):
        return np.zeros((0, dims or 0))
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _sample(frame: DataFrame, rows: int, total: int) -> np.ndarray:
    """About ``rows`` of the ``total`` vectors, the same ones whatever the partitions."""
    grain = 1 << 30
    part = min(grain, -(-rows * grain // max(1, total)))
    x = _matrix(frame.filter(F.pmod(F.xxhash64("v"), F.lit(grain)) < part).select("v").toArrow().column(0))
    return x[np.lexsort(x.T[::-1])] if len(x) else x


def fit(distinct: DataFrame, queries: DataFrame, k: int, recall: float = 0.95, rows_per_part: int = ROWS_PER_PART, fit_rows: int = FIT_ROWS) -> Router:
    """The model of distinct vectors (v), with probes for ``queries`` (v)."""
    spark = distinct.sparkSession
    n, dims = distinct.agg(F.count("*"), F.first(F.size("v"))).first()
    fit_rows = min(fit_rows, FIT_BYTES // (8 * (dims or 1)))
    x = _sample(distinct, fit_rows, n)
    parts = min(MOST_PARTS, n // rows_per_part, len(x) // (4 * LINKS))
    parts = 1 << (parts.bit_length() - 1) if parts > 1 else 1
    if parts == 1 or len(x) <= k:
        return Router(np.zeros(((dims or 0) + 1, 1)), np.inf, 1)
    size = np.sqrt((x * x).sum(1))
    loud = LOUD * float(np.quantile(size, 0.95))
    shared = spark.sparkContext.broadcast(x)

    def graph(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in b.column(0).to_pylist():
                own = np.arange(at, min(at + 512, len(shared.value)))
                near = nearest(shared.value[own], shared.value, LINKS, own)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(near.tolist(), pa.list_(pa.int64()))], names=["i", "near"])

    rows = spark.range(0, len(x), 512, -(-len(x) // 512)).mapInArrow(graph, "i bigint, near array<bigint>").toArrow()
    links = _matrix(rows.column(1))[np.argsort(rows.column(0).to_numpy())]
    router = Router(fit_parts(x, links, parts), loud, parts)
    q = _sample(queries, TRY_ROWS, queries.count())
    place = {v.tobytes(): i for i, v in enumerate(x)}
    near = nearest(q, x, k, np.array([place.get(v.tobytes(), -1) for v in q], np.int64))
    router.probes = probes_for(router, q, x, near, recall) if len(q) else 1
    return router


def classes(points: DataFrame, k: int) -> DataFrame:
    """(v, ids): each distinct vector with its k + 1 least ids, all that an answer of k can need."""
    ranked = points.distinct().withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("at") <= k + 1)
    return ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def indexed(distinct: DataFrame, router: Router) -> DataFrame:
    """The classes with the part each is indexed under."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(router.home(_matrix(b.column(0))), pa.int32()), *b.columns], names=["part", "v", "ids"])

    return distinct.select("v", "ids").mapInArrow(run, "part int, v array<double>, ids array<bigint>")


def bins_of(sizes: np.ndarray, cell: int) -> np.ndarray:
    """The bin of each part: parts in order fill a bin up to ``cell`` vectors, a larger part has one alone."""
    out, now, held = [], 0, 0
    for n in sizes.tolist():
        if held and held + n > cell:
            now, held = now + 1, 0
        out.append(now)
        held += n
    return np.array(out)


def routed(queries: DataFrame, router: Router, sizes: np.ndarray, bins: np.ndarray, k: int) -> DataFrame:
    """(q, v, bin, parts): the parts each query visits, a row for each bin; as many as hold k + 1 vectors, where there are that many."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            order = router.order(_matrix(b.column(1)))
            seen = np.cumsum(sizes[order], axis=1) + sizes[router.parts]
            need = np.maximum(router.probes, 1 + np.where(seen[:, -1] > k, np.argmax(seen > k, axis=1), router.parts - 1))
            visits = []
            for o, m in zip(order, need.tolist(), strict=True):
                own = np.sort(np.r_[router.parts, o[:m]])
                own = own[sizes[own] > 0]
                at = bins[own]
                visits.append([{"bin": int(at[x[0]]), "parts": own[x].tolist()} for x in np.split(np.arange(len(own)), np.flatnonzero(np.diff(at)) + 1) if len(x)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(visits, kind)], names=["q", "v", "visits"])

    kind = pa.list_(pa.struct([("bin", pa.int32()), ("parts", pa.list_(pa.int32()))]))
    rows = queries.select("q", "v").mapInArrow(run, "q bigint, v array<double>, visits array<struct<bin:int,parts:array<int>>>")
    return rows.select("q", "v", F.explode("visits").alias("x")).select("q", "v", "x.bin", "x.parts")


def _cell(k: int):
    """Compare the queries of a cell with its vectors: the k + 1 nearest rows of each query."""
    schema = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("same", pa.bool_())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        number, q, x = left.column("q").to_numpy(), _matrix(left.column("v")), _matrix(right.column("v"))
        if not len(q) or not len(x):
            return schema.empty_table()
        ids, parts = right.column("ids").combine_chunks(), left.column("parts").combine_chunks()
        many = np.diff(ids.offsets.to_numpy())
        begin, ids = np.cumsum(many) - many, ids.flatten().to_numpy()
        visitor, visited = np.repeat(np.arange(len(q)), np.diff(parts.offsets.to_numpy())), parts.flatten().to_numpy()
        home = right.column("part").to_numpy()
        out = []
        for p in np.unique(visited):
            here, who = np.flatnonzero(home == p), visitor[visited == p]
            if not len(here):
                continue
            y = x[here]
            top = min(k + 1, len(y))
            size = np.sqrt((y * y).sum(1)).max()
            for at in range(0, len(who), 128):
                part = q[who[at:at + 128]]
                s = part @ y.T
                least = -np.partition(-s, top - 1, axis=1)[:, top - 1] - 1e-12 * size * np.sqrt((part * part).sum(1))
                row, col = np.nonzero(s >= least[:, None])
                out.append((who[at + row], here[col]))
        if not out:
            return schema.empty_table()
        row, col = (np.concatenate(c) for c in zip(*out, strict=True))
        score = np.zeros(len(row))
        for d in range(x.shape[1]):  # one order of summation everywhere
            score += q[row, d] * x[col, d]
        order = np.lexsort((-score, row))  # no more than k + 1 classes and their ties matter
        row, col, score = row[order], col[order], score[order]
        last = np.minimum(np.searchsorted(row, row) + k, np.searchsorted(row, row, "right") - 1)
        near = score >= score[last]
        row, col, score = row[near], col[near], score[near]
        same = (q[row] == x[col]).all(1)
        each = np.repeat(np.arange(len(row)), many[col])
        vec_id = ids[np.arange(len(each)) - np.repeat(np.cumsum(many[col]) - many[col], many[col]) + begin[col][each]]
        order = np.lexsort((vec_id, -score[each], row[each]))
        owner = row[each][order]
        keep = order[np.arange(len(owner)) - np.searchsorted(owner, owner) <= k]
        return pa.table([number[row[each[keep]]], vec_id[keep], score[each[keep]], same[each[keep]]], schema=schema)

    return run


def search(index: DataFrame, queries: DataFrame, router: Router, k: int) -> DataFrame:
    """(q, near array<struct<rank, vec_id, score, same>>): the k + 1 nearest rows found for each query (q, v)."""
    spark = index.sparkSession
    sizes = np.zeros(router.parts + 1, np.int64)
    for r in index.groupBy("part").count().collect():
        sizes[r["part"]] = r["count"]
    dims = queries.agg(F.first(F.size("v"))).first()[0] or 1
    cell = max(k + 1, CELL_BYTES // (8 * dims))
    bins = bins_of(sizes, cell)
    visits = materialize(routed(queries, router, sizes, bins, k), "visits")
    asked = {r["bin"]: r["count"] for r in visits.groupBy("bin").count().collect()}  # at most a row a part
    held = np.bincount(bins, sizes)
    plan = spark.createDataFrame([(p, int(b), -(-int(held[b]) // cell), -(-asked[b] // cell)) for p, b in enumerate(bins.tolist()) if sizes[p] and b in asked],
                                 "part int, bin int, chunks bigint, slices bigint")
    here = index.join(F.broadcast(plan), "part").select("bin", "part", "v", "ids", F.pmod(F.xxhash64("v"), F.col("chunks")).alias("chunk"),
                                                        F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    there = visits.join(F.broadcast(plan.drop("part").distinct()), "bin").select(
        "bin", "q", "v", "parts", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod("q", F.col("slices")).alias("slice"))
    cells = ["bin", "chunk", "slice"]
    found = there.groupBy(*cells).cogroup(here.groupBy(*cells)).applyInArrow(_cell(k), "q bigint, vec_id bigint, score double, same boolean")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k + 1)
    return best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score", "same"))).alias("near"))


def neighbours(points: DataFrame, asked: DataFrame, k: int = 20, recall: float = 0.95, rows_per_part: int = ROWS_PER_PART, exhaustive: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): up to k nearest rows of ``points`` for each row of ``asked``, a subset of it.

    ``exhaustive`` visits every part (brute force through the same tables).
    """
    distinct = materialize(classes(points, k), "vector-classes")
    rows = asked.distinct()
    queries = materialize(rows.select("v").distinct().withColumn("q", F.monotonically_increasing_id()), "query-vectors")
    router = fit(distinct, queries, k, recall, rows_per_part)
    if exhaustive:
        router.probes = router.parts
    near = search(materialize(indexed(distinct, router), "vector-index"), queries, router, k)
    listed = rows.join(queries, "v").select(F.col("vec_id").alias("query_id"), "q").join(near, "q")
    others = F.slice(F.filter("near", lambda r: ~(r["same"] & (r["vec_id"] == F.col("query_id")))), 1, k)
    return listed.select("query_id", F.posexplode(others).alias("at", "r")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("r.vec_id").alias("vec_id"), F.col("r.score").alias("score"))


def neighbour_report(vectors: DataFrame, k: int = 20, every: int = 20, recall: float = 0.95) -> DataFrame:
    """The k nearest found for every row whose id is divisible by ``every``."""
    points = usable(vectors)
    return neighbours(points, points.filter(F.col("vec_id") % every == 0), k, recall)

"""N-gram Jaccard join by vertical partitioning (operator 3).

A document's set is its distinct word shingles.  Equal sets form a class, and
only one document of a class takes part in the join:

1. *Which classes can have a partner.*  Of its n shingles in hash order a set
   shows the first n - ceil(t n) + j.  Two sets t alike share ceil(t n) or
   more, so they show each other j shingles in common (j of the smaller set).
   Classes that show fewer which another class shows too are done.
2. *Global order.*  Over the classes left, shingles are ordered by document
   frequency, then hash.  A set whose share of shingles that others also have
   is below t is done as well; the rest are cut at pivots of the global order
   into vertical fragments, which are written.
3. *Candidates.*  Sets that can reach t share one of their rarest shingles
   (prefix filter).  Each shingle's members are first held against one of
   them (in two rounds with different choices); linked documents form
   components, and then members of *different* components that share a
   prefix shingle are compared.  Each carries its shingles as a parity map (a
   shingle flips one bit), and two maps differ in no more bits than the sets
   in shingles, so pairs that fall short of t are dropped where they meet.  So
   a large group of linked copies costs its size, near misses cost no rows,
   and no link between components is lost.
4. *Verification.*  Partial overlaps are counted per vertical fragment and
   summed per pair.

Defined cases: null or empty texts have an empty set and no links; a text with
fewer words than a shingle has one shingle, the whole sequence; rows that
repeat a doc_id stand for themselves; a row without doc_id shares the
component of equal sets with an id, else its component is null; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import bounded, free_names, texts
from topicspark.llm.components import connected_components
from topicspark.llm.rolling import BASES, Words, mix, rolling
from topicspark.session import materialize

SALTS = 8
BITS_A_KEY = 8  # bits of a parity map for each shingle, at least half of it


def shown(n: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles in hash order that a set of n shows, how many of them a set t percent alike shows too)."""
    least = -(-n * t // 100)  # what the smallest such set holds, and what both share
    return n - least + n // 16 + 1, least // 16 + 1


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash): the distinct shingles of each text, in order."""
    base = words.hashes()
    whole = np.flatnonzero(words.inside(n)) if len(words) >= n else np.zeros(0, np.int64)
    owner, key = words.owners()[whole], mix(rolling(base, n) + np.uint64(n))[whole]
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        one = np.array([rolling(base[a:b], b - a, BASES[1])[0] for a, b in zip(words.bounds[short], words.bounds[short + 1])], np.uint64)
        owner = np.concatenate([owner, short])
        key = np.concatenate([key, mix(one ^ mix(words.counts[short].astype(np.uint64)))])
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
    return owner[new], key[new]


def document_sets(docs: DataFrame, n: int, t: int) -> DataFrame:
    """(doc_id, body, n_shingles, cid, sig, head, least) of each row; cid and sig name the set, body the text.

    ``head`` holds the shingles shown, of which a class with a partner shows ``least`` in common with others.
    """
    def run(batches):
        for b in bounded(batches, "text", 4 << 20):
            words = Words(b.column("text").to_pylist(), lower=True)
            owner, key = shingle_sets(words, n)
            size = np.bincount(owner, minlength=b.num_rows)
            at = np.searchsorted(owner, np.arange(b.num_rows + 1))
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(key ^ np.uint64(x)), dtype=np.uint64)]) for x in BASES]
            one, two = ((s[at[1:]] - s[at[:-1]]) for s in sums)
            cid = mix(one ^ mix(size.astype(np.uint64))).view(np.int64)
            show, least = shown(size, t)
            show = np.where(size > 0, np.minimum(show, size), 0)
            head = key[np.arange(len(key)) - at[owner] < show[owner]]
            offsets = np.concatenate([[0], np.cumsum(show)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("body"), pa.array(size, pa.int64()), pa.array(cid), pa.array(two.view(np.int64)),
                 pa.ListArray.from_arrays(offsets, pa.array(head.view(np.int64))), pa.array(least, pa.int64())],
                ["doc_id", "body", "n_shingles", "cid", "sig", "head", "least"])
    return texts(docs).withColumn("body", F.xxhash64("text")).mapInArrow(run, "doc_id bigint, body bigint, n_shingles bigint, cid bigint, sig bigint, head array<bigint>, least bigint")


def _class_keys(docs: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """(cid, keys): the shingles of each class, from the text of its first document."""
    wanted = texts(docs).join(classes.select(F.col("rep").alias("doc_id"), "cid"), "doc_id")

    def run(batches):
        for b in bounded(batches, "text", 4 << 20):
            words = Words(b.column("text").to_pylist(), lower=True)
            owner, key = shingle_sets(words, n)
            size = np.bincount(owner, minlength=b.num_rows)
            at = np.searchsorted(owner, np.arange(b.num_rows + 1))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(key ^ np.uint64(BASES[0])), dtype=np.uint64)])
            cid = mix((sums[at[1:]] - sums[at[:-1]]) ^ mix(size.astype(np.uint64))).view(np.int64)
            mine = cid == b.column("cid").to_numpy()  # a repeated doc_id may bring another text
            offsets = np.concatenate([[0], np.cumsum(size[mine])]).astype(np.int32)
            keys = pa.ListArray.from_arrays(offsets, pa.array(key[mine[owner]].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(cid[mine]), keys], ["cid", "keys"])
    return wanted.select("cid", "text").mapInArrow(run, "cid bigint, keys array<bigint>").groupBy("cid").agg(F.first("keys").alias("keys"))


def _parity(keys: np.ndarray) -> np.ndarray:
    """The parity map of a set as 64-bit words, a power of two in number: each key flips one bit."""
    bits = 64 << (BITS_A_KEY * len(keys) // 128).bit_length()
    cell = (mix(keys.view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=bits) & 1).astype(np.uint8), bitorder="little").view("<i8")


def _with_parity(sets: DataFrame) -> DataFrame:
    """(cid, ahead, map): prefixes and parity maps of the sets ``keys``."""
    def run(batches):
        for b in batches:
            maps = [_parity(np.array(k, np.int64)) for k in b.column("keys").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("ahead"), pa.array(maps, pa.list_(pa.int64()))], ["cid", "ahead", "map"])
    return sets.select("cid", "ahead", "keys").mapInArrow(run, "cid bigint, ahead array<bigint>, map array<bigint>")


def _differing(a: str, b: str):
    """Bits in which two parity maps differ: at most the keys that only one set has.

    A map of twice the length is folded; maps further apart aren't compared (0).
    """
    def bits(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("int")), F.lit(0), lambda s, v: s + v)

    def folded(x):
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    na, nb = F.size(a), F.size(b)
    return F.when(na == nb, bits(F.col(a), F.col(b))).when(na == 2 * nb, bits(folded(a), F.col(b))).when(2 * na == nb, bits(F.col(a), folded(b))).otherwise(0)


def _overlaps(pairs: DataFrame, vectors: DataFrame, t: int) -> DataFrame:
    """Of (a, b) pairs with sizes na, nb, those at least t percent alike.  Partial overlaps are summed per pair."""
    salted = vectors.select(F.col("cid").alias("a"), "piece", F.col("keys").alias("ka"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    other = vectors.select(F.col("cid").alias("b"), "piece", F.col("keys").alias("kb"))
    wide = pairs.withColumn("salt", F.pmod(F.hash("b"), F.lit(SALTS))).join(salted, ["a", "salt"]).join(other, ["b", "piece"])
    part = wide.select("a", "b", "na", "nb", F.size(F.array_intersect("ka", "kb")).alias("part"))
    summed = part.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
    return summed.filter(F.lit(100) * F.col("both") >= F.lit(t) * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _can_reach(t: int):
    """Sizes alike enough, and enough shingles (sa, sb) that other sets also have."""
    sizes = F.lit(100) * F.least("na", "nb") >= F.lit(t) * F.greatest("na", "nb")
    return sizes & (F.lit(100 + t) * F.least("sa", "sb") >= F.lit(t) * (F.col("na") + F.col("nb")))


def jaccard_links(docs: DataFrame, n: int = 3, t: int = 90, pieces: int = 4) -> tuple[DataFrame, DataFrame]:
    """(members, components): each row's class, and (cid, component) of classes that are linked.

    ``members`` has doc_id, body, n_shingles, cid, sig; a component is named by one
    of its class ids.
    """
    sets = materialize(document_sets(docs, n, t), "sets")
    known = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(known.groupBy("cid", "sig").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n_shingles", "head", "least")]), "classes")

    # 1: classes that show enough shingles which another one shows too
    rows = classes.select("cid", "least", F.explode("head").alias("key"))
    shared = rows.groupBy("key").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).filter("lo < hi").select("key")
    involved = materialize(rows.join(shared, "key").groupBy("cid", "least").agg(F.count("*").alias("seen")).filter("seen >= least").select("cid").distinct(), "involved")
    part = classes.select("cid", "rep", F.col("n_shingles").alias("n")).join(involved, "cid")

    # 2: global order over these, and the sets cut at its pivots
    keys = materialize(_class_keys(docs, part, n), "class-keys").select("cid", F.explode("keys").alias("key"))
    frequency = keys.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    common = keys.join(frequency, "key").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"))
    common = materialize(part.join(common, "cid").filter(F.lit(100) * F.size("keys") >= F.lit(t) * F.col("n")), "ordered-sets")
    place = F.expr("k.df + (shiftrightunsigned(k.key, 11) / 9007199254740992D)")
    flat = common.select("cid", "n", F.explode("keys").alias("k")).withColumn("place", place)
    steps = ", ".join(str(i / pieces) for i in range(1, pieces))
    pivots = flat.agg(F.expr(f"percentile_approx(place, array({steps}), 1000)")).first()[0] or []
    piece = sum((F.when(F.col("place") > F.lit(p), 1).otherwise(0) for p in pivots), F.lit(0))
    vectors = materialize(flat.groupBy("cid", piece.alias("piece")).agg(F.collect_list("k.key").alias("keys")), "vertical-fragments")

    # 3: the prefix in the global order; unshared shingles come first in it and are left out here
    prefix = (F.size("keys") - F.ceil(F.col("n") * t / 100) + 1).cast("int")
    heads = common.filter(prefix > 0).select("cid", "n", F.size("keys").alias("s"), F.explode(F.slice("keys.key", F.lit(1), prefix)).alias("key"))
    heads = materialize(heads, "prefixes")
    links = None
    for turn in (0, 1):
        order = F.struct(F.xxhash64("cid", F.lit(turn)), F.col("cid").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
        hub = heads.groupBy("key").agg(F.min(order).alias("hub"), F.count("*").alias("held")).filter("held > 1").select("key", "hub.a", "hub.na", "hub.sa")
        pairs = heads.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"), "key").join(hub, "key").filter(F.col("a") != F.col("b")).filter(_can_reach(t))
        found = materialize(_overlaps(pairs.select("a", "b", "na", "nb").distinct(), vectors, t), "links")
        links = found if links is None else links.unionAll(found)
    parts = materialize(connected_components(links), "components")

    # what is still apart but shares a prefix shingle
    placed = heads.join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    apart = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    placed = materialize(placed.join(apart, "key"), "apart")
    some = common.join(placed.select("cid").distinct(), "cid").select("cid", F.slice("keys.key", F.lit(1), prefix).alias("ahead"), F.col("keys.key").alias("keys"))
    placed = placed.join(_with_parity(some), "cid")
    one, two = (placed.select("key", *[F.col(c).alias(d + x) for c, d in (("cid", ""), ("n", "n"), ("s", "s"), ("root", "r"), ("ahead", "h"), ("map", "m"))]) for x in "ab")
    # the overlap is at most half of what the sizes leave after the bits that differ; a pair is taken at its first common shingle
    near = F.lit(100 + t) * (F.col("sa") + F.col("sb") - _differing("ma", "mb")) >= F.lit(2 * t) * (F.col("na") + F.col("nb"))
    first = F.element_at(F.array_intersect("ha", "hb"), 1) == F.col("ka")
    close = (F.col("ra") != F.col("rb")) & (F.col("a") < F.col("b")) & _can_reach(t) & near & first
    rest = one.withColumnRenamed("key", "ka").join(two.withColumnRenamed("key", "kb"), (F.col("ka") == F.col("kb")) & close)
    links = links.unionAll(_overlaps(rest.select("a", "b", "na", "nb").distinct(), vectors, t))
    return sets.select("doc_id", "body", "n_shingles", "cid", "sig"), connected_components(links).withColumnRenamed("node", "cid").withColumnRenamed("root", "component")


def jaccard_components(docs: DataFrame, n: int = 3, t: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per document; the component is its smallest doc_id."""
    members, parts = jaccard_links(docs, n, t)
    known = members.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    least = known.groupBy("cid").agg(F.min("doc_id").alias("rep")).join(parts, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = least.groupBy("component").agg(F.min("rep").alias("component_id"))
    names = least.join(named, "component").select("cid", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = members.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS))).join(names, ["cid", "salt"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", own.alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, t: int = 80) -> DataFrame:
    """One row of each component, with all columns, and all rows without doc_id or words.

    It is the row with the smallest doc_id; of rows that repeat this doc_id,
    one.  Rows are told apart by doc_id and text.
    """
    members, parts = jaccard_links(docs, n, t)
    known = members.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("cid", F.struct("doc_id", "body").alias("me"))
    least = known.groupBy("cid").agg(F.min("me").alias("rep")).join(parts, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = least.groupBy("component").agg(F.min("rep").alias("keep"))
    names = least.join(named, "component").select("cid", "keep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = known.withColumn("salt", F.pmod(F.hash("me"), F.lit(SALTS))).join(names, ["cid", "salt"])
    key, at, text, gone = free_names(docs, "__body", "__id", "__text", "__gone")
    marks = rows.groupBy("me").agg(F.count("*").alias("n"), F.first(F.col("me") != F.col("keep")).alias(gone)).filter(F.col(gone) | (F.col("n") > 1))
    marks = materialize(marks.select(F.col("me.doc_id").alias(at), F.col("me.body").alias(text), gone), "near-copies")
    marked = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    same = (marked["doc_id"].cast("bigint") == F.col(at)) & (marked[key] == F.col(text))
    again = marked.join(marks.filter(~F.col(gone)), same, "left_semi").dropDuplicates(["doc_id", key])  # the kept row, more than once
    return marked.join(marks, same, "left_anti").unionAll(again).drop(key)

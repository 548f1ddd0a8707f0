"""Substring deduplication by window hashes (operator 4).

Every window of ``size`` consecutive words of one document has a Rabin-Karp
hash.  A window whose words also start in a document with a smaller id is
removed; windows that overlap or touch merge into maximal intervals.

Only windows that can repeat are sent through a shuffle.  A window's anchor is
the least hash among the ``gram``-word spans inside it, so equal windows have
equal anchors and a window whose anchor stands in one document alone can't
repeat.  Documents are dealt into slices by a hash; a slice sends each of its
anchors, and later each window hash (128 bits), once, with the least and the
greatest document id that has it.  So a passage that a third of all documents
share costs one row a slice, and no key gathers documents.

Defined cases: null or empty text has no words (kept text is empty); a null
doc_id ranks after every other id; rows that repeat a doc_id have equal rank,
so neither removes words of the other; texts shorter than the window stay
whole; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from topicspark.llm.rolling import BASES, Words, extremes, mix, rolling, sliding_min

LAST = (1 << 63) - 1


def _sliced(docs: DataFrame, carry: list[str], docs_per_slice: int) -> DataFrame:
    """(slice, rank, text, row): rows dealt to slices of about ``docs_per_slice`` rows."""
    slices = max(1, -(-docs.count() // docs_per_slice))
    row = F.struct(*[F.col(c) for c in carry])
    out = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("rank"), F.coalesce("text", F.lit("")).alias("text"), row.alias("row"))
    return out.withColumn("slice", F.pmod(F.xxhash64("rank", "text"), F.lit(slices)))


def _windows(words: Words, size: int, gram: int, ranks: np.ndarray):
    """(start, anchor, rank) of every window of the texts."""
    grams = mix(rolling(words.hashes(), gram))
    anchor = sliding_min(grams, size - gram + 1)
    start = np.flatnonzero(words.inside(size))
    return start, anchor[start], ranks[words.owners()[start]] if len(start) else ranks[:0]


def _pair_hash(words: Words, size: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one = rolling(words.hashes(BASES[0]), size, BASES[0])[start]
    two = rolling(words.hashes(BASES[1]), size, BASES[1])[start]
    return mix(one).view(np.int64), mix(two).view(np.int64)


def repeated_windows(docs: DataFrame, size: int = 50, gram: int = 25, docs_per_slice: int = 256, carry: list[str] | None = None):
    """(slices, repeats): the dealt documents, and (slice, h1, h2, first) of each slice's repeated windows."""
    sliced = _sliced(docs, carry or ["doc_id"], docs_per_slice)
    left = sliced.groupBy("slice")

    def anchors(t: pa.Table) -> pa.Table:
        words = Words(t.column("text").to_pylist())
        _, anchor, rank = _windows(words, size, gram, t.column("rank").to_numpy())
        keys, lo, hi = extremes(anchor, rank)
        at = np.full(len(keys), t.column("slice")[0].as_py(), np.int64)
        return pa.table({"slice": at, "anchor": keys.view(np.int64), "lo": lo, "hi": hi})

    found = left.applyInArrow(anchors, "slice bigint, anchor bigint, lo bigint, hi bigint")
    each = Window.partitionBy("anchor")
    shared = found.withColumn("lo", F.min("lo").over(each)).withColumn("hi", F.max("hi").over(each)).filter("lo < hi").select("slice", "anchor")

    def windows(t: pa.Table, keys: pa.Table) -> pa.Table:
        empty = pa.table({c: pa.array([], pa.int64()) for c in ("slice", "h1", "h2", "lo", "hi")})
        if not t.num_rows or not keys.num_rows:
            return empty
        words, ranks = Words(t.column("text").to_pylist()), t.column("rank").to_numpy()
        start, anchor, rank = _windows(words, size, gram, ranks)
        have = np.isin(anchor, keys.column("anchor").to_numpy().view(np.uint64))
        start, rank = start[have], rank[have]
        h1, h2 = _pair_hash(words, size, start)
        order = np.lexsort((h2, h1))
        h1, h2, rank = h1[order], h2[order], rank[order]
        if not len(h1):
            return empty
        at = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
        return pa.table({"slice": np.full(len(at), t.column("slice")[0].as_py(), np.int64), "h1": h1[at], "h2": h2[at],
                         "lo": np.minimum.reduceat(rank, at), "hi": np.maximum.reduceat(rank, at)})

    hashed = left.cogroup(shared.groupBy("slice")).applyInArrow(windows, "slice bigint, h1 bigint, h2 bigint, lo bigint, hi bigint")
    same = Window.partitionBy("h1", "h2")
    repeats = hashed.withColumn("first", F.min("lo").over(same)).filter("first < hi").select("slice", "h1", "h2", "first")
    return sliced, repeats


def dedup_substrings(docs: DataFrame, size: int = 50, gram: int = 25, docs_per_slice: int = 256, carry: list[str] | None = None) -> DataFrame:
    """(row, n_words, n_removed, removed, kept) of every document.

    ``row`` holds the ``carry`` columns of the input, ``removed`` the maximal
    intervals (first word, word after the last), ``kept`` the remaining words
    joined by one space.
    """
    sliced, repeats = repeated_windows(docs, size, gram, docs_per_slice, carry)
    fields = sliced.schema["row"].dataType

    def cut(t: pa.Table, hits: pa.Table) -> pa.Table:
        texts = t.column("text").to_pylist()
        words, ranks = Words(texts), t.column("rank").to_numpy()
        covered = np.zeros(len(words) + 1, np.int64)
        if hits.num_rows and len(words) >= size:
            start = np.flatnonzero(words.inside(size))
            h1, h2 = _pair_hash(words, size, start)
            table = {(a, b): f for a, b, f in zip(*(hits.column(c).to_pylist() for c in ("h1", "h2", "first")))}
            maybe = np.flatnonzero(np.isin(h1, hits.column("h1").to_numpy()))
            owner = ranks[words.owners()[start[maybe]]].tolist()
            gone = [s for s, a, b, r in zip(start[maybe].tolist(), h1[maybe].tolist(), h2[maybe].tolist(), owner) if table.get((a, b), r) < r]
            np.add.at(covered, gone, 1)
            np.add.at(covered, np.array(gone, np.int64) + size, -1)
        out = np.cumsum(covered)[:-1] > 0
        n_words, n_removed, removed, kept = [], [], [], []
        bounds = words.bounds.tolist()
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            mask = out[a:b]
            every = texts[k].encode("utf-8", "surrogatepass").split()
            lost = int(mask.sum())
            n_words.append(b - a)
            n_removed.append(lost)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).tolist() if lost else []
            removed.append([{"start": s, "end": e} for s, e in zip(edge[0::2], edge[1::2])])
            kept.append(b" ".join([w for w, m in zip(every, mask.tolist()) if not m] if lost else every).decode("utf-8", "surrogatepass"))
        interval = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        return pa.table({"row": t.column("row"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                         "removed": pa.array(removed, pa.list_(interval)), "kept": pa.array(kept, pa.string())})

    interval = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
    schema = StructType([StructField("row", fields), StructField("n_words", LongType()), StructField("n_removed", LongType()),
                         StructField("removed", ArrayType(interval)), StructField("kept", StringType())])
    return sliced.groupBy("slice").cogroup(repeats.groupBy("slice")).applyInArrow(cut, schema)


def removal_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    out = dedup_substrings(docs)
    return out.select(F.col("row.doc_id").cast("bigint").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, with repeated passages cut out of ``text`` (and ``n_chars`` counted anew)."""
    columns = docs.columns
    out = dedup_substrings(docs, carry=columns)
    lost = F.col("n_removed") > 0
    fresh = {"text": F.when(lost, F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in columns:
        fresh["n_chars"] = F.when(lost, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])

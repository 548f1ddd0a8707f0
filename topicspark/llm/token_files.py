"""Token files compressed by Re-Pair grammars (operator 7).

Documents are encoded, closed with an end id, and written in ascending doc_id
order as shards.  A shard's ids are compressed by Re-Pair: frequent pairs of
neighbouring ids are replaced by nonterminals, again and again, until no pair
is frequent; rules, their expansion lengths, and each document's place in the
compressed sequence are stored, so that one document can be decoded alone.
Pairs never reach across two documents.

File format: Parquet, one row a shard (a file of a few rows for each range of
doc_ids): ``part`` and ``shard`` (order), ``before`` (ids of the part before
the shard), ``doc_ids``, ``sizes`` (ids of each
document), ``at`` (place of each document's first symbol), ``symbols`` (the
compressed sequence), ``left``/``right`` (rules; nonterminal k is ``first`` +
k), ``lengths`` (expansion length of each rule).  Integer columns are packed
little-endian in 4 bytes, ids of documents in 8.

Defined cases: null and empty texts are one end id; a null doc_id comes before
all others; rows that repeat a doc_id stand side by side; an empty table gives
no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.llm.common import bounded, texts
from topicspark.llm.pieces import library_table
from topicspark.llm.rolling import mix
from topicspark.session import scratch_path

BITS = 20  # pairs are counted in 2**BITS cells before the exact count


class Grammar:
    """Rules of one shard: nonterminal ``first + k`` stands for ``left[k] right[k]``."""

    def __init__(self, first: int, left: np.ndarray, right: np.ndarray):
        self.first, self.left, self.right = first, left, right
        lengths: list[int] = []
        for a, b in zip(left.tolist(), right.tolist()):
            lengths.append((lengths[a - first] if a >= first else 1) + (lengths[b - first] if b >= first else 1))
        self.lengths = np.array(lengths, np.int64)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that a run of symbols stands for."""
        out = np.asarray(symbols, np.int64)
        while len(out):
            rule = out >= self.first
            if not rule.any():
                break
            size = 1 + rule
            place = np.cumsum(size) - size
            wide = np.empty(int(size.sum()), np.int64)
            wide[place[~rule]] = out[~rule]
            k = out[rule] - self.first
            wide[place[rule]] = self.left[k]
            wide[place[rule] + 1] = self.right[k]
            out = wide
        return out


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, place of each value among them, counts): ``np.unique`` with places of 4 bytes."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    found, number = ranked[new], np.empty(len(values), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return found, number, np.diff(np.append(np.flatnonzero(new), len(values)))


def re_pair(ids: np.ndarray, owner: np.ndarray, first: int, least: int = 16) -> tuple[np.ndarray, np.ndarray, Grammar]:
    """(symbols, their documents, grammar): each round replaces all frequent pairs that don't contend for a symbol.

    ``least`` is the count from which a pair earns a rule; the strongest pair of a round
    loses no more than every second place, to itself, so rounds go on until no pair has that count.
    """
    sym, left, right = ids.astype(np.int64), [], []
    while len(sym) > 1:
        cell = (sym[:-1] * 0x9E3779B1 + sym[1:] * 0x85EBCA77) >> 7
        cell &= (1 << BITS) - 1
        cell = cell.astype(np.int32)
        inside = owner[:-1] == owner[1:]
        count = np.bincount(cell[inside], minlength=1 << BITS)
        inside &= (count >= least)[cell]
        del cell, count
        at = np.flatnonzero(inside).astype(np.int32)
        if not len(at):
            break
        pair = (sym[at] << 32) | sym[at + 1]
        found, number, times = _numbered(pair)
        # a pair takes part where it is the more frequent of the pairs it overlaps; a hash of the pair breaks ties,
        # so that no order of the ids makes one pair wait for the next, and in a run of one pair every second one takes part
        hashed = (mix(found.view(np.uint64)) >> np.uint64(40)).astype(np.int64)
        del pair, found
        order = np.arange(len(at), dtype=np.int32)
        run = np.concatenate([[False], (number[1:] == number[:-1]) & (at[1:] == at[:-1] + 1)])
        odd = (order - np.maximum.accumulate(np.where(run, 0, order))) % 2
        del order, run
        strength = np.zeros(len(sym) + 2, np.int64)
        strength[at + 1] = (np.where(times >= least, times, 0) * (1 << 24) + hashed)[number] * 2 + 1 - odd
        del odd, number, at
        here, before, after = strength[1:-1], strength[:-2], strength[2:]
        win = (here > 0) & (here >= (1 << 25)) & (here >= after) & (here > before)
        del strength, here, before, after
        pos = np.flatnonzero(win[:len(sym) - 1])
        if not len(pos):
            break
        won = (sym[pos] << 32) | sym[pos + 1]
        rules, which, uses = np.unique(won, return_inverse=True, return_counts=True)
        earn = uses >= max(2, least // 4)
        if not earn.any():
            break
        name = np.cumsum(earn) - 1 + first + sum(map(len, left))
        pos, which = pos[earn[which]], which[earn[which]]
        left.append(rules[earn] >> 32)
        right.append(rules[earn] & 0xFFFFFFFF)
        sym = sym.copy()
        sym[pos] = name[which]
        keep = np.ones(len(sym), bool)
        keep[pos + 1] = False
        sym, owner = sym[keep], owner[keep]
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right)]
    return sym, owner, Grammar(first, *flat)


FIELDS = "part int, shard int, doc_ids binary, known binary, sizes binary, at binary, first int, symbols binary, left binary, right binary, lengths binary, n_tokens bigint, before bigint"


def _shard(part: int, shard: int, docs: list, ids: list[bytes], first: int, before: int) -> dict:
    sizes = np.array([len(x) // 4 for x in ids], "<u4")
    flat = np.frombuffer(b"".join(ids), "<u4")
    symbols, owner, g = re_pair(flat, np.repeat(np.arange(len(ids)), sizes), first)
    at = np.searchsorted(owner, np.arange(len(ids)))
    return {"part": part, "shard": shard, "doc_ids": np.array([d or 0 for d in docs], "<i8").tobytes(), "known": np.array([d is not None for d in docs], np.uint8).tobytes(),
            "sizes": sizes.tobytes(), "at": at.astype("<u4").tobytes(), "first": first, "symbols": symbols.astype("<u4").tobytes(),
            "left": g.left.astype("<u4").tobytes(), "right": g.right.astype("<u4").tobytes(), "lengths": g.lengths.astype("<u4").tobytes(), "n_tokens": int(sizes.sum()), "before": before}


def write_token_files(docs: DataFrame, path: str, folder: str, end: int = 0, first: int = 1 << 17, shard_tokens: int = 1 << 20) -> None:
    """Encode all documents and write their shards to ``folder`` in ascending doc_id order."""
    def run(batches):
        from pyspark import TaskContext

        part, shard, before, held, who, ids = TaskContext.get().partitionId(), 0, 0, 0, [], []
        closing = np.array([end], "<u4").tobytes()
        schema = pa.schema([(n, {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[k]) for n, k in (f.split() for f in FIELDS.split(", "))])
        for b in bounded(batches, "text", 6 << 20):
            for doc, one in zip(b.column("doc_id").to_pylist(), library_table(path).texts(b.column("text").to_pylist())):
                who.append(doc), ids.append(one + closing)
                held += len(one) // 4 + 1
                if held >= shard_tokens:
                    yield pa.RecordBatch.from_pylist([_shard(part, shard, who, ids, first, before)], schema)
                    shard, before, held, who, ids = shard + 1, before + held, 0, [], []
        if ids:
            yield pa.RecordBatch.from_pylist([_shard(part, shard, who, ids, first, before)], schema)

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]  # a hot id is split by its texts
    texts(docs).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, FIELDS).write.parquet(folder)


def shard_documents(row: dict, wanted: list[int] | None = None):
    """(doc_id, size, ids) of a shard's documents; ``wanted`` decodes these places only."""
    u4 = lambda k: np.frombuffer(row[k], "<u4").astype(np.int64)
    g = Grammar(row["first"], u4("left"), u4("right"))
    symbols, at, sizes = u4("symbols"), u4("at"), u4("sizes")
    docs, known = np.frombuffer(row["doc_ids"], "<i8").tolist(), np.frombuffer(row["known"], np.uint8).tolist()
    ends = np.append(at[1:], len(symbols))
    if wanted is None:
        flat = g.expand(symbols).astype("<u4")
        last = np.cumsum(sizes)
        for k, (a, b) in enumerate(zip((last - sizes).tolist(), last.tolist())):
            yield docs[k] if known[k] else None, b - a, flat[a:b].tobytes()
    else:
        for k in wanted:
            yield docs[k] if known[k] else None, int(sizes[k]), g.expand(symbols[at[k]:ends[k]]).astype("<u4").tobytes()


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, decoded from the files."""
    files = spark.read.schema(FIELDS).parquet(folder)
    # one total a range partition comes to the driver, as many as there are write tasks
    totals = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    if not totals:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids binary")
    begin, at = {}, 0
    for part in sorted(totals):
        begin[part], at = at, at + totals[part]

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                docs, sizes, ids = zip(*shard_documents(row))
                start = begin[row["part"]] + row["before"] + np.cumsum(sizes) - np.array(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                                                 ["doc_id", "start", "n_tokens", "ids"])
    return files.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def file_report(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files written."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-files")
    write_token_files(docs, path, folder)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

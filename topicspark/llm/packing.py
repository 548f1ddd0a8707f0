"""Best-fit packing with swap-based local search (operator 9).

Documents are encoded, closed with an end id, and only those longer than a
sequence are cut.  Pieces are dealt evenly into shards; each shard is packed
best-fit, longest first, and a local search then moves or exchanges documents
(one for one, two for one) between its underfull sequences, always towards the
fuller one, so that the sum of squared fills grows and sequences run empty.
Sequences that are full are done; the pieces of underfull ones are dealt anew
into fewer shards and packed again, until they fit one shard or their number
stops falling, so that waste doesn't add up over shards.

Defined cases: null and empty texts are one end id; a text of any length is
cut into whole sequences and a rest; rows that repeat a doc_id are packed each
on its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import bounded, texts
from topicspark.llm.pieces import library_table
from topicspark.session import materialize

FULL, ROUND = 1 << 62, 1 << 50  # sequence ids of pieces that fill one, and of each round
# a worker's memory beside an executor's heap: pieces kept with their ids, and text of a batch
KEPT, TEXT = 250_000, 2 << 20


def pieces(docs: DataFrame, path: str, size: int = 2048, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids): the encoded documents, cut where they exceed ``size``.

    ``ids`` are little-endian unsigned 32-bit integers.
    """
    def run(batches):
        closing = np.array([end], "<u4").tobytes()
        pa.default_memory_pool().release_unused()  # what a stage before left in this worker
        for b in bounded(batches, "text", TEXT):
            who, piece, start, length, ids = [], [], [], [], []
            for doc, one in zip(b.column("doc_id").to_pylist(), library_table(path, KEPT).texts(b.column("text").to_pylist())):
                one += closing
                for k, at in enumerate(range(0, len(one), 4 * size)):
                    cut = one[at:at + 4 * size]
                    who.append(doc), piece.append(k), start.append(at // 4), length.append(len(cut) // 4), ids.append(cut)
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                                              pa.array(length, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])
    return texts(docs).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Sequences as lists of piece numbers: longest first, each into the fullest sequence that still takes it."""
    bins: list[list[int]] = []
    open_by_gap: list[list[int]] = [[] for _ in range(size + 1)]
    gaps = 0  # bit g is set where a sequence with g free places exists
    for k in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[k]
        fit = gaps >> need
        if fit:
            gap = need + (fit & -fit).bit_length() - 1
            at = open_by_gap[gap].pop()
            if not open_by_gap[gap]:
                gaps &= ~(1 << gap)
        else:
            gap, at = size, len(bins)
            bins.append([])
        bins[at].append(k)
        left = gap - need
        open_by_gap[left].append(at)
        gaps |= 1 << left
    return bins


class _Offers:
    """What a sequence can give: a piece of each length, and as bit sets the lengths of single pieces and of pairs."""

    def __init__(self, pieces: list[int], lengths: list[int]):
        self.by: dict[int, list[int]] = {}
        for k in pieces:
            self.by.setdefault(lengths[k], []).append(k)
        self.one = self.two = 0
        for n, same in self.by.items():
            self.two |= self.one << n
            if len(same) > 1:
                self.two |= 1 << 2 * n
            self.one |= 1 << n

    def pair(self, total: int) -> list[int]:
        """Two pieces of this length together."""
        for n, same in self.by.items():
            other = self.by.get(total - n)
            if other and (other is not same or len(same) > 1):
                return [same[0], other[-1]]
        raise ValueError(total)


def improve(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Local search on the underfull sequences; a step is taken only if it makes the fuller of two fuller still.

    Each sequence meets all fuller ones, again and again until no step is left;
    the sum of squared fills grows with each step, so there is an end.
    """
    fill = [sum(lengths[k] for k in b) for b in bins]
    under = [i for i, f in enumerate(fill) if f < size]
    offers = {i: _Offers(bins[i], lengths) for i in under}
    changed = True
    fresh = set(under)  # changed since they were last held against all others
    while changed:
        changed = False
        under = sorted((i for i in under if 0 < fill[i] < size), key=lambda i: -fill[i])
        now, fresh = fresh, set()
        for rank, low in enumerate(reversed(under)):
            for high in under[:max(0, len(under) - 1 - rank)]:
                if low not in now and high not in now and low not in fresh and high not in fresh:
                    continue
                gap = size - fill[high]
                if gap <= 0 or fill[high] < fill[low] or not bins[low]:
                    continue
                step = _best_step(offers[high], offers[low], gap)
                if step is None:
                    continue
                out, into = step
                for k in out:
                    bins[high].remove(k)
                    bins[low].append(k)
                for k in into:
                    bins[low].remove(k)
                    bins[high].append(k)
                moved = sum(lengths[k] for k in into) - sum(lengths[k] for k in out)
                fill[high] += moved
                fill[low] -= moved
                offers[high], offers[low] = _Offers(bins[high], lengths), _Offers(bins[low], lengths)
                fresh |= {high, low}
                changed = True
    return [b for b in bins if b]


def _best_step(high: _Offers, low: _Offers, gap: int) -> tuple[list[int], list[int]] | None:
    """(leave high, enter high) that fills most of ``gap``: a move, one for one, or two for one."""
    best, step = 0, None
    for lengths in (low.one, low.two):
        for out in (0, *high.by) if lengths is low.one else high.by:
            gain = (lengths & ((2 << gap + out) - 1)).bit_length() - 1 - out
            if gain > best:
                best, step = gain, (out, lengths)
                if best == gap:
                    break
        if best == gap:
            break
    if step is None:
        return None
    out, lengths = step
    total = best + out
    return [high.by[out][0]] if out else [], [low.by[total][0]] if lengths is low.one else low.pair(total)


def _pack_shards(rows: DataFrame, size: int, shards: int, tag: int) -> DataFrame:
    """rows (row, length) -> (row, sequence_id, offset, fill); each shard is packed on its own."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        lengths, shard = t.column("length").to_pylist(), t.column("shard")[0].as_py()
        bins = improve(best_fit(lengths, size), lengths, size)
        order = [k for b in bins for k in b]
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        length = np.array([lengths[k] for k in order], np.int64)
        ends = np.cumsum(length)
        first = np.concatenate([[0], np.cumsum([len(b) for b in bins])[:-1]]).astype(np.int64)
        fill = np.add.reduceat(length, first)
        offset = ends - length - np.repeat((ends - length)[first], [len(b) for b in bins])
        return pa.table({"row": t.column("row").to_numpy()[order], "sequence_id": tag + (np.int64(shard) << 24) + number, "offset": offset, "fill": fill[number]})

    dealt = rows.select("row", "length", F.pmod(F.xxhash64("row", F.lit(tag)), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(run, "row bigint, sequence_id bigint, offset bigint, fill bigint")


def pack(rows: DataFrame, size: int = 2048, per_shard: int = 20_000) -> DataFrame:
    """Add sequence_id and offset to rows that have a ``length`` of 1 to ``size``."""
    stored = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "pieces")
    short = stored.filter(F.col("length") < size)
    places, todo, turn, last, before = [], short.select("row", "length"), 0, None, None
    while True:
        shards = max(1, -(-todo.count() // per_shard))
        if turn * ROUND >= FULL:
            raise RuntimeError("too many rounds for the sequence ids")
        got = materialize(_pack_shards(todo, size, shards, turn * ROUND), "packed")
        full = F.col("fill") >= size
        kinds = dict(got.groupBy(full.alias("full")).agg(F.countDistinct("sequence_id").alias("n")).collect())
        under = kinds.get(False, 0)
        if last is not None and sum(kinds.values()) > before:  # dealt anew they need more: the round before stays
            places.append(last)
            break
        if shards == 1 or last is not None and under >= before:
            places.append(got)
            break
        places.append(got.filter(full))
        last, before = got.filter(~full), under
        todo = materialize(todo.join(last.select("row"), "row", "left_semi"), "underfull")
        turn += 1
    places = reduce(DataFrame.unionAll, places).select("row", "sequence_id", "offset")
    whole = stored.filter(F.col("length") >= size).withColumn("sequence_id", F.lit(FULL) + F.col("row")).withColumn("offset", F.lit(0).cast("bigint"))
    return short.join(places, "row").unionByName(whole).drop("row")


def assemble(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the sequences themselves, from packed pieces that carry ``ids``."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_tokens"))
    return parts.select("sequence_id", "n_tokens", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"))


def packed_report(docs: DataFrame, path: str, size: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    narrow = pieces(docs, path, size).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(narrow, size)

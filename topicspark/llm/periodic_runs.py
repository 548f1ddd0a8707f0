"""Periodic runs of word sequences by a dictionary of basic factors (operator 13).

A run is a stretch of words with smallest period q, at least ``max(least,
2 * q)`` long, that no neighbouring word extends with period q.  The words of a
task's texts are laid end to end as numbers of their own text, so no factor of
one text equals a factor of another.  For each power of two L the dictionary
names the factors of L words; a name for 2L is a pair of names for L, and
positions whose factor stands once leave the dictionary, as every longer
factor there stands once too.

Proposals of level L have periods in [L, 2L).  Occurrences of one factor that
follow each other by at most L / 2 form an arithmetic progression whose
difference p is the factor's own period.  A run of period q holds its first L
words again q places on, and always in another progression: within one, p
would divide q and the run would have period p.  At most three progressions
begin within 2L of the end of one, so all periods are
``gap + t * p`` between a progression and the next three, where t counts
elements left of the one's last or right of the other's first.  Each proposal
is extended to both sides with the names, from long factors to short ones, and
of equal stretches the smallest period stays.

No row moves: a text is one row's work, batches are cut by bytes.  Names take
4 bytes a word and level, up to the length of the longest factor that repeats
within its text.

Defined cases: a null or empty text has no words, no run, and an empty
collapsed text; a text is never cut; rows that repeat a doc_id each give a
row; a null doc_id is kept (and never rewritten by the query); an empty table
gives an empty result; other columns are left behind by the reports.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from topicspark.llm.common import bounded, raw_words, texts

LEAST = 12
NEAR = 3  # progressions of one factor that can begin less than 2L after the end of another


def _names(codes: np.ndarray) -> list[np.ndarray]:
    """names[k][i]: the number of the factor of 2**k words at i; -1 where it stands once."""
    out, active = [], np.arange(len(codes))
    key = codes.astype(np.int64)
    while len(active):
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.r_[True, key[1:] != key[:-1]]
        number = np.cumsum(first) - 1
        many = np.bincount(number)[number] > 1
        names = np.full(len(codes), -1, np.int32)
        names[active[order[many]]] = number[many]
        if not many.any():
            break
        out.append(names)
        step = 1 << (len(out) - 1)
        active = np.flatnonzero(names[:-step] >= 0)
        active = active[names[active + step] >= 0]
        key = names[active].astype(np.int64) * (len(codes) + 1) + names[active + step]
    return out


def _progressions(names: np.ndarray, size: int):
    """(first, last, difference, name) of the progressions of every factor, by name and place."""
    at = np.flatnonzero(names >= 0)
    at = at[np.argsort(names[at], kind="stable")]
    name = names[at]
    linked = np.r_[False, (name[1:] == name[:-1]) & (at[1:] - at[:-1] <= size // 2)]
    head = np.flatnonzero(~linked)
    tail = np.r_[head[1:], len(at)] - 1
    count = tail - head + 1
    return at[head], at[tail], (at[tail] - at[head]) // np.maximum(count - 1, 1), name[head], count


def _proposals(names: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): the factor at place stands again ``period`` words on, size <= period < 2 * size."""
    first, last, step, name, count = _progressions(names, size)
    places, periods = [], []
    for hop in range(1, NEAR + 1):
        a = np.flatnonzero(name[hop:] == name[:-hop])
        b = a + hop
        gap = first[b] - last[a]
        p = np.maximum(step[a], step[b])
        lo = np.where(gap >= size, 0, np.where(p > 0, -((gap - size) // np.maximum(p, 1)), 2 * size))
        hi = np.minimum(np.where(p > 0, (2 * size - 1 - gap) // np.maximum(p, 1), 0), count[a] + count[b] - 2)
        n = np.where(gap < 2 * size, np.maximum(hi - lo + 1, 0), 0)
        pair = np.repeat(np.arange(len(a)), n)
        t = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + lo[pair]
        back = np.minimum(t, count[a][pair] - 1)  # elements left of the last one; the rest go right of the next first
        places.append(last[a][pair] - back * p[pair])
        periods.append(gap[pair] + t * p[pair])
    place, period = np.concatenate(places), np.concatenate(periods)
    return place, period


def _extend(names: list[np.ndarray], place: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the longest stretch with this period around place."""
    n = len(names[0])
    right, left = place.copy(), place.copy()
    for k in range(len(names) - 1, -1, -1):
        width, table = 1 << k, names[k]
        to = np.minimum(right + period, n - 1)
        same = (right + period + width <= n) & (table[np.minimum(right, n - 1)] >= 0) & (table[np.minimum(right, n - 1)] == table[to])
        right += np.where(same, width, 0)
        frm = left - width
        same = (frm >= 0) & (table[np.maximum(frm, 0)] >= 0) & (table[np.maximum(frm, 0)] == table[np.maximum(frm, 0) + period])
        left -= np.where(same, width, 0)
    return left, right + period - left


def find_runs(codes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period."""
    none = np.zeros((0, 3), np.int64)
    names = _names(codes)
    found = none
    for k in range(len(names)):
        place, period = _proposals(names[k], 1 << k)
        if not len(place):
            continue
        # places that follow each other with one period lie in one stretch or are apart by more than a factor
        order = np.lexsort((place, period))
        place, period = place[order], period[order]
        new = np.r_[True, (period[1:] != period[:-1]) | (place[1:] - place[:-1] > (1 << k))]
        place, period = place[new], period[new]
        start, length = _extend(names, place, period)
        ok = length >= np.maximum(least, 2 * period)
        found = np.unique(np.r_[found, np.stack([start, length, period], 1)[ok]], axis=0)
    if not len(found):
        return none
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    smallest = np.r_[True, (found[1:, 0] != found[:-1, 0]) | (found[1:, 1] != found[:-1, 1])]
    found = found[smallest]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_of_texts(texts_words: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """Runs of each word list, found together."""
    codes, bounds = [], [0]
    for words in texts_words:
        table: dict[bytes, int] = {}
        base = bounds[-1]
        codes.append(np.fromiter((table.setdefault(w, base + len(table)) for w in words), np.int64, len(words)))
        bounds.append(base + len(words))
    runs = find_runs(np.concatenate(codes), least) if bounds[-1] else np.zeros((0, 3), np.int64)
    at = np.searchsorted(runs[:, 0], bounds)
    return [runs[at[i]:at[i + 1]] - [bounds[i], 0, 0] for i in range(len(texts_words))]


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that stand in no run after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(edge[:-1]) == 0
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def periodic_words(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The query's rewriting: every tenth document (by crc32 of its id) repeats itself from some word on."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a:a + p]
    return words[:a] + (root * (-(-(n - a) // p)))[:n - a]


def _each(docs: DataFrame, least: int, rewrite: Callable | None, row: Callable, schema: str) -> DataFrame:
    """One row of ``schema`` a document: row(doc_id, words, runs)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 4 << 20):
            ids = batch.column(0).to_pylist()
            words = [raw_words(t) for t in batch.column(1).to_pylist()]
            if rewrite:
                words = [rewrite(w, i) for w, i in zip(words, ids, strict=True)]
            rows = [row(*x) for x in zip(ids, words, runs_of_texts(words, least), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    spec = [f.split(" ") for f in schema.split(", ")]
    names = [n for n, _ in spec]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "array<struct<start:bigint,length:bigint,period:bigint>>":
             pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))}
    types = [kinds[t] for _, t in spec]
    return texts(docs).mapInArrow(run, schema)


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, runs array<struct<start, length, period>>, collapsed): all runs of every text and the text without repeats."""
    def row(doc_id, words, runs):
        found = [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()]
        return doc_id, found, b" ".join(collapse(words, runs)).decode("utf-8", "replace")

    return _each(docs, least, None, row, "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def run_report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The runs of the rewritten texts as counts, the longest run and digests, a row for each document."""
    def row(doc_id, words, runs):
        found = runs.tolist()
        start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in found).encode()
        return (doc_id, len(found), start, length, period, 1000 * length // period if found else None,
                sha256(lines).hexdigest(), sha256(b" ".join(collapse(words, runs))).hexdigest())

    return _each(docs, least, periodic_words, row, "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, "
                 "exponent_milli bigint, runs_sha256 string, collapsed_sha256 string")

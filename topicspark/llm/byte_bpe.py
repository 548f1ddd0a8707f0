"""Byte-level BPE by merge replay (operator 2).

The distinct words of a slice of the corpus stand side by side in one array of
symbols.  An inverted index from merge rank (a token pair) to the positions
where that pair stands drives the replay: the lowest rank is taken, merged at
all its positions at once, and only the neighbours it touched get new index
entries.  A word's merges don't depend on other words, so slices of any size
give the same ids; a slice is bounded in bytes.

Defined cases: null text is empty (no ids); rows keep their doc_id, null and
repeated ones too; an empty table gives an empty result; other columns are
left behind.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import bounded, texts
from topicspark.llm.pieces import PieceTable

NEVER = np.int64(1 << 40)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    """All merges of a rank table, replayed over many words together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.size = max(ranks.values()) + 1
        keys, values = [], []
        for token, rank in ranks.items():
            for at in range(1, len(token)):
                left, right = ranks.get(token[:at]), ranks.get(token[at:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NEVER)

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, as repeated merging of its lowest-ranked leftmost pair gives them."""
        if not words:
            return []
        lengths = np.array([len(w) for w in words], np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        n = len(sym)
        word = np.repeat(np.arange(len(words)), lengths)
        ends = np.cumsum(lengths)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends[lengths > 0] - 1] = -1
        prv[(ends - lengths)[lengths > 0]] = -1
        rank = np.full(n, NEVER)
        has = np.flatnonzero(nxt >= 0)
        rank[has] = self.rank_of(sym[has], sym[nxt[has]])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(positions: np.ndarray) -> None:
            r = rank[positions]
            positions, r = positions[r < NEVER], r[r < NEVER]
            if not len(r):
                return
            order = np.argsort(r, kind="stable")
            positions, r = positions[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            starts = [0, *cuts.tolist()]
            for s, e in zip(starts, [*starts[1:], len(r)]):
                at = int(r[s])
                if at not in index:
                    index[at] = []
                    heapq.heappush(heap, at)
                index[at].append(positions[s:e])

        enter(has)
        while heap:
            r = heapq.heappop(heap)
            found = index.pop(r)
            pos = found[0] if len(found) == 1 else np.concatenate(found)
            pos = pos[rank[pos] == r]
            if not len(pos):
                continue
            if len(pos) > 1:
                pos = np.unique(pos)
                pos = self._free_of_overlap(pos, nxt)
                pos, later = self._in_turn(pos, r, sym, nxt, prv, word)
                if len(later):
                    index[r] = [later]
                    heapq.heappush(heap, r)
            right = nxt[pos]
            after = nxt[right]
            sym[pos] = r
            rank[right] = NEVER
            nxt[pos] = after
            inner = after >= 0
            prv[after[inner]] = pos[inner]
            before = prv[pos]
            touched = np.concatenate([pos, before[before >= 0]])
            if len(touched) > 1:
                touched = np.unique(touched)
            follow = nxt[touched]
            # a pair's second symbol may be the -1 past the word's end: masked below
            rank[touched] = np.where(follow >= 0, self.rank_of(sym[touched], sym[follow]), NEVER)
            enter(touched)
        # a symbol lives when it starts a word or its predecessor points at it
        alive = np.zeros(n, bool)
        alive[(ends - lengths)[lengths > 0]] = True
        at = np.flatnonzero(prv >= 0)
        alive[at] = nxt[prv[at]] == at
        ids, owner = sym[alive].astype("<u4"), word[alive]
        bounds = np.searchsorted(owner, np.arange(len(words) + 1))
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    @staticmethod
    def _free_of_overlap(pos: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        """Of positions whose pairs overlap (a a a), every second one from the left."""
        linked = np.concatenate([[False], pos[1:] == nxt[pos[:-1]]])
        if not linked.any():
            return pos
        at = np.arange(len(pos))
        start = np.maximum.accumulate(np.where(linked, 0, at))
        return pos[(at - start) % 2 == 0]

    def _in_turn(self, pos, r, sym, nxt, prv, word):
        """(merge now, merge later): where merging makes a pair of a lower rank, a word's merges go one by one."""
        owner = word[pos]
        many = np.zeros(len(pos), bool)
        same = owner[1:] == owner[:-1]
        many[1:] |= same
        many[:-1] |= same
        if not many.any():
            return pos, pos[:0]
        at = np.flatnonzero(many)
        p = pos[at]
        after, before = nxt[nxt[p]], prv[p]
        token = np.full(len(p), r)
        low = self.rank_of(token, token) < r
        low |= (after >= 0) & (self.rank_of(token, sym[after]) < r)
        low |= (before >= 0) & (self.rank_of(sym[before], token) < r)
        if not low.any():
            return pos, pos[:0]
        slow = np.isin(owner, owner[at[low]])
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        wait = slow & ~first
        return pos[~wait], pos[wait]


_TABLES: dict[str, tuple[PieceTable, list[bytes]]] = {}


def _worker_tables(path: str, pattern: str):
    """A worker's rank table, and ids of the pieces it has met."""
    if (path, pattern) not in _TABLES:
        import regex

        ranks = load_ranks(path)
        replay, words_of = MergeReplay(ranks), regex.compile(pattern).findall
        tokens = [b""] * replay.size
        for token, rank in ranks.items():
            tokens[rank] = token

        def encode(pieces: list[str]) -> list[bytes]:
            cuts = [words_of(p) for p in pieces]
            words = {w: None for c in cuts for w in c}
            ids = replay.encode([w.encode("utf-8", "surrogatepass") for w in words])
            done = {w: i.tobytes() for w, i in zip(words, ids)}
            return [b"".join([done[w] for w in c]) for c in cuts]

        _TABLES[path, pattern] = PieceTable(encode), tokens
    return _TABLES[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids of each whole text as little-endian unsigned 32-bit integers."""
    def run(batches):
        table, _ = _worker_tables(path, pattern)
        for b in bounded(batches, "text", 6 << 20):
            ids = list(table.texts(b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])
    return texts(docs).mapInArrow(run, "doc_id bigint, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that the ids stand for."""
    def run(batches):
        _, tokens = _worker_tables(path, pattern)
        for b in bounded(batches, "ids", 8 << 20):
            back = [b"".join([tokens[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(back, pa.binary())], ["doc_id", "ids", "decoded"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids binary, decoded binary")


def round_trip_report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each whole text."""
    both = decode(encode(docs, path, pattern), path, pattern)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

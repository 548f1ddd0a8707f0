"""Class-based bigram language model after Brown, by exchange clustering (operator 8).

Units of the model are the ``head`` most frequent words and, for all other
words, their last two bytes.  Exchange clustering assigns units to classes so
that the likelihood of neighbouring classes grows.  The probability of a word
after another one is

    mix * P(class | class before) * P(unit | class) * P(word | unit)
        + (1 - mix) * P(word)

with class transitions smoothed by class frequencies and P(word) the smoothed
word frequency.  A word outside the head has its exact training count c as a
factor c + 1/2 in both terms, which is joined from the table of all counts;
unknown words have c = 0.  So only the head, the units and the class table
(bounded by ``head``, 65,536 byte pairs and ``classes``) are sent to tasks.

Statistics cover all training documents: word counts and counts of
neighbouring units are Spark aggregations, read again in each exchange step.

Defined cases: null and empty texts are one end token; a null doc_id is
trained on and never held out; rows that repeat a doc_id are scored each; with
no training token every probability is that of one unknown type; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import bounded, held_out, lower_words, texts
from topicspark.llm.rolling import Words
from topicspark.session import materialize

END_HASH = np.uint64(0)  # the end token's place among word hashes


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): counts of all tokens; the end token is the empty word."""
    def run(batches):
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in bounded(batches, "text", 4 << 20):
            for t in b.column("text").to_pylist():
                held.update(lower_words(t))
            held[b""] += b.num_rows
            if len(held) > 300_000:
                yield flush()
        if held:
            yield flush()
    return docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Units:
    """Numbers of units: head words by hash, then byte pairs, then one for pairs never seen."""

    hashes: np.ndarray  # of head words, in order
    numbers: np.ndarray  # unit of each
    counts: np.ndarray  # of each unit, unit 0 is the end token
    types: np.ndarray  # words a unit stands for
    pair_unit: np.ndarray  # unit of each byte pair

    @property
    def head(self) -> int:
        return len(self.hashes) + 1

    def of(self, words: Words) -> np.ndarray:
        """The unit of each word."""
        h = words.hashes()
        last = words.buf[words.ends - 1].astype(np.int64)
        one = words.ends - words.starts == 1
        before = np.where(one, 0, words.buf[np.maximum(words.ends - 2, 0)].astype(np.int64))
        out = self.pair_unit[before * 256 + last]
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == h, self.numbers[at], out)
        return out


def make_units(counts: DataFrame, head: int) -> Units:
    """The most frequent words, and byte pairs with the counts of all other words."""
    top = counts.filter(F.octet_length("word") > 0).orderBy(F.desc("n"), "word").limit(head)
    rows = top.collect()  # at most ``head`` rows
    words, n = [bytes(r["word"]) for r in rows], [r["n"] for r in rows]
    end = counts.filter(F.octet_length("word") == 0).agg(F.sum("n")).first()[0] or 0
    known = Words([]) if not words else _joined(words)
    h = known.hashes()
    order = np.argsort(h)
    least = (n[-1], words[-1]) if len(words) == head else (0, b"\xff" * 8)
    rest = counts.filter((F.octet_length("word") > 0) & ((F.col("n") < least[0]) | ((F.col("n") == least[0]) & (F.col("word") > F.lit(bytearray(least[1]))))))
    pair = F.hex(F.substring("word", -2, 2))
    pairs = rest.groupBy(pair.alias("pair")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).orderBy("pair").collect()  # at most 65,792 rows
    other = len(words) + 1 + len(pairs)
    pair_unit = np.full(1 << 16, other)
    for k, r in enumerate(pairs):
        b = bytes.fromhex(r["pair"])
        pair_unit[(b[0] if len(b) == 2 else 0) * 256 + b[-1]] = len(words) + 1 + k
    total = np.array([end, *n, *(r["n"] for r in pairs), 0], float)
    types = np.array([1, *[1] * len(n), *(r["types"] for r in pairs), 0], float)
    return Units(h[order], order + 1, total, types, pair_unit)


def _joined(words: list[bytes]) -> Words:
    out = Words([])
    out.raw = b"\n".join([*words, b""])
    out.buf = np.frombuffer(out.raw, np.uint8)
    size = np.array([len(w) for w in words])
    out.ends = np.cumsum(size + 1) - 1
    out.starts = out.ends - size
    return out


def _stream(words: Words, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(units with an end after each text, text of each)."""
    rows = len(words.counts)
    at = np.repeat(np.arange(rows), words.counts + 1)
    out = np.zeros(len(at), np.int64)
    ends = np.cumsum(words.counts + 1) - 1
    inner = np.ones(len(at), bool)
    inner[ends] = False
    out[inner] = units
    return out, at


def unit_pairs(docs: DataFrame, units: Units) -> DataFrame:
    """(a, b, n): counts of neighbouring units; a text starts after an end."""
    size = len(units.counts)

    def run(batches):
        for b in bounded(batches, "text", 16 << 20):
            words = Words(b.column("text").to_pylist(), lower=True)
            flow, _ = _stream(words, units.of(words))
            before = np.concatenate([[0], flow[:-1]])  # the row before ends with an end, as a text starts after one
            pair, n = np.unique(before * size + flow, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((pair // size).astype(np.int32)), pa.array((pair % size).astype(np.int32)), pa.array(n, pa.int64())], ["a", "b", "n"])
    return docs.select("text").mapInArrow(run, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _chunks(batches, rows: int = 1 << 19):
    """The columns a, b, n of many batches, about ``rows`` rows at a time."""
    held, size = [], 0
    for b in batches:
        held.append([b.column(c).to_numpy() for c in ("a", "b", "n")])
        size += b.num_rows
        if size >= rows:
            yield [np.concatenate(c) for c in zip(*held)]
            held, size = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def class_table(pairs: DataFrame, of: np.ndarray, classes: int) -> np.ndarray:
    """Counts of neighbouring classes."""
    def run(batches):
        total = np.zeros(classes * classes)
        for x, y, n in _chunks(batches):
            total += np.bincount(of[x] * classes + of[y], weights=n, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])
    out = np.zeros(classes * classes)
    for r in pairs.mapInArrow(run, "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # classes**2 rows at most
        out[r["cell"]] = r["n"]
    return out.reshape(classes, classes)


def best_classes(own: np.ndarray, out: np.ndarray, into: np.ndarray, loop: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each unit the class in which the likelihood of the class bigrams is greatest, all others staying.

    ``out`` and ``into`` count a unit's neighbours after and before it by
    class (itself left out), ``loop`` the unit after itself.
    """
    def f(x):
        return x * np.log(np.maximum(x, 1e-9))

    left, right = table.sum(1), table.sum(0)
    best = np.empty(len(own), np.int64)
    step = 128
    for at in range(0, len(own), step):
        a, o, i, s = own[at:at + step], out[at:at + step], into[at:at + step], loop[at:at + step]
        k = np.arange(len(a))
        m = np.repeat(table[None], len(a), axis=0)  # without the unit
        m[k, a, :] -= o
        m[k, :, a] -= i
        m[k, a, a] -= s
        m = np.maximum(m, 0)
        l, r = np.repeat(left[None], len(a), 0), np.repeat(right[None], len(a), 0)  # noqa: E741
        l[k, a] -= o.sum(1) + s
        r[k, a] -= i.sum(1) + s
        gain = (f(m + o[:, None, :]) - f(m)).sum(2) + (f(m + i[:, :, None]) - f(m)).sum(1)
        d = np.diagonal(m, axis1=1, axis2=2)
        gain += f(d + o + i + s[:, None]) - f(d + o) - f(d + i) + f(d)  # both meet in one cell
        gain -= f(np.maximum(l, 0) + (o.sum(1) + s)[:, None]) - f(np.maximum(l, 0))
        gain -= f(np.maximum(r, 0) + (i.sum(1) + s)[:, None]) - f(np.maximum(r, 0))
        gain[k, a] += 1e-6
        best[at:at + step] = gain.argmax(1)
    return best


def exchange(pairs: DataFrame, units: Units, classes: int, passes: int = 3, parts: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, table of class bigrams): ``passes`` times through all units, a part of them at a time."""
    size = len(units.counts)
    of = np.arange(size) % classes
    of[0] = 0
    table = class_table(pairs, of, classes)
    for turn in range(passes * parts):
        chosen = (np.arange(size) // classes + np.arange(size)) % parts == turn % parts
        chosen[0] = False

        def rows(batches, of=of, chosen=chosen):
            cells = 2 * classes + 1
            total = np.zeros(size * cells)  # one row of neighbour classes a unit: bounded by head and classes
            for x, y, n in _chunks(batches):
                same = x == y
                for who, other, shift, keep in ((x, y, 0, chosen[x]), (y, x, classes, chosen[y] & ~same)):
                    cell = np.where(same, 2 * classes, of[other] + shift)
                    total += np.bincount((who.astype(np.int64) * cells + cell)[keep], weights=n[keep], minlength=len(total))
            at = np.flatnonzero(total)
            for k in range(0, len(at), 1 << 18):
                some = at[k:k + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(some // cells), pa.array((some % cells).astype(np.int32)), pa.array(total[some])], ["unit", "cell", "n"])

        def choose(batches, of=of, table=table):
            got = [(b.column("unit").to_numpy(), b.column("cell").to_numpy(), b.column("n").to_numpy()) for b in batches]  # at most units x cells
            if not got:
                return
            unit, cell, n = (np.concatenate(x) for x in zip(*got))
            who, number = np.unique(unit, return_inverse=True)
            for at in range(0, len(who), 2000):
                mine = (number >= at) & (number < at + 2000)
                some = who[at:at + 2000]
                v = np.zeros((len(some), 2 * classes + 1))
                np.add.at(v, (number[mine] - at, cell[mine]), n[mine])
                best = best_classes(of[some], v[:, :classes], v[:, classes:2 * classes], v[:, 2 * classes], table)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(best)], ["unit", "best"])

        dealt = pairs.mapInArrow(rows, "unit bigint, cell int, n double").groupBy("unit", "cell").agg(F.sum("n").alias("n")).repartition("unit")
        moves = dealt.mapInArrow(choose, "unit bigint, best bigint").collect()  # a row a unit
        of = of.copy()
        for r in moves:
            of[r["unit"]] = r["best"]
        table = class_table(pairs, of, classes)
    return of, table


@dataclass
class Model:
    units: Units
    of: np.ndarray
    move: np.ndarray  # P(class | class before)
    emit: np.ndarray  # P(unit | its class)
    tokens: float
    types: float
    mix: float

    def tail_scale(self) -> np.ndarray:
        """What (c + 1/2) is divided by for P(word | unit)."""
        return self.units.counts + 0.5 * (self.units.types + 1)

    def score(self, texts: list[str]):
        """(n_tokens, known head tokens, base, score, tail places, tail texts, words) without the factors c + 1/2 of the tail."""
        u, words = self.units, Words(texts, lower=True)
        flow, at = _stream(words, u.of(words))
        before = np.concatenate([[0], flow[:-1]])[:len(flow)]
        head = flow < u.head
        z = self.tokens + 0.5 * (self.types + 1)
        plain = np.where(head, u.counts[flow] + 0.5, 1.0) / z
        inner = np.where(head, 1.0, 1.0 / self.tail_scale()[flow])
        model = self.mix * self.move[self.of[before], self.of[flow]] * self.emit[flow] * inner + (1 - self.mix) * plain
        rows = len(texts)
        add = lambda x: np.bincount(at, weights=x, minlength=rows)
        known = add((head & (u.counts[flow] > 0)).astype(float))
        inside = np.ones(len(flow), bool)
        inside[np.cumsum(words.counts + 1) - 1] = False
        tail = np.flatnonzero(~head[inside])
        return words.counts + 1, known, add(np.log10(plain)), add(np.log10(model)), tail, words


def train(docs: DataFrame, head: int = 20_000, classes: int = 48, mix: float = 0.95, passes: int = 3) -> tuple[Model, DataFrame]:
    """(model, counts of all words) from all rows of ``docs``."""
    counts = materialize(word_counts(docs), "word-counts")
    total = counts.agg(F.sum("n"), F.count("*")).first()
    units = make_units(counts, head)
    pairs = materialize(unit_pairs(docs, units), "unit-pairs")
    of, table = exchange(pairs, units, classes, passes)
    right, left = table.sum(0), table.sum(1)
    share = (right + 0.5) / (right + 0.5).sum()
    move = (table + 20 * share[None, :]) / (left[:, None] + 20)
    weight = units.counts + 0.5
    emit = weight / np.bincount(of, weights=weight, minlength=classes)[of]
    return Model(units, of, move, emit, float(total[0] or 0), float(total[1] or 0), mix), counts


def score_report(docs: DataFrame) -> DataFrame:
    """Scores of all rows by a model of those that aren't held out.

    (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).
    """
    every = texts(docs)
    out_of = held_out(F.col("doc_id"), 5)
    model, counts = train(every.filter(~out_of))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # head words, units and class table: bounded

    def run(batches):
        m = sent.value
        for b in bounded(batches, "text", 4 << 20):
            n, known, base, score, tail, words = m.score(b.column("text").to_pylist())
            owner = words.owners()[tail]
            offsets = np.searchsorted(owner, np.arange(b.num_rows + 1)).astype(np.int32)
            raw, starts, ends = words.raw, words.starts[tail].tolist(), words.ends[tail].tolist()
            rest = pa.ListArray.from_arrays(offsets, pa.array([raw[s:e] for s, e in zip(starts, ends)], pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(known), pa.array(base), pa.array(score), rest],
                                             ["doc_id", "n_tokens", "known", "base", "score", "rest"])

    parts = every.mapInArrow(run, "doc_id bigint, n_tokens bigint, known double, base double, score double, rest array<binary>")
    parts = materialize(parts.withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = parts.select("row", F.explode("rest").alias("word")).join(counts, "word", "left")
    c = F.coalesce("n", F.lit(0))
    rest = rest.groupBy("row").agg(F.sum(F.log10(c + 0.5)).alias("more"), F.sum((c > 0).cast("bigint")).alias("seen"))
    more, seen = F.coalesce("more", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    return parts.drop("rest").join(rest, "row", "left").select(
        "doc_id", out_of.alias("held_out"), "n_tokens", (F.col("known") + seen).cast("bigint").alias("n_known"),
        F.lit(int(model.tokens)).cast("bigint").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))

"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 10).

Statistics of a whole text (``FEATURES``) are computed in numpy where the text
is.  Trees are fitted on the driver from a bounded sample of labelled rows
(``max_rows``, the only thing that is bounded), on binned values with logistic
loss; all trees are then flattened into arrays, which score any number of
rows by vectorised traversal.

Defined cases: null and empty texts have zero statistics and a score like any
other; with no labelled rows, or labels of one kind only, every score is the
share of good labels (0.5 without any); rows keep their doc_id, null
(never held out) and repeated ones too; an empty table gives an empty result;
only ``text`` is an input of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import bounded, held_out, texts
from topicspark.llm.rolling import Words, mix, rolling

# byte kinds: 0 lower, 1 upper, 2 digit, 3 space, 4 line end, 5 . ! ?, 6 , ; :, 7 other punctuation, 8 not ASCII, 9 control
_KIND = np.full(256, 7, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 8
_KIND[0:32], _KIND[127], _KIND[32], _KIND[9], _KIND[[10, 13]] = 9, 9, 3, 3, 4
_KIND[[33, 46, 63]], _KIND[[44, 58, 59]] = 5, 6
FEATURES = [
    "log_bytes", "log_words", *(f"kind_{k}" for k in range(10)), "mean_word", "sd_word", "log_longest_word", "short_words", "long_words",
    "distinct_words", "top_word", "distinct_pairs", "distinct_triples", "capital_words", "digit_words", "symbol_words", "words_per_stop",
    "log_lines", "distinct_lines", "words_per_line", "lines_ended", "longest_line_share", "common_words", "mean_repeat",
]


def _distinct(owner: np.ndarray, key: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of different keys, count of the most frequent key) of each row."""
    if not len(key):
        return np.zeros(rows), np.zeros(rows)
    order = np.lexsort((key, owner))
    o, k = owner[order], key[order]
    at = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (k[1:] != k[:-1])]))
    runs = np.diff(np.concatenate([at, [len(o)]]))
    most = np.zeros(rows)
    np.maximum.at(most, o[at], runs)
    return np.bincount(o[at], minlength=rows).astype(float), most


def statistics(texts: list[str]) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    rows, words = len(texts), Words(texts)
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    owner_of_byte = np.repeat(np.arange(rows), size + 1)
    kinds = np.bincount(owner_of_byte * 10 + _KIND[words.buf], minlength=rows * 10).reshape(rows, 10).astype(float)
    kinds[:, 4] -= 1  # the separator
    n = words.counts.astype(float)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(n, 1)
    owner, length = words.owners(), (words.ends - words.starts).astype(float)
    total = lambda x: np.bincount(owner, weights=x, minlength=rows) if len(owner) else np.zeros(rows)
    mean = total(length) * per_word
    spread = np.sqrt(np.maximum(total(length ** 2) * per_word - mean ** 2, 0))
    longest = np.zeros(rows)
    np.maximum.at(longest, owner, length)
    first = _KIND[words.buf[words.starts]] if len(owner) else np.zeros(0, np.uint8)
    last = _KIND[words.buf[words.ends - 1]] if len(owner) else np.zeros(0, np.uint8)
    h = words.hashes()
    kinds_of_word, most = _distinct(owner, h, rows)
    ngrams = []
    for k in (2, 3):
        ok = np.flatnonzero(words.inside(k)) if len(words) >= k else np.zeros(0, np.int64)
        got, _ = _distinct(owner[ok], mix(rolling(h, k))[ok] if len(ok) else h[:0], rows)
        ngrams.append(got / np.maximum(n - k + 1, 1))
    lines = np.zeros((rows, 5))
    for i, r in enumerate(raw):
        every = [x.strip() for x in r.split(b"\n")]
        every = [x for x in every if x]
        if every:
            lines[i] = (len(every), len(set(every)) / len(every), n[i] / len(every), sum(x[-1:] in b".!?\"" for x in every) / len(every), max(map(len, every)) / max(1, size[i]))
    stops = kinds[:, 5]
    columns = [
        np.log1p(size), np.log1p(n), *(kinds[:, k] * per_byte for k in range(10)), mean, spread, np.log1p(longest),
        total(length <= 3) * per_word, total(length > 12) * per_word, kinds_of_word * per_word, most * per_word, *ngrams,
        total(first == 1) * per_word, total(first == 2) * per_word, total((first >= 5) & (first <= 7)) * per_word, n / (1 + stops),
        np.log1p(lines[:, 0]), *(lines[:, k] for k in range(1, 5)), total(last == 7) * per_word, n / np.maximum(kinds_of_word, 1),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Forest:
    """All trees in arrays: an inner node sends values <= cut to ``left``, others to ``left + 1``."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        row = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                inner = self.left[node] >= 0
                right = x[row, self.feature[node]] > self.cut[node]
                node = np.where(inner, self.left[node] + right, node)
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, least: int = 15, l2: float = 2.0) -> Forest:
    """Boosted trees for labels 0/1, grown level by level from histograms of binned features."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        logit = 0.0 if not len(y) else (30.0 if share else -30.0)
        one = np.zeros(0, np.int64)
        return Forest(one, one, np.zeros(0), one, np.zeros(0), logit, 0)
    rows, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    flat = binned + np.arange(width) * bins
    base = float(np.log(share / (1 - share)))
    score = np.full(rows, base)
    feature, cut, left, value, roots = [], [], [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        root = len(value)
        roots.append(root)
        node = np.full(rows, root)
        level = [root]
        feature.append(0), cut.append(0.0), left.append(-1), value.append(0.0)
        for d in range(depth + 1):
            after = []
            for k in level:
                mine = np.flatnonzero(node == k)
                gs, hs = g[mine].sum(), h[mine].sum()
                value[k] = -rate * gs / (hs + l2)
                if d == depth or len(mine) < 2 * least:
                    continue
                at = flat[mine].ravel()
                gh, hh, nh = (np.bincount(at, weights=w, minlength=width * bins).reshape(width, bins).cumsum(axis=1) for w in (np.repeat(g[mine], width), np.repeat(h[mine], width), np.ones(len(at))))
                gain = gh ** 2 / (hh + l2) + (gs - gh) ** 2 / (hs - hh + l2) - gs ** 2 / (hs + l2)
                gain[(nh < least) | (len(mine) - nh < least)] = -1
                j, b = divmod(int(gain.argmax()), bins)
                if gain[j, b] <= 1e-6 or b >= len(cuts[j]):
                    continue
                feature[k], cut[k], left[k] = j, float(cuts[j][b]), len(value)
                after += [len(value), len(value) + 1]
                for _ in range(2):
                    feature.append(0), cut.append(0.0), left.append(-1), value.append(0.0)
                node[mine] = left[k] + (binned[mine, j] > b)
            level = after
        score += np.array(value)[node]
    return Forest(np.array(roots), np.array(feature), np.array(cut), np.array(left), np.array(value), base, depth)


def featured(docs: DataFrame, *carry: str) -> DataFrame:
    """(carry..., x): the statistics of each text as an array of doubles."""
    def run(batches):
        for b in bounded(batches, "text", 4 << 20):
            x = statistics(b.column("text").to_pylist())
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), flat], [*carry, "x"])
    kinds = dict(docs.dtypes)
    return docs.select(*carry, "text").mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in carry), "x array<double>"]))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **settings) -> Forest:
    """Fit on at most ``max_rows`` labelled rows (those of the least id hashes) that aren't held out."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    known = known.filter(~held_out(F.col("doc_id"), 3)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # at most max_rows rows of two numbers: a proven bound for the broadcast
    rows = featured(texts(docs).join(F.broadcast(known), "doc_id"), "doc_id", "quality").orderBy("doc_id").limit(2 * max_rows).collect()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["quality"] for r in rows], float), **settings)


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    forest = train(docs, labels, max_rows)

    def run(batches):
        for b in bounded(batches, "text", 4 << 20):
            score = forest.scores(statistics(b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], ["doc_id", "score"])
    out = texts(docs).mapInArrow(run, "doc_id bigint, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), 3).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all columns, without a shuffle."""
    forest = train(docs, labels)
    names, schema = docs.columns, docs.schema
    at = names.index("text")

    def run(batches):
        # a slice's arrays take some 30 times its bytes, beside whole rows on their way in and out
        for b in bounded(batches, "text", 1 << 20):
            score = forest.scores(statistics(b.column(at).to_pylist()))
            yield b.filter(pa.array(score >= 0.5))
    return docs.mapInArrow(run, schema)

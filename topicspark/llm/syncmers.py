"""Document fingerprints from closed syncmers (operator 6), DataFrame operations only.

Of every ``K`` consecutive words, the run is chosen when the least of its
``S``-word substrings (by hash) stands at its first or last place.  Whether a
run is chosen depends on its words alone, so two texts that share a passage
share its anchors wherever the passage stands.  A fingerprint lists the
anchors in text order, each as hash and first word's place, so matches can be
held against their positions.

Likeness of two fingerprints is 2 m / (a + b) for a and b distinct anchors, m
of them in common; two empty ones are alike (1), an empty and another aren't
(0).

Defined cases: null text is empty; an empty text or one without words has an
empty fingerprint; a text with fewer than ``K`` words, or in which no run is
chosen, has one anchor for all its words; rows that repeat doc_id and text are
one document; a null doc_id comes after all others in descending order; of
one document alone the next one is itself; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import WHITE, texts
from topicspark.operators.numbering import dense_number

K, S = 5, 2


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the anchors of ``text`` as an array of (a, at) in text order."""
    h, s = f"__h_{out}", f"__s_{out}"
    words = F.filter(F.split(F.col(text), WHITE), lambda w: w != "")
    df = df.withColumn(h, F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size(h)
    # S = 2: the hash of each two neighbouring words
    pairs = F.zip_with(F.slice(h, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(h, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn(s, F.when(n >= S, pairs))
    inner = K - S  # the last substring's place in a run of K words

    def at(i: Column, k: int) -> Column:
        return F.get(F.col(s), i + k)

    def chosen(i: Column) -> Column:
        return F.least(at(i, 0), at(i, inner)) <= F.least(*[at(i, k) for k in range(1, inner)])

    places = F.filter(F.sequence(F.lit(0), F.greatest(n - K, F.lit(0))), chosen)
    df = df.withColumn(f"__p_{out}", F.when(n >= K, places).otherwise(F.array().cast("array<int>")))
    runs = F.transform(f"__p_{out}", lambda i: F.struct(F.hash(at(i, 0), at(i, 2), F.get(F.col(h), i + K - 1)).alias("a"), i.alias("at")))
    whole = F.array(F.struct(F.hash(F.col(h)).alias("a"), F.lit(0).alias("at")))
    none = F.filter(whole, lambda x: F.lit(False))
    df = df.withColumn(out, F.when(F.size(f"__p_{out}") > 0, runs).when(n > 0, whole).otherwise(none))
    return df.drop(h, s, f"__p_{out}")


def as_text(anchors: str) -> Column:
    """``hash:place`` of each anchor, hash in hexadecimal."""
    return F.array_join(F.transform(anchors, lambda x: F.concat(F.hex(x["a"].cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(":"), x["at"].cast("string"))), " ")


def likeness(one: str, two: str) -> Column:
    a, b = F.array_distinct(F.col(f"{one}.a")), F.array_distinct(F.col(f"{two}.a"))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(2.0) * F.size(F.array_intersect(a, b)) / total)


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, key, next_id, next_key): each document's next one in descending doc_id; the first follows the last."""
    rows = docs.select("doc_id", "key")
    numbered = dense_number(rows, [F.col("doc_id").desc_nulls_last(), F.col("key").desc()], "place")
    count = numbered.count()
    after = numbered.select(F.col("doc_id").alias("next_id"), F.col("key").alias("next_key"), F.col("place").alias("after"))
    return numbered.withColumn("after", (F.col("place") + 1) % F.lit(max(1, count))).join(after, "after").select("doc_id", "key", "next_id", "next_key")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next document's are.

    The edited text has the last third of its code points replaced by the
    first as many (or all) of the next document's.
    """
    # read twice with the same columns (one struct), so that texts are shuffled by key once and both joins use that
    whole = texts(docs).select(F.xxhash64("doc_id", "text").alias("key"), F.struct("doc_id", "text").alias("doc")).dropDuplicates(["key"])
    follow = neighbours(texts(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("key")).dropDuplicates(["key"]))
    given = whole.select(F.col("key").alias("next_key"), F.col("doc.text").alias("next_text")).join(follow.select(F.col("key").alias("owner"), "next_key"), "next_key")
    both = whole.join(given.select(F.col("owner").alias("key"), "next_text"), "key").select("doc.doc_id", "doc.text", "next_text")
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    both = both.select("doc_id", "text", "next_text", n.cast("bigint").alias("n_chars"),
                       F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)).alias("edited"))
    both = both.withColumn("edited_sha256", F.sha2("edited", 256))
    for text, out in (("text", "own"), ("edited", "changed"), ("next_text", "following")):
        both = with_anchors(both, text, out)
    return both.select("doc_id", "n_chars", "edited_sha256", as_text("own").alias("fingerprint"), as_text("changed").alias("edited_fingerprint"),
                       likeness("own", "changed").alias("near_edited"), likeness("own", "following").alias("near_next"))

"""Saved runs (S6, S7) and fingerprints.

A run is a fresh folder of Parquet tables plus ``manifest`` (one JSON row) that
names it and is written last; a run without a manifest is unfinished and is never loaded.  Paths go
through Spark's file system layer, so a run can live on any shared store.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPTIONAL = ("probs", "embeddings", "xy", "aspects", "labels", "topics_per_class")


def _hex_int(expr):
    """First 15 hex digits of an md5 as a non-negative BIGINT (same value in DuckDB)."""
    return F.conv(F.substring(F.md5(expr), 1, 15), 16, 10).cast("bigint")


def settings_hash(settings: dict) -> str:
    return hashlib.md5(json.dumps(settings, sort_keys=True, default=str).encode("utf-8")).hexdigest()


def corpus_fingerprint(docs: DataFrame, settings: dict, key_cols=("docid",), text_col: str = "text") -> DataFrame:
    """One row (n_docs, docs_hash, settings_hash, key); order-insensitive, one aggregate pass."""
    row = F.concat_ws(":", *[F.col(c).cast("string") for c in key_cols], F.col(text_col))
    agg = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.bit_xor(_hex_int(row)).alias("docs_hash"))
    sh = settings_hash(settings)
    return agg.select("n_docs", "docs_hash", F.lit(sh).alias("settings_hash"),
                      F.md5(F.concat_ws(":", F.col("n_docs").cast("string"), F.col("docs_hash").cast("string"), F.lit(sh))).alias("key"))


def model_fingerprint(scores: DataFrame, doc_topic: DataFrame, ngram_range=(1, 1), max_df: float = 0.9,
                      nr_topics: int = 0) -> DataFrame:
    """One row: matrix shape, n-gram range, max_df, order-insensitive vocabulary and
    assignment digests, nr_topics."""
    v = scores.select("term").distinct().agg(F.count(F.lit(1)).alias("n_terms"), F.bit_xor(_hex_int(F.col("term"))).alias("vocab_hash"))
    t = doc_topic.agg(F.countDistinct("topic").alias("n_topics"),
                      F.bit_xor(_hex_int(F.concat_ws(":", F.col("docid").cast("string"), F.col("topic").cast("string")))).alias("topics_hash"))
    # both sides are one row: combined as scalar subqueries, not a join
    j = v.withColumns({"n_topics": t.select("n_topics").scalar(), "topics_hash": t.select("topics_hash").scalar()})
    return j.select("n_topics", "n_terms", F.lit(f"{ngram_range[0]}-{ngram_range[1]}").alias("ngram_range"),
                    F.lit(float(max_df)).alias("max_df"), "vocab_hash", "topics_hash", F.lit(int(nr_topics)).alias("nr_topics"))


def save_run(spark: SparkSession, path: str, tables: dict[str, DataFrame], settings: dict, fingerprint: str) -> dict:
    """Every table as Parquet in a fresh folder under ``path``, then the manifest that names it (last).

    Saving over a run never touches the tables that its manifest names, so a
    reader gets the old run, or (while the manifest is replaced) none, or the new one.
    """
    counts, folder = {}, f"tables-{uuid.uuid4().hex[:12]}"
    for name, df in tables.items():
        if df is None:
            continue
        out = os.path.join(path, folder, name)
        df.write.mode("overwrite").parquet(out)
        counts[name] = spark.read.parquet(out).count()
    manifest = {"fingerprint": fingerprint, "settings": settings, "folder": folder, "tables": counts}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True, default=str),)], "value string") \
        .coalesce(1).write.mode("overwrite").text(os.path.join(path, "manifest"))
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    from topicspark.sources.files import _exists
    mpath = os.path.join(path, "manifest")
    if not _exists(spark, mpath):
        return None
    rows = spark.read.text(mpath).collect()
    return json.loads(rows[0][0]) if rows else None


def load_run(spark: SparkSession, path: str, fingerprint: str | None = None) -> dict[str, DataFrame | None] | None:
    """The saved tables if the run finished (and matches ``fingerprint``); missing
    optional tables come back as None; an unfinished or different run gives None."""
    m = read_manifest(spark, path)
    if m is None or (fingerprint is not None and m.get("fingerprint") != fingerprint):
        return None
    out: dict[str, DataFrame | None] = {}
    for name in set(m["tables"]) | set(OPTIONAL):
        out[name] = spark.read.parquet(os.path.join(path, m["folder"], name)) if name in m["tables"] else None
    return out

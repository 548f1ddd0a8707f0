"""Readers for the input tables (Parquet) and the text-corpus layout."""

from __future__ import annotations

import os
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


# Tables whose rows carry heavy per-row text work, with the key to spread them by.
TEXT_TABLES = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id", "benchmark": "item_id"}


def _input_bytes(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(jpath).getLength())


def spread_small_input(df: DataFrame, path: str, key: str) -> DataFrame:
    """Hash-spread a text table over all cores when its files cannot give one split per core.

    A scan splits at most per Parquet row group; a small table written as one
    row group is read by one task, and everything per-row after it (tokenizing,
    chunking) would run in that task.  Large inputs already have more splits
    than cores and are left alone (no shuffle of the raw text at scale).
    """
    spark = df.sparkSession
    par = spark.sparkContext.defaultParallelism
    max_bytes = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if _input_bytes(spark, path) < max_bytes * par:
        return df.repartition(par, key)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Catalyst prunes columns and pushes filters into the scan."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    df = spark.read.parquet(path)
    if name in TEXT_TABLES:
        df = spread_small_input(df, path, TEXT_TABLES[name])
    return df


NO_NAME = "=null"  # file of the documents without a name; no escaped name is like it


def escaped(filename: str | None) -> str:
    """A file name that Spark's readers don't hide (``_`` and a dot in front do that), URL-escaped by ``=``, not ``%``."""
    name = quote(filename or "", safe="").replace("_", "%5F").replace("%", "=")
    return "=2E" + name[1:] if name[:1] == "." else name or NO_NAME


def write_text_corpus(docs: DataFrame, path: str) -> list[str]:
    """Write every document (filename, text) as a UTF-8 file that ends with a line break; the folders written.

    Each task attempt writes its files straight into a folder of its own below
    ``path``, and only the folders of attempts that succeeded are returned (one
    name a task).  Spark's own writer by ``filename`` opens a writer, makes a
    folder and moves it twice for each file.  Names are escaped; rows of one
    task that share a name share the file, a line break between them.
    """
    def run(batches):
        from pyspark import TaskContext

        local = path.removeprefix("file:")
        store, base = (fs.LocalFileSystem(), "/" + local.lstrip("/")) if local.startswith("/") else fs.FileSystem.from_uri(path)
        folder, name, out = f"part-{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}", None, None
        try:
            for b in batches:
                for filename, text in zip(b.column("filename").to_pylist(), b.column("text").to_pylist()):
                    if out is None:
                        store.create_dir(f"{base}/{folder}", recursive=True)
                        yield pa.RecordBatch.from_arrays([pa.array([folder])], ["folder"])
                    if out is None or filename != name:
                        if out is not None:
                            out.close()
                        name, out = filename, store.open_output_stream(f"{base}/{folder}/{escaped(filename)}")
                    out.write((text or b"") + b"\n")
        finally:
            if out is not None:
                out.close()

    rows = docs.select("filename", F.col("text").cast("binary").alias("text")).sortWithinPartitions("filename")
    return [os.path.join(path, r["folder"]) for r in rows.mapInArrow(run, "folder string").collect()]


def read_text_corpus(spark: SparkSession, path: str | list[str], pattern: str = "*.txt", written: bool = False) -> DataFrame:
    """One row per text file: raw(filename, title, text); title = file stem.

    ``wholetext`` keeps a file in one row, so a document is never split across
    tasks; many files spread over many tasks.  With ``written`` the paths are
    folders of ``write_text_corpus``: all files are taken, names are unescaped
    and the line break at the end of a file is removed.
    """
    if written:
        if not path:
            return spark.createDataFrame([], "filename string, title string, text string")
        df = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("filename"))
        df = df.select(F.when(F.col("filename") != NO_NAME, F.url_decode(F.replace("filename", F.lit("="), F.lit("%")))).alias("filename"),
                       F.expr("substring(value, 1, length(value) - 1)").alias("value"))
    else:
        df = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("filename"))
    return df.select("filename", F.regexp_replace("filename", r"\.[^.]*$", "").alias("title"), F.col("value").alias("text"))

"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null text as empty; every other column is left behind."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def raw_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8 (bytes.split cuts at exactly these characters)."""
    return text.encode("utf-8", "surrogatepass").split()


def lower_words(text: str) -> list[bytes]:
    """The same words with A-Z in lower case (bytes.lower touches ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def held_out(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``, is 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod)) == 1, F.lit(False))


def bounded(batches: Iterable[pa.RecordBatch], column: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``most`` bytes, or one row."""
    for batch in batches:
        rows = batch.num_rows
        if rows == 0:
            continue
        parts = max(1, -(-batch.column(batch.schema.get_field_index(column)).nbytes // most))
        step = max(1, -(-rows // parts))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """Each name, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out

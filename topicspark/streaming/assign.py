"""Streaming topic assignment (K8 / A5 on arriving texts).

New texts arrive as files in a folder.  Each micro-batch is encoded with the
fitted encoder statistics (static table) and compared with the topic vectors
(a bounded scalar), exactly as the batch operator does; no state is kept
between batches.  Output goes to one folder per batch id, overwritten on a
retry, so a replayed batch after a lost executor or driver restart writes the
same files again (idempotent sink); progress lives in the checkpoint folder.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.functions import text as T
from topicspark.operators import encode as E
from topicspark.operators import model as K
from topicspark.operators import vectorize as V


def assign_batch(batch: DataFrame, idf: DataFrame, cents, unit_cols, threshold: float = 0.0) -> DataFrame:
    """Topic of every text of one batch (unit columns + text); -1 without a known term."""
    units = list(unit_cols)
    toks = batch.select(*units, T.tokenize_word("text").alias("tokens"))
    counts = V.term_counts(toks.select(F.struct(*units).alias("_u"), "tokens"), "_u")
    dense = E.rows_to_dense(E.hash_rows(counts, idf, unit="_u"), unit="_u", units=toks.select(F.struct(*units).alias("_u")).distinct())
    a = K.assign_new(dense, cents, "_u", threshold=threshold)
    return a.select(*[F.col("_u")[u].alias(u) for u in units], "topic", "similarity")


def start_assignment_stream(spark: SparkSession, source: str, schema, out_dir: str, checkpoint: str,
                            idf: DataFrame, cents, unit_cols, fmt: str = "parquet",
                            max_files_per_trigger: int | None = None, available_now: bool = True):
    """Start the stream; returns the StreamingQuery."""
    units = list(unit_cols)
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        out = assign_batch(batch, idf, cents, units)
        out.write.mode("overwrite").parquet(os.path.join(out_dir, f"batch_id={batch_id}"))

    writer = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()

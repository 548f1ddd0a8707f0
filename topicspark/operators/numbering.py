"""Dense 0..n-1 numbering in a total order, without one task seeing all rows.

Rows are range-partitioned on the order key; each partition is numbered
locally, partition totals (one row per partition) give the offsets.  Only the
partition totals pass through a single window.  The partition layout is cut
once with a checkpoint so that a recomputation cannot move rows between ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicspark.session import cut_lineage


def dense_number(df: DataFrame, order_cols, out_col: str, weight_col: str | None = None,
                 partitions: int | None = None) -> DataFrame:
    """Add ``out_col`` = number of rows (or sum of ``weight_col``) before this row in order.

    With no weight every row counts 1, giving 0..n-1.  ``order_cols`` must be a
    total order (unique key).
    """
    order = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    spark = df.sparkSession
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    w = F.col(weight_col).cast("bigint") if weight_col else F.lit(1).cast("bigint")
    ranged = df.repartitionByRange(n_parts, *order).withColumn("__dn_pid", F.spark_partition_id()).withColumn("__dn_w", w)
    ranged = cut_lineage(ranged)
    local = Window.partitionBy("__dn_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.withColumn("__dn_local", F.coalesce(F.sum("__dn_w").over(local), F.lit(0)))
    totals = ranged.groupBy("__dn_pid").agg(F.sum("__dn_w").alias("__dn_tot"))
    # one row per partition: a tiny window, then a broadcast join
    offs = totals.withColumn(
        "__dn_off", F.coalesce(F.sum("__dn_tot").over(Window.orderBy("__dn_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = ranged.join(F.broadcast(offs.select("__dn_pid", "__dn_off")), "__dn_pid")
    return out.withColumn(out_col, (F.col("__dn_off") + F.col("__dn_local")).cast("bigint")).drop("__dn_pid", "__dn_w", "__dn_local", "__dn_off")

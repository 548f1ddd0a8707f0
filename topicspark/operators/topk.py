"""Top-k per group that survives a hot group.

``row_number() over (partition by g) <= k`` is planned by Spark with a
partial ``WindowGroupLimit`` before the shuffle (k up to
``spark.sql.optimizer.windowGroupLimitThreshold``, 1000 by default): each map
task forwards at most k rows per group, so a hot group reaches its final task
as k rows per map task, not as all its rows.  For larger k the rows are first
cut to the best k inside (group, salt) cells, where the salt is a hash of a
row key, then ranked again per group.  Both ways are exact: the best k of a
group are always among the best k of any part of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, group_cols, order_cols, k: int, salt_col=None, salt_buckets: int = 64,
          rank_col: str = "rank") -> DataFrame:
    groups = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    order = list(order_cols)
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if salt_col is not None and salt_buckets > 1 and k > threshold:
        salt = F.pmod(F.xxhash64(F.col(salt_col)), F.lit(salt_buckets))
        df = df.withColumn("_salt", salt)
        w1 = Window.partitionBy(*groups, "_salt").orderBy(*order)
        df = df.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1", "_salt")
    w = Window.partitionBy(*groups).orderBy(*order) if groups else Window.orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)

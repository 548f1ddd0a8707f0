"""CSV/TSV sources and sinks: corpus metadata (S2, S3) and custom labels."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METADATA_JA = T.StructType([T.StructField(n, t) for n, t in [
    ("filename", T.StringType()), ("author", T.StringType()), ("author_ja", T.StringType()),
    ("title", T.StringType()), ("title_ja", T.StringType()), ("genre", T.StringType()),
    ("year", T.IntegerType())]])
METADATA_EN = T.StructType([T.StructField(n, T.StringType()) for n in ["filename", "author", "title", "genre"]])
LABELS_CSV = T.StructType([T.StructField("topic_id", T.IntegerType()), T.StructField("custom_label", T.StringType())])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def read_metadata(spark: SparkSession, path: str, language: str = "Japanese") -> DataFrame:
    """TSV (Japanese) or CSV (English) with a header and a fixed schema.

    A missing file gives an empty table of the same schema.  English metadata
    has no year; it is added as NULL so that both languages share one schema.
    """
    schema = METADATA_JA if language == "Japanese" else METADATA_EN
    if not _exists(spark, path):
        df = spark.createDataFrame([], schema)
    else:
        df = (spark.read.option("header", True).option("sep", "\t" if language == "Japanese" else ",")
              .option("enforceSchema", False).schema(schema).csv(path))
    if language != "Japanese":
        df = df.withColumn("year", F.lit(None).cast("int"))
    return df


def write_metadata(df: DataFrame, path: str, language: str = "Japanese") -> None:
    cols = [f.name for f in (METADATA_JA if language == "Japanese" else METADATA_EN).fields]
    (df.select(*cols).write.mode("overwrite").option("header", True)
     .option("sep", "\t" if language == "Japanese" else ",").csv(path))


def localize_metadata(df: DataFrame) -> DataFrame:
    """S3: author/title replaced by author_ja/title_ja when those columns exist."""
    out = df
    for col in ("author", "title"):
        ja = f"{col}_ja"
        if ja in out.columns:
            out = out.drop(col).withColumnRenamed(ja, col)
    return out


def export_labels(labels: DataFrame, path: str) -> None:
    """Write (topic_id, custom_label) CSV with the '{topic}: ' prefix removed."""
    from topicspark.functions.text import strip_topic_prefix
    (labels.select(F.col("topic").cast("int").alias("topic_id"),
                   strip_topic_prefix("label", "topic").alias("custom_label"))
     .write.mode("overwrite").option("header", True).csv(path))


def import_labels(spark: SparkSession, path: str, current: DataFrame) -> DataFrame:
    """Read a labels CSV and overlay it on ``current`` (topic, label).

    Rejected unless it has both columns; rows for unknown topics are ignored
    (left join from the known topics); topics without a new label keep theirs.
    """
    raw = spark.read.option("header", True).csv(path)
    missing = {"topic_id", "custom_label"} - set(raw.columns)
    if missing:
        raise ValueError(f"labels file must have columns topic_id and custom_label; missing {sorted(missing)}")
    new = (raw.select(F.col("topic_id").try_cast("int").alias("topic"), F.col("custom_label").alias("_new"))
           .where(F.col("topic").isNotNull())
           .groupBy("topic").agg(F.max_by("_new", F.col("_new")).alias("_new")))
    return (current.join(new, "topic", "left")
            .withColumn("custom_label", F.coalesce(F.nullif(F.col("_new"), F.lit("")), F.col("label"))).drop("_new"))

"""Exact deduplication as a keyed stream (operator 5), DataFrame operations only.

Documents arrive as a stream of (digest, id, locator) rows.  A streaming
aggregation keeps one state row per digest in a disk-backed (RocksDB) store
without expiry: the smallest identifier seen, where its content lies, and the
number of arrivals.  A digest with more than one arrival is a hit; the full
normalised bytes of all its documents are then compared, so that two texts
that merely share a digest stay apart.

Defined cases: null text counts as empty; a null doc_id sorts after every
other id (``keep_id`` is null only where a whole group has no id); rows that
repeat doc_id and text are one document in the result and count once each in
``group_size``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.llm.common import WHITE, free_names, texts
from topicspark.session import materialize, scratch_path

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each store reserves megabytes of disk unused
}
SALTS = 8


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def arrivals(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """(doc_id, sha, digest, locator): one narrow row per document."""
    sha = F.unhex(F.sha2(normalised(F.col("text")), 256))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), sha.alias("sha"), F.input_file_name().alias("locator")) \
        .withColumn("digest", F.substring("sha", 1, digest_bytes))


def run_state(spark: SparkSession, folder: str) -> DataFrame:
    """Stream the arrival files of ``folder`` through the keyed state; return the state.

    (digest, keep_id, locator, n): the state as the store holds it after the
    last batch, read from its checkpoint in the shared folder.
    """
    if spark.read.parquet(folder).isEmpty():  # the stream would make no state to read
        return spark.createDataFrame([], "digest binary, keep_id bigint, locator string, n bigint")
    home = scratch_path(spark, "dedup-state")
    schema = spark.read.parquet(folder).schema
    with _conf(spark, STATE_CONF):
        first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "locator"))
        stream = spark.readStream.schema(schema).parquet(folder).groupBy("digest").agg(first.alias("first"), F.count("*").alias("n"))
        run = stream.writeStream.format("noop").outputMode("update").option("checkpointLocation", home).trigger(availableNow=True).start()
        run.awaitTermination()
        state = spark.read.format("statestore").load(home)
    value = [F.col(f"value.{f.name}") for f in state.schema["value"].dataType.fields]
    return state.select(F.col("key.digest").alias("digest"), value[0].getField("doc_id").alias("keep_id"),
                        value[0].getField("locator").alias("locator"), value[1].alias("n"))


def dedup_report(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``digest_bytes`` shortens the state's key (tests use it to force
    collisions; results don't depend on it).
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "dedup-arrivals")
    arrivals(docs, digest_bytes).write.parquet(folder)
    narrow = spark.read.parquet(folder)
    hits = run_state(spark, folder).filter("n > 1").select("digest")
    members = narrow.join(hits, "digest").select(F.col("doc_id"), "digest").distinct()

    # full bytes of every hit: texts move by id (no key is hot), equal ones then meet once a task
    known = texts(docs).filter("doc_id IS NOT NULL").join(members.filter("doc_id IS NOT NULL"), "doc_id")
    unknown = texts(docs).filter("doc_id IS NULL").withColumn("digest", F.substring(F.unhex(F.sha2(normalised(F.col("text")), 256)), 1, digest_bytes)) \
        .join(hits, "digest").select("doc_id", "text", "digest")
    bodies = known.select("doc_id", "text", "digest").unionAll(unknown).withColumn("body", normalised(F.col("text")))
    sha = F.unhex(F.sha2(F.col("body"), 256))
    bodies = bodies.filter(F.substring(sha, 1, digest_bytes) == F.col("digest"))
    variants = bodies.groupBy("digest", "body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    variants = materialize(variants.select("digest", F.unhex(F.sha2("body", 256)).alias("sha"), F.crc32(F.col("body").cast("binary")).alias("crc"),
                                           F.length("body").alias("chars"), "keep_id", "n"), "dedup-variants")

    # a digest with one body needs no more; of others, each body is its own group
    groups = variants.groupBy("digest", "sha").agg(F.count("*").alias("bodies"), F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    if groups.filter("bodies > 1").limit(1).count():
        raise RuntimeError("two different texts share a SHA-256 value")
    groups = groups.select("sha", "keep_id", "group_size", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    one = narrow.select("doc_id", "sha").distinct().withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS)))
    out = one.join(groups, ["sha", "salt"], "left")
    found = F.col("group_size").isNotNull()
    return out.select("doc_id", F.when(found, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
                      F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
                      F.when(found, F.col("doc_id").eqNullSafe(F.col("keep_id"))).otherwise(F.lit(True)).alias("kept"),
                      F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row per kept document."""
    sha, keep, keep_sha = free_names(docs, "__sha", "__keep", "__keep_sha")
    kept = dedup_report(docs).filter("kept").select(F.col("doc_id").alias(keep), F.col("text_sha256").alias(keep_sha))
    marked = docs.withColumn(sha, F.sha2(normalised(F.col("text")), 256))
    same = marked["doc_id"].cast("bigint").eqNullSafe(F.col(keep)) & (marked[sha] == F.col(keep_sha))
    return marked.join(kept, same, "left_semi").dropDuplicates(["doc_id", sha]).drop(sha)

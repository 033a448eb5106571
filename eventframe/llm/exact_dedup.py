"""Exact deduplication with a keyed streaming state (DataFrame functions only).

A narrow table of fingerprints (digest, identifier, locator) is streamed through a Structured Streaming
aggregate in update mode. Its state, held by RocksDB on the executors' disks and checkpointed to the shared
folder, has one entry per digest, never expires, and keeps the smallest identifier with the place of its
content (the locator) and the number of rows. The state is read back as a table; groups with more than one
row are hits, and their whole normalised texts are compared. Rows with equal digests and different texts
would be grouped again by the text itself.

Defined cases: a null text counts as empty; a null identifier sorts after all others; of rows with equal
text and equal smallest identifier the one with the smallest locator stays; an empty table gives an empty
result; extra columns are ignored by ``dedup`` and kept by ``keep_first``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventframe.llm.common import broadcast_hot, cut, free_name, table
from eventframe.session import scratch_dir

#: Runs of white space other than exactly one space.
_WHITE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
#: Session settings for the run of the stream; the earlier values are put back.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores: no space is set aside on disk for each of them
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # all stores of an executor share one budget of memory, and a store is closed when its task ends
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "192",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text: str = "text") -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _WHITE, " ")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, digest, locator)`` per row; the locator is the row's place in the written table's order."""
    return docs.select(F.col(doc_id).alias("id"), F.sha2(normalised(text), 256).alias("digest"),
                       F.monotonically_increasing_id().alias("locator"))


def stream_state(spark: SparkSession, path: str, schema, batches: int = 2) -> DataFrame:
    """Stream the fingerprint files below ``path`` through the keyed state, in about ``batches``
    micro-batches, and return the state: ``(digest, keep, size)``, ``keep`` = (no_id, id, locator)."""
    files = len(spark.read.schema(schema).parquet(path).inputFiles())
    source = (spark.readStream.schema(schema)
              .option("maxFilesPerTrigger", max(1, math.ceil(files / batches))).parquet(path))
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "locator")
    state = source.groupBy("digest").agg(F.min(first).alias("keep"), F.count("*").alias("size"))
    place = scratch_dir(spark, "dedup-state")
    before = {k: spark.conf.get(k, None) for k in _STATE}
    try:
        for k, v in _STATE.items():
            spark.conf.set(k, v)
        (state.writeStream.outputMode("update").format("noop").option("checkpointLocation", place)
         .trigger(availableNow=True).start().awaitTermination())
        entries = spark.read.format("statestore").load(place)
        return cut(entries.select(F.col("key.digest").alias("digest"), F.col("value.min").alias("keep"),
                                  F.col("value.count").alias("size")), "dedup-groups")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def collisions(docs: DataFrame, groups: DataFrame, text: str = "text") -> DataFrame:
    """The digests among the hits whose whole normalised texts are not all equal (none, but for a broken
    digest). A group's texts meet as one smallest and one largest text of each task."""
    keys = cut(groups.where("size > 1").select(F.xxhash64("digest").alias("_key")), "hits")
    texts = docs.select(normalised(text).alias("_text"))
    texts = texts.withColumn("_digest", F.sha2("_text", 256)).withColumn("_key", F.xxhash64("_digest"))
    ends = texts.join(keys, "_key", "left_semi").groupBy("_digest").agg(
        F.min("_text").alias("lo"), F.max("_text").alias("hi"))
    return ends.where("lo <> hi").select(F.col("_digest").alias("digest"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256, locator)`` for every row of ``docs``."""
    spark = docs.sparkSession
    path = scratch_dir(spark, "fingerprints")
    fingerprints(docs, doc_id, text).write.parquet(path)
    rows = spark.read.parquet(path)
    if rows.isEmpty():
        groups = rows.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "locator"))
                                            .alias("keep"), F.count("*").alias("size"))
    else:
        groups = stream_state(spark, path, rows.schema, 2)
        if not (broken := cut(collisions(docs, groups, text), "collisions")).isEmpty():
            rows, groups = _by_text(docs, rows, groups, broken, doc_id, text)
    out = broadcast_hot(rows, groups, "digest", "size")
    return out.select(F.col("id").alias("doc_id"), F.col("keep.id").alias("keep_id"), F.col("size").alias("group_size"),
                      (F.col("locator") == F.col("keep.locator")).alias("kept"),
                      F.substring("digest", 1, 64).alias("text_sha256"), "locator")


def _by_text(docs, rows, groups, broken, doc_id, text):
    """Regroup the rows of colliding digests by a key that the text itself extends."""
    texts = docs.select(F.col(doc_id).alias("id"), normalised(text).alias("_text"))
    texts = texts.withColumn("digest", F.sha2("_text", 256)).join(broken, "digest", "left_semi")
    split = cut(texts.select("id", F.concat("digest", "_text").alias("digest"),
                             F.monotonically_increasing_id().alias("locator")), "collisions")
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "locator")
    again = split.groupBy("digest").agg(F.min(first).alias("keep"), F.count("*").alias("size"))
    return (rows.join(broken, "digest", "left_anti").unionByName(split),
            groups.join(broken, "digest", "left_anti").unionByName(again))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged."""
    kept = dedup(docs, doc_id, text)
    drop = kept.where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest"))
    stay = kept.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest"))
    # (id, digest) pairs with a row that stays and rows that go are repeated rows
    again = cut(drop.intersect(stay), "repeated")
    drop = cut(drop.distinct().subtract(again), "dropped")
    own, digest = free_name(docs, "_id"), free_name(docs, "_digest")
    marked = docs.withColumns({own: F.col(doc_id), digest: F.sha2(normalised(text), 256)})
    same = lambda d: (marked[digest] == d["_digest"]) & marked[own].eqNullSafe(d["_id"])
    left = marked.join(drop, same(drop), "left_anti")
    if again.isEmpty():
        return left.drop(own, digest)
    once = left.join(again, same(again), "left_semi").dropDuplicates([own, digest])
    return left.join(again, same(again), "left_anti").unionByName(once).drop(own, digest)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the row that stays for its text."""
    return dedup(table(spark, sf_dir, "documents")).drop("locator")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

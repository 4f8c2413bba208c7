"""Exact deduplication as a stateful stream (operator 4).

1. Every document is reduced to (row, doc_id, SHA-256 digest, content locator)
   in one scan; the text itself does not travel.
2. A Structured Streaming query over those rows keeps keyed state without
   expiry in RocksDB, on the executors' disks and in the checkpoint: per digest
   the number of rows, the stable identifier (largest doc_id, then largest row)
   and its content locator. Rows of one digest are combined before the
   shuffle, so a hot group is one state update per task. Appending files to the
   same ``state_path`` and running again continues from that state.
3. On hits (digests with several rows) the full bytes are compared: the texts
   of those rows are grouped by (digest, text) itself. Digests that turn out to
   stand for several texts are split by text.

Null text counts as empty, so all null and empty texts are one group. Repeated
rows (same doc_id and text) belong to one group; exactly one row of a group is
kept. A null doc_id ranks below every other. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, documents, scratch, settings, sha256_digest, write_table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW = ("row long, doc_id long, digest binary, locator string")


def digest_rows(docs: DataFrame, digest=sha256_digest, locator: Column | None = None) -> DataFrame:
    """One row per document without its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    where = locator if locator is not None else F.input_file_name()
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       digest(text).alias("digest"), where.alias("locator"))


def update_state(spark: SparkSession, rows_path: str, state_path: str, shuffle: int | None = None) -> DataFrame:
    """Run the stream over all files that it has not seen yet; returns the
    state by digest: n, keep_id, keep_row, locator."""
    stream = spark.readStream.schema(ROW).parquet(rows_path)
    state = stream.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "row", "locator")).alias("best"))
    out = os.path.join(state_path, "updates")

    def write(batch: DataFrame, batch_id: int) -> None:
        # a batch that is run again after a failure replaces its own folder
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    conf = {"spark__sql__streaming__stateStore__providerClass": ROCKSDB,
            # preallocated log files would take 4 MB in each state partition
            "spark__sql__streaming__stateStore__rocksdb__allowFAllocate": "false",
            "spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage": "true",
            "spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB": "128",
            # an executor holds many state partitions: small write buffers, and
            # the stores of a stream that has ended go within seconds
            "spark__sql__streaming__stateStore__rocksdb__writeBufferSizeMB": "8",
            "spark__sql__streaming__stateStore__maintenanceInterval": "10s"}
    with settings(spark, **conf):
        (state.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", os.path.join(state_path, "checkpoint"))
         .trigger(availableNow=True).start().awaitTermination())
    seen = spark.read.option("basePath", out).schema(
        "digest binary, n long, best struct<doc_id: long, row: long, locator: string>, batch long").parquet(out)
    newest = seen.groupBy("digest").agg(F.max(F.struct("batch", "n", "best")).alias("s"))
    return newest.select("digest", F.col("s.n").alias("n"), F.col("s.best.doc_id").alias("keep_id"),
                         F.col("s.best.row").alias("keep_row"), F.col("s.best.locator").alias("locator"))


def exact_dedup(docs: DataFrame, digest=sha256_digest, locator: Column | None = None) -> DataFrame:
    """doc_id, digest, keep_id, locator (of the row that stays), group_size and
    kept, for every row of ``docs``."""
    spark = docs.sparkSession
    rows_path, state_path = scratch(spark, "digests"), scratch(spark, "dedup-state")
    digest_rows(docs, digest, locator).write.parquet(rows_path)
    rows = spark.read.schema(ROW).parquet(rows_path)
    if rows.isEmpty():
        return rows.select("doc_id", "digest", F.col("doc_id").alias("keep_id"), "locator",
                           F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    state = write_table(update_state(spark, rows_path, state_path), "dedup-groups")
    found = rows.drop("locator").join(state, "digest").select(
        "doc_id", "row", "digest", "keep_id", "locator", F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"))
    clash = collisions(docs, state, digest)
    if clash.isEmpty():
        return found.drop("row")
    return split_collisions(docs, found, clash, digest).drop("row")


def collisions(docs: DataFrame, state: DataFrame, digest=sha256_digest) -> DataFrame:
    """Full-byte check of the hits: digests whose rows do not all hold the same
    text. Copies are combined in each task before their text is shuffled."""
    hits = broadcast_if_small(state.where("n > 1").select("digest"), 80)
    text = F.coalesce(F.col("text"), F.lit(""))
    same = (docs.select(text.alias("text")).withColumn("digest", digest(F.col("text")))
            .join(hits, "digest", "left_semi").groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n")))
    return write_table(same.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"),
                       "dedup-collisions")


def split_collisions(docs: DataFrame, found: DataFrame, clash: DataFrame, digest) -> DataFrame:
    """Groups of the clashing digests by their text instead."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = write_table(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                                   text.alias("text")).withColumn("digest", digest(F.col("text")))
                       .join(clash, "digest", "left_semi"), "dedup-clashing")
    groups = rows.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("group_size"),
                                                F.max(F.struct("doc_id", "row")).alias("best"))
    apart = rows.join(groups, ["digest", "text"]).select(
        "doc_id", "row", "digest", F.col("best.doc_id").alias("keep_id"), F.lit(None).cast("string").alias("locator"),
        "group_size", (F.col("row") == F.col("best.row")).alias("kept"))
    return found.join(clash, "digest", "left_anti").unionByName(apart)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the row of its group of equal texts that stays."""
    docs = documents(spark, sf_dir)
    where = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    return exact_dedup(docs, locator=where).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the rows that an equal text with a larger doc_id
    replaces; of repeated rows (same doc_id and text) one stays."""
    verdict = write_table(exact_dedup(docs), "dedup-verdict")
    stays = verdict.where("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    goes = verdict.where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    twice = goes.join(stays, goes["_id"].eqNullSafe(stays["_id"]) & (goes["_digest"] == stays["_digest"]), "left_semi")
    key = sha256_digest(F.coalesce(docs["text"], F.lit("")))
    if twice.isEmpty():
        gone = broadcast_if_small(goes, 80)
        return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (key == gone["_digest"]), "left_anti")
    kept = docs.join(stays, docs["doc_id"].eqNullSafe(stays["_id"]) & (key == stays["_digest"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])

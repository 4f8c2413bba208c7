"""Small helpers shared by the operators: tables in the shared folder,
checked broadcasts, and joins that keep null keys."""

from __future__ import annotations

import contextlib
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ensure_session

#: Rows and bytes up to which a table may be broadcast (both are checked).
BROADCAST_BYTES = 32 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share."""
    ensure_session(spark)
    return os.path.join(checkpoint_dir(spark), f"llm-{name}-{uuid.uuid4().hex[:12]}")


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back, so
    later uses neither repeat the work nor depend on lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table of ``write_table`` that no later plan reads."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def broadcast_if_small(df: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint when the rows fit ``limit`` bytes; otherwise the plain
    table, which the planner joins by shuffle. ``row_bytes``: a bound for every
    row, or a column with each row's own size where rows have none."""
    size = df.count() * row_bytes if isinstance(row_bytes, int) else df.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


@contextlib.contextmanager
def settings(spark: SparkSession, **values):
    """Session settings for one block, put back afterwards (names with __ for dots)."""
    old = {}
    for k, v in values.items():
        k = k.replace("__", ".")
        old[k] = spark.conf.get(k, None)
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def text_digest(docs: DataFrame) -> Column:
    """Digest of a row's text; null counts as empty."""
    return sha256_digest(F.coalesce(docs["text"], F.lit("")))


def without(docs: DataFrame, dropped: DataFrame, how: str = "left_anti") -> DataFrame:
    """Rows of ``docs`` whose doc_id and text digest are not together in
    ``dropped`` (a null doc_id matches null), or with ``left_semi`` those that
    are; no column is added, so extra columns of any name pass through."""
    gone = dropped.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    gone = broadcast_if_small(gone, 80)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (text_digest(docs) == gone["_digest"]), how)

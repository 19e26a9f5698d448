"""Where jobs keep tables that every executor must see, and small column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Characters that separate words in every contract of this package.
WORD_SPACE = " \t\n\x0b\x0c\r"


#: Bytes of rows in one Arrow batch: what a task holds at once on both sides of a Python function.
BATCH = "8m"


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches be of ``BATCH`` bytes in this session, unless it sets their size itself."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "64m", "64MB", str(64 << 20), f"{64 << 20}b"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that the cluster shares.

    ``spark.checkpoint.dir`` names that folder. Only a local session may leave it unset: then a
    folder of this machine serves, which no cluster could use.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="fernhill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which ends its lineage there."""
    small_batches(df.sparkSession)
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of an id written as text; the contracts split training and held-out rows by it."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of ``key``.

    A bound on the hash, from the number of rows, first leaves little more than that, so that no task
    sends many more rows than its share.
    """
    n = rows.count()
    code = F.xxhash64(key)
    if n > most:
        rows = rows.where(code <= min(2**63 - 1, int((1.05 * most + 500) / n * 2**64) - 2**63))
    return rows.orderBy(code, key).limit(most)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name

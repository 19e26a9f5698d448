"""Snapshots of ranked results that are named by their content, and what changed between two."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def top_results(results: DataFrame, order: Sequence[Column | str], limit: int = 10, by: str = "query_id") -> DataFrame:
    """The first ``limit`` results of each query with their ``rank``; scores are rounded to 6 places."""
    w = W.partitionBy(by).orderBy(*order)
    ranked = results.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit)
    return ranked.withColumn("score", F.round(F.col("score").cast("double"), 6)) if "score" in results.columns else ranked


def content_digest(rows: DataFrame) -> str:
    """32 hex digits that depend on the rows, their number and the columns, not on their order or partitions.

    Each row's sha256 gives four numbers of 60 bits; tasks add them up, so that the driver gets one row.
    """
    columns = sorted(rows.columns)
    code = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(code, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{k}") for k in range(4)]
    named = F.concat_ws(":", F.lit(",".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)), "n", *(F.coalesce(f"s{k}", F.lit(0)) for k in range(4)))
    return rows.agg(F.count("*").alias("n"), *parts).select(F.substring(F.sha2(named, 256), 1, 32)).first()[0]


class SnapshotStore:
    """Folders below ``root`` by content: what is stored twice is there once, and a folder never changes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def write(self, rows: DataFrame) -> str:
        """Store the rows and return their digest. A folder gets its name by one rename after all of it is written."""
        draft = f"{self.root}/draft-{uuid.uuid4().hex}"
        rows.write.parquet(draft)
        digest = content_digest(self.spark.read.schema(rows.schema).parquet(draft))
        target = self._path(f"{self.root}/{digest}")
        if self._fs.exists(target) or not self._fs.rename(self._path(draft), target):
            self._fs.delete(self._path(draft), True)
        return digest

    def read(self, digest: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{digest}")


def diff_results(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("query_id", "product_id")) -> DataFrame:
    """(keys, change, old_rank, new_rank, old_score, new_score) of the results that are not the same in both.

    Both have (keys, rank, score), a key once. A result is added, lost, moved (its rank differs) or rescored
    (its rank is the same). Equal snapshots give no rows.
    """
    side = lambda rows, name: rows.select(*(F.col(k).alias(f"{name}_{k}") for k in keys), F.col("rank").alias(f"{name}_rank"), F.col("score").alias(f"{name}_score"), F.lit(True).alias(f"in_{name}"))
    a, b = side(old, "old"), side(new, "new")
    rows = a.join(b, functools.reduce(lambda x, y: x & y, (a[f"old_{k}"].eqNullSafe(b[f"new_{k}"]) for k in keys)), "full_outer")
    change = (
        F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "lost").when(~F.col("old_rank").eqNullSafe(F.col("new_rank")), "moved")
        .when(~F.col("old_score").eqNullSafe(F.col("new_score")), "rescored")
    )
    found = rows.withColumn("change", change).where(F.col("change").isNotNull())
    return found.select(*(F.when(F.col("in_old"), F.col(f"old_{k}")).otherwise(F.col(f"new_{k}")).alias(k) for k in keys), "change", "old_rank", "new_rank", "old_score", "new_score")

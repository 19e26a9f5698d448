"""Incremental flows as Structured Streaming jobs over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fernhill.operators.resolution import latest_wins, upsert_by_key
from fernhill.streaming.bucket_table import BucketTable


def _drain(stream: DataFrame, table: BucketTable, merge, checkpoint: str) -> BucketTable:
    """Process all files there are; each batch is one commit of the table."""
    q = stream.writeStream.foreachBatch(lambda batch, number: table.apply(batch, number, merge) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return table


def refresh_stream(spark: SparkSession, source: str, schema: T.StructType, root: str, files: int = 1, buckets: int = 16) -> BucketTable:
    """Stream refreshed image records (product_id, refreshed_at, ...) into an index table.

    Within a batch only a product's latest refresh counts; it replaces all rows of the product. The table
    is in buckets by product; an empty feed leaves it empty.
    """

    def merge(old: DataFrame, batch: DataFrame) -> DataFrame:
        newest = batch.groupBy("product_id").agg(F.max("refreshed_at").alias("refreshed_at"))
        return upsert_by_key(old, batch.join(newest, ["product_id", "refreshed_at"], "left_semi"), "product_id")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return _drain(stream, BucketTable(spark, f"{root}/index", schema, "product_id", buckets), merge, f"{root}/checkpoint")


def judgment_stream(spark: SparkSession, source: str, schema: T.StructType, root: str, files: int = 1, late: str = "1 day", buckets: int = 16) -> BucketTable:
    """Stream feedback (product_id, judgment_id, judged_at) into one current row per product; retries come once."""

    def merge(old: DataFrame, batch: DataFrame) -> DataFrame:
        return latest_wins(old.unionByName(batch), ["product_id"], F.desc("judged_at"), F.desc("judgment_id"))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    once = stream.withWatermark("judged_at", late).dropDuplicatesWithinWatermark(["judgment_id"])
    return _drain(once, BucketTable(spark, f"{root}/index", schema, "product_id", buckets), merge, f"{root}/checkpoint")

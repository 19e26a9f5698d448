"""Queries that write files from the given tables and read them as feeds or streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fernhill.fixtures import duck_sql, view
from fernhill.plans._book import ORACLES, QUERIES
from fernhill.sources import catalog as S
from fernhill.streaming import refresh as R
from fernhill.tables import scratch


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "fx_products")
    urls = F.when(F.col("product_id") % 10 == 0, "").otherwise(F.concat(F.lit("https://x.test/"), F.col("product_id"), F.lit("/1.jpg, https://x.test/2.png")))
    levels = lambda c: F.concat(F.col(c), F.lit("::0::"), F.col(c))
    return p.select(
        F.col("product_id").cast("string").alias("Product ID"), F.concat(F.lit(" "), F.col("product_name"), F.lit(', "q"')).alias("Product Name"), F.col("brand").alias("Brand Name"), levels("a_level").alias("A level Names"),
        levels("b_level").alias("B Level Names"), F.lit("").alias("C Level Names"), urls.alias("Image Url"),
    )


def read_project_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "feed")
    _feed(spark, sf_dir).write.csv(path, header=True, quote='"', escape='"', encoding="ISO-8859-1")
    got = S.read_project_csv(spark, path)
    return got.select("raw_id", "product_name", "brand", F.array_join("a_level", "|").alias("a_level"), F.size("c_level").cast("long").alias("n_c"), F.array_join("image_urls", "|").alias("urls"))


def read_export_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "export")
    p = view(spark, sf_dir, "fx_products")
    image = F.concat(F.lit("https://x.test/"), F.col("product_id"), F.lit(".jpg?v=1"))
    rows = p.select(F.col("product_id").cast("string").alias("Product ID"), F.col("product_name").alias("Name"), F.col("brand").alias("Manufacturer"), F.col("a_level").alias("Category"), image.alias("Default Image URL"), F.when(F.col("product_id") % 2 == 0, image).otherwise("notes.txt").alias("Attachments"))
    rows.write.csv(path, header=True, quote='"', escape='"')
    return S.read_export_dir(spark, path).select("product_id", "product_name", "brand", F.array_join("image_urls", "|").alias("urls"))


def read_id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "ids")
    p = view(spark, sf_dir, "fx_products")
    line = F.when(F.col("product_id") % 3 == 0, F.concat(F.lit("https://x.test/p/"), F.col("product_id"), F.lit("/name"))).when(F.col("product_id") % 3 == 1, F.col("product_id").cast("string")).otherwise("Product ID")
    p.select(line.alias("value")).union(p.select(line.alias("value"))).write.text(path)
    return S.read_id_list(spark, path)


def read_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "snapshot")
    p = view(spark, sf_dir, "fx_products")
    ids = F.when(F.col("product_id") % 2 == 0, F.concat(F.lit("product_dp_"), F.col("product_id"))).otherwise(F.concat(F.lit("product_0123456789ab_"), F.col("product_id") - F.col("product_id") % 4))
    group = F.floor(F.col("product_id") / 500).alias("grp")
    doc = p.select(group, ids.alias("product_id"), "product_name").groupBy("grp").agg(F.collect_list(F.struct("product_id", "product_name")).alias("products"), F.collect_list(F.struct(F.col("product_id").alias("image_id"), "product_id")).alias("images"))
    doc.drop("grp").write.json(path)
    return S.read_index_snapshot(spark, path, lines=True)[0].select("product_id", "product_name")


def write_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "report")
    S.write_report(view(spark, sf_dir, "fx_products").groupBy("brand").agg(F.count("*").alias("n")), path, "csv")
    return spark.read.csv(path, header=True, schema="brand string, n long")


def _batches(spark: SparkSession, rows: DataFrame, path: str) -> None:
    for k in range(3):  # files in the order of their batches
        rows.where(F.col("batch") == k).drop("batch").coalesce(1).write.mode("append").parquet(path)


def refresh_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark, "refresh")
    e = view(spark, sf_dir, "fx_refreshes").select("product_id", "refreshed_at", "event_id", "status", (F.col("event_id") % 3).cast("int").alias("batch"))
    _batches(spark, e, f"{root}/in")
    schema = e.drop("batch").schema
    return R.refresh_stream(spark, f"{root}/in", schema, root).read().select("product_id", "event_id", "status")


def judgment_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark, "judgments")
    e = view(spark, sf_dir, "fx_refreshes").select("product_id", F.col("event_id").alias("judgment_id"), F.col("refreshed_at").cast("timestamp").alias("judged_at"), (F.col("event_id") % 3).cast("int").alias("batch"))
    _batches(spark, e, f"{root}/in")
    schema = e.drop("batch").schema
    return R.judgment_stream(spark, f"{root}/in", schema, root, late="10000 days").read().select("product_id", "judgment_id")


QUERIES |= {
    "s1_read_project_csv": read_project_csv, "s2_read_export_dir": read_export_dir, "s4_read_id_list": read_id_list, "s11_stage_index_snapshot": read_snapshot,
    "s15_write_report": write_report, "t1_refresh_stream": refresh_stream, "t2_judgment_stream": judgment_stream,
}
ORACLES |= {
    name: duck_sql(sql)
    for name, sql in {
        "s1_read_project_csv": """SELECT CAST(product_id AS VARCHAR) AS raw_id, concat(product_name, ', "q"') AS product_name, brand, a_level, 0::BIGINT AS n_c, concat('https://x.test/', product_id, '/1.jpg|https://x.test/2.png') AS urls FROM fx_products WHERE product_id % 10 <> 0""",
        "s2_read_export_dir": "SELECT CAST(product_id AS VARCHAR) AS product_id, product_name, brand, concat('https://x.test/', product_id, '.jpg?v=1') AS urls FROM fx_products",
        "s4_read_id_list": "SELECT CAST(product_id AS VARCHAR) AS product_id FROM fx_products WHERE product_id % 3 <> 2",
        "s11_stage_index_snapshot": "WITH p AS (SELECT CASE WHEN product_id % 2 = 0 THEN concat('product_dp_', product_id) ELSE concat('product_0123456789ab_', product_id - product_id % 4) END AS product_id, product_name FROM fx_products) SELECT * FROM p WHERE product_id LIKE 'product_dp_%' OR regexp_extract(product_id, '(\\d+)$', 1) NOT IN (SELECT regexp_extract(product_id, '(\\d+)$', 1) FROM p WHERE product_id LIKE 'product_dp_%')",
        "s15_write_report": "SELECT brand, count(*) AS n FROM fx_products GROUP BY 1",
        "t1_refresh_stream": "WITH e AS (SELECT *, event_id % 3 AS b FROM fx_refreshes), l AS (SELECT product_id, max(b) AS b FROM e GROUP BY 1), m AS (SELECT product_id, b, max(refreshed_at) AS r FROM e GROUP BY ALL) SELECT e.product_id, e.event_id, e.status FROM e JOIN l USING (product_id, b) JOIN m ON m.product_id = e.product_id AND m.b = e.b AND m.r = e.refreshed_at",
        "t2_judgment_stream": "SELECT product_id, arg_max(event_id, (refreshed_at, event_id)) AS judgment_id FROM fx_refreshes GROUP BY 1",
    }.items()
}

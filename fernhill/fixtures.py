"""Views that reshape the test tables into catalog tables; the same text serves Spark and DuckDB.

``{table}`` stands for a base table. ``with_clause`` gives the WITH list that a query needs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "fx_products": """
SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS brand,
       p_type AS a_level, split_part(p_name, ' ', 2) AS b_level, split_part(p_name, ' ', 1) AS c_level,
       CASE p_type WHEN 'SMALL' THEN 'stool' WHEN 'MEDIUM' THEN 'guest_chair' WHEN 'LARGE' THEN 'lounge_chair'
                   WHEN 'STANDARD' THEN 'task_collab_chair' WHEN 'ECONOMY' THEN 'bench' ELSE '' END AS visual_type
FROM {part}""",
    "fx_images": """
SELECT CAST((order_id * 8 + line) * 61 + twin - 1 AS BIGINT) AS image_id, product_id, position, visual_type, brand, stage_0_result, excluded, confidence_tier,
       ai_refreshed_at, short_side, CAST((order_id * 7 + line + twin * 3) % 500 AS BIGINT) AS vec_id, tiebreaker_triggered, supplier_id
FROM (
  SELECT CAST(l_orderkey AS BIGINT) AS order_id, CAST(l_linenumber AS BIGINT) AS line,
         CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS BIGINT) AS twin,
         CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate) AS BIGINT) AS position,
         l_partkey AS product_id, p.visual_type, p.brand,
         CASE WHEN l_returnflag = 'R' THEN 'scene' ELSE 'product' END AS stage_0_result,
         l_discount > 0.095 AS excluded,
         CASE WHEN l_tax < 0.025 THEN 'high' WHEN l_tax < 0.055 THEN 'medium' ELSE 'low' END AS confidence_tier,
         l_shipdate AS ai_refreshed_at, CAST(floor(l_extendedprice / 50) AS INT) AS short_side,
         l_linestatus = 'F' AS tiebreaker_triggered, l_suppkey AS supplier_id
  FROM {lineitem} JOIN fx_products p ON p.product_id = l_partkey) t""",
    "fx_traits": """
SELECT image_id, product_id, position, visual_type, stage_0_result, excluded, field,
       CASE WHEN v = 0 THEN 'unknown' WHEN v = 9 THEN 'off-list' ELSE concat('value ', CAST(v AS VARCHAR(8))) END AS value
FROM (
  SELECT i.*, f.field, (i.image_id * f.k + i.product_id) % f.n AS v
  FROM fx_images i CROSS JOIN (VALUES ('base_type', 3, 6), ('base_finish', 5, 7), ('arm_option', 7, 5), ('back_height', 11, 10)) AS f(field, k, n)) t""",
    "fx_catalog_side": """
SELECT CASE WHEN p_partkey % 7 = 0 THEN concat('legacy_', md5(CAST(p_partkey AS VARCHAR(20))), 'x') ELSE concat('product_', substring(md5(p_name), 1, 12), '_', CAST(p_partkey AS VARCHAR(20))) END AS source_product_id,
       p_name AS product_name, p_brand AS brand FROM {part} WHERE p_partkey % 5 <> 0""",
    "fx_index_side": """
SELECT concat('product_dp_', CAST(p_partkey AS VARCHAR(20))) AS source_product_id, p_name AS product_name, p_brand AS brand FROM {part} WHERE p_partkey % 3 <> 0""",
    "fx_runs": """
SELECT o_orderkey AS image_id, r.run_id, 'arm_option' AS field,
       concat('value ', CAST((o_orderkey + (o_custkey % r.m)) % 4 AS VARCHAR(8))) AS value
FROM {orders} CROSS JOIN (VALUES (1, 1), (2, 2), (3, 3)) AS r(run_id, m)""",
    "fx_rankings": """
SELECT l_orderkey AS query_id, l_partkey AS product_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS model_rank,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS BIGINT) AS human_rank,
       l_returnflag = 'R' AS removed
FROM {lineitem}""",
    "fx_refreshes": """
SELECT event_id, user_id AS product_id, ts AS refreshed_at, event_type AS status, value AS cost_usd, props FROM {events}""",
}


def with_clause(body: str) -> str:
    """The WITH list for the views that ``body`` names, those that they name included."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in need:
                add(VIEWS[name])
                need.append(name)

    add(body)
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in need)
    return f"WITH {views}" if views else ""


def duck_sql(body: str) -> str:
    """``body`` with the views it needs, for DuckDB; it may begin with WITH and names base tables in braces."""
    views = with_clause(body)
    if views and (m := re.match(r"\s*WITH\b", body)):
        body = ", " + body[m.end() :]
    text = f"{views}\n{body}"
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views as a DataFrame over the tables of ``sf_dir``."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    text = f"{with_clause(name)} SELECT * FROM {name}"
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)

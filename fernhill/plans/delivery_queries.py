"""Queries on snapshots, page payloads, catalog staging, logs, sort modes and client rows."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from fernhill.fixtures import duck_sql, table, view
from fernhill.functions import text as T, vectors as Vec
from fernhill.operators import evaluation as V, resolution as E, retrieval as R, snapshots as Sn, vector_search as N
from fernhill.plans._book import ORACLES, QUERIES, query
from fernhill.plans.retrieval_queries import _TOPK
from fernhill.sources import catalog as S, payload as P
from fernhill.tables import scratch


def _results(emb: DataFrame, scene_loss: bool) -> DataFrame:
    images = emb.select(F.col("vec_id").alias("image_id"), F.col("label").alias("product_id"), "embedding")
    queries = emb.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = N.vector_topk(images, queries, 50, ties=["product_id"]).join(images.drop("embedding"), "image_id").withColumn("confidence", F.lit(0))
    room = F.col("image_id") % 7 == 0 if scene_loss else F.lit(False)
    scored = R.image_score(near, F.col("similarity"), F.lit(0.0), F.col("product_id") == F.col("query_id") % 10, F.col("image_id") == F.col("query_id"), room)
    return Sn.top_results(R.rollup_to_product(scored), ["product_rank"], 5).select("query_id", "product_id", "rank", "score", "hero_image_id")


def search_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the top five of each search become when scenes lose nothing, by two stored snapshots."""
    store, emb = Sn.SnapshotStore(spark, scratch(spark, "snapshots")), table(spark, sf_dir, "embeddings")
    old, new = (store.write(_results(emb, loss)) for loss in (True, False))
    return Sn.diff_results(store.read(old), store.read(new))


def _ranked_sql(name: str, loss: str) -> str:
    score = f"round(similarity + CASE WHEN product_id = query_id % 10 THEN 0.03 ELSE 0.0 END + CASE WHEN image_id = query_id THEN 2.0 ELSE 0.0 END - {loss}, 6)"
    return f"""{name}_p AS (SELECT query_id, product_id, max({score}) AS score FROM topk GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM {name}_p
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) <= 5)"""


def _page_json(p: DataFrame) -> DataFrame:
    """A page for each product, whose attribute names it; some are broken in one way or another."""
    k = F.col("product_id")
    entry = lambda level, name: F.struct(level.alias("level"), name.alias("name"))
    cats = F.when(k % 5 == 0, F.array(entry(F.lit("0"), F.col("a_level")), entry(F.lit("2"), F.col("c_level")))).otherwise(
        F.array(entry(F.lit("0"), F.col("a_level")), entry(F.lit("1"), F.concat(F.lit(" "), F.col("b_level"))), entry(F.lit("1"), F.col("b_level")), entry(F.lit("2"), F.col("c_level"))))
    url = lambda n: F.concat(F.lit("https://x.test/"), k, F.lit(f"/{n}.jpg?a=1&b=2"))
    body = F.struct(
        F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(k.cast("string")).alias("id"), F.concat(F.lit("The  \""), F.col("product_name"), F.lit("\" <b> & 'c'")).alias("name"),
        F.struct(F.col("brand").alias("name")).alias("manufacturer"), cats.alias("dp_categories"), F.struct(url(0).alias("url")).alias("default_image"), F.array(F.struct(url(1).alias("url")), F.struct(url(0).alias("url"))).alias("additional_images"),
    )
    json = F.to_json(body)
    json = F.when(k % 7 == 0, F.substring(json, 1, 40)).otherwise(json)
    for char, entity in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;")):
        json = F.replace(json, F.lit(char), F.lit(entity))
    div = F.concat(F.lit('<html><title>x</title><DIV id="z" class="wide image-column left" data-source-data="'), json, F.lit('"></div><p data-source-data="{}">'))
    return p.select("product_id", F.when(k % 13 == 0, "").when(k % 17 == 0, "<div class=\"image-columns\" data-source-data=\"{}\">").otherwise(div).alias("html"))


@query("s5_page_attributes", """
WITH p AS (SELECT *, CASE WHEN product_id % 13 = 0 THEN 'empty_page' WHEN product_id % 17 = 0 THEN 'no_payload' WHEN product_id % 7 = 0 THEN 'broken_payload' WHEN product_id % 11 = 0 THEN 'no_id' END AS why FROM fx_products),
q AS (SELECT *, why IS NULL OR why = 'no_id' AS fine, CASE WHEN product_id % 5 = 0 THEN a_level ELSE b_level END AS b FROM p)
SELECT product_id, CASE WHEN fine THEN CASE WHEN product_id % 11 = 0 THEN '' ELSE CAST(product_id AS VARCHAR) END END AS source_product_id,
  CASE WHEN fine THEN concat('The "', product_name, '" <b> & ''c''') END AS product_name, CASE WHEN fine THEN brand END AS brand,
  CASE WHEN fine THEN concat_ws('|', a_level, b, c_level) END AS levels, CASE WHEN fine THEN CASE WHEN c_level = b THEN b ELSE concat(c_level, ' :: ', b) END END AS raw_category,
  CASE WHEN fine THEN concat('https://x.test/', product_id, '/0.jpg?a=1&b=2 https://x.test/', product_id, '/1.jpg?a=1&b=2') END AS urls, why AS flag_reason FROM q""", "fx_products")
def page_attributes(products):
    # a few bytes of a product become a page: dealt first, since a small file of products is one task otherwise
    got = P.read_payloads(_page_json(products.repartition("product_id")))
    levels = F.when(F.col("a_level").isNotNull(), F.concat_ws("|", F.array_join("a_level", "+"), F.array_join("b_level", "+"), F.array_join("c_level", "+")))
    return got.select("product_id", "source_product_id", "product_name", "brand", levels.alias("levels"), "raw_category", F.array_join("image_urls", " ").alias("urls"), "flag_reason")


def stage_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of many objects with repeated products, staged and put over what was there."""
    path = scratch(spark, "catalog")
    p = view(spark, sf_dir, "fx_products")
    one = lambda name, n: F.struct(F.concat(F.lit(" "), F.col("product_id"), F.lit(" ")).alias("product_id"), name.alias("name"), "brand", F.array(F.col("a_level"), F.lit(" ")).alias("a_level"), F.concat(F.lit("u/"), "product_id", F.lit(f"/{n}")).alias("product_image"))
    image = lambda n: F.struct(F.concat("product_id", F.lit(f"_{n}")).alias("image_id"), (F.col("product_id") + F.when(F.col("product_id") % 10 == 0, 10_000_000).otherwise(0)).cast("string").alias("product_id"), F.concat(F.lit("u/"), "product_id", F.lit(f"/{n}")).alias("image_url"))
    rows = p.select((F.col("product_id") % 50).alias("grp"), "product_id", F.array(one(F.lit("first"), 1), one(F.col("product_name"), 2)).alias("products"), F.array(image(1), image(2)).alias("images"))
    docs = rows.groupBy("grp").agg(F.flatten(F.collect_list("products")).alias("products"), F.flatten(F.collect_list("images")).alias("images"))
    docs.drop("grp").write.json(path)
    products, images = S.stage_catalog_snapshot(spark, path, "normalized_catalog", lines=True)
    was = p.where("product_id % 4 = 0").select(F.lit("normalized_catalog").alias("source_system"), F.concat(F.col("product_id"), F.when(F.col("product_id") % 8 == 0, "_gone").otherwise("")).alias("source_product_id"), F.lit("old").alias("product_name"))
    staged = E.upsert_by_key(was, products.select(*was.columns), "source_system", "source_product_id")
    n = images.groupBy("source_product_id").agg(F.count("*").alias("n_images"), F.count_if("is_catalog_primary_image").alias("n_primary"))
    found = staged.join(n, "source_product_id", "left").join(products.select("source_product_id", F.array_join("a_level", "|").alias("a_level")), "source_product_id", "left")
    S.audit_run(spark, scratch(spark, "audit"), "normalized_catalog", "catalog_snapshot", path, products.count())
    return found.select("source_product_id", "product_name", F.coalesce("n_images", F.lit(0)).alias("n_images"), F.coalesce("n_primary", F.lit(0)).alias("n_primary"), "a_level")


def audit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two jobs, appended to the audit table and read back."""
    path, at = scratch(spark, "audit"), datetime.datetime(2024, 1, 1)
    p, i = view(spark, sf_dir, "fx_products"), view(spark, sf_dir, "fx_images")
    S.audit_run(spark, path, "catalog", "products", "p.json", p.count(), {"brands": p.select("brand").distinct().count()}, at)
    log = S.audit_run(spark, path, "index", "images", "i.json", i.count(), at=at)
    return log.select("source_system", "record_type", "record_count", "notes", F.date_format("run_at", "yyyy-MM-dd").alias("run_on"))


def correction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of two appends, the second of which sends a part again, by field."""
    path, e = scratch(spark, "corrections"), view(spark, sf_dir, "fx_refreshes")
    k = F.col("event_id")
    rows = e.select(
        k, F.col("refreshed_at").cast("timestamp").alias("corrected_at"), F.concat(F.lit(" u/"), "product_id", F.lit("/"), k % 50).alias("image_url"), F.col("status").alias("field"), F.concat(F.lit("value "), k % 3).alias("model_value"),
        F.when(k % 5 > 0, F.concat(F.lit("value "), k % 4, F.lit(" "))).alias("user_value"), (k % 7 == 0).alias("was_skipped"),
    )
    V.append_corrections(rows.where("event_id % 3 < 2"), path)
    return V.correction_summary(V.append_corrections(rows.where("event_id % 3 > 0"), path))


_SORT_ROWS = """
SELECT p.brand AS query_id, p.product_id, p.product_name, p.brand, round(sum(i.short_side) / 1000.0, 4) AS score, max(CASE confidence_tier WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS confidence,
       max(CAST(i.ai_refreshed_at AS VARCHAR(30))) AS ai_refreshed_at, p.product_id % 19 = 0 AS is_exact_source
FROM fx_products p JOIN fx_images i USING (product_id) GROUP BY p.product_id, p.product_name, p.brand"""
_MODES = {
    "auto": "is_exact_source DESC, score DESC, confidence DESC", "refreshed_desc": "ai_refreshed_at DESC, score DESC", "refreshed_asc": "ai_refreshed_at, score DESC",
    "name": "lower(product_name), product_name, lower(brand), brand",
}


@query("l1_sort_modes", f"WITH r AS ({_SORT_ROWS}) " + " UNION ALL ".join(f"SELECT '{m}' AS mode, query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY {o}, product_id) AS place FROM r QUALIFY place <= 12" for m, o in _MODES.items()), "fx_products", "fx_images")
def sort_modes(products, images):
    confidence = T.confidence_rank(F.col("confidence_tier"))
    rows = images.drop("brand").join(products, "product_id").groupBy("product_id", "product_name", "brand").agg(F.round(F.sum("short_side") / 1000.0, 4).alias("score"), F.max(confidence).alias("confidence"), F.max(F.col("ai_refreshed_at").cast("string")).alias("ai_refreshed_at"))
    rows = rows.withColumns({"query_id": F.col("brand"), "is_exact_source": F.col("product_id") % 19 == 0})
    found = [R.sort_results(rows, m, limit=12).select(F.lit(m).alias("mode"), "query_id", "product_id", "place") for m in _MODES]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query("p7_trim_columns", """
WITH i AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY short_side DESC, image_id) AS n FROM fx_images)
SELECT product_id, brand, count(*) AS match_count, string_agg(concat(image_id, ' ', stage_0_result, ' ', image_id % 3 = 0), ', ' ORDER BY n) FILTER (WHERE n <= 3) AS images FROM i GROUP BY product_id, brand""", "fx_images")
def trim_columns(images):
    one = F.struct((-F.col("short_side")).alias("o"), "image_id", "stage_0_result", F.when(F.col("image_id") % 3 == 0, F.array(F.lit(1.0))).alias("embedding"), "supplier_id")
    rows = images.groupBy("product_id", "brand").agg(F.count("*").alias("match_count"), F.array_sort(F.collect_list(one)).alias("matching_images"), F.max("supplier_id").alias("internal"))
    got = R.client_projection(rows)
    text = F.transform("matching_images", lambda x: F.concat_ws(" ", x["image_id"].cast("string"), x["stage_0_result"], x["has_stored_embedding"].cast("string")))
    return got.select("product_id", "brand", "match_count", F.array_join(text, ", ").alias("images"))


@query("f28_unit_vector", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN list_transform(embedding::DOUBLE[], lambda x: x * 0) ELSE embedding::DOUBLE[] END AS e FROM {embeddings}),
u AS (SELECT vec_id, CASE WHEN list_inner_product(e, e) > 0 THEN list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) ELSE [] END AS u FROM v)
SELECT vec_id, len(u) AS n, round(u[1], 6) AS first, round(u[64], 6) AS last, CASE WHEN len(u) > 0 THEN round(list_inner_product(u, u), 6) ELSE 0 END AS norm FROM u""", "embeddings")
def unit_vectors(emb):
    e = F.col("embedding").cast("array<double>")
    u = Vec.unit_vector(F.when(F.col("vec_id") % 10 == 0, F.transform(e, lambda x: x * 0)).otherwise(e))
    norm = F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)
    return emb.select("vec_id", u.alias("u")).select("vec_id", F.size("u").cast("long").alias("n"), F.round(F.try_element_at("u", F.lit(1)), 6).alias("first"), F.round(F.try_element_at("u", F.lit(64)), 6).alias("last"), F.round(norm, 6).alias("norm"))


_CATEGORIES = [("Bolts", ["bolt"]), ("Nuts and rings", ["wing nut", "NUT", "ring"])]


@query("f24_canonical_category", "SELECT product_id, CASE WHEN contains(lower(product_name), 'bolt') THEN 'Bolts' WHEN contains(lower(product_name), 'nut') OR contains(lower(product_name), 'ring') THEN 'Nuts and rings' ELSE product_name END AS category FROM fx_products", "fx_products")
def canonical(products):
    return products.select("product_id", T.canonical_category(F.concat(F.lit(" "), F.initcap("product_name"), F.lit("  ")), _CATEGORIES).alias("category")).withColumn("category", F.when(F.col("category").isin("Bolts", "Nuts and rings"), F.col("category")).otherwise(F.lower("category")))


QUERIES |= {"e12_search_snapshot": search_snapshot, "s12_stage_catalog_snapshot": stage_catalog, "s16_audit_table": audit_table, "e13_correction_outcomes": correction_log}
ORACLES |= {
    name: duck_sql(sql)
    for name, sql in {
        "e12_search_snapshot": f"""WITH {_TOPK}, {_ranked_sql("old", "CASE WHEN image_id % 7 = 0 THEN 0.2 ELSE 0.0 END")}, {_ranked_sql("new", "0.0")},
d AS (SELECT coalesce(o.query_id, n.query_id) AS query_id, coalesce(o.product_id, n.product_id) AS product_id,
        CASE WHEN o.rank IS NULL THEN 'added' WHEN n.rank IS NULL THEN 'lost' WHEN o.rank <> n.rank THEN 'moved' WHEN o.score <> n.score THEN 'rescored' END AS change,
        o.rank AS old_rank, n.rank AS new_rank, o.score AS old_score, n.score AS new_score FROM old o FULL JOIN new n ON o.query_id = n.query_id AND o.product_id = n.product_id)
SELECT * FROM d WHERE change IS NOT NULL""",
        "s12_stage_catalog_snapshot": """
SELECT CAST(product_id AS VARCHAR) AS source_product_id, product_name, CASE WHEN product_id % 10 = 0 THEN 0 ELSE 2 END::BIGINT AS n_images, CASE WHEN product_id % 10 = 0 THEN 0 ELSE 1 END::BIGINT AS n_primary, a_level FROM fx_products
UNION ALL SELECT concat(product_id, '_gone'), 'old', 0, 0, NULL FROM fx_products WHERE product_id % 8 = 0""",
        "s16_audit_table": """
SELECT 'catalog' AS source_system, 'products' AS record_type, count(*) AS record_count, concat('{"brands": ', count(DISTINCT brand), '}') AS notes, '2024-01-01' AS run_on FROM fx_products
UNION ALL SELECT 'index', 'images', count(*), '{}', '2024-01-01' FROM fx_images""",
        "e13_correction_outcomes": """
WITH c AS (SELECT DISTINCT refreshed_at, concat('u/', product_id, '/', event_id % 50) AS image_url, status AS field, concat('value ', event_id % 3) AS m, CASE WHEN event_id % 5 > 0 THEN concat('value ', event_id % 4) END AS u, event_id % 7 = 0 AS skipped FROM fx_refreshes),
o AS (SELECT *, CASE WHEN skipped THEN 'skipped' WHEN coalesce(u, m) = m THEN 'accepted' ELSE 'changed' END AS outcome FROM c)
SELECT field, count(*) AS corrections, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'accepted') AS accepted, count(*) FILTER (WHERE outcome = 'changed') AS changed, count(DISTINCT image_url) AS images FROM o GROUP BY field""",
    }.items()
}

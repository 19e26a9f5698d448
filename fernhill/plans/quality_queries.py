"""Queries on diagnostics, evaluation, ingest, aggregations and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from fernhill.functions import text as T
from fernhill.operators import diagnostics as D, evaluation as V, ordered as O
from fernhill.plans._book import query, rows
from fernhill.sources import catalog as S

_TYPES = ("stool", "guest_chair", "lounge_chair", "task_collab_chair", "bench")
_FIELDS = ("base_type", "base_finish", "arm_option", "back_height")
_VOCAB_SQL = "vocab AS (SELECT t.visual_type, f.field FROM (VALUES " + ", ".join(f"('{t}')" for t in _TYPES) + ") t(visual_type) CROSS JOIN (VALUES " + ", ".join(f"('{f}')" for f in _FIELDS) + ") f(field) WHERE NOT (t.visual_type = 'stool' AND f.field = 'arm_option'))"


def _vocab(like):
    return rows(like, [(t, f) for t in _TYPES for f in _FIELDS if (t, f) != ("stool", "arm_option")], "visual_type string, field string")


_MISSING = "('', 'unknown', 'na', 'null', 'undefined')"

# ---- diagnostics -----------------------------------------------------------------------------


@query("d1_trait_health", f"""
WITH {_VOCAB_SQL}, base(visual_type, field, baseline) AS (VALUES ('bench', 'base_type', 0.95), ('stool', 'base_type', 0.84)),
b AS (SELECT image_id, visual_type FROM fx_images WHERE stage_0_result = 'product' AND visual_type <> ''),
h AS (SELECT b.visual_type, v.field, count(*) AS images, count(*) FILTER (WHERE lower(trim(t.value)) NOT IN {_MISSING}) AS present
      FROM b JOIN vocab v USING (visual_type) LEFT JOIN fx_traits t ON t.image_id = b.image_id AND t.field = v.field GROUP BY ALL)
SELECT h.*, round(present / images, 6) AS coverage, base.baseline::DOUBLE AS baseline, round(present / images, 6) < 0.8 AS below,
  coalesce(round(base.baseline::DOUBLE - round(present / images, 6), 6) >= 0.1, false) AS dropped FROM h LEFT JOIN base USING (visual_type, field)""", "fx_images", "fx_traits")
def trait_health(images, traits):
    return D.trait_health(images, traits, _vocab(traits), rows(traits, [("bench", "base_type", 0.95), ("stool", "base_type", 0.84)], "visual_type string, field string, baseline double"))


@query("d3_compliance_violations", f"SELECT visual_type, field, value, count(*) AS n, min(image_id) AS first_image FROM fx_traits WHERE lower(trim(value)) NOT IN {_MISSING} AND value NOT IN ('value 1', 'value 2', 'value 3', 'value 4', 'value 5', 'value 6', 'value 7', 'value 8') GROUP BY ALL", "fx_traits")
def violations(traits):
    return D.compliance_violations(traits, rows(traits, [(f, f"value {n}") for f in _FIELDS for n in range(1, 9)], "field string, value string"))


_RULES = [("stool_with_arms", "visual_type = 'stool' AND arm_option = 'value 1'"), ("bench_back", "visual_type = 'bench' AND back_height = 'value 2'"), ("no_base", "base_type = 'unknown' AND base_finish <> 'unknown'")]
_WIDE = "wide AS (SELECT image_id, visual_type, " + ", ".join(f"max(value) FILTER (WHERE field = '{f}') AS {f}" for f in _FIELDS) + " FROM fx_traits GROUP BY ALL)"


@query("d4_logical_inconsistencies", f"WITH {_WIDE} " + " UNION ALL ".join(f"SELECT image_id, '{n}' AS rule FROM wide WHERE {c}" for n, c in _RULES), "fx_traits")
def inconsistent(traits):
    wide = traits.groupBy("image_id", "visual_type").pivot("field", list(_FIELDS)).agg(F.max("value"))
    return D.inconsistencies(wide, _RULES)


@query("d2_supplemental_metrics", f"""WITH {_WIDE} SELECT visual_type, count(*) AS images, count(*) FILTER (WHERE back_height <> 'unknown') AS with_back, count(*) FILTER (WHERE back_height <> 'unknown' AND arm_option <> 'unknown') AS backs_with_arms,
round(count(*) FILTER (WHERE back_height <> 'unknown' AND arm_option <> 'unknown') / nullif(count(*) FILTER (WHERE back_height <> 'unknown'), 0), 6) AS arm_share FROM wide GROUP BY 1""", "fx_traits")
def supplemental(traits):
    found = D.supplemental_metrics(traits, "back_height", "arm_option")
    return found.withColumnsRenamed({"with_field": "with_back", "with_both": "backs_with_arms", "share": "arm_share"})


@query("d20_applicability", f"WITH {_WIDE} SELECT image_id, base_type <> 'unknown' AS base_applies, visual_type <> 'stool' AND arm_option <> 'unknown' AS arms_apply, visual_type IN ('bench', 'lounge_chair') AS seat_applies FROM wide", "fx_traits")
def applicability(traits):
    return D.applicability(traits, {"base_applies": (None, (), "base_type"), "arms_apply": (None, ("stool",), "arm_option"), "seat_applies": (("bench", "lounge_chair"), (), None)})


@query("d5_extraction_failures", "SELECT product_id, count(*) AS failures FROM fx_refreshes WHERE status IN ('error', 'refund') GROUP BY 1", "fx_refreshes")
def failures(refreshes):
    return D.failures(refreshes)[0]


@query("d6_stage_cost", """
WITH s AS (SELECT *, CASE WHEN stage_0_result <> 'product' THEN 'not_applicable' WHEN excluded THEN 'failed' ELSE 'extracted' END AS status, short_side * 0.001::DOUBLE AS cost FROM fx_images)
SELECT visual_type, count(*) FILTER (WHERE status <> 'not_applicable') AS eligible, count(*) FILTER (WHERE status = 'extracted') AS extracted, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status = 'not_applicable') AS not_applicable, round(sum(CASE WHEN status = 'extracted' THEN cost ELSE 0.0 END), 4) AS cost, round(avg(cost) FILTER (WHERE status = 'extracted'), 6) AS mean_cost FROM s GROUP BY 1""", "fx_images")
def stage_cost(images):
    return D.stage_cost(images, F.col("short_side") * 0.001)


@query("d8_tiebreaker_counts", "SELECT visual_type, count(*) AS images, count(*) FILTER (WHERE tiebreaker_triggered) AS all_tiebreaks, count(*) FILTER (WHERE tiebreaker_triggered AND stage_0_result = 'product') AS product_tiebreaks FROM fx_images GROUP BY 1", "fx_images")
def tiebreakers(images):
    return D.tiebreaker_counts(images)





@query("d9_mapping_diagnostics", """
WITH d(grouping_, decided) AS (VALUES ('Brand#11', 'stool'), ('Brand#12', 'bench')), t(grouping_, tabled) AS (VALUES ('Brand#12', 'stool'), ('Brand#13', 'bench')),
p AS (SELECT brand AS grouping_, count(*) AS products FROM fx_products GROUP BY 1), i AS (SELECT brand AS grouping_, visual_type FROM fx_images),
m AS (SELECT grouping_, visual_type, count(*) AS n FROM i WHERE visual_type <> '' GROUP BY ALL),
x AS (SELECT grouping_, visual_type AS extracted FROM (SELECT *, row_number() OVER (PARTITION BY grouping_ ORDER BY n DESC, visual_type) AS k, sum(n) OVER (PARTITION BY grouping_) AS total FROM m) WHERE k = 1 AND n >= total * 0.2),
s AS (SELECT grouping_, count(*) AS images, count(*) FILTER (WHERE visual_type = '') AS missing FROM i GROUP BY 1)
SELECT p.grouping_ AS "grouping", products, coalesce(images, 0) AS images, coalesce(missing, 0) AS missing, coalesce(decided, tabled, extracted, '') AS mapped_type,
  CASE WHEN decided IS NOT NULL THEN 'decision' WHEN tabled IS NOT NULL THEN 'table' WHEN extracted IS NOT NULL THEN 'dominant' ELSE 'unmapped' END AS mapping_source
FROM p LEFT JOIN s USING (grouping_) LEFT JOIN d USING (grouping_) LEFT JOIN t USING (grouping_) LEFT JOIN x USING (grouping_)""", "fx_products", "fx_images")
def mapping(products, images):
    g = lambda df: df.withColumnRenamed("brand", "grouping")
    decisions = rows(products, [("Brand#11", "stool"), ("Brand#12", "bench")], "grouping string, decided string")
    table = rows(products, [("Brand#12", "stool"), ("Brand#13", "bench")], "grouping string, tabled string")
    return D.mapping_diagnostics(g(products), g(images), decisions, table, 0.2)


@query("d10_mismatch_scan", """
WITH r AS (SELECT brand AS category, visual_type, image_id FROM fx_images),
b AS (SELECT *, row_number() OVER (PARTITION BY category, visual_type ORDER BY image_id) AS k FROM r WHERE NOT (category IN ('Brand#11', 'Brand#12') AND visual_type = 'stool'))
SELECT category, visual_type, count(*) AS n, string_agg(CAST(image_id AS VARCHAR), ',' ORDER BY image_id) FILTER (WHERE k <= 5) AS examples FROM b GROUP BY ALL""", "fx_images")
def mismatches(images):
    return D.mismatch_scan(images.select(F.col("brand").alias("category"), "visual_type", "image_id"), rows(images, [("Brand#11", "stool"), ("Brand#12", "stool")], "category string, visual_type string"))


_SIGNALS = [("with the", 3), ("[0-9]{3}", 2), ("tion", 1), ("https?://", 4), ("(scum|trash)", 5)]


@query("d11_scene_triage", "SELECT doc_id, " + " + ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {w} ELSE 0 END" for p, w in _SIGNALS) + " AS score, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{p}' END" for p, _ in _SIGNALS) + ") AS fired FROM {documents}", "documents")
def triage(docs):
    return docs.select("doc_id", T.score_of(F.col("text"), _SIGNALS).alias("score"), F.array_join(T.fired(F.col("text"), _SIGNALS), ",").alias("fired"))


@query("d12_stale_types", "SELECT i.image_id, i.visual_type, p.visual_type AS mapped_type FROM (SELECT image_id, product_id + 1 AS product_id, visual_type FROM fx_images) i JOIN fx_products p USING (product_id) WHERE i.visual_type <> p.visual_type AND p.visual_type <> ''", "fx_images", "fx_products")
def stale(images, products):
    return D.stale_types(images.withColumn("product_id", F.col("product_id") + 1), products.select("product_id", F.col("visual_type").alias("mapped_type")))


@query("d13_hero_audit", """
SELECT p.product_id, i.image_id, CASE WHEN i.image_id IS NULL THEN 'no_image' WHEN i.excluded THEN 'excluded' WHEN i.stage_0_result <> 'product' THEN 'scene' END AS skip_reason
FROM fx_products p LEFT JOIN (SELECT * FROM fx_images WHERE position = 1) i USING (product_id)""", "fx_products", "fx_images")
def hero_audit(products, images):
    return D.hero_audit(products, images)


@query("d14_ghost_fields", f"WITH {_VOCAB_SQL} SELECT t.visual_type, t.field, count(*) AS removed FROM fx_traits t LEFT JOIN vocab v USING (visual_type, field) WHERE v.field IS NULL GROUP BY ALL", "fx_traits")
def ghosts(traits):
    return D.ghost_fields(traits, _vocab(traits))


@query("d15_value_migration", """
WITH r(field, value, nf, nv) AS (VALUES ('base_type', 'value 1', 'leg_type', 'four leg'), ('arm_option', 'value 2', 'arm_option', 'armless'))
SELECT t.image_id, coalesce(nf, t.field) AS field, coalesce(nv, t.value) AS value, nf IS NOT NULL AS migrated FROM fx_traits t LEFT JOIN r USING (field, value)""", "fx_traits")
def migration(traits):
    return D.value_migration(traits, rows(traits, [("base_type", "value 1", "leg_type", "four leg"), ("arm_option", "value 2", "arm_option", "armless")], "field string, value string, new_field string, new_value string"))


@query("d17_env_gap", """
WITH a AS (SELECT product_id, count(*) AS n, max(brand) AS name FROM fx_images GROUP BY 1),
b AS (SELECT product_id, count(*) FILTER (WHERE image_id % 9 <> 0 AND product_id % 11 <> 0) AS n, max(brand) AS name FROM fx_images WHERE product_id % 7 <> 0 GROUP BY 1)
SELECT product_id, CASE WHEN b.name IS NULL THEN 'missing_everything' WHEN a.name IS NULL THEN 'extra' WHEN b.n = 0 THEN 'shell_only' WHEN b.n < a.n THEN 'partial' ELSE 'present' END AS state, a.name IS DISTINCT FROM b.name AS name_differs FROM a FULL JOIN b USING (product_id)""", "fx_images")
def env_gap(images):
    a = images.groupBy("product_id").agg(F.count("*").alias("n_images"), F.max("brand").alias("name"))
    b = images.where("product_id % 7 <> 0").groupBy("product_id").agg(F.count_if((F.col("image_id") % 9 != 0) & (F.col("product_id") % 11 != 0)).alias("n_images"), F.max("brand").alias("name"))
    return D.env_gap(a, b)


@query("d18_post_copy_verify", "SELECT product_id, count(*) AS expected, count(*) FILTER (WHERE image_id % 50 <> 0) AS copied, count(*) = count(*) FILTER (WHERE image_id % 50 <> 0) AS complete FROM fx_images GROUP BY 1", "fx_images")
def verify_copy(images):
    return D.copy_verify(images, images.where("image_id % 50 <> 0"), "product_id")


@query("d21_snapshot_parity", """
WITH s AS (SELECT product_id, brand, product_name FROM fx_products WHERE product_id % 13 <> 0), n AS (SELECT product_id, CASE WHEN product_id % 17 = 0 THEN 'x' ELSE brand END AS brand, product_name FROM fx_products WHERE product_id % 19 <> 0)
SELECT count(*) FILTER (WHERE s.product_id IS NOT NULL AND n.product_id IS NOT NULL) AS matching, count(*) FILTER (WHERE s.product_id IS NULL) AS missing, count(*) FILTER (WHERE n.product_id IS NULL) AS extra,
  count(*) FILTER (WHERE s.product_id IS NOT NULL AND n.product_id IS NOT NULL AND s.brand IS DISTINCT FROM n.brand) AS differs_brand,
  count(*) FILTER (WHERE s.product_id IS NOT NULL AND n.product_id IS NOT NULL AND s.product_name IS DISTINCT FROM n.product_name) AS differs_product_name FROM s FULL JOIN n ON s.product_id = n.product_id""", "fx_products")
def parity(products):
    p = products.select("product_id", "brand", "product_name")
    return D.snapshot_parity(p.where("product_id % 13 <> 0"), p.where("product_id % 19 <> 0").withColumn("brand", F.when(F.col("product_id") % 17 == 0, "x").otherwise(F.col("brand"))), "product_id", "brand", "product_name")


@query("d22_refresh_outcome", """
SELECT product_id, count(*) AS attempts, count(*) FILTER (WHERE status IN ('error', 'refund')) AS failed, round(sum(cost_usd), 4) AS cost_usd, max(refreshed_at) AS last_refreshed,
  CASE WHEN count(*) FILTER (WHERE status IN ('error', 'refund')) = count(*) THEN 'error' WHEN count(*) FILTER (WHERE status IN ('error', 'refund')) > 0 THEN 'partial' ELSE 'ok' END AS outcome FROM fx_refreshes GROUP BY 1""", "fx_refreshes")
def outcome(refreshes):
    return D.refresh_outcome(refreshes)


# ---- aggregations ----------------------------------------------------------------------------


@query("a1_bootstrap_counts", "SELECT (SELECT count(*) FROM fx_products) AS products, (SELECT count(*) FROM fx_images) AS images, (SELECT count(*) FROM fx_images WHERE vec_id IN (SELECT vec_id FROM {embeddings})) AS indexed", "fx_products", "fx_images", "embeddings")
def bootstrap(products, images, emb):
    indexed = images.join(emb.select("vec_id"), "vec_id", "left_semi").agg(F.count("*").alias("indexed"))
    return products.agg(F.count("*").alias("products")).crossJoin(images.agg(F.count("*").alias("images"))).crossJoin(indexed)


_FAMILY = [("stool", "seating"), ("guest_chair", "seating"), ("lounge_chair", "lounge"), ("bench", "lounge")]


@query("a2_family_searchable_counts", "WITH f(visual_type, family) AS (VALUES " + ", ".join(map(str, _FAMILY)) + "), c AS (SELECT visual_type, count(DISTINCT product_id) AS n FROM fx_images WHERE stage_0_result = 'product' AND NOT excluded GROUP BY 1) SELECT family, CAST(sum(n) AS BIGINT) AS products FROM c JOIN f USING (visual_type) GROUP BY 1", "fx_images")
def families(images):
    per = images.where("stage_0_result = 'product' AND NOT excluded").groupBy("visual_type").agg(F.countDistinct("product_id").alias("n"))
    return per.join(rows(images, _FAMILY, "visual_type string, family string"), "visual_type").groupBy("family").agg(F.sum("n").alias("products"))


@query("a3_category_counts", "SELECT coalesce(nullif(visual_type, ''), 'unspecified') AS category, count(*) AS images, count(*) FILTER (WHERE tiebreaker_triggered) AS tiebreaks FROM fx_images GROUP BY 1", "fx_images")
def categories(images):
    return images.groupBy(F.coalesce(F.nullif("visual_type", F.lit("")), F.lit("unspecified")).alias("category")).agg(F.count("*").alias("images"), F.count_if("tiebreaker_triggered").alias("tiebreaks"))


@query("a4_distinct_lists", "SELECT DISTINCT 'brand' AS kind, brand AS value FROM fx_products UNION ALL SELECT DISTINCT 'category', b_level FROM fx_products", "fx_products")
def lists(products):
    return S.distinct_values(products, {"brand": "brand", "category": "b_level"})


@query("a5_lightweight_products", """
WITH i AS (SELECT product_id, count(*) AS images, count(*) FILTER (WHERE stage_0_result = 'product') AS passing, string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) FILTER (WHERE position <= 3) AS first_images FROM fx_images WHERE product_id % 6 <> 0 GROUP BY 1),
p AS (SELECT product_id, product_name FROM fx_products WHERE product_id % 5 <> 0)
SELECT product_id, coalesce(product_name, '') AS product_name, coalesce(images, 0) AS images, coalesce(passing, 0) AS passing, coalesce(first_images, '') AS first_images FROM p FULL JOIN i USING (product_id)""", "fx_products", "fx_images")
def lightweight(products, images):
    firsts = F.array_join(F.array_sort(F.collect_list(F.when(F.col("position") <= 3, F.col("position")))).cast("array<string>"), ",")
    i = images.where("product_id % 6 <> 0").groupBy("product_id").agg(F.count("*").alias("images"), F.count_if(F.col("stage_0_result") == "product").alias("passing"), firsts.alias("first_images"))
    p = products.where("product_id % 5 <> 0").select("product_id", "product_name")
    return p.join(i, "product_id", "full_outer").fillna({"product_name": "", "images": 0, "passing": 0, "first_images": ""})


@query("a12_unmapped_summary", "SELECT b_level AS \"grouping\", count(DISTINCT product_id) AS products, min(product_id) AS first_seen, string_agg(DISTINCT a_level, ',' ORDER BY a_level) AS reasons, b_level IN ('nut', 'bolt') AS resolved FROM fx_products WHERE visual_type = '' OR product_id % 3 = 0 GROUP BY 1, 5", "fx_products")
def unmapped(products):
    g = products.where("visual_type = '' OR product_id % 3 = 0").groupBy(F.col("b_level").alias("grouping")).agg(F.countDistinct("product_id").alias("products"), F.min("product_id").alias("first_seen"), F.array_join(F.array_sort(F.collect_set("a_level")), ",").alias("reasons"))
    return g.withColumn("resolved", F.col("grouping").isin("nut", "bolt"))


@query("a13_import_counts", "SELECT brand, a_level, count(*) AS n FROM fx_products GROUP BY ALL", "fx_products")
def import_counts(products):
    return products.groupBy("brand", "a_level").agg(F.count("*").alias("n"))


@query("a14_dominant_value", "WITH c AS (SELECT product_id, field, value, count(*) AS n, min(position) AS first_at FROM fx_traits WHERE value <> 'unknown' GROUP BY ALL) SELECT product_id, field, value, n FROM c QUALIFY row_number() OVER (PARTITION BY product_id, field ORDER BY n DESC, first_at) = 1", "fx_traits")
def dominant(traits):
    c = traits.where("value <> 'unknown'").groupBy("product_id", "field", "value").agg(F.count("*").alias("n"), F.min("position").alias("first_at"))
    return c.withColumn("k", F.row_number().over(W.partitionBy("product_id", "field").orderBy(F.desc("n"), "first_at"))).where("k = 1").select("product_id", "field", "value", "n")


@query("a15_exact_quantiles", "SELECT visual_type, count(*) AS support, round(avg(short_side), 6) AS mean, " + ", ".join(f"round(quantile_cont(short_side::DOUBLE, {q}), 6) AS p{int(q * 100)}" for q in (0.25, 0.5, 0.75, 0.9)) + " FROM fx_images GROUP BY 1", "fx_images")
def quantiles(images):
    totals = images.groupBy("visual_type").agg(F.count("*").alias("support"), F.round(F.avg("short_side"), 6).alias("mean"))
    return O.with_quantiles(totals, images, ["visual_type"], "short_side", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}, 6)


@query("a16_high_image_products", "WITH p AS (SELECT product_id, visual_type, count(*) AS n FROM fx_images GROUP BY ALL) SELECT visual_type, count(*) AS products, CAST(sum(n - 30) AS BIGINT) AS excess, max(n) AS most FROM p WHERE n > 30 GROUP BY ROLLUP (visual_type)", "fx_images")
def high_image(images):
    return D.high_image_products(images, 30)


@query("a17_histogram_buckets", "WITH c AS (SELECT p.product_id, count(i.image_id) AS n FROM fx_products p LEFT JOIN (SELECT * FROM fx_images WHERE excluded) i USING (product_id) GROUP BY 1) SELECT CASE WHEN n = 0 THEN '0' WHEN n <= 2 THEN '1-2' WHEN n <= 4 THEN '3-4' ELSE '5+' END AS bucket, count(*) AS products FROM c GROUP BY 1", "fx_products", "fx_images")
def histogram(products, images):
    return D.count_buckets(products, images.where("excluded"), "product_id", [2, 4]).withColumnRenamed("keys", "products")


@query("a18_flip_matrix", "SELECT stage_0_result AS old_class, CASE WHEN short_side > 600 THEN 'product' ELSE 'scene' END AS new_class, count(*) AS n FROM fx_images GROUP BY ALL", "fx_images")
def flips(images):
    return D.flip_matrix(images, F.when(F.col("short_side") > 600, "product").otherwise("scene"))


# ---- predicates and joins --------------------------------------------------------------------


@query("p1_eligible_images", "SELECT image_id FROM fx_images WHERE stage_0_result = 'product' AND NOT excluded AND brand NOT IN ('Brand#11')", "fx_images")
def eligible(images):
    return images.where((T.effective_class(F.col("stage_0_result")) == "product") & ~F.col("excluded") & ~F.col("brand").isin("Brand#11")).select("image_id")


@query("p2_search_scope", "SELECT i.image_id FROM fx_images i JOIN {embeddings} e USING (vec_id) WHERE stage_0_result = 'product' AND NOT excluded AND visual_type IN ('stool', 'bench')", "fx_images", "embeddings")
def scope(images, emb):
    return images.where("stage_0_result = 'product' AND NOT excluded AND visual_type IN ('stool', 'bench')").join(emb.where("embedding IS NOT NULL").select("vec_id"), "vec_id", "left_semi").select("image_id")


@query("p3_category_filter", "SELECT DISTINCT product_id FROM fx_images WHERE visual_type IN ('stool', 'bench') AND stage_0_result = 'product' AND NOT excluded", "fx_products", "fx_images")
def category_filter(products, images):
    good = images.where("visual_type IN ('stool', 'bench') AND stage_0_result = 'product' AND NOT excluded")
    return products.select("product_id").join(good.select("product_id"), "product_id", "left_semi")


@query("p4_level_filter", "SELECT product_id FROM fx_products WHERE lower(a_level) IN ('small', 'nut') OR lower(b_level) IN ('small', 'nut') OR lower(c_level) IN ('small', 'nut')", "fx_products")
def level_filter(products):
    terms = F.transform(F.array("a_level", "b_level", "c_level"), F.lower)
    return products.where(F.arrays_overlap(terms, F.array(F.lit("small"), F.lit("nut")))).select("product_id")


@query("p5_refresh_age_filter", "SELECT event_id FROM fx_refreshes WHERE refreshed_at IS NOT NULL AND refreshed_at <= TIMESTAMP '2024-06-01 00:00:00' - INTERVAL 90 DAY", "fx_refreshes")
def age_filter(refreshes):
    return refreshes.where("refreshed_at IS NOT NULL AND refreshed_at <= TIMESTAMP '2024-06-01 00:00:00' - INTERVAL 90 DAY").select("event_id")


@query("p6_trait_filter", "SELECT DISTINCT product_id FROM fx_traits GROUP BY product_id, image_id HAVING max((field = 'base_type' AND value = 'value 1')::INT) = 1 AND max((field = 'arm_option' AND value = 'value 2')::INT) = 1", "fx_products", "fx_traits")
def trait_filter(products, traits):
    ok = lambda f, v: F.max(F.when((F.col("field") == f) & (F.col("value") == v), 1).otherwise(0)) == 1
    good = traits.groupBy("product_id", "image_id").agg((ok("base_type", "value 1") & ok("arm_option", "value 2")).alias("ok")).where("ok")
    return products.select("product_id").join(good.select("product_id"), "product_id", "left_semi")


@query("p8_unmapped_filter", "SELECT i.image_id, p.visual_type = '' AS skipped FROM fx_images i JOIN fx_products p USING (product_id)", "fx_products", "fx_images")
def unmapped_filter(products, images):
    return images.select("product_id", "image_id").join(products.select("product_id", (F.col("visual_type") == "").alias("skipped")), "product_id").select("image_id", "skipped")


@query("p9_mapping_rows_filter", """
WITH g AS (SELECT product_id, max(visual_type) AS t, count(*) FILTER (WHERE excluded) AS ex, count(*) AS n, max(ai_refreshed_at) AS last FROM fx_images GROUP BY 1)
SELECT product_id, CASE WHEN t = '' THEN 'needs_mapping' WHEN ex * 4 > n THEN 'excluded' WHEN n < 10 THEN 'missing_extraction' WHEN last < (SELECT max(ai_refreshed_at) FROM fx_images) - INTERVAL 60 DAY THEN 'stale' ELSE 'healthy' END AS action FROM g""", "fx_images")
def mapping_rows(images):
    g = images.groupBy("product_id").agg(F.max("visual_type").alias("t"), F.count_if("excluded").alias("ex"), F.count("*").alias("n"), F.max("ai_refreshed_at").alias("last"))
    newest = F.broadcast(images.agg(F.max("ai_refreshed_at").alias("newest")))
    action = F.when(F.col("t") == "", "needs_mapping").when(F.col("ex") * 4 > F.col("n"), "excluded").when(F.col("n") < 10, "missing_extraction").when(F.col("last") < F.col("newest") - F.expr("INTERVAL 60 DAY"), "stale").otherwise("healthy")
    return g.crossJoin(newest).select("product_id", action.alias("action"))


@query("j2_product_best_image", "SELECT p.product_id, b.image_id FROM fx_products p LEFT JOIN LATERAL (SELECT image_id FROM fx_images i WHERE i.product_id = p.product_id AND confidence_tier = 'high' ORDER BY ai_refreshed_at DESC NULLS LAST, image_id LIMIT 1) b ON true", "fx_products", "fx_images")
def best_image(products, images):
    w = W.partitionBy("product_id").orderBy(F.desc_nulls_last("ai_refreshed_at"), "image_id")
    best = images.where("confidence_tier = 'high'").withColumn("k", F.row_number().over(w)).where("k = 1").select("product_id", "image_id")
    return products.select("product_id").join(best, "product_id", "left")


@query("j12_ordered_pairs", "SELECT a.query_id, a.product_id AS higher, b.product_id AS lower FROM fx_rankings a JOIN fx_rankings b ON a.query_id = b.query_id AND a.model_rank < b.model_rank", "fx_rankings")
def ordered_pairs(rankings):
    a = rankings.select("query_id", F.col("product_id").alias("higher"), F.col("model_rank").alias("ra"))
    b = rankings.select("query_id", F.col("product_id").alias("lower"), F.col("model_rank").alias("rb"))
    return a.join(b, "query_id").where("ra < rb").select("query_id", "higher", "lower")


# ---- windows and evaluation ------------------------------------------------------------------


@query("w5_score_gaps", "SELECT o_orderkey, round(o_totalprice - lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), 4) AS gap FROM {orders}", "orders")
def gaps(orders):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return orders.select("o_orderkey", F.round(F.col("o_totalprice") - F.lead("o_totalprice").over(w), 4).alias("gap"))


@query("w6_rank_delta", "SELECT query_id, product_id, model_rank, human_rank, model_rank - human_rank AS delta, CASE WHEN model_rank > human_rank THEN 'up' WHEN model_rank < human_rank THEN 'down' ELSE 'same' END AS move FROM fx_rankings", "fx_rankings")
def rank_delta(rankings):
    return V.rank_delta(rankings)


@query("w7_recovery_class", """
WITH s AS (SELECT user_id AS record_id, event_id AS step, event_type <> 'error' AND value > 20 AS stable FROM {events})
SELECT record_id, step, CASE WHEN stable THEN 'stable' WHEN coalesce(lead(stable, 1) OVER w, false) OR coalesce(lead(stable, 2) OVER w, false) THEN 'transient' ELSE 'persistent' END AS state FROM s WINDOW w AS (PARTITION BY record_id ORDER BY step)""", "events")
def recovery(events):
    return V.recovery_class(events.select(F.col("user_id").alias("record_id"), F.col("event_id").alias("step"), ((F.col("event_type") != "error") & (F.col("value") > 20)).alias("stable")))


@query("w8_stratified_sample", "SELECT product_id, visual_type, row_number() OVER (PARTITION BY visual_type ORDER BY product_name, product_id) AS place FROM fx_products QUALIFY place <= 7", "fx_products")
def stratified(products):
    return V.stratified_sample(products, "visual_type", 7, "product_name", "product_id").select("product_id", "visual_type", "place")


@query("w9_quota_sample", """
WITH s AS (SELECT product_id, CASE WHEN b_level = 'nut' THEN 'a' WHEN c_level = 'brass' THEN 'b' ELSE 'rest' END AS stratum FROM fx_products),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY product_id) AS k FROM s), q AS (SELECT *, k <= CASE stratum WHEN 'a' THEN 5 WHEN 'b' THEN 3 ELSE 0 END AS by_quota FROM r)
SELECT product_id, stratum, by_quota FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN by_quota THEN 0 ELSE 1 END, product_id) AS n FROM q) WHERE n <= 20""", "fx_products")
def quota(products):
    stratum = F.when(F.col("b_level") == "nut", "a").when(F.col("c_level") == "brass", "b").otherwise("rest")
    return D.quota_sample(products, stratum, {"a": 5, "b": 3}, 20, "product_id").select("product_id", "stratum", "by_quota")


@query("e2_order_checks", """
WITH r AS (SELECT query_id AS case_id, product_id, min(model_rank) AS rank FROM fx_rankings GROUP BY ALL),
x AS (SELECT query_id AS case_id, max(product_id) FILTER (WHERE human_rank = 1) AS higher, max(product_id) FILTER (WHERE human_rank = 2) AS lower FROM fx_rankings GROUP BY 1 HAVING count(*) >= 2)
SELECT x.case_id, count(*) AS checks, count(*) FILTER (WHERE a.rank < b.rank) AS passed FROM x LEFT JOIN r a ON a.case_id = x.case_id AND a.product_id = x.higher LEFT JOIN r b ON b.case_id = x.case_id AND b.product_id = x.lower GROUP BY 1""", "fx_rankings")
def order_checks(rankings):
    ranks = rankings.groupBy(F.col("query_id").alias("case_id"), "product_id").agg(F.min("model_rank").alias("rank"))
    at = lambda k: F.max(F.when(F.col("human_rank") == k, F.col("product_id")))
    expected = rankings.groupBy(F.col("query_id").alias("case_id")).agg(at(1).alias("higher"), at(2).alias("lower"), F.count("*").alias("n")).where("n >= 2").drop("n")
    return V.order_checks(ranks, expected)


_INV = """
t AS (SELECT * FROM fx_rankings WHERE model_rank <= 10 AND NOT removed),
pairs AS (SELECT DISTINCT a.query_id, a.product_id AS preferred, b.product_id AS demoted FROM t a JOIN t b ON a.query_id = b.query_id AND a.human_rank < b.human_rank AND a.model_rank > b.model_rank AND a.product_id <> b.product_id)"""


@query("e4_preference_pairs", f"WITH {_INV} SELECT * FROM pairs", "fx_rankings")
def pairs(rankings):
    return V.inversions(rankings)


@query("e5_preference_summary", f"""WITH {_INV}, tags AS (SELECT product_id, [a_level, b_level, c_level] AS tags FROM fx_products),
r AS (SELECT p.tags AS pt, d.tags AS dt FROM pairs JOIN tags p ON p.product_id = preferred JOIN tags d ON d.product_id = demoted),
x AS (SELECT unnest(list_filter(list_distinct(pt), lambda v: NOT list_contains(dt, v))) AS tag, 1 AS side FROM r UNION ALL SELECT unnest(list_filter(list_distinct(dt), lambda v: NOT list_contains(pt, v))), -1 FROM r)
SELECT tag, count(*) FILTER (WHERE side = 1) AS preferred, count(*) FILTER (WHERE side = -1) AS demoted, CAST(sum(side) AS BIGINT) AS net FROM x GROUP BY 1""", "fx_rankings", "fx_products")
def summary(rankings, products):
    return V.preference_summary(V.inversions(rankings), products.select("product_id", F.array("a_level", "b_level", "c_level").alias("tags")))


@query("e6_judgment_upsert", "SELECT user_id AS product_id, arg_max(event_id, (ts, event_id)) AS judgment_id FROM {events} WHERE event_type <> 'view' GROUP BY 1", "events")
def judgments(events):
    j = events.select(F.col("user_id").alias("product_id"), F.col("event_id").alias("judgment_id"), F.col("ts").alias("judged_at"), (F.col("event_type") != "view").alias("has_signal"))
    return V.judgment_upsert(j).select("product_id", "judgment_id")


@query("e7_eval_progress", "SELECT count(DISTINCT query_id) AS reviewed, count(DISTINCT query_id) FILTER (WHERE model_rank <> human_rank) AS corrected, (SELECT count(*) FROM {orders}) AS total FROM fx_rankings", "fx_rankings", "orders")
def progress(rankings, orders):
    return rankings.agg(F.countDistinct("query_id").alias("reviewed"), F.countDistinct(F.when(F.col("model_rank") != F.col("human_rank"), F.col("query_id"))).alias("corrected")).crossJoin(orders.agg(F.count("*").alias("total")))


_TOK = "list_filter(string_split(trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 1)"


@query("e8_run_stability", f"""
WITH c AS (SELECT conv_id, max(text) FILTER (WHERE turn = 0) AS a, max(text) FILTER (WHERE turn = 1) AS b FROM {{conversations}} GROUP BY 1),
t AS (SELECT conv_id AS record_id, list_distinct({_TOK.format(x='a')}) AS a, list_distinct({_TOK.format(x='b')}) AS b FROM c),
j AS (SELECT record_id, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS jaccard FROM t)
SELECT record_id, jaccard::DOUBLE AS jaccard, CASE WHEN jaccard >= 0.8 THEN 'stable' WHEN jaccard >= 0.5 THEN 'minor' ELSE 'divergent' END AS rating FROM j""", "conversations")
def stability(conv):
    at = lambda k: T.tokenize(F.max(F.when(F.col("turn") == k, F.col("text"))))
    return V.run_stability(conv.groupBy(F.col("conv_id").alias("record_id")).agg(at(0).alias("a"), at(1).alias("b")))


@query("e9_agreement_rate", "SELECT a.image_id, round(avg((a.value = b.value)::INT), 6) AS agreement FROM fx_runs a JOIN fx_runs b ON a.image_id = b.image_id AND a.field = b.field AND a.run_id < b.run_id GROUP BY 1", "fx_runs")
def agreement(runs):
    return V.agreement_rate(runs)


@query("e10_old_new_compare", "SELECT a.field, count(*) AS n, round(avg((a.value = b.value)::INT), 6) AS same FROM fx_runs a JOIN fx_runs b ON a.image_id = b.image_id AND a.field = b.field AND a.run_id = 1 AND b.run_id = 2 GROUP BY 1", "fx_runs")
def old_new(runs):
    a, b = runs.where("run_id = 1").select("image_id", "field", F.col("value").alias("old")), runs.where("run_id = 2").select("image_id", "field", F.col("value").alias("new"))
    return a.join(b, ["image_id", "field"]).groupBy("field").agg(F.count("*").alias("n"), F.round(F.avg((F.col("old") == F.col("new")).cast("int")), 6).alias("same"))


@query("e11_threshold_search", """
WITH s AS (SELECT o_totalprice AS score, CASE WHEN o_totalprice + o_custkey % 100 * 1000 > 200000 THEN 1 ELSE 0 END AS label FROM {orders}),
g AS (SELECT score, count(*) AS n, sum(label) AS ones FROM s GROUP BY score),
r AS (SELECT score, lead(score) OVER w AS next, sum(n) OVER w AS below, sum(ones) OVER w AS ones_below FROM g WINDOW w AS (ORDER BY score)),
t AS (SELECT sum(n) AS all_n, sum(ones) AS all_ones FROM g)
SELECT (score + next) / 2 AS threshold, round(((below - ones_below) + (all_ones - ones_below))::DOUBLE / all_n, 6) AS accuracy
FROM r, t WHERE next IS NOT NULL ORDER BY accuracy DESC, threshold LIMIT 1""", "orders")
def threshold(orders):
    label = F.when(F.col("o_totalprice") + F.col("o_custkey") % 100 * 1000 > 200000, 1).otherwise(0)
    return V.threshold_search(orders.select(F.col("o_totalprice").alias("score"), label.alias("label")))


@query("e13_correction_log", "SELECT status AS field, count(*) AS corrections, count(DISTINCT product_id) AS products FROM fx_refreshes GROUP BY 1", "fx_refreshes")
def corrections(refreshes):
    return refreshes.groupBy(F.col("status").alias("field")).agg(F.count("*").alias("corrections"), F.countDistinct("product_id").alias("products"))


# ---- ingest ----------------------------------------------------------------------------------


@query("s3_import_gate", """
SELECT product_id, CASE WHEN lower(trim(brand)) IN ('brand#11') THEN 'placeholder_brand' WHEN lower(trim(product_name)) IN ('brass nut') THEN 'placeholder_name' WHEN product_id % 9 = 0 THEN 'no_image' WHEN product_id % 4 = 0 THEN 'already_indexed' END AS reject_reason FROM fx_products""", "fx_products")
def gate(products):
    r = products.select("product_id", "brand", "product_name", F.when(F.col("product_id") % 9 == 0, 0).otherwise(3).alias("n_images"))
    return S.import_gate(r, products.where("product_id % 4 = 0"), ["brand#11"], ["brass nut"]).select("product_id", "reject_reason")


@query("s5_extract_page_payload", r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(trim(url), '[#?].*$', ''), '/$', '') AS url, html, nullif(trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1, 'is')), '') AS t, nullif(trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1, 'is')), '') AS h FROM {pages})
SELECT page_id, url, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS title,
  replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS heading,
  len(regexp_extract_all(html, '(?i)<a\s')) AS n_links, CASE WHEN html IS NULL OR html = '' THEN 'empty_page' WHEN t IS NULL THEN 'no_title' END AS flag_reason FROM p""", "pages")
def payload(pages):
    return S.extract_page_payload(pages)


@query("s7_explode_images", "SELECT product_id, u.pos AS position, concat(product_id, '_img_', lpad(CAST(u.pos AS VARCHAR), 3, '0')) AS image_id, concat(product_name, '/', u.pos) AS image_url FROM (SELECT CAST(product_id AS VARCHAR) AS product_id, product_name FROM fx_products), LATERAL (SELECT unnest(range(1, 4)) AS pos) u", "fx_products")
def exploded(products):
    urls = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.concat("product_name", F.lit("/"), k.cast("string")))
    return S.explode_images(products.select(F.col("product_id").cast("string").alias("product_id"), "product_name", urls.alias("image_urls"))).select("product_id", "position", "image_id", "image_url")


@query("s8_intake_classify", """
WITH b AS (SELECT product_id, max(short_side) AS side FROM fx_images WHERE product_id % 7 <> 0 GROUP BY 1)
SELECT p.product_id, CASE WHEN p.product_id % 5 = 0 THEN 'skipped_existing' WHEN side IS NULL THEN 'flagged_no_page' WHEN side < 1990 THEN 'flagged_small_images' ELSE 'accepted' END AS state FROM fx_products p LEFT JOIN b USING (product_id)""", "fx_products", "fx_images")
def intake(products, images):
    return S.intake_classify(products, products.where("product_id % 5 = 0"), images.where("product_id % 7 <> 0"), 1990)


@query("s10_catalog_summary", "SELECT 'products' AS kind, NULL AS value, count(*) AS n FROM fx_products UNION ALL SELECT 'images', NULL, count(*) FROM fx_images UNION ALL SELECT 'brand', brand, count(*) FROM fx_products GROUP BY brand UNION ALL SELECT 'category', b_level, count(*) FROM fx_products GROUP BY b_level", "fx_products", "fx_images")
def catalog_summary(products, images):
    return S.catalog_summary(products, images)


@query("s14_rebuild_products", """
WITH i AS (SELECT i.product_id, position, CASE WHEN position % 3 = 1 THEN '' ELSE p.product_name END AS product_name, p.brand, concat('u/', position % 4) AS image_url FROM fx_images i JOIN fx_products p USING (product_id)),
u AS (SELECT product_id, image_url, min(position) AS at FROM i GROUP BY ALL)
SELECT product_id, arg_min(product_name, position) FILTER (WHERE product_name <> '') AS product_name, arg_min(brand, position) AS brand, (SELECT string_agg(image_url, ',' ORDER BY u.at) FROM u WHERE u.product_id = i.product_id) AS urls FROM i GROUP BY product_id""".replace(" AS at ", " AS first_at ").replace("u.at", "u.first_at"), "fx_products", "fx_images")
def rebuild(products, images):
    i = images.select("product_id", "position").join(products.select("product_id", "product_name", "brand"), "product_id")
    i = i.withColumns({"product_name": F.when(F.col("position") % 3 == 1, "").otherwise(F.col("product_name")), "image_url": F.concat(F.lit("u/"), F.col("position") % 4)})
    return S.rebuild_products(i).select("product_id", "product_name", "brand", F.array_join("image_urls", ",").alias("urls"))


@query("s17_catalog_row_filter", "SELECT product_id FROM fx_products WHERE (contains(lower(concat_ws(' ', a_level, b_level, c_level)), 'nut') OR contains(lower(concat_ws(' ', a_level, b_level, c_level)), 'large')) AND contains(lower(brand), 'brand#1') ORDER BY product_id LIMIT 50 OFFSET 10", "fx_products")
def row_filter(products):
    return S.catalog_row_filter(products, ["nut", "large"], "brand#1", offset=10, limit=50).select("product_id")


@query("s18_append_new_only", "WITH n AS (SELECT image_id, concat('u/', image_id, '?x') AS u FROM fx_images WHERE image_id % 2 = 0) SELECT image_id FROM n WHERE image_id % 3 <> 0 AND image_id % 5 <> 0", "fx_images")
def append_new(images):
    url = lambda q: F.concat(F.lit("u/"), F.col("image_id"), F.lit(q)).alias("image_url")
    old = images.where("image_id % 3 = 0").select("image_id", url("#a")).unionByName(images.where("image_id % 5 = 0").select((-F.col("image_id")).alias("image_id"), url("/")))
    return S.append_new_only(images.where("image_id % 2 = 0").select("image_id", url("?x")), old).select("image_id")


# ---- scalar functions ------------------------------------------------------------------------


@query("f_text_functions", r"""
SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS f1, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS f2,
  substring(regexp_replace(regexp_replace(replace(lower(text), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS f3,
  concat('product_', substring(sha1(concat_ws('::', nullif(source, ''), nullif(lang, ''))), 1, 12)) AS f4, substring(sha1(concat(source, '::', lang)), 1, 16) AS f6,
  length(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 1)) AS f15,
  CASE WHEN length(text) > 50 THEN concat(substring(text, 1, 49), '...') ELSE text END AS f46, regexp_matches(lower(text), '\b(none|no|not visible|concealed|unknown|without|absent|hidden)\b') AS f35,
  CASE WHEN contains(lower(text), 'with the') THEN 'x' WHEN contains(lower(text), 'der') THEN 'y' ELSE '' END AS f24 FROM {documents}""", "documents")
def text_functions(docs):
    t = F.col("text")
    return docs.select(
        "doc_id", F.md5(T.norm_ws(t)).alias("f1"), F.md5(T.norm_alnum(t)).alias("f2"), T.slugify(t).alias("f3"), T.create_id("product", F.col("source"), F.col("lang")).alias("f4"), T.hash_key(F.col("source"), F.col("lang")).alias("f6"),
        F.size(T.tokenize(t)).cast("long").alias("f15"), T.truncate_text(t, 50).alias("f46"), T.is_absence(t).alias("f35"), T.first_rule(t, [("with the", "x"), ("der", "y")]).alias("f24"),
    )


@query("f_id_url_functions", r"""
SELECT source_product_id, regexp_extract(source_product_id, '(\d+)$', 1) AS f7, CASE WHEN regexp_matches(source_product_id, '^product_dp_\d+$') THEN 'dp' WHEN regexp_matches(source_product_id, '^product_[0-9a-f]{12}') THEN 'hashed' ELSE 'other' END AS f8,
  coalesce(nullif(regexp_extract(source_product_id, '^product_dp_(\d+)$', 1), ''), '') AS f9 FROM (SELECT source_product_id FROM fx_catalog_side UNION ALL SELECT source_product_id FROM fx_index_side)""", "fx_catalog_side", "fx_index_side")
def id_functions(catalog, index):
    c = F.col("source_product_id")
    return catalog.select(c).union(index.select(c)).select(c, T.tail_id(c).alias("f7"), T.id_kind(c).alias("f8"), T.source_product_id(F.lit(None).cast("string"), F.lit(None).cast("string"), c).alias("f9"))


@query("f_url_functions", r"SELECT page_id, regexp_replace(regexp_replace(trim(url), '[#?].*$', ''), '/$', '') AS f10, regexp_replace(url, '[#?].*$', '') AS f11, regexp_matches(lower(regexp_replace(url, '[#?].*$', '')), '\.(jpg|jpeg|png|webp|gif)$') AS f12 FROM {pages}", "pages")
def url_functions(pages):
    u = F.col("url")
    return pages.select("page_id", T.canonical_url(u).alias("f10"), T.sql_canonical_url(u).alias("f11"), T.is_image_url(u).alias("f12"))


@query("f_category_functions", "SELECT product_id, array_to_string(list_sort(list_distinct([a_level, b_level, c_level])), ' | ') AS f18, c_level AS f17, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS f25 FROM (SELECT *, CASE product_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE '' END AS confidence FROM fx_products)", "fx_products")
def category_functions(products):
    conf = F.when(F.col("product_id") % 4 == 0, "high").when(F.col("product_id") % 4 == 1, "medium").when(F.col("product_id") % 4 == 2, "low").otherwise("")
    return products.select("product_id", T.grouping_key(F.array("a_level", "b_level", "c_level")).alias("f18"), T.leaf_categories(F.array("b_level"), F.array("c_level"))[0].alias("f17"), T.confidence_rank(conf).alias("f25"))

"""Queries on vectors, scores, cutoffs, phrases, bullets and facets."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from fernhill.functions import text as T, vectors as V
from fernhill.operators import dictionary as Dc, retrieval as R, vector_search as N
from fernhill.plans._book import query, rows

_TOPK = """
near AS (
  SELECT q.vec_id AS query_id, i.vec_id AS image_id, i.label AS product_id,
         round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) + 0.0 AS similarity
  FROM {embeddings} q JOIN {embeddings} i ON q.vec_id % 20 = 0),
topk AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, product_id, image_id) AS rank FROM near
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, product_id, image_id) <= 50)"""


def _topk(emb, k=50):
    images = emb.select(F.col("vec_id").alias("image_id"), F.col("label").alias("product_id"), "embedding")
    queries = emb.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return N.vector_topk(images, queries, k, ties=["product_id"]).join(images.drop("embedding"), "image_id")


def _scored(emb):
    top = _topk(emb).withColumn("confidence", F.lit(0))
    return R.image_score(top, F.col("similarity"), F.lit(0.0), F.col("product_id") == F.col("query_id") % 10, F.col("image_id") == F.col("query_id"), F.col("image_id") % 7 == 0)


_SCORED = _TOPK + """,
scored AS (
  SELECT *, round(similarity + CASE WHEN product_id = query_id % 10 THEN 0.03 ELSE 0.0 END + CASE WHEN image_id = query_id THEN 2.0 ELSE 0.0 END
                  - CASE WHEN image_id % 7 = 0 THEN 0.2 ELSE 0.0 END, 6) AS score FROM topk)"""
_PRODUCTS = _SCORED + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, product_id ORDER BY score DESC, image_id) AS pos FROM scored),
products AS (
  SELECT query_id, product_id, max(image_id) FILTER (WHERE pos = 1) AS hero_image_id, max(score) AS score, count(*) AS match_count,
         string_agg(CAST(image_id AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE pos <= 3) AS top_images
  FROM placed GROUP BY ALL)"""


@query("r1_vector_topk", f"WITH {_TOPK} SELECT query_id, image_id, similarity, rank FROM topk", "embeddings")
def vector_topk(emb):
    return _topk(emb).select("query_id", "image_id", "similarity", "rank")


@query("r2_ann_topk", None, "embeddings")
def ann_topk(emb):
    images = emb.select(F.col("vec_id").alias("image_id"), "embedding")
    return N.ann_topk(images, emb.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)


@query("r3_image_score", f"WITH {_SCORED} SELECT query_id, image_id, score FROM scored", "embeddings")
def image_score(emb):
    return _scored(emb).select("query_id", "image_id", "score")


@query("q_search_rollup", f"WITH {_PRODUCTS} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS product_rank FROM products", "embeddings")
def search_rollup(emb):
    return R.rollup_to_product(_scored(emb)).drop("confidence")


_BULLETS = [
    (0, 1, "high", "Base type: value 1", "base_type", "value 1"), (0, 2, "normal", "Base finish: value 2", "base_finish", "value 2"), (0, 3, "low", "Arm option: value 3", "arm_option", "value 3"),
    (0, 4, "normal", "Arm option: value 4", "arm_option", "value 4"), (0, 5, "high", "Back height: none", "back_height", "none"), (0, 6, "low", "base type - Value 1", "base_type", "value 1"),
    (0, 7, "high", "some free words", None, None), (0, 8, "normal", "Seat: unknown", "seat", "unknown"),
    (1, 1, "high", "Back height, lumbar: value 5", "back_height", "value 5"), (1, 2, "low", "Base type: value 4", "base_type", "value 4"), (1, 3, "high", "Wheel size: value 1", "wheel_size", "value 1"),
]
_GROUPS = [("base_type", "value 1", "a"), ("base_type", "value 2", "a"), ("base_finish", "value 2", "b"), ("base_finish", "value 3", "b"), ("back_height", "value 5", "c"), ("back_height", "value 6", "c")]
_SQL_BULLETS = "bullets(query_id, ord, priority, text, field, value) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in _BULLETS) + ")"
_SQL_GROUPS = "groups(field, value, grp) AS (VALUES " + ", ".join(map(str, _GROUPS)) + ")"


@query("r4_trait_boost", f"""
WITH {_SQL_BULLETS}, {_SQL_GROUPS},
lv AS (SELECT *, CASE priority WHEN 'high' THEN 0 WHEN 'normal' THEN 1 ELSE 2 END AS level, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM bullets),
once AS (SELECT * FROM lv QUALIFY row_number() OVER (PARTITION BY query_id, norm ORDER BY level, ord) = 1),
asked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, field ORDER BY level DESC, ord DESC) = 1 AS counts, list_contains(['none', 'no', 'without', 'absent', 'hidden', 'concealed', 'unknown'], split_part(norm, ' ', -1)) AS absent
  FROM once WHERE field IS NOT NULL AND value <> 'unknown'),
pairs AS (SELECT image_id, q.query_id, image_id % 97 = q.query_id AS exact FROM fx_images, (VALUES (0), (1)) AS q(query_id)),
stored AS (SELECT image_id, field, value AS held FROM fx_traits WHERE value <> 'unknown'),
parts AS (
  SELECT p.query_id, p.image_id, p.exact, a.*, CASE s.held WHEN 'off-list' THEN 'off list' ELSE s.held END AS held,
         EXISTS (SELECT 1 FROM groups x JOIN groups y ON x.field = y.field AND x.grp = y.grp WHERE x.field = a.field AND x.value = s.held AND y.value = a.value AND s.held <> a.value) AS near
  FROM pairs p JOIN asked a ON a.query_id = p.query_id LEFT JOIN stored s ON s.image_id = p.image_id AND s.field = a.field)
SELECT query_id, image_id,
  round(coalesce(sum(CASE WHEN held = value THEN [0.35, 0.10, 0.05][level + 1] WHEN exact THEN 0.0
    ELSE -(CASE level WHEN 0 THEN CASE WHEN norm LIKE '%lumbar%' OR norm LIKE '%wheel%' THEN 0.55 ELSE 0.2 END WHEN 1 THEN 0.06 ELSE 0.0 END) * CASE WHEN near THEN 0.5 ELSE 1.0 END END) FILTER (WHERE counts), 0)::DOUBLE, 6) AS boost,
  coalesce(string_agg(text, '|' ORDER BY level, ord) FILTER (WHERE held = value AND NOT absent), '') AS matched
FROM parts GROUP BY query_id, image_id""", "fx_images", "fx_traits")
def trait_boost(images, traits):
    bullets = rows(traits, _BULLETS, "query_id int, ord int, priority string, text string, field string, value string")
    pairs = images.select("image_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("query_id")).withColumn("exact", F.col("image_id") % 97 == F.col("query_id"))
    found = R.trait_boost(pairs, traits, bullets, rows(traits, _GROUPS, "field string, value string, grp string"))
    return found.select("query_id", "image_id", "boost", F.array_join("matched", "|").alias("matched"))


_FAMILIES = (("stool", "bench"), ("guest_chair", "lounge_chair"), ("task_collab_chair",))
_TYPES = [t for kinds in _FAMILIES for t in kinds]


@query("r7_search", f"""
WITH {_SQL_BULLETS.replace("bullets(query_id", "told(kind")}, {_SQL_GROUPS},
q AS (
  SELECT vec_id AS query_id, {_TYPES}[(vec_id / 20)::INT % 5 + 1] AS visual_type, ['gear', 'bolt', 'ring'][vec_id::INT % 3 + 1] AS wanted, vec_id * 61 + 488 AS source_image,
         CASE WHEN vec_id % 40 = 0 THEN TIMESTAMP '1998-05-24 00:00:00' END AS since, CAST(vec_id % 40 = 0 AS INTEGER) AS kind, embedding FROM {{embeddings}} WHERE vec_id % 20 = 0),
f(visual_type, family) AS (VALUES {", ".join(str((t, k)) for k, kinds in enumerate(_FAMILIES) for t in kinds)}),
open_images AS (
  SELECT i.*, f.family, e.embedding, p.b_level AS category, i.image_id % 11 = 0 AS room, CASE confidence_tier WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS confidence
  FROM fx_images i JOIN f USING (visual_type) JOIN {{embeddings}} e USING (vec_id) JOIN fx_products p USING (product_id) WHERE stage_0_result = 'product' AND NOT excluded),
near AS (
  SELECT q.query_id, q.kind, q.wanted, q.source_image, q.since, i.image_id, i.product_id, i.category, i.room, i.confidence, i.ai_refreshed_at,
         round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS similarity
  FROM q JOIN f USING (visual_type) JOIN open_images i ON i.family = f.family
  QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) DESC, i.product_id, i.image_id) <= 1000),
lv AS (SELECT *, CASE priority WHEN 'high' THEN 0 WHEN 'normal' THEN 1 ELSE 2 END AS level, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM told),
once AS (SELECT * FROM lv QUALIFY row_number() OVER (PARTITION BY kind, norm ORDER BY level, ord) = 1),
asked AS (SELECT * FROM once WHERE field IS NOT NULL AND value <> 'unknown' QUALIFY row_number() OVER (PARTITION BY kind, field ORDER BY level DESC, ord DESC) = 1),
boosts AS (
  SELECT n.query_id, n.image_id, sum(CASE WHEN s.value = a.value THEN [0.35, 0.10, 0.05][level + 1] WHEN n.image_id = n.source_image THEN 0.0
    ELSE -(CASE level WHEN 0 THEN CASE WHEN norm LIKE '%lumbar%' OR norm LIKE '%wheel%' THEN 0.55 ELSE 0.2 END WHEN 1 THEN 0.06 ELSE 0.0 END)
         * CASE WHEN EXISTS (SELECT 1 FROM groups x JOIN groups y ON x.field = y.field AND x.grp = y.grp WHERE x.field = a.field AND x.value = s.value AND y.value = a.value AND s.value <> a.value) THEN 0.5 ELSE 1.0 END END)::DOUBLE AS boost
  FROM near n JOIN asked a USING (kind) LEFT JOIN fx_traits s ON s.image_id = n.image_id AND s.field = a.field AND s.value <> 'unknown' GROUP BY ALL),
scored AS (
  SELECT n.*, n.image_id = n.source_image AS exact, round(similarity + round(boost, 6) + CASE WHEN category = wanted THEN 0.03::DOUBLE ELSE 0 END + CASE WHEN n.image_id = n.source_image THEN 2 ELSE 0 END - CASE WHEN room THEN 0.2::DOUBLE ELSE 0 END, 6) AS score
  FROM near n JOIN boosts b USING (query_id, image_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, product_id ORDER BY score DESC, confidence DESC, image_id) AS pos FROM scored),
products AS (
  SELECT query_id, product_id, max(image_id) FILTER (WHERE pos = 1) AS hero_image_id, max(score) AS score, count(*) AS match_count, string_agg(concat('u/', image_id), ',' ORDER BY pos) AS image_urls,
         max(ai_refreshed_at) AS refreshed, bool_or(room) AS is_room_scene, bool_or(exact) AS is_exact_source, max(confidence) FILTER (WHERE pos = 1) AS confidence, any_value(since) AS since
  FROM placed GROUP BY ALL)
SELECT query_id, product_id, hero_image_id, score, match_count, image_urls, is_room_scene, is_exact_source, row_number() OVER (PARTITION BY query_id ORDER BY is_exact_source DESC, score DESC, confidence DESC, product_id) AS place
FROM products WHERE since IS NULL OR refreshed >= since
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY is_exact_source DESC, score DESC, confidence DESC, product_id) <= 10""", "fx_images", "fx_products", "fx_traits", "embeddings")
def whole_search(images, products, traits, emb):
    told = rows(traits, _BULLETS, "kind int, ord int, priority string, text string, field string, value string")
    queries = emb.where("vec_id % 20 = 0").select(
        F.col("vec_id").alias("query_id"), F.element_at(F.array(*map(F.lit, _TYPES)), (F.floor(F.col("vec_id") / 20) % 5).cast("int") + 1).alias("visual_type"),
        F.element_at(F.array(F.lit("gear"), F.lit("bolt"), F.lit("ring")), (F.col("vec_id") % 3).cast("int") + 1).alias("category"), (F.col("vec_id") * 61 + 488).alias("source_image"),
        F.when(F.col("vec_id") % 40 == 0, F.lit("1998-05-24 00:00:00").cast("timestamp_ntz")).alias("refreshed_since"), (F.col("vec_id") % 40 == 0).cast("int").alias("kind"), "embedding",
    )
    pictures = images.join(products.select("product_id", F.col("b_level").alias("category")), "product_id")
    pictures = pictures.withColumns({"room": F.col("image_id") % 11 == 0, "confidence": T.confidence_rank(F.col("confidence_tier")), "image_url": F.concat(F.lit("u/"), "image_id")})
    bullets = queries.select("query_id", "kind").join(told, "kind").drop("kind")
    found = R.search(pictures, queries, traits, bullets, rows(traits, _GROUPS, "field string, value string, grp string"), _FAMILIES, vectors=emb.select("vec_id", "embedding"))
    return found.select("query_id", "product_id", "hero_image_id", "score", "match_count", "image_urls", "is_room_scene", "is_exact_source", "place")


@query("r8_refine_more_less", """
SELECT a.vec_id, round(list_inner_product(m.more, a.embedding::DOUBLE[]) / sqrt(list_inner_product(m.more, m.more)), 6) AS more_dot,
       round(list_inner_product(m.less, a.embedding::DOUBLE[]) / sqrt(list_inner_product(m.less, m.less)), 6) AS less_dot
FROM (SELECT a.vec_id, list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: (z[1] + z[2]) / 2) AS more,
             list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: z[1] - z[2]) AS less
      FROM {embeddings} a JOIN {embeddings} b ON b.vec_id = a.vec_id + 1) m JOIN {embeddings} a ON a.vec_id = m.vec_id""", "embeddings")
def refine(emb):
    v = F.col("embedding").cast("array<double>")
    pairs = emb.select("vec_id", v.alias("q")).join(emb.select((F.col("vec_id") - 1).alias("vec_id"), v.alias("t")), "vec_id")
    return pairs.select("vec_id", F.round(V.dot(V.refine(F.col("q"), F.col("t")), F.col("q")), 6).alias("more_dot"), F.round(V.dot(V.refine(F.col("q"), F.col("t"), False), F.col("q")), 6).alias("less_dot"))


@query("r9_similar_to_product", """
WITH best AS (
  SELECT product_id, vec_id FROM fx_images WHERE product_id % 20 = 0
  QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY CASE confidence_tier WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, ai_refreshed_at DESC NULLS LAST, image_id) = 1),
n AS (SELECT b.product_id AS query_id, i.vec_id AS image_id, round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) + 0.0 AS similarity
      FROM best b JOIN {embeddings} q ON q.vec_id = b.vec_id CROSS JOIN {embeddings} i)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, image_id) AS rank FROM n
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, image_id) <= 5""", "fx_images", "embeddings")
def similar_to_product(images, emb):
    target = R.target_vector(images.where("product_id % 20 = 0")).select(F.col("product_id").alias("query_id"), "vec_id")
    return N.vector_topk(emb.select(F.col("vec_id").alias("image_id"), "embedding"), target.join(emb, "vec_id").select("query_id", "embedding"), 5)


@query("r10_score_cutoff", """
WITH s AS (SELECT o_custkey AS query_id, o_orderkey AS item, o_totalprice / 100000.0 AS score FROM {orders}),
r AS (SELECT *, row_number() OVER w AS i, score - lead(score) OVER w AS gap FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, item)),
g AS (SELECT query_id, count(*) AS n, max(score) AS first, min(score) AS last, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS gaps FROM r GROUP BY query_id),
c AS (SELECT r.query_id, arg_min(i, (-gap, i)) AS at FROM r JOIN g USING (query_id)
      WHERE i BETWEEN 3 AND 20 AND gap >= 0.3 AND gap >= gaps[len(gaps) // 2 + 1] * 1.5 GROUP BY r.query_id),
f AS (SELECT r.query_id, min(i) - 1 AS low FROM r JOIN g USING (query_id) WHERE score < first * 0.7 GROUP BY r.query_id)
SELECT g.query_id, g.n,
  CASE WHEN n <= 3 OR last >= first * 0.8 THEN n WHEN c.at IS NOT NULL THEN c.at WHEN f.low IS NOT NULL THEN least(greatest(f.low, 3), 20, n) ELSE n END AS cutoff,
  CASE WHEN n <= 3 THEN 'too_few' WHEN last >= first * 0.8 THEN 'uniform' WHEN c.at IS NOT NULL THEN 'gap' WHEN f.low IS NOT NULL THEN 'relative' ELSE 'none' END AS reason
FROM g LEFT JOIN c USING (query_id) LEFT JOIN f USING (query_id)""", "orders")
def score_cutoff(orders):
    return R.score_cutoff(orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item"), (F.col("o_totalprice") / 100000.0).alias("score")))


_PHRASES = [("the", "article"), ("with the", "pair"), ("of the", "pair"), ("und", "german"), ("que", "romance")]
_NORM = "trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


@query("r12_phrase_category", "WITH phrases(phrase, result) AS (VALUES " + ", ".join(map(str, _PHRASES)) + f"""),
t AS (SELECT conv_id * 1000 + turn AS id, concat(' ', {_NORM.format(x='text')}, ' ') AS padded FROM {{conversations}})
SELECT id, phrase, result FROM t JOIN phrases ON contains(padded, concat(' ', phrase, ' '))
QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(phrase) DESC, instr(padded, concat(' ', phrase, ' ')), phrase) = 1""", "conversations")
def phrase_category(conv):
    texts = conv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return Dc.phrase_match(texts, rows(conv, _PHRASES, "phrase string, result string"), "id")


@query("r11_annotate_queries", """
WITH b AS (SELECT DISTINCT brand FROM fx_products),
t AS (SELECT p.product_id AS id, concat(' ', lower(concat(p.product_name, ' by ', p.brand)), ' ') AS padded FROM fx_products p)
SELECT id, brand, trim(replace(padded, concat(' ', lower(brand), ' '), ' ')) AS residual FROM t JOIN b ON contains(padded, concat(' ', lower(brand), ' '))
QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(brand) DESC, brand) = 1""", "fx_products")
def annotate_queries(products):
    texts = products.select(F.col("product_id").alias("id"), F.concat_ws(" by ", "product_name", "brand").alias("text"))
    return Dc.annotate_queries(texts, products.select("brand"))


@query("r15_merge_bullets", """
WITH b AS (SELECT image_id % 97 AS query_id, lower(concat(field, ':', value)) AS key, CASE position % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'normal' ELSE 'low' END AS priority,
                  image_id * 10 + length(field) AS ord, concat(field, ': ', value) AS text FROM fx_traits WHERE value <> 'unknown'),
m AS (SELECT query_id, key, max(CASE priority WHEN 'high' THEN 3 WHEN 'normal' THEN 2 ELSE 1 END) AS r, min(ord) AS ord, arg_min(text, ord) AS text FROM b GROUP BY ALL)
SELECT query_id, key, ord, text, ['low', 'normal', 'high'][r] AS priority FROM m""", "fx_traits")
def merge_bullets(traits):
    b = traits.where("value <> 'unknown'").select((F.col("image_id") % 97).alias("query_id"), F.lower(F.concat_ws(":", "field", "value")).alias("key"), F.element_at(F.array(F.lit("high"), F.lit("normal"), F.lit("low")), (F.col("position") % 3 + 1).cast("int")).alias("priority"), (F.col("image_id") * 10 + F.length("field")).alias("ord"), F.concat_ws(": ", "field", "value").alias("text"))
    return R.merge_bullets(b, ["query_id"])


_MAP = [("base_type", "value 1", "leg_type", "value 2"), ("base_type", "value 2", "leg_type", "value 9"), ("arm_option", "value 1", "arm", "value 1")]
_ANTI, _ALLOWED = [("base_type", "value 3")], [("leg_type", "value 2"), ("arm", "value 1")]


@query("r17_translate_bullets", "WITH m(field, value, to_field, to_value) AS (VALUES " + ", ".join(map(str, _MAP)) + """), never(field, value) AS (VALUES ('base_type', 'value 3')),
allowed(to_field, to_value) AS (VALUES ('leg_type', 'value 2'), ('arm', 'value 1')), b AS (SELECT image_id, field, value FROM fx_traits)
SELECT b.image_id, b.field, b.value, m.to_field, m.to_value,
  CASE WHEN b.value = '' THEN 'unparseable' WHEN b.field NOT IN (SELECT field FROM m) THEN 'unknown_field' WHEN never.field IS NOT NULL THEN 'anti_mapping'
       WHEN m.to_field IS NULL THEN 'no_mapping' WHEN allowed.to_field IS NULL THEN 'no_valid_value' END AS drop_reason
FROM b LEFT JOIN never ON never.field = b.field AND never.value = b.value LEFT JOIN m ON m.field = b.field AND m.value = b.value
LEFT JOIN allowed ON allowed.to_field = m.to_field AND allowed.to_value = m.to_value""", "fx_traits")
def translate_bullets(traits):
    return R.translate_bullets(traits.select("image_id", "field", "value"), rows(traits, _MAP, "field string, value string, to_field string, to_value string"), rows(traits, _ANTI, "field string, value string"), rows(traits, _ALLOWED, "field string, value string"))


@query("r16_search_bullets", """
SELECT image_id, string_agg(concat(field, ': ', value), ' | ' ORDER BY CASE field WHEN 'base_type' THEN 1 WHEN 'base_finish' THEN 2 WHEN 'arm_option' THEN 3 ELSE 4 END) AS bullets
FROM fx_traits WHERE value NOT IN ('unknown', '') GROUP BY image_id""", "fx_traits")
def search_bullets(traits):
    order = F.array_position(F.array(*map(F.lit, ("base_type", "base_finish", "arm_option", "back_height"))), F.col("field"))
    kept = traits.where(~F.col("value").isin("unknown", "") & ~T.is_absence(F.col("value")))
    return kept.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.concat_ws(": ", "field", "value").alias("t")))), lambda x: x["t"]), " | ").alias("bullets"))


@query("r21_browse", """
WITH hero AS (SELECT * FROM fx_images WHERE visual_type IN ('stool', 'bench')
  QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN stage_0_result = 'product' THEN 0 ELSE 1 END, position, ai_refreshed_at DESC NULLS LAST, image_id) = 1)
SELECT p.product_id, p.product_name, p.brand, h.image_id AS hero_image_id, h.confidence_tier,
       row_number() OVER (ORDER BY p.product_name, p.brand, p.product_id) AS place
FROM fx_products p LEFT JOIN hero h USING (product_id)
ORDER BY p.product_name, p.brand, p.product_id LIMIT 100""", "fx_products", "fx_images")
def browse(products, images):
    hero = R.hero_image(images.where(F.col("visual_type").isin("stool", "bench"))).select("product_id", F.col("image_id").alias("hero_image_id"), "confidence_tier")
    page = products.orderBy("product_name", "brand", "product_id").limit(100)
    placed = page.withColumn("place", F.row_number().over(W.orderBy("product_name", "brand", "product_id")).cast("long"))
    return placed.join(hero, "product_id", "left").select("product_id", "product_name", "brand", "hero_image_id", "confidence_tier", "place")


@query("r22_facet_counts", """
WITH vocab AS (SELECT f.field, concat('value ', v.n) AS value FROM (VALUES ('base_type'), ('base_finish'), ('arm_option'), ('back_height')) f(field) CROSS JOIN (SELECT unnest(range(1, 9)) AS n) v),
met AS (SELECT image_id, max((field = 'base_type' AND value = 'value 1')::INT) AS a, max((field = 'arm_option' AND value = 'value 2')::INT) AS b FROM fx_traits WHERE value NOT IN ('', 'unknown') GROUP BY image_id),
c AS (SELECT t.field, t.value, count(DISTINCT product_id) AS products FROM fx_traits t JOIN met USING (image_id)
      WHERE t.value NOT IN ('', 'unknown') AND (a = 1 OR t.field = 'base_type') AND (b = 1 OR t.field = 'arm_option') GROUP BY ALL)
SELECT v.field, v.value, coalesce(c.products, 0) AS products, false AS legacy FROM vocab v LEFT JOIN c USING (field, value)
UNION ALL SELECT field, value, products, true FROM c WHERE (field, value) NOT IN (SELECT (field, value) FROM vocab)""", "fx_traits")
def facet_counts(traits):
    vocab = rows(traits, [(f, f"value {n}") for f in ("base_type", "base_finish", "arm_option", "back_height") for n in range(1, 9)], "field string, value string")
    return R.facet_counts(traits, {"base_type": "value 1", "arm_option": "value 2"}, vocab)


@query("r23_score_explain", f"WITH {_SCORED} SELECT query_id, image_id, c.component, c.amount FROM scored, LATERAL (VALUES ('similarity', similarity), ('category', CASE WHEN product_id = query_id % 10 THEN 0.03 ELSE 0.0 END), ('exact', CASE WHEN image_id = query_id THEN 2.0 ELSE 0.0 END), ('room', CASE WHEN image_id % 7 = 0 THEN -0.2 ELSE 0.0 END)) c(component, amount)", "embeddings")
def score_explain(emb):
    part = lambda c, v: F.when(c, v).otherwise(0.0)
    top = _topk(emb).select("query_id", "image_id", "similarity", part(F.col("product_id") == F.col("query_id") % 10, 0.03).alias("category"), part(F.col("image_id") == F.col("query_id"), 2.0).alias("exact"), part(F.col("image_id") % 7 == 0, -0.2).alias("room"))
    return top.unpivot(["query_id", "image_id"], ["similarity", "category", "exact", "room"], "component", "amount")


@query("l4_apply_order", """
WITH r AS (SELECT *, CASE WHEN model_rank <= 10 AND human_rank <= 3 THEN human_rank END AS place FROM (SELECT query_id, product_id, min(model_rank) AS model_rank, min(human_rank) AS human_rank FROM fx_rankings GROUP BY ALL))
SELECT query_id, product_id, model_rank AS rank,
  row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN model_rank <= 10 THEN 0 ELSE 1 END, coalesce(place, 1000000 + model_rank)) AS new_rank FROM r""", "fx_rankings")
def apply_order(rankings):
    one = rankings.groupBy("query_id", "product_id").agg(F.min("model_rank").alias("rank"), F.min("human_rank").alias("place"))
    ranked, order = one.select("query_id", "product_id", F.col("rank").cast("long").alias("rank")), one.where("place <= 3").select("query_id", "product_id", F.col("place").cast("long").alias("place"))
    return R.apply_order(ranked, order)


@query("e1_self_retrieval", """
WITH n AS (
  SELECT q.vec_id AS query_id, q.label, i.label AS product_id, max(round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) + 0.0) AS s
  FROM {embeddings} q JOIN {embeddings} i ON q.vec_id % 20 = 0 AND i.vec_id <> q.vec_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, product_id) AS rank FROM n)
SELECT count(*) AS queries, round(avg((rank = 1)::INT), 6) AS at_1, round(avg((rank <= 3)::INT), 6) AS at_3, round(avg(rank), 6) AS mean_rank FROM r WHERE label = product_id""", "embeddings")
def self_retrieval(emb):
    q = emb.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    near = N.product_similarity(emb.select(F.col("vec_id").alias("image_id"), F.col("label").alias("product_id"), "embedding"), q)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "product_id"))).join(q.select("query_id", "label"), "query_id").where("label = product_id")
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return ranked.agg(F.count("*").alias("queries"), share(F.col("rank") == 1).alias("at_1"), share(F.col("rank") <= 3).alias("at_3"), F.round(F.avg("rank"), 6).alias("mean_rank"))


@query("w1_hero_image", """
SELECT product_id, image_id FROM fx_images
QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN stage_0_result = 'product' THEN 0 ELSE 1 END, position, ai_refreshed_at DESC NULLS LAST, image_id) = 1""", "fx_images")
def hero(images):
    return R.hero_image(images).select("product_id", "image_id")


@query("w2_target_vector", """
SELECT product_id, image_id, vec_id FROM fx_images
QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY CASE confidence_tier WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, ai_refreshed_at DESC NULLS LAST, image_id) = 1""", "fx_images")
def target(images):
    return R.target_vector(images).select("product_id", "image_id", "vec_id")


_BYTE = "CAST('0x' || substr(h, {k} * 2 + 1, 2) AS INTEGER)"
_ENTRIES = " UNION ALL ".join(f"SELECT product_id AS id, ({_BYTE.format(k=2 * i)} * 256 + {_BYTE.format(k=2 * i + 1)}) % 192 AS dim, (CASE WHEN {_BYTE.format(k=8 + i)} % 2 = 0 THEN 1 ELSE -1 END) * (1 + {_BYTE.format(k=12 + i)} / 255.0::DOUBLE) AS x FROM tokens" for i in range(4))


@query("f30_hash_embed", f"""
WITH tokens AS (SELECT product_id, sha1(token) AS h FROM (SELECT product_id, unnest(string_split(lower(product_name), ' ')) AS token FROM fx_products) WHERE length(token) > 1),
e AS ({_ENTRIES}), s AS (SELECT id, dim, sum(x) AS x FROM e GROUP BY id, dim)
SELECT id, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS x FROM s""", "fx_products")
def hash_embed(products):
    found = V.hash_embed(products.select(F.col("product_id").alias("id"), T.tokenize(F.col("product_name")).alias("tokens")))
    return found.select("id", F.posexplode("vector").alias("dim", "x")).where("x <> 0")

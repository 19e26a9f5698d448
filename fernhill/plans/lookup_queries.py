"""Queries on vocabularies, bullets, phrases, plain joins, sorts and the remaining reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernhill.functions import text as T, vectors as V
from fernhill.operators import diagnostics as D, phrases as P, resolution as E
from fernhill.plans._book import query, rows
from fernhill.sources import catalog as S


def _values(name: str, columns: str, data: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join(str(x) if len(x) > 1 else f'({x[0]!r})' for x in data)})"


_VOCAB = [("base_type", "Value 1"), ("base_type", "unknown"), ("base_finish", "Value 2"), ("arm_option", "yes"), ("arm_option", "Value 3")]
_ALIAS = [("value 4", "value 1"), ("value 5", "value 2"), ("value 2", "value 3")]


@query("f34_norm_enum", f"""WITH {_values('v', 'field, value', _VOCAB)}, {_values('al', 'alias, target', _ALIAS)}
SELECT t.image_id, t.field, t.value, coalesce(a.value, b.value, CASE WHEN EXISTS (SELECT 1 FROM v WHERE v.field = t.field AND lower(v.value) = 'unknown') THEN 'unknown' ELSE '' END) AS normalized
FROM (SELECT image_id, field, value FROM fx_traits) t LEFT JOIN v a ON a.field = t.field AND lower(a.value) = lower(trim(t.value))
LEFT JOIN al ON al.alias = lower(trim(t.value)) LEFT JOIN v b ON b.field = t.field AND lower(b.value) = al.target""", "fx_traits")
def norm_enum(traits):
    return P.norm_enum(traits.select("image_id", "field", "value"), rows(traits, _VOCAB, "field string, value string"), rows(traits, _ALIAS, "alias string, target string"))


_LABELS = [("Base Type", "base_type"), ("arm-option", "arm_option")]


@query("f36_parse_bullet", "SELECT image_id, concat(replace(field, '_', ' '), ': ', value) AS text, value, CASE WHEN field IN ('base_type', 'arm_option') THEN field END AS field FROM fx_traits", "fx_traits")
def parse_bullet(traits):
    bullets = traits.select("image_id", F.concat(F.replace("field", F.lit("_"), F.lit(" ")), F.lit(": "), F.col("value")).alias("text"))
    return P.parse_bullets(bullets, rows(traits, _LABELS, "label string, field string")).select("image_id", "text", "value", "field")


@query("f22_pixel_type", "SELECT product_id, CASE WHEN brand = 'Brand#11' THEN 'stool' WHEN brand IN ('Brand#12', 'Brand#13') THEN 'bench' ELSE 'SKIP' END AS pixel_type FROM fx_products", "fx_products")
def pixel(products):
    decisions, table = rows(products, [("Brand#11", "stool")], "grouping string, visual_type string"), rows(products, [("Brand#11", "bench"), ("Brand#12", "bench"), ("Brand#13", "bench")], "grouping string, visual_type string")
    return P.pixel_type(products.select("product_id", F.col("brand").alias("grouping")), decisions, table).select("product_id", "pixel_type")


@query("f23_image_cap", "SELECT product_id, least(CASE visual_type WHEN 'stool' THEN 5 WHEN 'bench' THEN 30 ELSE 8 END, 15)::BIGINT AS cap FROM fx_products", "fx_products")
def cap(products):
    return P.image_cap(products.select("product_id", "visual_type"), rows(products, [("stool", 5), ("bench", 30)], "visual_type string, cap int")).select("product_id", "cap")


_FAM = [("stool", "a"), ("bench", "a"), ("guest_chair", "b"), ("lounge_chair", "b")]


@query("f21_compatible_types", f"WITH {_values('f', 'visual_type, family', _FAM)} SELECT p.product_id, b.visual_type AS compatible FROM fx_products p JOIN f a USING (visual_type) JOIN f b ON a.family = b.family", "fx_products")
def compatible(products):
    return P.compatible_types(products.select("product_id", "visual_type"), rows(products, _FAM, "visual_type string, family string")).select("product_id", "compatible")


@query("f20_visual_type_key", "SELECT product_id, CASE lower(a_level) WHEN 'small' THEN 'stool' WHEN 'economy' THEN 'bench' ELSE '' END AS type_key FROM fx_products", "fx_products")
def type_key(products):
    return products.select("product_id", T.first_rule(F.col("a_level"), [("small", "stool"), ("economy", "bench")]).alias("type_key"))


_DICT = [("greeting", "with the", "pair"), ("greeting", "the", "article"), ("number", "[0-9]{2}", "digits"), ("tongue", "(und|der)", "german"), ("tongue", "(que|los)", "spanish")]


@query("f53_query_trait_flags", "SELECT conv_id, turn, " + ", ".join("CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{v}'" for t, p, v in _DICT if t == trait) + f" END AS {trait}" for trait in ("greeting", "number", "tongue")) + " FROM {conversations}", "conversations")
def flags(conv):
    return P.trait_flags(conv.select("conv_id", "turn", "text"), _DICT).drop("text")


_NOUNS = ["the", "with", "and", "des", "die"]
_HEAD = "concat(' ', array_to_string(list_slice(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), 1, 10), ' '), ' ')"


@query("f48_category_noun", "SELECT doc_id, CASE " + " ".join(f"WHEN contains({_HEAD}, ' {n} ') THEN '{n}'" for n in sorted(_NOUNS, key=lambda n: (-len(n), n))) + " END AS noun FROM {documents}", "documents")
def noun(docs):
    return P.category_noun(docs.select("doc_id", "text"), _NOUNS).select("doc_id", "noun")


_SCENE = ["with the ", "is in ", "les "]


@query("f49_room_scene", "SELECT doc_id, " + " OR ".join(f"contains(lower(text), '{p}')" for p in _SCENE) + " AS is_scene FROM {documents}", "documents")
def room(docs):
    return docs.select("doc_id", P.contains_any(F.col("text"), _SCENE).alias("is_scene"))


@query("f50_detected_traits", "SELECT image_id, string_agg(concat(field, ': ', value), '; ' ORDER BY field) AS detected FROM fx_traits WHERE value NOT IN ('', 'unknown', 'n/a') GROUP BY 1", "fx_traits")
def detected(traits):
    some = traits.where("value NOT IN ('', 'unknown', 'n/a')").groupBy("image_id").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "field", "value"))).alias("d"))
    return some.select("image_id", F.array_join(F.slice("d", 1, 6), "; ").alias("detected"))


@query("f51_search_text", "SELECT p.product_id, concat_ws('. ', product_name, brand, nullif(visual_type, ''), concat('a level: ', a_level)) AS search_text FROM fx_products p", "fx_products")
def search_text(products):
    traits = F.create_map(F.lit("a_level"), F.col("a_level"), F.lit("gone"), F.lit("unknown"))
    return products.select("product_id", T.search_text([F.col("product_name"), F.col("brand"), F.col("visual_type")], traits, []).alias("search_text"))


@query("f52_usage_cost", "SELECT user_id, round(sum(event_id * 0.00000015::DOUBLE + user_id * 0.0000006::DOUBLE), 6) AS cost FROM {events} GROUP BY 1", "events")
def usage(events):
    return events.groupBy("user_id").agg(F.round(F.sum(T.usage_cost(F.col("event_id"), F.col("user_id"), 0.00000015, 0.0000006)), 6).alias("cost"))


@query("f54_base_type_norm", "SELECT DISTINCT value, CASE WHEN contains(lower(value), 'value 1') THEN 'four leg' WHEN contains(lower(value), 'value') THEN 'other' ELSE '' END AS base FROM fx_traits", "fx_traits")
def base_norm(traits):
    return traits.select("value").distinct().select("value", T.first_rule(F.col("value"), [("value 1", "four leg"), ("value", "other")]).alias("base"))


@query("f55_negation_language", "SELECT doc_id, regexp_matches(lower(text), '\\b(not|no|without|ohne|sans|sin)\\b') AS negated FROM {documents}", "documents")
def negation(docs):
    return docs.select("doc_id", F.lower("text").rlike(T.whole_words("not|no|without|ohne|sans|sin")).alias("negated"))


@query("f56_finish_fallback", "SELECT product_id, CASE WHEN c_level IN ('brass', 'steel') THEN c_level WHEN regexp_matches(lower(product_name), 'nut') THEN 'metal' WHEN regexp_matches(lower(product_name), 'bolt') THEN 'iron' ELSE 'unknown' END AS finish FROM fx_products", "fx_products")
def finish(products):
    base = products.select("product_id", "product_name", F.when(F.col("c_level").isin("brass", "steel"), F.col("c_level")).otherwise("").alias("finish"))
    return P.finish_fallback(base, [("nut", "metal"), ("bolt", "iron")]).select("product_id", "finish")


@query("f19_effective_class", "SELECT image_id, CASE WHEN excluded AND confidence_tier = 'high' THEN 'detail' ELSE stage_0_result END AS class FROM fx_images", "fx_images")
def effective(images):
    override = F.when(F.col("excluded") & (F.col("confidence_tier") == "high"), "DETAIL").otherwise("nonsense")
    return images.select("image_id", T.effective_class(override, F.col("stage_0_result")).alias("class"))


@query("f26_overall_confidence", "SELECT product_id, CASE WHEN bool_or(confidence_tier = 'low') THEN 'low' WHEN bool_or(confidence_tier = 'medium') THEN 'medium' ELSE 'high' END AS confidence FROM fx_images GROUP BY 1", "fx_images")
def overall(images):
    return images.groupBy("product_id").agg(T.overall_confidence(F.collect_set("confidence_tier")).alias("confidence"))


@query("f27_vector_functions", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, round(greatest(0, least(1, (list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2)), 6) AS similarity FROM {embeddings} a JOIN {embeddings} b ON b.vec_id = a.vec_id + 3", "embeddings")
def vector_functions(emb):
    pairs = emb.select("vec_id", "embedding").join(emb.select((F.col("vec_id") - 3).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    c = V.cosine(F.col("embedding"), F.col("other"))
    return pairs.select("vec_id", F.round(c, 6).alias("cosine"), V.norm_similarity(c).alias("similarity"))


@query("f39_measure_functions", "SELECT p_partkey, CASE WHEN p_size <= 18 AND p_retailprice > 1000 THEN 'narrow' ELSE 'wide' END AS width, round(least(greatest(p_size::DOUBLE, 2), 8), 2) AS clamped FROM {part}", "part")
def measures(part):
    return part.select("p_partkey", F.when((F.col("p_size") <= 18) & (F.col("p_retailprice") > 1000), "narrow").otherwise("wide").alias("width"), T.clamp_measure(F.col("p_size"), 2.0, 8.0).alias("clamped"))


_COMPONENTS = [("(nut|bolt)", "hardware"), ("(plate|bracket)", "frame")]


@query("f42_component_group", "SELECT product_id, CASE WHEN regexp_matches(product_name, '(nut|bolt)') THEN 'hardware' WHEN regexp_matches(product_name, '(plate|bracket)') THEN 'frame' ELSE 'misc' END AS component FROM fx_products", "fx_products")
def component(products):
    return products.select("product_id", T.first_pattern(F.col("product_name"), _COMPONENTS, "misc").alias("component"))


@query("r14_strip_category", "SELECT product_id, trim(regexp_replace(regexp_replace(trim(replace(lower(concat('with ', product_name, ' x')), lower(c_level), ' ')), '\\s+', ' ', 'g'), '^[\\s,.;:]*(with )?', '')) AS residual FROM fx_products", "fx_products")
def strip(products):
    return products.select("product_id", P.strip_phrase(F.concat(F.lit("with "), F.col("product_name"), F.lit(" x")), F.col("c_level")).alias("residual"))


@query("r13_clarify_options", "SELECT product_id, CASE WHEN b_level = 'nut' THEN 'stool|bench' WHEN a_level = 'SMALL' THEN 'stool' ELSE 'any' END AS options FROM fx_products", "fx_products")
def clarify(products):
    text = F.concat_ws(" ", "b_level", F.lower("a_level"))
    return products.select("product_id", T.first_rule(text, [("nut", "stool|bench"), ("small", "stool")], "any").alias("options"))


_PHRASES = [
    "Tapered wooden legs", "curved wood back", "Four legs", "modern design", "thin metal frame legs", "Rounded armrests!!", "mesh mesh backrest", "the back of mesh", "stool", "open seat", "a quiet design presence",
    "upholstered seat cushions, thick", "floating top", "metal legs", "chrome base with 5 casters wheel", "tall angular silhouette look", "glass top panel", "slender wood leg tapered", "wraparound shell", " closed side panels. ",
]
_SQL_PHRASES = "raw AS (SELECT product_id AS record_id, position AS ord, [" + ", ".join(repr(x) for x in _PHRASES) + f"][CAST((image_id * 7 + position) % {len(_PHRASES)} AS INTEGER) + 1] AS text FROM fx_images)"
_NORM = "trim(lower(text))"
for _pattern, _to in ((r"[;:,.!?]{2,}", "."), (r"\s+", " "), (r"^[,.;:!?]+|[,.;:!?]+$", ""), *((rf"\b{a}\b", b) for a, b in T.BULLET_FORMS)):
    _NORM = f"regexp_replace({_NORM}, '{_pattern}', '{_to}', 'g')"
_NORM = f"replace({_NORM}, 'mesh mesh', 'mesh')"  # the one doubled word among the phrases; there are no back-references here
_COUNT = lambda words: f"len(list_filter(ws, lambda w: list_contains({list(words)}, w)))"
_SQL_BULLETS = f"""{_SQL_PHRASES},
normed AS (SELECT record_id, ord, {_NORM} AS norm FROM raw),
words AS (SELECT *, list_filter(string_split(norm, ' '), lambda w: w <> '') AS ws FROM normed),
judged AS (
  SELECT record_id, ord, norm,
    3 * {_COUNT(P.MATERIAL_WORDS)} + 3 * {_COUNT(P.COMPONENT_NOUNS)} + 2 * {_COUNT(P.QUALIFIER_WORDS)} + CASE WHEN len(ws) >= 5 THEN 2 WHEN len(ws) >= 3 THEN 1 ELSE 0 END AS score,
    norm = '' OR list_contains({list(P.LOW_VALUE)}, norm) OR regexp_matches(norm, '{P.COUNTED_PARTS}') OR (len(ws) <= 2 AND {_COUNT(P.OBJECT_NOUNS)} > 0)
      OR ({_COUNT(P.ABSTRACT_TERMS)} > 0 AND {_COUNT(P.MATERIAL_WORDS)} = 0 AND {_COUNT(P.COMPONENT_NOUNS)} <= 1 AND len(ws) >= 3) AS low,
    CASE {" ".join(f"WHEN regexp_matches(norm, '{chr(92)}b({w}){chr(92)}b') THEN '{g}'" for w, g in P.COMPONENT_GROUPS)} ELSE 'misc' END AS part,
    list_filter(list_transform(regexp_split_to_array(regexp_replace(norm, '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), lambda w: CASE w {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in P.SAME_WORDS)} ELSE w END), lambda w: w <> '' AND NOT list_contains({list(P.STOP_WORDS)}, w)) AS tokens
  FROM words)"""


def _bullets(images):
    n = len(_PHRASES)
    text = F.element_at(F.array(*map(F.lit, _PHRASES)), ((F.col("image_id") * 7 + F.col("position")) % n).cast("int") + 1)
    return images.select(F.col("product_id").alias("record_id"), F.col("position").alias("ord"), text.alias("text"))


@query("f41_norm_bullet", f"WITH {_SQL_BULLETS} SELECT record_id, ord, norm FROM judged", "fx_images")
def normed_bullets(images):
    return _bullets(images).select("record_id", "ord", T.norm_bullet(F.col("text")).alias("norm"))


@query("f42_bullet_part", f"WITH {_SQL_BULLETS} SELECT record_id, ord, part FROM judged", "fx_images")
def bullet_parts(images):
    return _bullets(images).select("record_id", "ord", P.component_group(T.norm_bullet(F.col("text"))).alias("part"))


@query("f43_bullet_score", f"WITH {_SQL_BULLETS} SELECT record_id, ord, CAST(score AS INTEGER) AS score FROM judged", "fx_images")
def bullet_scores(images):
    return _bullets(images).select("record_id", "ord", P.bullet_score(T.norm_bullet(F.col("text"))).alias("score"))


@query("f44_low_value_bullet", f"WITH {_SQL_BULLETS} SELECT record_id, ord, low FROM judged", "fx_images")
def low_bullets(images):
    return _bullets(images).select("record_id", "ord", P.low_value_bullet(T.norm_bullet(F.col("text"))).alias("low"))


_OVERLAP = """(contains(x[1].norm, k.norm) OR contains(k.norm, x[1].norm)
  OR (x[1].part = k.part AND k.part <> 'misc' AND len(list_filter(x[1].tokens, lambda t: list_contains(k.tokens, t))) >= 2)
  OR len(list_filter(x[1].tokens, lambda t: list_contains(k.tokens, t))) / greatest(len(x[1].tokens), len(k.tokens), 1) >= 0.7)"""
_AT = f"coalesce(list_position(list_transform(kept, lambda k: {_OVERLAP}), true), 0)"


@query("r18_clean_highlights", f"""
WITH {_SQL_BULLETS},
firsts AS (SELECT record_id, norm, min(ord) AS ord, any_value(part) AS part, any_value(tokens) AS tokens, any_value(score) AS score FROM judged WHERE NOT low GROUP BY record_id, norm),
lists AS (SELECT record_id, list([{{'norm': norm, 'part': part, 'tokens': tokens, 'score': score}}] ORDER BY ord, norm) AS items FROM firsts GROUP BY record_id),
folded AS (
  SELECT record_id, list_reduce(items, lambda kept, x: CASE WHEN {_AT} = 0 THEN list_concat(kept, x)
    ELSE list_transform(kept, lambda k, i: CASE WHEN i = {_AT} AND x[1].score > k.score THEN x[1] ELSE k END) END) AS kept FROM lists)
SELECT record_id, array_to_string(list_transform(kept[1:8], lambda k: k.norm), '|') AS highlights FROM folded""", "fx_images")
def highlights(images):
    return P.clean_highlights(_bullets(images)).select("record_id", F.array_join("highlights", "|").alias("highlights"))


@query("r19_matched_phrases", """
WITH w AS (SELECT product_id, [b_level, c_level] AS wanted FROM fx_products), p AS (SELECT i.product_id, p.product_name || ' ' || i.position AS phrase, i.position % 3 AS salience, [p.b_level, p.c_level, CAST(i.position AS VARCHAR)] AS tokens FROM fx_images i JOIN fx_products p ON p.product_id = i.product_id - 1),
s AS (SELECT p.product_id AS record_id, phrase, round((3 * len(list_intersect(tokens, wanted)) + salience + 0.1::DOUBLE * 3), 6) AS score FROM p JOIN w USING (product_id))
SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, phrase) AS place FROM s QUALIFY place <= 3""", "fx_products", "fx_images")
def matched(products, images):
    i = images.select((F.col("product_id") - 1).alias("k"), "position").join(products.select(F.col("product_id").alias("k"), "product_name", "b_level", "c_level"), "k")
    phrases = i.select((F.col("k") + 1).alias("record_id"), F.concat_ws(" ", "product_name", F.col("position").cast("string")).alias("phrase"), (F.col("position") % 3).alias("salience"), F.array("b_level", "c_level", F.col("position").cast("string")).alias("tokens"))
    return P.matched_phrases(phrases, products.select(F.col("product_id").alias("record_id"), F.array("b_level", "c_level").alias("wanted")))


@query("r5_category_boost", "SELECT product_id, CASE WHEN 'SMALL' IN (a_level, b_level, c_level) THEN 0.03::DOUBLE ELSE 0.0 END AS boost FROM fx_products", "fx_products")
def category_boost(products):
    return products.select("product_id", F.when(F.array_contains(F.array("a_level", "b_level", "c_level"), "SMALL"), 0.03).otherwise(0.0).alias("boost"))


@query("l1_result_sort", "SELECT product_id, brand FROM fx_products ORDER BY lower(brand), brand, product_id LIMIT 30", "fx_products")
def result_sort(products):
    return products.orderBy(F.lower("brand"), "brand", "product_id").limit(30).select("product_id", "brand")


@query("l3_top_examples", """
WITH c AS (SELECT brand AS a, visual_type AS b, count(*) AS n FROM fx_images GROUP BY ALL ORDER BY n DESC, a, b LIMIT 15),
e AS (SELECT i.brand AS a, i.visual_type AS b, c.n, image_id FROM fx_images i JOIN c ON c.a = i.brand AND c.b = i.visual_type QUALIFY row_number() OVER (PARTITION BY i.brand, i.visual_type ORDER BY image_id) <= 5)
SELECT a, b, n, string_agg(CAST(image_id AS VARCHAR), ',' ORDER BY image_id) AS examples FROM e GROUP BY ALL""", "fx_images")
def examples(images):
    return P.top_examples(images.select(F.col("brand").alias("a"), F.col("visual_type").alias("b"), F.col("image_id").alias("id")))


_ISSUES = [("loose", "short_side < 500"), ("contradiction", "stage_0_result = 'scene' AND confidence_tier = 'high'"), ("stale", "excluded")]


@query("d16_observation_audit", "SELECT image_id AS record_id, concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _ISSUES) + ") AS issues FROM fx_images", "fx_images")
def audit(images):
    return P.observation_audit(images.withColumnRenamed("image_id", "record_id"), _ISSUES).select("record_id", F.array_join("issues", ",").alias("issues"))


@query("d7_health_baseline", "SELECT visual_type, field, round(count(*) FILTER (WHERE value <> 'unknown') / count(*), 6) AS baseline FROM fx_traits WHERE stage_0_result = 'product' AND visual_type <> '' GROUP BY ALL", "fx_images", "fx_traits")
def baseline(images, traits):
    vocab = traits.where("visual_type <> ''").select("visual_type", "field").distinct()
    none = rows(traits, [], "visual_type string, field string, baseline double")
    return D.trait_health(images, traits, vocab, none).select("visual_type", "field", F.col("coverage").alias("baseline"))


@query("e3_candidate_profile", "SELECT product_id, string_agg(DISTINCT concat('image.', field, ':', value), ',' ORDER BY concat('image.', field, ':', value)) AS tokens FROM fx_traits WHERE value <> 'unknown' GROUP BY 1", "fx_traits")
def profile(traits):
    token = F.concat(F.lit("image."), F.col("field"), F.lit(":"), F.col("value"))
    return traits.where("value <> 'unknown'").groupBy("product_id").agg(F.array_join(F.array_sort(F.collect_set(token)), ",").alias("tokens"))


@query("s6_category_levels_from_list", "SELECT product_id, a_level AS a, CASE WHEN product_id % 2 = 0 THEN b_level ELSE a_level END AS b FROM fx_products", "fx_products")
def levels(products):
    entry = lambda level, c: F.struct(F.lit(level).alias("level"), F.col(c).alias("name"))
    entries = F.when(F.col("product_id") % 2 == 0, F.array(entry("a", "a_level"), entry("b", "b_level"))).otherwise(F.array(entry("a", "a_level")))
    got = S.levels_from_list(F.col("entries"))
    return products.withColumn("entries", entries).select("product_id", F.array_join(got["a_level"], "|").alias("a"), F.array_join(got["b_level"], "|").alias("b"))


@query("s9_catalog_from_selection", "SELECT p.product_id, count(*) AS n_images FROM fx_products p JOIN (SELECT * FROM fx_images WHERE short_side > 1000) i USING (product_id) GROUP BY 1", "fx_products", "fx_images")
def selection(products, images):
    return S.catalog_from_selection(products, images.where("short_side > 1000")).select("product_id", "n_images")


@query("s16_audit_run", "SELECT 'merge' AS job, count(*) AS n_rows FROM fx_products UNION ALL SELECT 'old', 5", "fx_products")
def audit_run(products):
    import datetime

    old = rows(products, [("old", 5, datetime.datetime(2024, 1, 1))], "job string, n_rows long, run_at timestamp")
    new = products.agg(F.lit("merge").alias("job"), F.count("*").alias("n_rows"), F.current_timestamp().alias("run_at"))
    return old.unionByName(new).select("job", "n_rows")


@query("j1_image_product", "SELECT i.image_id, p.product_name FROM fx_images i JOIN fx_products p USING (product_id)", "fx_images", "fx_products")
def image_product(images, products):
    return images.select("image_id", "product_id").join(products.select("product_id", "product_name"), "product_id").select("image_id", "product_name")


@query("j7_full_coverage", "SELECT coalesce(c.t, i.t) AS tail, c.t IS NOT NULL AS in_catalog, i.t IS NOT NULL AS in_index FROM (SELECT DISTINCT regexp_extract(source_product_id, '(\\d+)$', 1) AS t FROM fx_catalog_side) c FULL JOIN (SELECT DISTINCT regexp_extract(source_product_id, '(\\d+)$', 1) AS t FROM fx_index_side) i ON c.t = i.t", "fx_catalog_side", "fx_index_side")
def full(catalog, index):
    side = lambda df, name: df.select(T.tail_id(F.col("source_product_id")).alias("tail")).distinct().withColumn(name, F.lit(True))
    return side(catalog, "in_catalog").join(side(index, "in_index"), "tail", "full_outer").fillna(False)


@query("j8_unindexed_products", "SELECT product_id FROM fx_products WHERE product_id NOT IN (SELECT product_id FROM fx_images WHERE short_side > 1900)", "fx_products", "fx_images")
def unindexed(products, images):
    return products.select("product_id").join(images.where("short_side > 1900").select("product_id"), "product_id", "left_anti")


@query("c6_canonical_image_key", "SELECT image_id, concat('dp:', product_id, ':img:', substring(sha1(concat('u/', image_id)), 1, 16)) AS canonical_image_key FROM fx_images", "fx_images")
def image_key(images):
    return images.select("image_id", F.concat(F.lit("dp:"), F.col("product_id"), F.lit(":img:"), T.hash_key(F.concat(F.lit("u/"), F.col("image_id")))).alias("canonical_image_key"))


@query("c5_merge_image_fields", "SELECT product_id, image_id, CASE WHEN image_id % 5 = 0 THEN 'catalog' ELSE 'index' END AS preferred, CASE WHEN image_id % 5 = 0 THEN brand ELSE visual_type END AS label FROM fx_images WHERE image_id % 3 <> 0 OR image_id % 5 = 0", "fx_images")
def merge_image_fields(images):
    index = images.where("image_id % 5 <> 0 AND image_id % 3 <> 0").select("product_id", "image_id", F.lit("index").alias("preferred"), F.col("visual_type").alias("label"))
    catalog = images.where("image_id % 5 = 0").select("product_id", "image_id", F.lit("catalog").alias("preferred"), F.col("brand").alias("label"))
    return E.upsert_by_key(catalog, index, "image_id")


_RAW = "concat('  ', p.product_name, '. Made of ', p.c_level, '! Is it ', lower(p.a_level), '? ', p.brand)"


@query("f_catalog_functions", f"""
WITH r AS (SELECT p.*, {_RAW} AS raw, CAST(product_id % 7 AS VARCHAR) AS d FROM fx_products p)
SELECT product_id,
  concat('product_', substring(sha1(concat_ws('::', nullif(brand, ''), nullif(product_name, ''))), 1, 12), '_', substring(regexp_replace(regexp_replace(replace(lower(raw), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80)) AS f5,
  concat('https://', CASE WHEN product_id % 2 = 0 THEN 'img.test' ELSE 'cdn.test' END, '/', product_id, CASE WHEN product_id % 2 = 0 THEN '' ELSE '_large' END, '.jpg') AS f13,
  array_to_string(list_filter([a_level], lambda x: x NOT IN ('', '0')), '|') AS f16_a,
  CASE WHEN product_id % 3 = 0 THEN a_level ELSE b_level END AS f16_b, CASE WHEN product_id % 5 <> 0 THEN c_level WHEN product_id % 3 = 0 THEN a_level ELSE b_level END AS f16_c,
  CASE product_id % 7 WHEN 3 THEN '' ELSE d || '.5,' END || '-2.0' AS f31,
  product_id % 4 < 3 AS f38,
  concat(trim(product_name), '. Made of ', c_level, '!') AS f45,
  CASE product_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'normal' END AS f37
FROM r""", "fx_products")
def catalog_functions(products):
    raw = F.concat(F.lit("  "), "product_name", F.lit(". Made of "), "c_level", F.lit("! Is it "), F.lower("a_level"), F.lit("? "), "brand")
    url = F.concat(F.lit("https://"), F.when(F.col("product_id") % 2 == 0, "img.test").otherwise("cdn.test"), F.lit("/"), "product_id", F.lit("_large.jpg"))
    bare = lambda c, n: F.when(F.col("product_id") % n == 0, F.array(F.lit("0"), F.lit(""))).otherwise(F.array(c))
    levels = T.category_levels(F.array("a_level"), bare("b_level", 3), bare("c_level", 5))
    vector = F.concat(F.lit("[ "), F.when(F.col("product_id") % 7 == 3, "Infinity").otherwise(F.concat((F.col("product_id") % 7).cast("string"), F.lit(".5"))), F.lit(", nan, x, -2]"))
    said = F.element_at(F.array(*map(F.lit, (" No", "none", "No arms ", "nothing"))), (F.col("product_id") % 4).cast("int") + 1)
    listed = rows(products, [("stool", "f0", "high"), ("stool", "f1", "low")], "visual_type string, field string, priority string")
    asked = products.withColumns({"raw": raw, "visual_type": F.when(F.col("product_id") % 2 == 0, "stool").otherwise("other"), "field": F.concat(F.lit("f"), F.col("product_id") % 3)})
    return P.field_priority(asked, listed, "stool").select(
        "product_id", T.catalog_product_id(F.col("brand"), F.col("product_name"), raw).alias("f5"), T.strip_large_suffix(url, "img.test").alias("f13"),
        *(F.array_join(levels[c], "|").alias(f"f16_{c[0]}") for c in levels), F.array_join(V.parse_vector(vector).cast("array<string>"), ",").alias("f31"),
        T.negative_value(said).alias("f38"), T.first_sentences(raw, 2).alias("f45"), F.col("priority").alias("f37"),
    )

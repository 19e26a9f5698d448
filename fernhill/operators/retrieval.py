"""Vector retrieval, scoring, roll-up to products, cutoffs, facets and browsing."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from fernhill.functions.text import confidence_rank, is_absence, norm_alnum
from fernhill.operators.ordered import at_positions, running_totals
from fernhill.operators.vector_search import vector_topk
from fernhill.tables import written

def image_score(df: DataFrame, similarity: Column, trait: Column, category: Column, exact: Column, room: Column) -> DataFrame:
    """Similarity, trait boost, 0.03 for the category, 2 for the exact source, -0.2 for a room scene."""
    total = similarity + trait + F.when(category, 0.03).otherwise(0.0) + F.when(exact, 2.0).otherwise(0.0) - F.when(room, 0.2).otherwise(0.0)
    return df.withColumn("score", F.round(total, 6))


def rollup_to_product(scored: DataFrame, by: Sequence[str] = ("query_id",), top: int = 3) -> DataFrame:
    """Best image, match count, ordered image ids and product rank from scored images.

    Where ``scored`` has them: ``image_url`` gives all urls in order, ``ai_refreshed_at`` the latest one,
    ``room`` and ``exact`` whether any image is a room scene or the exact source; a product with the
    exact source comes first.
    """
    order = (F.desc("score"), F.desc("confidence"), "image_id")
    w = W.partitionBy(*by, "product_id").orderBy(*order)
    ranked = scored.withColumn("pos", F.row_number().over(w))
    more = {
        "image_url": F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "image_url"))), lambda x: x["image_url"]), ",").alias("image_urls") if "image_url" in scored.columns else None,
        "ai_refreshed_at": F.max("ai_refreshed_at").alias("ai_refreshed_at"), "room": F.max("room").alias("is_room_scene"), "exact": F.max("exact").alias("is_exact_source"),
    }
    products = ranked.groupBy(*by, "product_id").agg(
        F.max(F.when(F.col("pos") == 1, F.col("image_id"))).alias("hero_image_id"),
        F.max("score").alias("score"), F.max(F.when(F.col("pos") == 1, F.col("confidence"))).alias("confidence"),
        F.count("*").alias("match_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("pos") <= top, F.struct("pos", "image_id")))), lambda x: x["image_id"].cast("string")), ",").alias("top_images"),
        *(c for name, c in more.items() if name in scored.columns),
    )
    first = [F.desc("is_exact_source")] if "exact" in scored.columns else []
    best = W.partitionBy(*by).orderBy(*first, F.desc("score"), F.desc("confidence"), "product_id")
    return products.withColumn("product_rank", F.row_number().over(best).cast("long"))


def nearest_images(images: DataFrame, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``images`` with query_id and similarity: the ``k`` nearest of each query in its family, ties by product and id.

    images: (image_id, product_id, family, vec_id, ...); vectors: (vec_id, embedding); queries: (query_id,
    family, embedding). Images that share a vector are as near as each other, so that only the first ``k`` of
    them can be among the nearest: a vector is compared once for each family, at the place of its first image,
    and images follow for those vectors that have fewer than ``k`` images before them.
    """
    first = W.partitionBy("family", "vec_id").orderBy("product_id", "image_id")
    some = written(images.withColumn("\0n", F.row_number().over(first)).where(F.col("\0n") <= k), "images")
    heads = some.groupBy("family", "vec_id").agg(F.count("*").alias("size"), F.min(F.struct("product_id", "image_id")).alias("head")).select("family", "vec_id", "size", "head.*")
    near = vector_topk(heads.join(vectors, "vec_id"), queries, k, ties=["product_id"], scope="family").drop("rank")
    near = near.join(heads.drop("product_id"), "image_id").drop("image_id")
    w = W.partitionBy("query_id")
    nearer = F.sum("size").over(w.orderBy(F.desc("similarity")).rangeBetween(W.unboundedPreceding, 0)) - F.sum("size").over(W.partitionBy("query_id", "similarity"))
    found = near.withColumn("nearer", nearer).where(F.col("nearer") < k).drop("nearer", "size").join(some.drop("\0n"), ["family", "vec_id"])
    return found.withColumn("\0n", F.row_number().over(w.orderBy(F.desc("similarity"), "product_id", "image_id"))).where(F.col("\0n") <= k).drop("\0n")


def search(images: DataFrame, queries: DataFrame, traits: DataFrame, bullets: DataFrame, groups: DataFrame, families: Sequence[Sequence[str]], candidates: int = 1000, limit: int = 10, vectors: DataFrame | None = None) -> DataFrame:
    """The whole search of a batch of queries: scope, vectors, scores, products, order and limit.

    images: (image_id, product_id, visual_type, category, stage_0_result, excluded, confidence, image_url,
    ai_refreshed_at, room, vec_id), with ``vectors`` (vec_id, embedding), or with an embedding of their own
    instead; queries: (query_id, visual_type, category, source_image, refreshed_since, embedding). Only
    product images of a type that is interchangeable with the query's (``families``) are searched; each
    query keeps ``candidates`` of them by cosine, ties by product and id, and these, which are written
    once, are scored with trait boost, category, exact source and room scene. Products come
    with the exact source first, then by score and confidence; those last refreshed before the
    query's ``refreshed_since`` (null: none) go before the limit.
    """
    open_ = images.where("stage_0_result = 'product' AND NOT excluded")
    if vectors is None:
        open_ = open_.withColumn("vec_id", F.col("image_id")).where("embedding IS NOT NULL")
        vectors = open_.select("vec_id", "embedding")
    kinds = F.create_map(*(F.lit(x) for f, types in enumerate(families) for t in types for x in (t, f)))
    scoped = lambda rows: rows.withColumn("family", F.try_element_at(kinds, "visual_type")).where("family IS NOT NULL")
    near = nearest_images(scoped(open_.drop("embedding", "excluded", "stage_0_result")), scoped(queries).select("query_id", "family", "embedding"), vectors, candidates)
    asked = queries.select("query_id", F.col("category").alias("wanted"), "source_image", "refreshed_since")
    rows = written(near.drop("family", "vec_id"), "near").join(asked, "query_id")
    rows = rows.withColumn("exact", F.coalesce(F.col("image_id") == F.col("source_image"), F.lit(False)))
    boosted = trait_boost(rows, traits.join(rows.select("image_id").distinct(), "image_id", "left_semi"), bullets, groups)
    scored = image_score(boosted, F.col("similarity"), F.col("boost"), F.coalesce(F.col("category") == F.col("wanted"), F.lit(False)), F.col("exact"), F.col("room"))
    products = rollup_to_product(scored).join(asked.select("query_id", "refreshed_since"), "query_id")
    fresh = products.where(F.col("refreshed_since").isNull() | (F.col("ai_refreshed_at") >= F.col("refreshed_since")))
    best = W.partitionBy("query_id").orderBy("product_rank")
    return fresh.withColumn("place", F.row_number().over(best).cast("long")).where(F.col("place") <= limit).drop("refreshed_since", "product_rank")


#: A high-priority bullet that names one of these costs more when it is missed.
NEAR_MANDATORY = ("lumbar", "caster", "casters", "wheel", "wheels", "mesh back", "mesh backrest", "angled metal legs", "thin angled metal legs", "curved armrests", "slim curved armrests", "rounded seat cushion")


def trait_boost(pairs: DataFrame, traits: DataFrame, bullets: DataFrame, groups: DataFrame) -> DataFrame:
    """``pairs`` (query_id, image_id, exact) with ``boost`` and ``matched``: a query's bullets against an image's traits.

    bullets: (query_id, ord, priority, text, field, value), a few for each query; field and value are null
    where the text could not be parsed. They are taken from high to low priority; a repeated text
    counts once, a later bullet of a field overwrites an earlier one. A hit adds 0.35, 0.10 or 0.05 by
    priority. A miss, which a field that is unknown or absent in the image is too, takes 0.2 (0.55 for
    near-mandatory words) or 0.06, half of it when expected and stored values share a group (field,
    value, grp), and nothing at low priority or for the query's exact source image. ``matched`` lists
    all hits' texts but those that say something is absent.
    """
    level = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "normal", 1).otherwise(2)
    rows = bullets.withColumns({"level": level, "norm": norm_alnum(F.col("text")), "value": norm_alnum(F.col("value"))}).where("norm <> ''")
    once = W.partitionBy("query_id", "norm").orderBy("level", "ord")
    rows = rows.withColumn("n", F.row_number().over(once)).where("n = 1 AND field IS NOT NULL AND value NOT IN ('', 'unknown')")
    last = W.partitionBy("query_id", "field").orderBy(F.desc("level"), F.desc("ord"))
    member = groups.select("field", norm_alnum(F.col("value")).alias("value"), "grp")
    near = member.join(member.withColumnRenamed("value", "other"), ["field", "grp"]).where("value <> other").groupBy("field", "value").agg(F.collect_set("other").alias("near"))
    must = functools.reduce(lambda a, b: a | b, (F.contains("norm", F.lit(t)) for t in NEAR_MANDATORY))
    rows = rows.withColumns({
        "counts": F.row_number().over(last) == 1,
        "gain": F.element_at(F.array(F.lit(0.35), F.lit(0.10), F.lit(0.05)), F.col("level") + 1),
        "loss": F.when(F.col("level") == 0, F.when(must, 0.55).otherwise(0.2)).when(F.col("level") == 1, 0.06).otherwise(0.0),
        "said": ~is_absence(F.col("text")),
    }).join(near, ["field", "value"], "left")
    # a query starts from all its misses; what a held value adds to that, and the texts it hits, is found by value and field
    effect = lambda value, loss, gain, text: F.struct(value.alias("value"), F.when(F.col("counts"), loss).alias("more"), F.when(F.col("counts"), gain).alias("plain"), text.alias("text"))
    hit = effect(F.col("value"), F.col("gain") + F.col("loss"), F.col("gain"), F.when(F.col("said"), F.struct("level", "ord", "text")))
    close = F.transform(F.coalesce("near", F.array().cast("array<string>")), lambda v: effect(v, F.col("loss") * 0.5, F.lit(0.0), F.lit(None).cast(rows.select(F.struct("level", "ord", "text").alias("x")).schema["x"].dataType)))
    effects = rows.select("query_id", "field", F.explode(F.concat(F.array(hit), close)).alias("e")).select("query_id", "field", "e.*")
    per_value = effects.groupBy("query_id", "field", "value").agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("more", "plain")), F.collect_list("text").alias("texts"))
    name = F.concat_ws("\0", "value", "field")
    maps = per_value.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct(name, F.struct("more", "plain", "texts")))).alias("effects"))
    asked = maps.join(rows.groupBy("query_id").agg(F.sum(F.when(F.col("counts"), -F.col("loss")).otherwise(0.0)).alias("missed")), "query_id")
    # a held value without any effect counts as no value; one field holds one value
    held = traits.select("image_id", "field", norm_alnum(F.col("value")).alias("value")).join(per_value.select("field", "value").distinct(), ["field", "value"], "left_semi")
    stored = held.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("stored"))
    stored = stored.select("image_id", F.transform(F.map_entries("stored"), lambda e: F.concat_ws("\0", e["value"], e["key"])).alias("stored"))
    # bullets come last: an image's pairs travel without them
    found = pairs.join(stored, "image_id", "left").join(asked, "query_id", "left")
    met = F.filter(F.transform(F.coalesce("stored", F.array().cast("array<string>")), lambda v: F.try_element_at("effects", v)), lambda e: e.isNotNull())
    found = found.select(*pairs.columns, "missed", met.alias("\0met"))
    total = F.when(F.col("exact"), F.aggregate("\0met", F.lit(0.0), lambda s, e: s + e["plain"])).otherwise(F.aggregate("\0met", F.col("missed"), lambda s, e: s + e["more"]))
    matched = F.transform(F.array_sort(F.flatten(F.transform("\0met", lambda e: e["texts"]))), lambda t: t["text"])
    return found.select(*pairs.columns, F.coalesce(F.round(total, 6), F.lit(0.0)).alias("boost"), F.coalesce(matched, F.array().cast("array<string>")).alias("matched"))


def score_cutoff(ranked: DataFrame, by: str = "query_id", least: int = 3, most: int = 20, gap: float = 0.3, ratio: float = 1.5, floor: float = 0.7, uniform: float = 0.8) -> DataFrame:
    """(by, n, cutoff, reason): where a descending score list should end.

    Places, gaps and the median gap come from running totals over range partitions, so that a list may
    be of any length.
    """
    one = ranked.select(by, "item", "score", (-F.col("score")).alias("fall"), F.lit(1).alias("one"))
    s = running_totals(one, [by], ["fall", "item"], ["one"], ["score"]).select(by, "score", F.col("one_upto").alias("i"), (F.col("score") - F.col("next_score")).alias("gap"))
    median = at_positions(s, [by], "gap", {"median": lambda n: F.floor(n / 2)})
    lists = s.groupBy(by).agg(F.count("*").alias("n"), F.max("score").alias("first"), F.min("score").alias("last"))
    lists = lists.join(median.withColumnRenamed(by, "of"), F.col(by).eqNullSafe(F.col("of")), "left").drop("of")
    rows = s.join(lists.withColumnRenamed(by, "of"), F.col(by).eqNullSafe(F.col("of"))).drop("of")
    good = F.col("i").between(least, most) & (F.col("gap") >= gap) & (F.col("gap") >= F.col("median") * ratio)
    g = rows.groupBy(by, "n", "first", "last").agg(
        F.max(F.when(good, F.struct("gap", (-F.col("i")).alias("at")))).alias("widest"),
        F.min(F.when(F.col("score") < F.col("first") * floor, F.col("i") - 1)).alias("low"),
    )
    relative = F.least(F.greatest("low", F.lit(least)), F.lit(most), F.col("n"))
    few, flat = F.col("n") <= least, F.col("last") >= F.col("first") * uniform
    wide, low = F.col("widest").isNotNull(), F.col("low").isNotNull()
    cut = F.when(few | flat, F.col("n")).when(wide, -F.col("widest.at")).when(low, relative).otherwise(F.col("n"))
    why = F.when(few, "too_few").when(flat, "uniform").when(wide, "gap").when(low, "relative").otherwise("none")
    return g.select(by, "n", cut.cast("long").alias("cutoff"), why.alias("reason"))


def result_order(mode: str = "auto") -> list[Column]:
    """Sort columns of results: auto, refreshed_desc, refreshed_asc or name; any other mode is auto.

    Auto takes the exact source, then score, then confidence; a missing refresh time is the earliest;
    names go without case first. Ties end at the product id, so that an order is total.
    """
    refreshed, last = F.coalesce(F.col("ai_refreshed_at").cast("string"), F.lit("")), F.col("product_id")
    modes = {
        "refreshed_desc": [refreshed.desc(), F.desc("score"), last],
        "refreshed_asc": [refreshed.asc(), F.desc("score"), last],
        "name": [F.lower("product_name"), F.col("product_name"), F.lower("brand"), F.col("brand"), last],
    }
    return modes.get(mode, [F.coalesce("is_exact_source", F.lit(False)).desc(), F.desc("score"), F.coalesce("confidence", F.lit(0)).desc(), last])


def sort_results(results: DataFrame, mode: str = "auto", by: str = "query_id", limit: int | None = None) -> DataFrame:
    """Each query's results with their ``place`` from 1 in an order of ``result_order``, up to ``limit``."""
    placed = results.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(*result_order(mode))).cast("long"))
    return placed if limit is None else placed.where(F.col("place") <= limit)


#: What a client gets of a result and of an image, and what more for debugging.
RESULT_FIELDS = ("query_id", "product_id", "product_name", "brand", "category", "category_tags", "filter_categories", "ai_refreshed_at", "best_image_url", "image_urls", "score", "matched_traits", "match_count", "matching_images", "hero_image", "contributing_images", "is_exact_source", "is_room_scene", "scene_filter", "scene_filter_results", "confidence_tier", "confidence", "place")
IMAGE_FIELDS = ("image_id", "image_url", "stage_0_result", "effective_class", "visual_type", "score", "confidence_tier", "has_stored_embedding", "matched_traits", "enum_fields")
DEBUG_FIELDS = ("debug", "embedding", "trait_contributions", "free_text", "score_breakdown", "structured_caption", "visual_summary")


def client_projection(results: DataFrame, debug: bool = False, top: int = 3) -> DataFrame:
    """Results as a client gets them: known columns only, the first ``top`` matching images, known fields of images.

    With ``debug`` all images and the debugging fields stay. An image has has_stored_embedding, whether its
    vector is there, instead of the vector. What the input lacks is left out.
    """
    more = DEBUG_FIELDS if debug else ()

    def image(x: Column, kind: T.StructType) -> Column:
        have = {f.name for f in kind.fields}
        fields = [x[c].alias(c) for c in (*IMAGE_FIELDS, *more) if c in have and c != "has_stored_embedding"]
        stored = (F.coalesce(F.size(x["embedding"]) > 0, F.lit(False)) if "embedding" in have else F.lit(False)) | (F.coalesce(x["has_stored_embedding"], F.lit(False)) if "has_stored_embedding" in have else F.lit(False))
        return F.when(x.isNotNull(), F.struct(*fields, stored.alias("has_stored_embedding")))

    columns = []
    for name in (*RESULT_FIELDS, *more):
        if name not in results.columns:
            continue
        kind, value = results.schema[name].dataType, F.col(name)
        if name == "matching_images":
            value = F.coalesce(value, F.array().cast(kind))
            value = _each(value if debug else F.slice(value, 1, top), kind.elementType, image)
        elif name == "hero_image":
            value = image(value, kind)
        columns.append(value.alias(name))
    return results.select(*columns)


def _each(images: Column, kind: T.StructType, image) -> Column:
    return F.transform(images, lambda x: image(x, kind))


def apply_order(ranked: DataFrame, order: DataFrame, depth: int = 10) -> DataFrame:
    """Put the first ``depth`` of each list in an external order (query_id, product_id, place); others follow."""
    joined = ranked.join(order, ["query_id", "product_id"], "left")
    key = F.when((F.col("rank") <= depth) & F.col("place").isNotNull(), F.col("place")).otherwise(F.lit(1_000_000) + F.col("rank"))
    w = W.partitionBy("query_id").orderBy(F.when(F.col("rank") <= depth, 0).otherwise(1), key)
    return joined.withColumn("new_rank", F.row_number().over(w).cast("long")).drop("place")


def hero_image(images: DataFrame) -> DataFrame:
    """The best image of each product: product class, first position, latest refresh, id."""
    w = W.partitionBy("product_id").orderBy(F.when(F.col("stage_0_result") == "product", 0).otherwise(1), "position", F.desc_nulls_last("ai_refreshed_at"), "image_id")
    return images.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def target_vector(images: DataFrame) -> DataFrame:
    """The image whose vector stands for a product: confidence, latest refresh, id."""
    w = W.partitionBy("product_id").orderBy(F.desc(confidence_rank(F.col("confidence_tier"))), F.desc_nulls_last("ai_refreshed_at"), "image_id")
    return images.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def facet_counts(traits: DataFrame, filters: dict[str, str], vocab: DataFrame) -> DataFrame:
    """(field, value, products): products with an image of the value that meets all other filters.

    Values of the vocabulary (field, value) come with 0 too; values outside it follow as legacy.
    """
    known = traits.where(~F.col("value").isin("", "unknown"))
    # bit k: the image meets the k-th filter
    mask = functools.reduce(lambda a, b: a.bitwiseOR(b), (F.when((F.col("field") == f) & (F.col("value") == v), 1 << k).otherwise(0).cast("long") for k, (f, v) in enumerate(filters.items())), F.lit(0).cast("long"))
    met = F.bit_or(mask).over(W.partitionBy("image_id"))
    whole = (1 << len(filters)) - 1
    own = functools.reduce(lambda c, x: F.when(F.col("field") == x[1], 1 << x[0]).otherwise(c), enumerate(filters), F.lit(0)).cast("long")
    rows = known.withColumn("met", met if filters else F.lit(0).cast("long")).where(F.col("met").bitwiseOR(own) == whole)
    if isinstance(traits.schema["product_id"].dataType, T.IntegralType):
        # products of a value as bitmaps, one for each 32768 ids, that tasks make and merge
        of = F.col("product_id").cast("long")
        parts = rows.groupBy("field", "value", F.bitmap_bucket_number(of).alias("part")).agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(of))).alias("n"))
        counts = parts.groupBy("field", "value").agg(F.sum("n").alias("products"))
    else:
        counts = rows.groupBy("field", "value").agg(F.countDistinct("product_id").alias("products"))
    listed = vocab.join(counts, ["field", "value"], "left").select("field", "value", F.coalesce("products", F.lit(0)).alias("products"), F.lit(False).alias("legacy"))
    return listed.unionByName(counts.join(vocab, ["field", "value"], "left_anti").withColumn("legacy", F.lit(True)))


def merge_bullets(bullets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bullets united by meaning (key): the highest priority wins, at the first one's place."""
    rank = F.when(F.col("priority") == "high", 3).when(F.col("priority") == "normal", 2).otherwise(1)
    best = bullets.withColumn("r", rank).groupBy(*by, "key").agg(F.max("r").alias("r"), F.min("ord").alias("ord"), F.min_by("text", "ord").alias("text"))
    return best.withColumn("priority", F.element_at(F.array(F.lit("low"), F.lit("normal"), F.lit("high")), F.col("r"))).drop("r")


def translate_bullets(bullets: DataFrame, mapping: DataFrame, anti: DataFrame, allowed: DataFrame) -> DataFrame:
    """Bullets of one family in another's fields and values, or the first reason that drops them."""
    b = bullets.join(anti.select("field", "value", F.lit(True).alias("is_anti")), ["field", "value"], "left")
    known = mapping.select("field").distinct().withColumn("known_field", F.lit(True))
    b = b.join(known, "field", "left").join(mapping.select("field", "value", "to_field", "to_value"), ["field", "value"], "left")
    b = b.join(allowed.select(F.col("field").alias("to_field"), F.col("value").alias("to_value"), F.lit(True).alias("is_allowed")), ["to_field", "to_value"], "left")
    reason = (
        F.when(F.col("field").isNull() | (F.col("value") == ""), "unparseable").when(F.col("known_field").isNull(), "unknown_field")
        .when(F.col("is_anti"), "anti_mapping").when(F.col("to_field").isNull(), "no_mapping").when(F.col("is_allowed").isNull(), "no_valid_value")
    )
    return b.withColumn("drop_reason", reason).select(*bullets.columns, "to_field", "to_value", "drop_reason")

"""Entity resolution: two source systems to canonical products and images, with lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fernhill.functions.text import canonical_url, cleaner_string, hash_key, norm_ws, tail_id


def _name_key() -> Column:
    return F.concat_ws("::", F.lower(norm_ws(F.coalesce("brand", F.lit("")))), F.lower(norm_ws(F.coalesce("product_name", F.lit("")))))


def match_products(catalog: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches (catalog_id, index_id, strategy, confidence, canonical_key), and rejects with their reason.

    Products with equal trailing digits match first; among several index candidates exactly one
    product_dp_ id wins and all are used up. Then exact brand and name, where only one is left on
    either side. What remains is from a single source.
    """
    c = catalog.select(F.col("source_product_id").alias("catalog_id"), "product_name", "brand", F.nullif(tail_id(F.col("source_product_id")), F.lit("")).alias("tail"), _name_key().alias("name_key"))
    i = index.select(F.col("source_product_id").alias("index_id"), F.nullif(tail_id(F.col("source_product_id")), F.lit("")).alias("tail"), _name_key().alias("name_key"))
    dp = F.col("index_id").rlike(r"^product_dp_\d+$")
    cands = i.where("tail IS NOT NULL").groupBy("tail").agg(F.count("*").alias("n"), F.count_if(dp).alias("n_dp"), F.min(F.when(dp, F.col("index_id"))).alias("dp_id"), F.min("index_id").alias("any_id"))
    first = W.partitionBy("tail").orderBy("catalog_id")
    tailed = c.join(cands, "tail").withColumn("turn", F.row_number().over(first))
    fine = (F.col("turn") == 1) & ((F.col("n") == 1) | (F.col("n_dp") == 1))
    by_tail = tailed.where(fine).select("catalog_id", F.when(F.col("n") == 1, F.col("any_id")).otherwise(F.col("dp_id")).alias("index_id"), "tail", "name_key")
    ambiguous = tailed.where((F.col("turn") == 1) & ~fine).select("catalog_id", F.lit("ambiguous_tail_id").alias("reason"))
    c_left = c.join(by_tail.select("catalog_id"), "catalog_id", "left_anti").join(ambiguous.select("catalog_id"), "catalog_id", "left_anti")
    i_left = i.join(by_tail.select("tail"), "tail", "left_anti")
    c_n = c_left.withColumn("nc", F.count("*").over(W.partitionBy("name_key")))
    i_n = i_left.withColumn("ni", F.count("*").over(W.partitionBy("name_key"))).select("index_id", "name_key", "ni")
    named = c_n.join(i_n, "name_key")
    by_name = named.where("nc = 1 AND ni = 1").select("catalog_id", "index_id", "tail", "name_key")
    rejects = ambiguous.unionByName(named.where("nc > 1 OR ni > 1").select("catalog_id").distinct().withColumn("reason", F.lit("ambiguous_name")))
    only_c = c_left.join(by_name.select("catalog_id"), "catalog_id", "left_anti").select("catalog_id", F.lit(None).cast("string").alias("index_id"), "tail", "name_key")
    only_i = i_left.join(by_name.select("index_id"), "index_id", "left_anti").select(F.lit(None).cast("string").alias("catalog_id"), "index_id", "tail", "name_key")
    tag = lambda df, s, conf: df.withColumns({"strategy": F.lit(s), "confidence": F.lit(conf)})
    found = tag(by_tail, "tail_id", "high").unionByName(tag(by_name, "brand_name", "medium")).unionByName(tag(only_c, "catalog_only", "single")).unionByName(tag(only_i, "index_only", "single"))
    key = (
        F.when(F.col("tail").isNotNull(), F.concat(F.lit("dp:"), F.col("tail"))).when(F.col("strategy") == "brand_name", F.concat(F.lit("fallback:"), hash_key(F.col("name_key"))))
        .when(F.col("strategy") == "catalog_only", F.concat(F.lit("normalized_catalog:"), F.col("catalog_id"))).otherwise(F.concat(F.lit("image_index:"), F.col("index_id")))
    )
    return found.select("catalog_id", "index_id", "strategy", "confidence", key.alias("canonical_key")), rejects


def merge_product_fields(matches: DataFrame, catalog: DataFrame, index: DataFrame) -> DataFrame:
    """Canonical products: the cleaner name (index first), the catalog's brand if it has one, source count."""
    c = catalog.select(F.col("source_product_id").alias("catalog_id"), F.col("product_name").alias("c_name"), F.col("brand").alias("c_brand"))
    i = index.select(F.col("source_product_id").alias("index_id"), F.col("product_name").alias("i_name"), F.col("brand").alias("i_brand"))
    joined = matches.join(c, "catalog_id", "left").join(i, "index_id", "left")
    blank = lambda x: F.coalesce(F.col(x), F.lit(""))
    return joined.select(
        "canonical_key", "strategy", cleaner_string(blank("i_name"), blank("c_name")).alias("product_name"), F.coalesce(F.nullif(blank("c_brand"), F.lit("")), blank("i_brand")).alias("brand"),
        (F.col("catalog_id").isNotNull().cast("int") + F.col("index_id").isNotNull().cast("int")).alias("source_count"),
    )


def lineage_links(matches: DataFrame) -> DataFrame:
    """One row per canonical product and source row; the catalog is preferred where it is present."""
    side = lambda column, system, preferred: matches.where(F.col(column).isNotNull()).select("canonical_key", F.lit(system).alias("source_system"), F.col(column).alias("source_product_id"), "strategy", "confidence", preferred.alias("is_preferred"))
    return side("catalog_id", "normalized_catalog", F.lit(True)).unionByName(side("index_id", "image_index", F.col("catalog_id").isNull()))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def match_images(catalog: DataFrame, index: DataFrame) -> DataFrame:
    """Images of matched products joined by url: (canonical_key, url, catalog_image, index_image, strategy).

    Both sides have (canonical_key, image_id, image_url); a url that repeats on a side keeps its smallest id.
    """
    one = lambda df, name: df.groupBy("canonical_key", canonical_url(F.col("image_url")).alias("url")).agg(F.min("image_id").alias(name))
    joined = one(catalog, "catalog_image").join(one(index, "index_image"), ["canonical_key", "url"], "full_outer")
    strategy = F.when(F.col("catalog_image").isNull(), "index_only").when(F.col("index_image").isNull(), "catalog_only").otherwise("url")
    return joined.withColumn("strategy", strategy).withColumn("canonical_image_key", F.concat(F.col("canonical_key"), F.lit(":img:"), hash_key(F.col("url"))))


def upsert_by_key(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it lacks."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def latest_wins(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def replace_product_images(old: DataFrame, new: DataFrame) -> DataFrame:
    """Product-level replace: all images of a refreshed product go, the new ones come."""
    return upsert_by_key(old, new, "product_id")


def url_union(urls: DataFrame) -> DataFrame:
    """(product_id, urls): urls by first place, one per canonical url. urls has (product_id, ord, url)."""
    one = urls.withColumn("key", canonical_url(F.col("url"))).groupBy("product_id", "key").agg(F.min(F.struct("ord", "url")).alias("first"))
    return one.groupBy("product_id").agg(F.transform(F.array_sort(F.collect_list("first")), lambda x: x["url"]).alias("urls"))

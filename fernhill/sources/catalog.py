"""Reading catalog feeds, and shaping them to products and images."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from fernhill.functions.text import canonical_url, catalog_product_id, grouping_key, is_image_url, norm_ws, split_levels


def read_project_csv(spark: SparkSession, path: str) -> DataFrame:
    """Products of a latin-1 project feed; headers in any case, levels split at '::', urls at ','.

    Rows without id, name, brand or image are left out.
    """
    raw = spark.read.csv(path, header=True, encoding="ISO-8859-1", multiLine=True, quote='"', escape='"')
    raw = raw.toDF(*(" ".join(c.strip().lower().split()) for c in raw.columns))

    def first(*names: str) -> Column:
        have = [F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names if n in raw.columns]
        return F.coalesce(*have, F.lit("")) if have else F.lit("")

    urls = F.array_distinct(F.filter(F.transform(F.split(first("image url"), ","), lambda x: F.trim(x)), lambda x: x != ""))
    out = raw.select(
        first("product id").alias("raw_id"), norm_ws(first("product name")).alias("product_name"), norm_ws(first("brand name", "brand")).alias("brand"),
        first("user selected category name", "dp categories").alias("raw_category"), split_levels(first("a level names")).alias("a_level"),
        split_levels(first("b level names")).alias("b_level"), split_levels(first("c level names")).alias("c_level"), first("product url", "website").alias("website"), urls.alias("image_urls"),
    )
    kept = out.where((F.col("raw_id") != "") & (F.col("product_name") != "") & (F.col("brand") != "") & (F.size("image_urls") > 0))
    return kept.withColumn("product_id", catalog_product_id(F.col("brand"), F.col("product_name"), F.col("raw_id")))


def read_export_dir(spark: SparkSession, path: str) -> DataFrame:
    """Products of all CSV files of a folder; any cell that is an image url counts as an image."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', pathGlobFilter="*.csv")
    cells = [c for c in raw.columns]
    raw = raw.select("*", F.col("_metadata.file_name").alias("source_file"))
    images = F.array_distinct(F.filter(F.array(*(F.trim(F.col(f"`{c}`")) for c in cells)), lambda x: x.isNotNull() & is_image_url(x)))
    pick = lambda *names: F.coalesce(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for n in names for c in cells if c.lower() == n), F.lit(""))
    name, brand, category = pick("name", "product name"), pick("manufacturer", "brand"), pick("category")
    fallback = F.substring(F.sha1(F.concat_ws("::", "source_file", brand, name, category)), 1, 12)
    return raw.select(F.coalesce(F.nullif(pick("product id"), F.lit("")), fallback).alias("product_id"), name.alias("product_name"), brand.alias("brand"), category.alias("raw_category"), images.alias("image_urls"), "source_file")


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a one-column list: digits, or the id in a product url; a header is skipped."""
    lines = spark.read.text(path).select(F.trim(F.split("value", ",")[0]).alias("x"))
    found = F.coalesce(F.when(F.col("x").rlike(r"^\d+$"), F.col("x")), F.nullif(F.regexp_extract("x", r"/(\d+)(?:[/?#]|$)", 1), F.lit("")))
    return lines.select(found.alias("product_id")).where("product_id IS NOT NULL").dropDuplicates()


def import_gate(rows: DataFrame, indexed: DataFrame, placeholder_brands: Sequence[str], placeholder_names: Sequence[str]) -> DataFrame:
    """The rows with the first rule that rejects them, or null: brand, name, image, already indexed."""
    known = indexed.select("product_id", F.lit(True).alias("is_indexed")).distinct()
    reason = (
        F.when(F.lower(F.trim("brand")).isin(*placeholder_brands) | (F.trim("brand") == ""), "placeholder_brand")
        .when(F.lower(F.trim("product_name")).isin(*placeholder_names) | (F.trim("product_name") == ""), "placeholder_name")
        .when(F.col("n_images") == 0, "no_image").when(F.col("is_indexed"), "already_indexed")
    )
    return rows.join(known, "product_id", "left").withColumn("reject_reason", reason).drop("is_indexed")


def explode_images(products: DataFrame) -> DataFrame:
    """A row per image with its place from 1 and an id <product>_img_NNN."""
    rows = products.select("*", F.posexplode("image_urls").alias("pos", "image_url")).drop("image_urls")
    return rows.withColumns({"position": (F.col("pos") + 1).cast("long"), "image_id": F.concat(F.col("product_id"), F.lit("_img_"), F.lpad((F.col("pos") + 1).cast("string"), 3, "0"))}).drop("pos")


def distinct_values(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(kind, value): the distinct values of some columns as rows, kinds mapped to columns; nulls are left out.

    All columns go through one exchange, and lists of any length stay spread over the tasks.
    """
    pairs = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")) for kind, c in columns.items()))
    return rows.select(F.inline(pairs)).where("value IS NOT NULL").distinct()


def catalog_summary(products: DataFrame, images: DataFrame) -> DataFrame:
    """(kind, value, n): the numbers of products and images, and of products by brand and category."""
    total = lambda rows, kind: rows.agg(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("value"), F.count("*").alias("n"))
    pairs = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")) for kind, c in (("brand", "brand"), ("category", "b_level"))))
    listed = products.select(F.inline(pairs)).where("value IS NOT NULL").groupBy("kind", "value").agg(F.count("*").alias("n"))
    return total(products, "products").unionByName(total(images, "images")).unionByName(listed)


def extract_page_payload(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, heading, n_links, flag_reason): fields of a page; a bad page is flagged, not lost."""
    grab = lambda p: F.nullif(F.trim(F.regexp_extract("html", p, 1)), F.lit(""))
    title, heading = grab(r"(?is)<title[^>]*>([^<]*)</title>"), grab(r"(?is)<h1[^>]*>([^<]*)</h1>")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        title, heading = F.replace(title, F.lit(entity), F.lit(char)), F.replace(heading, F.lit(entity), F.lit(char))
    flag = F.when(F.col("html").isNull() | (F.col("html") == ""), "empty_page").when(title.isNull(), "no_title")
    return pages.select("page_id", canonical_url(F.col("url")).alias("url"), title.alias("title"), heading.alias("heading"), F.size(F.regexp_extract_all("html", F.lit(r"(?i)<a\s"), 0)).cast("long").alias("n_links"), flag.alias("flag_reason"))


def levels_from_list(entries: Column) -> dict[str, Column]:
    """Level arrays from an array of (level, name); the second falls back to the first name."""
    at = lambda n: F.array_distinct(F.transform(F.filter(entries, lambda e: e["level"] == n), lambda e: e["name"]))
    b = at("b")
    return {"a_level": at("a"), "b_level": F.when(F.size(b) > 0, b).otherwise(F.slice(F.transform(entries, lambda e: e["name"]), 1, 1)), "c_level": at("c")}


def catalog_from_selection(products: DataFrame, chosen: DataFrame) -> DataFrame:
    """Products that have chosen images (product_id, image_id), with how many; an image that is chosen twice counts once."""
    n = chosen.select("product_id", "image_id").distinct().groupBy("product_id").agg(F.count("*").alias("n_images"))
    return products.join(n, "product_id")


def intake_classify(submitted: DataFrame, existing: DataFrame, images: DataFrame, least: int = 591) -> DataFrame:
    """(product_id, state): skipped_existing, flagged without a large enough image, or accepted."""
    have = existing.select("product_id", F.lit(True).alias("known")).distinct()
    best = images.groupBy("product_id").agg(F.max("short_side").alias("side"))
    rows = submitted.select("product_id").distinct().join(have, "product_id", "left").join(best, "product_id", "left")
    state = F.when(F.col("known"), "skipped_existing").when(F.col("side").isNull(), "flagged_no_page").when(F.col("side") < least, "flagged_small_images").otherwise("accepted")
    return rows.select("product_id", state.alias("state"))


def rebuild_products(images: DataFrame) -> DataFrame:
    """Product rows from image rows: first non-empty name and brand, ordered distinct urls."""
    first = lambda c: F.min_by(c, F.when(F.col(c) != "", F.col("position")))
    urls = F.array_sort(F.collect_list(F.struct("position", "image_url")))
    return images.groupBy("product_id").agg(first("product_name").alias("product_name"), first("brand").alias("brand"), F.array_distinct(F.transform(urls, lambda x: x["image_url"])).alias("image_urls"))


def append_new_only(new: DataFrame, old: DataFrame) -> DataFrame:
    """New images whose id and canonical url are both unknown."""
    keyed = new.withColumn("__url", canonical_url(F.col("image_url")))
    urls = old.select(canonical_url(F.col("image_url")).alias("__url")).distinct()
    return keyed.join(old.select("image_id"), "image_id", "left_anti").join(urls, "__url", "left_anti").drop("__url")


def catalog_row_filter(products: DataFrame, terms: Sequence[str] = (), brand: str = "", name: str = "", offset: int = 0, limit: int | None = None) -> DataFrame:
    """Indexing scope: any term in the categories, brand and name contained, then a page in id order."""
    category = F.lower(F.concat_ws(" ", "a_level", "b_level", "c_level"))
    out = products
    if terms:
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.contains(category, F.lit(t.lower()))
        out = out.where(hit)
    if brand:
        out = out.where(F.contains(F.lower("brand"), F.lit(brand.lower())))
    if name:
        out = out.where(F.contains(F.lower("product_name"), F.lit(name.lower())))
    out = out.orderBy("product_id").offset(offset)
    return out if limit is None else out.limit(limit)


def unmapped_split(products: DataFrame, mapping: DataFrame) -> DataFrame:
    """Products with their mapped type, or SKIP; mapping is (grouping, mapped_type)."""
    keyed = products.withColumn("grouping", grouping_key(F.array("a_level", "b_level", "c_level")))
    return keyed.join(mapping, "grouping", "left").withColumn("mapped_type", F.coalesce("mapped_type", F.lit("SKIP")))


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A report as JSON lines, quoted CSV or Parquet."""
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True, quoteAll=True) if kind == "csv" else writer.format(kind).save(path)


AUDIT = "source_system string, record_type string, source_path string, record_count long, notes string, run_at timestamp"


def audit_run(spark: SparkSession, path: str, source_system: str, record_type: str, source_path: str, record_count: int, notes: dict | None = None, at=None) -> DataFrame:
    """Append a run to the audit table below ``path`` and return the table as it is then.

    A row is one file of an append, so that runs that end at once do not disturb each other; the time is
    the session's, if none is given.
    """
    row = spark.createDataFrame([(source_system, record_type, source_path, int(record_count), json.dumps(notes or {}, sort_keys=True), at)], AUDIT)
    row.withColumn("run_at", F.coalesce("run_at", F.current_timestamp())).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(AUDIT).parquet(path)


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def _texts(c: Column) -> Column:
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), _text), lambda x: x != "")


_CATALOG = (
    "products array<struct<product_id:string,name:string,brand:string,description:string,raw_category:string,a_level:array<string>,b_level:array<string>,c_level:array<string>,product_image:string,website:string,source_file:string,image_urls:array<string>>>, "
    "images array<struct<image_id:string,product_id:string,image_url:string,name:string,brand:string,a_level:array<string>,b_level:array<string>,c_level:array<string>,category:string,source_file:string>>"
)


def stage_catalog_snapshot(spark: SparkSession, path: str, source_system: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Staging products and images of a normalized catalog: JSON with lists of both, one object a file or, with ``lines``, one a line.

    Texts are trimmed and empty ones leave the lists. Of rows that share an id the last one counts (by
    file, object and place); images come only with a product of the snapshot, and are primary where their
    url is the product's. The rows are ready for ``upsert_by_key`` on (source_system, source_product_id)
    or (source_system, source_image_id).
    """
    docs = spark.read.schema(_CATALOG).json(path, multiLine=not lines)
    docs = docs.select("*", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))

    def entries(column: str, key: str) -> DataFrame:
        rows = docs.select("at", F.posexplode(column).alias("pos", "r")).where(F.col("r").isNotNull()).select("r.*", F.struct("at", "pos").alias("at"), F.to_json("r").alias("raw_payload"))
        w = W.partitionBy(_text(F.col(key))).orderBy(F.desc("at"))
        return rows.withColumn("\0n", F.row_number().over(w)).where("`\0n` = 1").drop("\0n", "at")

    system = F.lit(source_system).alias("source_system")
    p = entries("products", "product_id")
    same = lambda names: [_text(F.col(c)).alias(c) for c in names]
    lists = lambda names: [_texts(F.col(c)).alias(c) for c in names]
    products = p.select(
        system, _text(F.col("product_id")).alias("source_product_id"), _text(F.col("name")).alias("product_name"), *same(["brand", "description", "raw_category"]), *lists(["a_level", "b_level", "c_level"]),
        _text(F.col("product_image")).alias("product_image_url"), *same(["website", "source_file"]), *lists(["image_urls"]), "raw_payload",
    )
    i = entries("images", "image_id").select(
        system, _text(F.col("image_id")).alias("source_image_id"), _text(F.col("product_id")).alias("source_product_id"), *same(["image_url"]), _text(F.col("name")).alias("product_name"), *same(["brand"]),
        *lists(["a_level", "b_level", "c_level"]), *same(["category", "source_file"]), "raw_payload",
    )
    images = i.join(products.select("source_product_id", "product_image_url"), "source_product_id").withColumn("is_catalog_primary_image", F.col("image_url") == F.col("product_image_url"))
    return products, images.select(*i.columns, "is_catalog_primary_image")


def read_index_snapshot(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Staging products and images of a JSON snapshot: one object a file, or with ``lines`` one a line.

    A product summary with a hashed id is left out when a product_dp_ row has the same trailing digits.
    """
    doc = spark.read.json(path, multiLine=not lines)
    products = doc.select(F.explode_outer("products").alias("p")).select("p.*").where("product_id IS NOT NULL")
    images = doc.select(F.explode_outer("images").alias("i")).select("i.*").where("image_id IS NOT NULL")
    tail = lambda c: F.nullif(F.regexp_extract(c, r"(\d+)$", 1), F.lit(""))
    dp = products.select("product_id").union(images.select("product_id")).where(F.col("product_id").rlike(r"^product_dp_\d+$")).select(tail("product_id").alias("__tail")).distinct()
    hashed = products.withColumn("__tail", tail("product_id"))
    doubled = hashed.where(~F.col("product_id").rlike("^product_dp_")).join(dp, "__tail", "left_semi").select("product_id")
    return products.join(doubled, "product_id", "left_anti"), images

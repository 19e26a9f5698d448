"""Product fields from the attribute JSON that product pages embed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The entities that a page's attribute is unescaped from. The ampersand is last, so that each is replaced once.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&"))
#: Where the attribute is: a div of this class, the value between quotes of one kind.
ATTRIBUTE = r"""(?is)<div[^>]*class="[^"]*\bimage-column\b[^"]*"[^>]*data-source-data=(["'])(.*?)\1"""
_SCHEMA = (
    "id string, name string, manufacturer struct<name:string>, dp_categories array<struct<level:string,name:string>>, "
    "default_image struct<url:string>, additional_images array<struct<url:string>>, _broken string"
)


def _clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def _distinct(texts: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(texts, F.array().cast("array<string>")), _clean), lambda x: x != ""))


def read_payloads(pages: DataFrame, site: str = "https://products.test/products/", html_col: str = "html") -> DataFrame:
    """``pages`` without the page's text, and with its product's fields or the reason why there are none.

    Adds source_product_id, product_name, brand, website, a_level, b_level, c_level, raw_category,
    default_image_url, image_urls and flag_reason: empty_page, no_payload (no such attribute),
    broken_payload (no JSON object), no_id or null. A level's names are distinct, in their order; without
    names of the second level its place is taken by the first name of all. The default image comes first
    among the urls. A field of another type than expected counts as missing, other fields stay. Rows are
    read where they lie; repeated pages stay.
    """
    html = F.col(html_col)
    raw = F.regexp_extract(html, ATTRIBUTE, 2)
    for entity, char in ENTITIES:
        raw = F.replace(raw, F.lit(entity), F.lit(char))
    located = F.regexp_like(html, F.lit(ATTRIBUTE))
    rows = pages.withColumns({"\0located": located, "\0raw": F.trim(raw)}).withColumn("\0p", F.from_json("\0raw", _SCHEMA, {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}))
    p = F.col("\0p")
    entries = F.coalesce(p["dp_categories"], F.array().cast("array<struct<level:string,name:string>>"))
    level = lambda n: _distinct(F.transform(F.filter(entries, lambda e: e["level"].try_cast("double") == n), lambda e: e["name"]))
    every = _distinct(F.transform(entries, lambda e: e["name"]))
    b_level = F.when(F.size(level(1)) > 0, level(1)).otherwise(F.slice(every, 1, 1))
    product_id = _clean(p["id"])
    digits = F.regexp_replace(product_id, r"\D+", "")
    default = _clean(p["default_image"]["url"])
    urls = _distinct(F.concat(F.array(default), F.coalesce(F.transform(p["additional_images"], lambda x: x["url"]), F.array().cast("array<string>"))))
    broken = p.isNull() | ~F.col("\0raw").startswith("{") | (p["_broken"].isNotNull() & p["id"].isNull() & p["name"].isNull())
    reason = (
        F.when(F.coalesce(html.rlike(r"^\s*$"), F.lit(True)), "empty_page").when(~F.col("\0located"), "no_payload")
        .when(broken, "broken_payload").when(product_id == "", "no_id")
    )
    fields = {
        "source_product_id": product_id, "product_name": _clean(p["name"]), "brand": _clean(p["manufacturer"]["name"]), "website": F.when(digits != "", F.concat(F.lit(site), digits)).otherwise(""),
        "a_level": level(0), "b_level": b_level, "c_level": level(2), "raw_category": F.array_join(F.array_distinct(F.concat(level(2), b_level)), " :: "), "default_image_url": default, "image_urls": urls,
    }
    kept = [c for c in pages.columns if c not in (html_col, *fields, "flag_reason")]
    rows = rows.withColumn("flag_reason", reason)
    some = F.col("flag_reason").isNull() | (F.col("flag_reason") == "no_id")
    return rows.select(*kept, *(F.when(some, c).alias(name) for name, c in fields.items()), "flag_reason")

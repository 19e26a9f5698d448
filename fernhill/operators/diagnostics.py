"""Data-quality diagnostics of a trait index."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Values that count as missing in diagnostics; n/a is present there.
MISSING = ("", "unknown", "na", "null", "undefined")


def _present(value: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(value)).isin(*MISSING), F.lit(False))


def trait_health(images: DataFrame, traits: DataFrame, vocab: DataFrame, baseline: DataFrame, least: float = 0.8, drop: float = 0.1) -> DataFrame:
    """Coverage per type and field over product images, flags below ``least`` or ``drop`` under the baseline.

    vocab has (visual_type, field), baseline (visual_type, field, baseline).
    """
    base = images.where("stage_0_result = 'product' AND visual_type <> ''").select("image_id", "visual_type")
    asked = base.join(vocab, "visual_type")
    found = asked.join(traits.select("image_id", "field", "value"), ["image_id", "field"], "left")
    health = found.groupBy("visual_type", "field").agg(F.count("*").alias("images"), F.count_if(_present(F.col("value"))).alias("present"))
    cover = F.round(F.col("present") / F.col("images"), 6)
    rows = health.withColumn("coverage", cover).join(baseline, ["visual_type", "field"], "left")
    return rows.withColumns({"below": F.col("coverage") < least, "dropped": F.coalesce(F.round(F.col("baseline") - F.col("coverage"), 6) >= drop, F.lit(False))})


def compliance_violations(traits: DataFrame, allowed: DataFrame) -> DataFrame:
    """Present values that the vocabulary (field, value) does not have, counted."""
    bad = traits.where(_present(F.col("value"))).join(allowed.select("field", "value"), ["field", "value"], "left_anti")
    return bad.groupBy("visual_type", "field", "value").agg(F.count("*").alias("n"), F.min("image_id").alias("first_image"))


def inconsistencies(wide: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(image_id, rule) for each rule (name, SQL condition) that a record breaks."""
    hits = F.array_compact(F.array(*(F.when(F.expr(condition), F.lit(name)) for name, condition in rules)))
    return wide.select("image_id", F.explode(hits).alias("rule"))


def failures(refreshes: DataFrame) -> tuple[DataFrame, DataFrame]:
    bad = refreshes.where("status IN ('error', 'refund')")
    return bad.groupBy("product_id").agg(F.count("*").alias("failures")), bad.groupBy("status").agg(F.count("*").alias("failures"), F.countDistinct("product_id").alias("products"))


def stage_cost(images: DataFrame, cost: Column) -> DataFrame:
    """Per type: eligible, extracted, failed and not applicable, summed and mean cost."""
    status = F.when(F.col("stage_0_result") != "product", "not_applicable").when(F.col("excluded"), "failed").otherwise("extracted")
    rows = images.withColumns({"status": status, "cost": cost})
    done = F.col("status") == "extracted"
    return rows.groupBy("visual_type").agg(
        F.count_if(F.col("status") != "not_applicable").alias("eligible"), F.count_if(done).alias("extracted"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "not_applicable").alias("not_applicable"),
        F.round(F.sum(F.when(done, F.col("cost")).otherwise(0.0)), 4).alias("cost"), F.round(F.avg(F.when(done, F.col("cost"))), 6).alias("mean_cost"),
    )


def mapping_diagnostics(products: DataFrame, images: DataFrame, decisions: DataFrame, table: DataFrame, dominant: float = 0.8) -> DataFrame:
    """Per grouping: its type and where that is from (decision, table, dominant extracted type, none), and counts."""
    mode = W.partitionBy("grouping").orderBy(F.desc("n"), "visual_type")
    shares = images.where("visual_type <> ''").groupBy("grouping", "visual_type").agg(F.count("*").alias("n"))
    top = shares.withColumns({"k": F.row_number().over(mode), "total": F.sum("n").over(W.partitionBy("grouping"))}).where(F.col("k") == 1)
    top = top.where(F.col("n") >= F.col("total") * dominant).select("grouping", F.col("visual_type").alias("extracted"))
    counts = products.groupBy("grouping").agg(F.count("*").alias("products"))
    stage = images.groupBy("grouping").agg(F.count("*").alias("images"), F.count_if(F.col("visual_type") == "").alias("missing"))
    joined = counts.join(stage, "grouping", "left").join(decisions, "grouping", "left").join(table, "grouping", "left").join(top, "grouping", "left")
    source = F.when(F.col("decided").isNotNull(), "decision").when(F.col("tabled").isNotNull(), "table").when(F.col("extracted").isNotNull(), "dominant").otherwise("unmapped")
    return joined.select("grouping", "products", F.coalesce("images", F.lit(0)).alias("images"), F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("decided", "tabled", "extracted", F.lit("")).alias("mapped_type"), source.alias("mapping_source"))


def mismatch_scan(records: DataFrame, allowed: DataFrame, examples: int = 5) -> DataFrame:
    """(category, visual_type, n, examples): pairs that the rule table (category, visual_type) does not allow."""
    bad = records.join(allowed, ["category", "visual_type"], "left_anti")
    placed = bad.withColumn("k", F.row_number().over(W.partitionBy("category", "visual_type").orderBy("image_id")))
    return placed.groupBy("category", "visual_type").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= examples, F.col("image_id")))).cast("array<string>"), ",").alias("examples"))


def ghost_fields(traits: DataFrame, vocab: DataFrame) -> DataFrame:
    """Counts of trait keys that a type's vocabulary (visual_type, field) lacks."""
    return traits.join(vocab, ["visual_type", "field"], "left_anti").groupBy("visual_type", "field").agg(F.count("*").alias("removed"))


def value_migration(traits: DataFrame, renames: DataFrame) -> DataFrame:
    """Traits with fields and values renamed by (field, value, new_field, new_value), and whether they were."""
    joined = traits.join(renames, ["field", "value"], "left")
    return joined.select("image_id", F.coalesce("new_field", "field").alias("field"), F.coalesce("new_value", "value").alias("value"), F.col("new_field").isNotNull().alias("migrated"))


def env_gap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(product_id, state): a product in environment a against b, both (product_id, n_images, name)."""
    joined = a.withColumnsRenamed({"n_images": "na", "name": "name_a"}).join(b.withColumnsRenamed({"n_images": "nb", "name": "name_b"}), "product_id", "full_outer")
    state = F.when(F.col("name_b").isNull(), "missing_everything").when(F.col("name_a").isNull(), "extra").when(F.col("nb") == 0, "shell_only").when(F.col("nb") < F.col("na"), "partial").otherwise("present")
    return joined.select("product_id", state.alias("state"), (~F.col("name_a").eqNullSafe(F.col("name_b"))).alias("name_differs"))


def snapshot_parity(staged: DataFrame, snapshot: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row: matching, missing and extra keys, and differing values by column."""
    s = staged.select(key, F.lit(True).alias("in_staged"), *(F.col(c).alias(f"s_{c}") for c in columns))
    n = snapshot.select(key, F.lit(True).alias("in_snapshot"), *(F.col(c).alias(f"n_{c}") for c in columns))
    both = F.col("in_staged") & F.col("in_snapshot")
    return s.join(n, key, "full_outer").agg(
        F.count_if(both).alias("matching"), F.count_if(F.col("in_staged").isNull()).alias("missing"), F.count_if(F.col("in_snapshot").isNull()).alias("extra"),
        *(F.count_if(both & ~F.col(f"s_{c}").eqNullSafe(F.col(f"n_{c}"))).alias(f"differs_{c}") for c in columns),
    )


def refresh_outcome(refreshes: DataFrame) -> DataFrame:
    """Per product: attempts, failed attempts, cost and outcome of its refreshes."""
    failed = F.col("status").isin("error", "refund")
    g = refreshes.groupBy("product_id").agg(F.count("*").alias("attempts"), F.count_if(failed).alias("failed"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"), F.max("refreshed_at").alias("last_refreshed"))
    return g.withColumn("outcome", F.when(F.col("failed") == F.col("attempts"), "error").when(F.col("failed") > 0, "partial").otherwise("ok"))


def wide_traits(traits: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(image_id, visual_type, one column for each field): an image's values side by side."""
    return traits.groupBy("image_id", "visual_type").pivot("field", list(fields)).agg(F.max("value"))


def supplemental_metrics(traits: DataFrame, field: str, other: str) -> DataFrame:
    """(visual_type, images, with_field, with_both, share): of the images with a known ``field``, how many have a known ``other``."""
    wide = wide_traits(traits, [field, other])
    has = F.coalesce(_present(F.col(field)), F.lit(False))
    both = has & F.coalesce(_present(F.col(other)), F.lit(False))
    g = wide.groupBy("visual_type").agg(F.count("*").alias("images"), F.count_if(has).alias("with_field"), F.count_if(both).alias("with_both"))
    return g.withColumn("share", F.round(F.try_divide("with_both", "with_field"), 6))


def applicability(traits: DataFrame, rules: dict[str, tuple[Sequence[str] | None, Sequence[str], str | None]]) -> DataFrame:
    """(image_id, a flag for each rule): whether something applies to an image.

    A rule (types, not_types, field) holds for images of one of ``types`` (None: of any) that are of none of
    ``not_types`` and whose ``field``, if one is named, has a known value.
    """
    wide = wide_traits(traits, sorted({f for _, _, f in rules.values() if f}))
    kind, flags = F.col("visual_type"), []
    for name, (types, barred, field) in rules.items():
        holds = F.lit(True) if types is None else kind.isin(*types)
        holds = holds & ~kind.isin(*barred) if barred else holds
        flags.append((holds & _present(F.col(field)) if field else holds).alias(name))
    return wide.select("image_id", *flags)


def tiebreaker_counts(images: DataFrame) -> DataFrame:
    """(visual_type, images, all_tiebreaks, product_tiebreaks): how often a tiebreaker decided, over all images and product images."""
    hit = F.coalesce("tiebreaker_triggered", F.lit(False))
    return images.groupBy("visual_type").agg(F.count("*").alias("images"), F.count_if(hit).alias("all_tiebreaks"), F.count_if(hit & (F.col("stage_0_result") == "product")).alias("product_tiebreaks"))


def stale_types(images: DataFrame, mapping: DataFrame) -> DataFrame:
    """(image_id, visual_type, mapped_type): images whose type is not the one that their product maps to now; mapping is (product_id, mapped_type)."""
    known = mapping.where("mapped_type <> ''").select("product_id", "mapped_type")
    return images.select("image_id", "product_id", "visual_type").join(known, "product_id").where("NOT visual_type <=> mapped_type").select("image_id", "visual_type", "mapped_type")


def hero_audit(products: DataFrame, images: DataFrame) -> DataFrame:
    """(product_id, image_id, skip_reason): why a product's first image cannot be its hero: no_image, excluded or scene."""
    first = images.where("position = 1").select("product_id", "image_id", "excluded", "stage_0_result")
    reason = F.when(F.col("image_id").isNull(), "no_image").when(F.col("excluded"), "excluded").when(F.col("stage_0_result") != "product", "scene")
    return products.select("product_id").join(first, "product_id", "left").select("product_id", "image_id", reason.alias("skip_reason"))


def copy_verify(source: DataFrame, copy: DataFrame, by: str) -> DataFrame:
    """(by, expected, copied, complete): rows of each key before and after a copy."""
    expected, copied = source.groupBy(by).agg(F.count("*").alias("expected")), copy.groupBy(by).agg(F.count("*").alias("copied"))
    n = F.coalesce("copied", F.lit(0))
    return expected.join(copied, by, "left").select(by, "expected", n.alias("copied"), (F.col("expected") == n).alias("complete"))


def high_image_products(images: DataFrame, most: int) -> DataFrame:
    """(visual_type, products, excess, most): products with more than ``most`` images, by type and (null) in all."""
    p = images.groupBy("product_id", "visual_type").agg(F.count("*").alias("n")).where(F.col("n") > most)
    return p.rollup("visual_type").agg(F.count("*").alias("products"), F.sum(F.col("n") - most).alias("excess"), F.max("n").alias("most"))


def count_buckets(keys: DataFrame, rows: DataFrame, by: str, edges: Sequence[int]) -> DataFrame:
    """(bucket, keys): how many keys have so many rows. ``edges`` end the buckets: 0, then 1 to the first edge, and so on, then more."""
    counts = keys.select(by).join(rows.groupBy(by).agg(F.count("*").alias("n")), by, "left").fillna(0, ["n"])
    bucket, low = F.when(F.col("n") == 0, "0"), 1
    for edge in edges:
        bucket, low = bucket.when(F.col("n") <= edge, f"{low}-{edge}" if low < edge else str(edge)), edge + 1
    return counts.groupBy(bucket.otherwise(f"{low}+").alias("bucket")).agg(F.count("*").alias("keys"))


def flip_matrix(images: DataFrame, new_class: Column) -> DataFrame:
    """(old_class, new_class, n): how a new rule would class the images."""
    return images.groupBy(F.col("stage_0_result").alias("old_class"), new_class.alias("new_class")).agg(F.count("*").alias("n"))


def quota_sample(rows: DataFrame, stratum: Column, quotas: dict[str, int], size: int, order: str) -> DataFrame:
    """``size`` rows: first those within their stratum's quota, then others, both in the order of a column."""
    placed = rows.withColumn("stratum", stratum)
    quota = functools.reduce(lambda c, x: F.when(F.col("stratum") == x[0], x[1]).otherwise(c), quotas.items(), F.lit(0))
    k = F.row_number().over(W.partitionBy("stratum").orderBy(order))
    return placed.withColumn("by_quota", k <= quota).orderBy(F.desc("by_quota"), order).limit(size)

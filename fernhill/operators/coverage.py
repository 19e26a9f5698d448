"""Coverage of trait pairs by image position, and the cost of image caps."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from fernhill.operators.ordered import with_quantiles
from fernhill.tables import written

MISSING = ("", "unknown", "n/a", "na")


def trait_pairs(traits: DataFrame) -> DataFrame:
    """Distinct (product_id, image_id, position, visual_type, field, value) that are not missing."""
    return traits.where(~F.lower("value").isin(*MISSING)).select("product_id", "image_id", "position", "visual_type", "field", "value").distinct()


def coverage_trajectory(traits: DataFrame, least: int = 8, most: int | None = 12) -> DataFrame:
    """Per product and position: new pairs, fields and values, and the covered share of the final set.

    Products with at least ``least`` images count. The final set is that of all images; rows are those
    of the first ``most`` positions, or all.
    """
    images = traits.select("product_id", "visual_type", "position").distinct()
    first_pair = traits.where(~F.lower("value").isin(*MISSING) & F.col("position").isNotNull()).groupBy("product_id", "field", "value").agg(F.min("position").alias("position"))
    # new pairs and fields of the few positions that bring some; everything is dealt by product alone
    at = first_pair.groupBy("product_id", "field", "position").agg(F.count("*").alias("pairs"))
    at = at.withColumn("fields", (F.row_number().over(W.partitionBy("product_id", "field").orderBy("position")) == 1).cast("long"))
    at = at.groupBy("product_id", "position").agg(F.sum("pairs").alias("pairs"), F.sum("fields").alias("fields"))
    at = at.groupBy("product_id").agg(F.map_from_entries(F.collect_list(F.struct("position", F.struct("pairs", "fields")))).alias("at"))
    w = W.partitionBy("product_id")
    here = F.try_element_at("at", F.col("position"))
    rows = images.withColumn("n_images", F.count("*").over(w)).where(F.col("n_images") >= least).join(at, "product_id", "left")
    rows = rows.select("product_id", "visual_type", "position", F.coalesce(here["pairs"], F.lit(0)).alias("new_pairs"), F.coalesce(here["fields"], F.lit(0)).alias("new_fields"))
    run = w.orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("new_pairs").over(w)
    path = rows.select(
        "product_id", "visual_type", "position", "new_pairs", "new_fields", (F.col("new_pairs") - F.col("new_fields")).alias("new_values"), F.sum("new_pairs").over(run).alias("cumulative"),
        F.when(total > 0, F.round(F.sum("new_pairs").over(run) / total, 6)).otherwise(0.0).alias("coverage"),
    )
    return path if most is None else path.where(F.col("position") <= most)


def marginal_curve(trajectory: DataFrame) -> DataFrame:
    """Per type and position: mean and exact quartiles of new pairs, mean coverage, support.

    Rows of equal numbers are counted once and written, so that the trajectory is made once.
    """
    counts = written(trajectory.groupBy("visual_type", "position", "new_pairs").agg(F.count("*").alias("n"), F.sum("coverage").alias("covered")), "counts")
    n = F.sum("n")
    totals = counts.groupBy("visual_type", "position").agg(
        n.alias("support"), F.round(F.sum(F.col("new_pairs") * F.col("n")) / n, 6).alias("mean_new"), F.round(F.sum("covered") / n, 6).alias("mean_coverage"), (n < 20).alias("low_confidence")
    )
    return with_quantiles(totals, counts, ["visual_type", "position"], "new_pairs", {"median_new": 0.5, "p75_new": 0.75, "p90_new": 0.9}, 6, F.col("n"))


def saturation_point(curve: DataFrame, least: int = 20, under: float = 0.5) -> DataFrame:
    return curve.where((F.col("support") >= least) & (F.col("mean_new") < under)).groupBy("visual_type").agg(F.min("position").alias("saturation"))


def late_gain(trajectory: DataFrame, after: Sequence[int] = (5, 8, 10)) -> DataFrame:
    flags = [F.max(F.when((F.col("position") > a) & (F.col("new_pairs") > 0), 1).otherwise(0)).alias(f"after_{a}") for a in after]
    return trajectory.groupBy("visual_type", "product_id").agg(*flags).groupBy("visual_type").agg(F.count("*").alias("products"), *(F.round(F.avg(f"after_{a}"), 6).alias(f"after_{a}") for a in after))


def threshold_crossing(trajectory: DataFrame, share: float = 0.9) -> DataFrame:
    at = trajectory.groupBy("visual_type", "product_id").agg(F.min(F.when(F.col("coverage") >= share, F.col("position"))).alias("at"))
    counts = written(at.groupBy("visual_type", "at").agg(F.count("*").alias("n")), "counts")
    totals = counts.groupBy("visual_type").agg(F.sum("n").alias("products"), F.round(F.sum(F.when(F.col("at").isNull(), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("never"))
    return with_quantiles(totals, counts, ["visual_type"], "at", {"median_at": 0.5, "p90_at": 0.9}, 6, F.col("n")).select("visual_type", "products", "median_at", "p90_at", "never")


def cap_scorecard(trajectory: DataFrame, caps: Sequence[int] = (4, 6, 8, 10, 12), image_cost: float = 0.009532) -> DataFrame:
    """Per cap: mean coverage at the cap, shares of products at 0.9 and 0.95, cost and savings.

    Savings are against all images, so that the trajectory must have all positions.
    """
    caps_df = trajectory.sparkSession.createDataFrame([(c,) for c in caps], "cap long")
    per = trajectory.crossJoin(F.broadcast(caps_df)).groupBy("cap", "product_id").agg(F.max(F.when(F.col("position") <= F.col("cap"), F.col("coverage"))).alias("c"), F.count("*").alias("n"))
    kept = F.least(F.col("n"), F.col("cap"))
    return per.groupBy("cap").agg(
        F.round(F.avg("c"), 6).alias("mean_coverage"), F.round(F.avg((F.col("c") >= 0.9).cast("int")), 6).alias("share_90"), F.round(F.avg((F.col("c") >= 0.95).cast("int")), 6).alias("share_95"),
        F.round(F.sum(kept) * image_cost, 4).alias("cost"), F.round(F.sum(F.col("n") - kept) * image_cost, 4).alias("savings"),
    )


def policy_savings(images: DataFrame, policies: DataFrame, image_cost: float = 0.009532) -> DataFrame:
    """(policy, visual_type, ...) under caps (policy, visual_type, cap): processed, skipped, rate, dollars."""
    n = images.groupBy("product_id", "visual_type").agg(F.count("*").alias("n"))
    rows = n.join(policies, "visual_type")
    kept = F.least(F.col("n"), F.col("cap"))
    return rows.groupBy("policy", "visual_type").agg(
        F.sum(kept).alias("processed"), F.sum(F.col("n") - kept).alias("skipped"), F.round(F.sum(F.col("n") - kept) / F.sum("n"), 6).alias("skip_rate"), F.round(F.sum(F.col("n") - kept) * image_cost, 4).alias("saved"),
    )


def capped_images(images: DataFrame, caps: dict[str, int], soft: int = 8, hard: int = 15) -> DataFrame:
    """Passing images (product class, not excluded) in order, up to the type's cap; counters per product."""
    passing = images.where("stage_0_result = 'product' AND NOT excluded")
    cap = F.least(F.coalesce(*(F.when(F.col("visual_type") == t, F.lit(c)) for t, c in caps.items()), F.lit(soft)), F.lit(hard))
    return passing.withColumns({"cap": cap, "n": F.row_number().over(W.partitionBy("product_id").orderBy("position")), "n_passing": F.count("*").over(W.partitionBy("product_id"))}).withColumn("selected", F.col("n") <= F.col("cap"))


def resolution_gate(images: DataFrame, least: int = 591, most: int = 5) -> DataFrame:
    """Per product: first passing image, how many pass (up to ``most``), how many were looked at for that."""
    w = W.partitionBy("product_id").orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    ok = F.col("short_side") >= least
    rows = images.withColumns({"ok": ok, "so_far": F.sum(ok.cast("int")).over(w)})
    return rows.groupBy("product_id").agg(
        F.min(F.when(F.col("ok"), F.col("position"))).alias("first_passing"), F.least(F.sum(F.col("ok").cast("long")), F.lit(most)).alias("passing"),
        F.count_if((F.col("so_far") < most) | (F.col("ok") & (F.col("so_far") == most))).alias("checked"),
    )


def oracle_order(traits: DataFrame, most: int = 12) -> DataFrame:
    """The first ``most`` images in greedy order per product, by most new pairs (ties: earliest) among all images.

    The choice depends on all before it, so that a product is in one task, where its rows follow each other;
    a task reads them a batch at a time. A gain never grows as more is covered, so an image's last known
    gain bounds it: a heap gives the image with the largest bound, whose gain is counted anew, until one
    stays on top; few images are counted in a step. Images without pairs come last.
    """

    def greedy(product: int, held: dict[int, int], out: list[list]) -> None:
        heap = [(-pairs.bit_count(), position) for position, pairs in held.items()]
        heapq.heapify(heap)
        seen = step = 0
        while heap and step < most:
            bound, position = heapq.heappop(heap)
            new = (held[position] & ~seen).bit_count()
            if new < -bound:
                heapq.heappush(heap, (-new, position))
                continue
            seen |= held[position]
            step += 1
            for column, x in zip(out, (product, position, step, new, seen.bit_count())):
                column.append(x)

    names = ["product_id", "position", "step", "new_pairs", "cumulative"]

    def ordered(batches):
        product, held, bits = None, {}, {}  # bits: the pairs of this product by number
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for p, position, field, value in zip(*(c.to_pylist() for c in batch.columns)):
                if p != product:
                    if held:
                        greedy(product, held, out)
                    product, held, bits = p, {}, {}
                own = held.get(position, 0)
                held[position] = own if value is None else own | 1 << bits.setdefault((field, value), len(bits))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)
        out = [[] for _ in names]
        if held:
            greedy(product, held, out)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    valid = ~F.lower("value").isin(*MISSING)
    pairs = traits.select(F.col("product_id").cast("long"), F.col("position").cast("long"), F.when(valid, F.col("field")).alias("field"), F.when(valid, F.col("value")).alias("value"))
    return pairs.repartition("product_id").sortWithinPartitions("product_id", "position").mapInArrow(ordered, "product_id long, position long, step long, new_pairs long, cumulative long")

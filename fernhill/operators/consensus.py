"""Votes over repeated extraction runs, and product-level consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from fernhill.operators.ordered import with_quantiles


def vote(runs: DataFrame) -> DataFrame:
    """(image_id, field, value, votes, total, distinct_values): most frequent value, ties by value."""
    counts = runs.groupBy("image_id", "field", "value").agg(F.count("*").alias("votes"))
    w = W.partitionBy("image_id", "field")
    ranked = counts.withColumns({"n": F.row_number().over(w.orderBy(F.desc("votes"), "value")), "total": F.sum("votes").over(w), "distinct_values": F.count("*").over(w)})
    return ranked.where("n = 1").drop("n")


def majority_vote(runs: DataFrame) -> DataFrame:
    """2 or 3 runs: the majority, or unknown with low confidence when three runs all differ."""
    v = vote(runs)
    split = (F.col("total") >= 3) & (F.col("distinct_values") == F.col("total"))
    confidence = F.when(F.col("votes") == F.col("total"), "high").when(split, "low").otherwise("medium")
    return v.select("image_id", "field", F.when(split, "unknown").otherwise(F.col("value")).alias("value"), confidence.alias("confidence"))


def fraction_vote(runs: DataFrame) -> DataFrame:
    """The majority with votes / total as confidence."""
    return vote(runs).select("image_id", "field", "value", F.round(F.col("votes") / F.col("total"), 4).alias("confidence"))


def tiebreak_needed(runs: DataFrame) -> DataFrame:
    """(image_id, needs_tiebreak): whether run 1 and run 2 differ in any field."""
    two = runs.where("run_id <= 2").groupBy("image_id", "field").agg(F.min(F.when(F.col("run_id") == 1, F.col("value"))).alias("a"), F.min(F.when(F.col("run_id") == 2, F.col("value"))).alias("b"))
    return two.groupBy("image_id").agg(F.max(~F.col("a").eqNullSafe(F.col("b"))).alias("needs_tiebreak"))


def list_vote(items: DataFrame, runs_of: DataFrame, share: float = 0.5) -> DataFrame:
    """(record_id, item, votes): items in at least a share of a record's runs, most frequent first."""
    votes = items.select("record_id", "run_id", "item").distinct().groupBy("record_id", "item").agg(F.count("*").alias("votes"))
    kept = votes.join(runs_of, "record_id").where(F.col("votes") >= F.ceil(F.col("n_runs") * share))
    w = W.partitionBy("record_id").orderBy(F.desc("votes"), "item")
    return kept.withColumn("place", F.row_number().over(w).cast("long")).drop("n_runs")


def product_consensus(traits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per product and field the voted value over its images, and the image that agrees most often.

    For the images, rows are dealt once, by product: votes, agreements and places are told within its partition.
    """
    v = vote(traits.select(F.col("product_id").alias("image_id"), "field", "value"))
    agreed = v.select(F.col("image_id").alias("product_id"), "field", F.col("value").alias("consensus"), F.round(F.col("votes") / F.col("total"), 4).alias("confidence"))
    of = W.partitionBy("product_id", "field")
    dealt = traits.where("product_id IS NOT NULL AND field IS NOT NULL").select("product_id", "image_id", "field", "value").repartition("product_id")
    voted = dealt.withColumn("votes", F.count("*").over(W.partitionBy("product_id", "field", "value")))
    told = voted.withColumn("consensus", F.first("value").over(of.orderBy(F.desc("votes"), "value")))
    hits = told.groupBy("product_id", "image_id").agg(F.sum((F.col("value") == F.col("consensus")).cast("long")).alias("agreements"))
    w = W.partitionBy("product_id").orderBy(F.desc("agreements"), "image_id")
    best = hits.withColumn("n", F.row_number().over(w)).where("n = 1").select("product_id", "image_id", "agreements")
    return agreed, best


def measure_median(runs: DataFrame) -> DataFrame:
    """(record_id, measure, median): the runs' exact median, 2 places."""
    return with_quantiles(runs.select("record_id", "measure").distinct(), runs, ["record_id", "measure"], "value", {"median": 0.5}, 2)


def merge_traits(image: DataFrame, spec: DataFrame) -> DataFrame:
    """Image and spec values per record and field, with where the result is from; the spec wins conflicts."""
    joined = image.withColumnRenamed("value", "image_value").join(spec.withColumnRenamed("value", "spec_value"), ["record_id", "field"], "full_outer")
    source = F.when(F.col("spec_value").isNull(), "image").when(F.col("image_value").isNull(), "spec").when(F.col("image_value") == F.col("spec_value"), "both").otherwise("spec_over_image")
    return joined.select("record_id", "field", F.coalesce("spec_value", "image_value").alias("value"), source.alias("source"))

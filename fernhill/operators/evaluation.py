"""Relevance evaluation: rankings against judgments, run stability, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from fernhill.functions.text import create_id, token_jaccard
from fernhill.operators.ordered import running_totals


def order_checks(ranks: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, checks, passed): whether each expected product stands above another; ranks (case_id, product_id, rank)."""
    a, b = (ranks.select("case_id", F.col("product_id").alias(x), F.col("rank").alias(f"{x}_rank")) for x in ("higher", "lower"))
    joined = expected.join(a, ["case_id", "higher"], "left").join(b, ["case_id", "lower"], "left")
    return joined.groupBy("case_id").agg(F.count("*").alias("checks"), F.count_if(F.col("higher_rank") < F.col("lower_rank")).alias("passed"))


def inversions(rankings: DataFrame, depth: int = 10) -> DataFrame:
    """(query_id, preferred, demoted): pairs that the human order has the other way round than the model's."""
    top = rankings.where((F.col("model_rank") <= depth) & ~F.col("removed"))
    a = top.select("query_id", F.col("product_id").alias("preferred"), F.col("model_rank").alias("ma"), F.col("human_rank").alias("ha"))
    b = top.select("query_id", F.col("product_id").alias("demoted"), F.col("model_rank").alias("mb"), F.col("human_rank").alias("hb"))
    return a.join(b, "query_id").where("ha < hb AND ma > mb AND preferred <> demoted").select("query_id", "preferred", "demoted").distinct()


def preference_summary(pairs: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag, preferred, demoted, net): how often each side of a pair has a tag that the other lacks. tags: (product_id, tags array)."""
    p, d = (tags.select(F.col("product_id").alias(x), F.col("tags").alias(f"{x}_tags")) for x in ("preferred", "demoted"))
    rows = pairs.join(p, "preferred").join(d, "demoted")
    only = lambda x, y, side: rows.select(F.explode(F.array_except(x, y)).alias("tag"), F.lit(side).alias("side"))
    both = only("preferred_tags", "demoted_tags", 1).unionByName(only("demoted_tags", "preferred_tags", -1))
    return both.groupBy("tag").agg(F.count_if(F.col("side") == 1).alias("preferred"), F.count_if(F.col("side") == -1).alias("demoted"), F.sum("side").alias("net"))


def rank_delta(rankings: DataFrame) -> DataFrame:
    """(query_id, product_id, delta, move): by how much the human order moved each product."""
    delta = F.col("model_rank") - F.col("human_rank")
    return rankings.select("query_id", "product_id", "model_rank", "human_rank", delta.alias("delta"), F.when(delta > 0, "up").when(delta < 0, "down").otherwise("same").alias("move"))


def agreement_rate(runs: DataFrame) -> DataFrame:
    """(image_id, agreement): mean agreement over all pairs of runs."""
    a = runs.select("image_id", "field", F.col("run_id").alias("ra"), F.col("value").alias("va"))
    b = runs.select("image_id", "field", F.col("run_id").alias("rb"), F.col("value").alias("vb"))
    return a.join(b, ["image_id", "field"]).where("ra < rb").groupBy("image_id").agg(F.round(F.avg((F.col("va") == F.col("vb")).cast("int")), 6).alias("agreement"))


def run_stability(texts: DataFrame) -> DataFrame:
    """(record_id, jaccard, rating): token overlap of two runs' texts. texts has (record_id, a, b) token arrays."""
    j = F.round(token_jaccard(F.col("a"), F.col("b")), 6)
    return texts.select("record_id", j.alias("jaccard"), F.when(j >= 0.8, "stable").when(j >= 0.5, "minor").otherwise("divergent").alias("rating"))


def threshold_search(scores: DataFrame) -> DataFrame:
    """(threshold, accuracy): the single cut over midpoints that separates labels best; ties: smallest.

    scores has (score, label 0 or 1). Counts below each distinct score are running totals over range
    partitions, so that neither is a score compared with every midpoint nor are all of them in one task.
    """
    g = scores.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("ones"))
    total = g.agg(F.sum("n").alias("all_n"), F.sum("ones").alias("all_ones"))
    run = running_totals(g, [], ["score"], ["n", "ones"], ["score"]).where("next_score IS NOT NULL").crossJoin(F.broadcast(total))
    run = run.withColumns({"below": F.col("n_upto"), "ones_below": F.col("ones_upto"), "next": F.col("next_score")})
    right = (F.col("below") - F.col("ones_below")) + (F.col("all_ones") - F.col("ones_below"))
    cuts = run.select(((F.col("score") + F.col("next")) / 2).alias("threshold"), F.round(right / F.col("all_n"), 6).alias("accuracy"))
    return cuts.orderBy(F.desc("accuracy"), "threshold").limit(1)


def stratified_sample(rows: DataFrame, stratum: str, n: int, *order: str) -> DataFrame:
    w = W.partitionBy(stratum).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n)


def recovery_class(steps: DataFrame) -> DataFrame:
    """(record_id, step, state): an unstable step is transient if one of the next two is stable."""
    w = W.partitionBy("record_id").orderBy("step")
    soon = F.coalesce(F.lead("stable", 1).over(w), F.lit(False)) | F.coalesce(F.lead("stable", 2).over(w), F.lit(False))
    return steps.select("record_id", "step", F.when(F.col("stable"), "stable").when(soon, "transient").otherwise("persistent").alias("state"))


def judgment_upsert(judgments: DataFrame) -> DataFrame:
    """The latest judgment of each product; those without a removed, reordered or kept id do not count."""
    w = W.partitionBy("product_id").orderBy(F.desc("judged_at"), F.desc("judgment_id"))
    return judgments.where("has_signal").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def correction_records(corrections: DataFrame) -> DataFrame:
    """Rows of the correction log: trimmed texts, an id from time, image, field and value, and whether the model was right.

    corrections: (corrected_at, image_url, field, model_value, user_value, was_skipped). ``outcome`` is
    skipped, accepted (the user kept the model's value or gave none) or changed.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    user = F.trim(F.col("user_value").cast("string"))
    rows = corrections.select(F.col("corrected_at").cast("timestamp"), text("image_url").alias("image_url"), text("field").alias("field"), text("model_value").alias("model_value"), user.alias("user_value"), F.coalesce("was_skipped", F.lit(False)).alias("was_skipped"))
    time = F.date_format("corrected_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    key = create_id("trait_correction", time, F.col("image_url"), F.col("field"), F.coalesce("user_value", "model_value"))
    outcome = F.when(F.col("was_skipped"), "skipped").when(F.coalesce("user_value", "model_value") == F.col("model_value"), "accepted").otherwise("changed")
    return rows.select(key.alias("correction_id"), *rows.columns, outcome.alias("outcome"))


def append_corrections(corrections: DataFrame, path: str) -> DataFrame:
    """Append to the log below ``path`` and return all of it; a record that is sent again, by its id, counts once."""
    records = correction_records(corrections)
    records.write.mode("append").parquet(path)
    log = corrections.sparkSession.read.schema(records.schema).parquet(path)
    return log.dropDuplicates(["correction_id"])


def correction_summary(log: DataFrame) -> DataFrame:
    """(field, corrections, skipped, accepted, changed, images) of a correction log."""
    count = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    return log.groupBy("field").agg(F.count("*").alias("corrections"), *map(count, ("skipped", "accepted", "changed")), F.countDistinct("image_url").alias("images"))

"""Vector expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def unit_vector(a: Column) -> Column:
    """The vector with length 1; empty where it has none."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.array().cast("array<double>"))


def norm_similarity(c: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c + 1) / 2)), 6)


def parse_vector(text: Column) -> Column:
    """'[1, 2]' as doubles; what is not a finite number goes."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\[\]\s]", ""), ",")
    return F.filter(F.transform(parts, lambda x: x.try_cast("double")), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def refine(query: Column, target: Column, more: bool = True) -> Column:
    """Move a query towards a result (mean of both), or away from it, at length 1."""
    moved = F.zip_with(query, target, (lambda q, t: (q + t) / 2) if more else (lambda q, t: q - t))
    return unit_vector(moved)


def hash_embed(docs: DataFrame, tokens: str = "tokens", key: str = "id", dims: int = 192) -> DataFrame:
    """(key, vector): signed token hashing; each token adds four weighted entries read from its sha1.

    Entry i has its place in bytes 2i and 2i + 1, its sign in byte 8 + i and its weight in byte 12 + i.
    The vector has length 1, or is all zero where there is no token. Texts are dealt by key before their
    tokens become entries, so that sums need no further exchange and no task of a small file has those of all;
    in all shuffle partitions, since entries are many times the bytes by which those would be put together.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = docs.repartition(parts, key).select(key, F.explode_outer(tokens).alias("token")).withColumn("h", F.sha1("token"))
    byte = lambda k: F.conv(F.substring("h", 2 * k + 1, 2), 16, 10).cast("int")
    sign = lambda k: F.when(byte(8 + k) % 2 == 0, 1.0).otherwise(-1.0)
    four = F.array(*(F.struct(((byte(2 * k) * 256 + byte(2 * k + 1)) % dims).alias("dim"), (sign(k) * (1 + byte(12 + k) / 255.0)).alias("x")) for k in range(4)))
    summed = entries.select(key, F.explode(four).alias("e")).groupBy(key, "e.dim").agg(F.sum("e.x").alias("x"))
    some = F.when(F.col("dim").isNotNull(), F.struct("dim", "x"))
    sparse = summed.groupBy(key).agg(F.map_from_entries(F.collect_list(some)).alias("at"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    value = lambda d: F.coalesce(F.round(F.element_at("at", d) / F.when(F.col("size") > 0, F.col("size")), 6), F.lit(0.0))
    return sparse.select(key, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), value).alias("vector"))

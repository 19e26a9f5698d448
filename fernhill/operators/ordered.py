"""Running totals and exact ranks over range partitions: no task holds more of a group than its share of the rows."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fernhill.tables import written

_PART = "\0part"


def running_totals(rows: DataFrame, group: Sequence[str], order: Sequence[str], values: Sequence[str], following: Sequence[str] = ()) -> DataFrame:
    """The input with ``<v>_upto``, the sum of ``v`` over the group's rows up to this one, and ``next_<f>``, ``f`` of the group's next row.

    Rows are range-partitioned by group and order and written with their partition's number. A first
    pass sums each partition's share of each group (its chunk), a second adds the chunks before to a sum
    within the chunk. A group of all rows is spread over all partitions; what is ordered at once is a
    chunk, or the chunks of one group, of which there is one for each partition. ``order`` should tell
    rows apart; nulls come first. Null values count as 0; an empty table gives none.
    """
    dealt = rows.repartitionByRange(*group, *order).withColumn(_PART, F.spark_partition_id())
    table = written(dealt, "ranges")
    first = F.struct(*order)
    sums = [F.coalesce(F.sum(v), F.lit(0)).alias(f"before_{v}") for v in values]
    chunks = table.groupBy(*group, _PART).agg(F.count("*").alias("size"), *sums, *(F.min_by(f, first).alias(f"after_{f}") for f in following))
    chunks = _shifted(chunks, group, [f"before_{v}" for v in values], [f"after_{f}" for f in following]).drop("size")
    chunks = chunks.toDF(*[f"\0{c}" for c in chunks.columns])
    same = [table[_PART] == chunks[f"\0{_PART}"], *(table[c].eqNullSafe(chunks[f"\0{c}"]) for c in group)]
    w = W.partitionBy(_PART, *group).orderBy(*order)
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    named = {f"{v}_upto": F.col(f"\0before_{v}") + F.coalesce(F.sum(v).over(so_far), F.lit(0)) for v in values}
    last = F.lead(F.lit(1)).over(w).isNull()
    named |= {f"next_{f}": F.when(last, F.col(f"\0after_{f}")).otherwise(F.lead(f).over(w)) for f in following}
    joined = table.join(chunks, functools.reduce(lambda a, b: a & b, same))
    return joined.select(*rows.columns, *(c.alias(name) for name, c in named.items()))


def _shifted(chunks: DataFrame, group: Sequence[str], before: Sequence[str], after: Sequence[str]) -> DataFrame:
    """For each chunk the sums of its group's chunks before, and the first values of the one behind."""
    if group:
        w = W.partitionBy(*group).orderBy(_PART)
        past = w.rowsBetween(W.unboundedPreceding, -1)
        return chunks.withColumns({c: F.coalesce(F.sum(c).over(past), F.lit(0)) for c in before} | {c: F.lead(c).over(w) for c in after})
    rows = sorted((r.asDict() for r in chunks.collect()), key=lambda r: r[_PART])  # a row for each partition
    total = dict.fromkeys(before, 0)
    behind = [{c: r[c] for c in after} for r in rows[1:]] + [dict.fromkeys(after)]
    out = []
    for r, follows in zip(rows, behind):
        out.append(r | total | follows)
        total = {c: total[c] + r[c] for c in before}
    return chunks.sparkSession.createDataFrame([tuple(r[c] for c in chunks.columns) for r in out], chunks.schema)


def at_positions(rows: DataFrame, group: Sequence[str], value: str, places: dict[str, Callable[[Column], Column]], weight: Column | None = None) -> DataFrame:
    """(group, names): the values at places of each group's ascending values, nulls left out.

    ``places`` maps a name to a function from the group's number of values to a place from 0; a place
    between two values gives a point between them. Equal values are counted before they are ordered;
    a row counts as often as ``weight`` says, or once.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("value")).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    ordered = running_totals(counts, group, ["value"], ["n"], ["value"])
    totals = counts.groupBy(*group).agg(F.sum("n").alias("all_n"))
    other = totals.toDF(*[f"\0{c}" for c in group], "all_n")
    same = functools.reduce(lambda a, b: a & b, (ordered[c].eqNullSafe(other[f"\0{c}"]) for c in group), F.lit(True))
    found = {}
    for name, place in places.items():
        at = place(F.col("all_n")).cast("double")
        low = F.floor(at)
        there = (low >= F.col("n_upto") - F.col("n")) & (low < F.col("n_upto"))
        above = F.when(low + 1 < F.col("n_upto"), F.col("value")).otherwise(F.col("next_value"))
        found[name] = F.max(F.when(there, F.when(at == low, F.col("value")).otherwise(F.col("value") + (at - low) * (above - F.col("value")))))
    return ordered.join(other, same).groupBy(*group).agg(*(c.alias(name) for name, c in found.items()))


def exact_quantiles(rows: DataFrame, group: Sequence[str], value: str, shares: dict[str, float], weight: Column | None = None) -> DataFrame:
    """(group, names): exact quantiles of each group's values, between two values by their distance."""
    return at_positions(rows.withColumn(value, F.col(value).cast("double")), group, value, {name: lambda n, q=q: (n - 1) * q for name, q in shares.items()}, weight)


def with_quantiles(totals: DataFrame, rows: DataFrame, group: Sequence[str], value: str, shares: dict[str, float], digits: int, weight: Column | None = None) -> DataFrame:
    """``totals``, which has a row for each group, with the groups' rounded quantiles; null where a group has no values."""
    found = exact_quantiles(rows, group, value, shares, weight)
    found = found.select(*(F.col(c).alias(f"\0{c}") for c in group), *(F.round(name, digits).alias(name) for name in shares))
    same = functools.reduce(lambda a, b: a & b, (totals[c].eqNullSafe(found[f"\0{c}"]) for c in group))
    return totals.join(found, same, "left").select(*totals.columns, *shares)

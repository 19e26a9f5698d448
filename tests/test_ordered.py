"""Running totals and ranks against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from fernhill.operators import ordered as O
from fernhill.operators.evaluation import threshold_search
from fernhill.operators.retrieval import score_cutoff


def rows_for(seed, n):
    r = random.Random(seed)
    # a third of all rows in one group, some without one
    return [(r.choice(["hot"] * 3 + ["a", "b", None, "c", "d", "e"]), i, r.choice([0.5, 1.0, -2.0, 7.25, None, r.random()]), r.randint(0, 5)) for i in range(n)]


@pytest.fixture
def many_parts(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])


@pytest.mark.parametrize("group", [["g"], []])
def test_running_totals(spark, many_parts, group):
    rows = rows_for(1, 200)
    table = spark.createDataFrame(rows, "g string, i int, x double, w int").repartition(5)
    got = {r.i: (r.w_upto, r.next_i, r.next_x) for r in O.running_totals(table, group, ["i"], ["w"], ["i", "x"]).collect()}
    want, total, before = {}, {}, {}
    for g, i, x, w in rows:
        g = g if group else 0
        total[g] = total.get(g, 0) + w
        if g in before:
            want[before[g]] = (want[before[g]][0], i, x)
        want[i], before[g] = (total[g], None, None), i
    assert got == want
    assert O.running_totals(table.limit(0), group, ["i"], ["w"]).count() == 0


def test_no_window_without_a_group(spark, many_parts):
    table = spark.createDataFrame(rows_for(2, 50), "g string, i int, x double, w int")
    plan = O.running_totals(table, [], ["i"], ["w"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "hashpartitioning" in plan


def test_quantiles_of_groups(spark, many_parts):
    rows = rows_for(3, 300)
    table = spark.createDataFrame(rows, "g string, i int, x double, w int").repartition(4)
    got = {r.g: (r.low, r.middle, r.most) for r in O.exact_quantiles(table, ["g"], "x", {"low": 0.1, "middle": 0.5, "most": 1.0}).collect()}
    for g in {r[0] for r in rows}:
        values = sorted(x for h, _, x, _ in rows if h == g and x is not None)
        at = (len(values) - 1) * 0.1
        low = values[int(at)] + (at - int(at)) * (values[int(at) + 1] - values[int(at)])
        assert got[g] == pytest.approx((low, statistics.median(values), values[-1]))
    whole = O.exact_quantiles(table, [], "x", {"middle": 0.5}).collect()
    assert [r.middle for r in whole] == [pytest.approx(statistics.median(x for *_, x, _ in rows if x is not None))]
    totals = spark.createDataFrame([("hot", 1), ("none", 2), (None, 3)], "g string, n int")
    found = {r.g: r.q for r in O.with_quantiles(totals, table.where("g IS NULL OR g <> 'none'"), ["g"], "x", {"q": 0.5}, 6).collect()}
    assert found["none"] is None and found["hot"] is not None and found[None] is not None


def plain_cutoff(scores, least=3, most=20, gap=0.3, ratio=1.5, floor=0.7, uniform=0.8):
    s = sorted(scores, reverse=True)
    n, gaps = len(s), [a - b for a, b in zip(s, s[1:])]
    if n <= least:
        return n, "too_few"
    if s[-1] >= s[0] * uniform:
        return n, "uniform"
    median = sorted(gaps)[len(gaps) // 2]
    wide = [(-g, i + 1) for i, g in enumerate(gaps) if least <= i + 1 <= most and g >= gap and g >= median * ratio]
    if wide:
        return min(wide)[1], "gap"
    low = [i for i, x in enumerate(s) if x < s[0] * floor]
    return (min(max(low[0], least), most, n), "relative") if low else (n, "none")


def test_cutoffs_of_lists(spark, many_parts):
    r = random.Random(5)
    lists = {q: [round(r.choice([r.random(), r.random() * 3, 2.0]), 3) for _ in range(r.choice([1, 2, 3, 5, 30]))] for q in range(40)} | {99: [3.0 - i * 0.001 for i in range(300)], 98: [1.0] * 50, 97: [1.0, 1.0, 0.99, 0.9, 0.5]}
    rows = [(q, i, x) for q, xs in lists.items() for i, x in enumerate(xs)]
    got = {x.query_id: (x.cutoff, x.reason) for x in score_cutoff(spark.createDataFrame(rows, "query_id int, item int, score double")).collect()}
    assert got == {q: plain_cutoff(xs) for q, xs in lists.items()}


def test_threshold_over_many_scores(spark, many_parts):
    r = random.Random(6)
    rows = [(round(r.random(), 3), 0) for _ in range(300)] + [(round(r.random() + 0.4, 3), 1) for _ in range(300)]
    got = threshold_search(spark.createDataFrame(rows, "score double, label int")).collect()
    values = sorted({s for s, _ in rows})
    cuts = [(-round(sum((s > (a + b) / 2) == label for s, label in rows) / len(rows), 6), (a + b) / 2) for a, b in zip(values, values[1:])]
    assert [(-x.accuracy, x.threshold) for x in got] == [min(cuts)]
    assert threshold_search(spark.createDataFrame([(1.0, 1)], "score double, label int").where(F.lit(False))).count() == 0

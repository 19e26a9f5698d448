"""Goldens and invariants of the catalog operators, and all queries against their SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from fernhill.fixtures import TABLES, view
from fernhill.functions import text as T, vectors as V
from fernhill.operators import coverage as K, resolution as E, retrieval as R
from fernhill.plans.catalog_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0 if math.isfinite(v) else str(v)
    return round(float(v), 5) if type(v).__name__ == "Decimal" else v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = ordered(got.select(*columns).collect())
    if name in ORACLES:
        picked = ", ".join(f'"{c}"' for c in columns)
        assert rows == ordered(duck.sql(f"SELECT {picked} FROM ({ORACLES[name]})").fetchall())
    else:
        assert rows


@pytest.mark.parametrize(
    ("scores", "cutoff", "reason"),
    [([3.0, 2.0, 1.0], 3, "too_few"), ([1.0, 0.95, 0.9, 0.85, 0.82], 5, "uniform"), ([2.0, 1.9, 1.8, 1.0, 0.9, 0.8], 3, "gap"), ([1.0, 0.9, 0.8, 0.75, 0.6, 0.5, 0.4], 4, "relative")],
)
def test_cutoff(spark, scores, cutoff, reason):
    rows = spark.createDataFrame([(1, k, s) for k, s in enumerate(scores)], "query_id long, item long, score double")
    r = R.score_cutoff(rows).collect()[0]
    assert (r.cutoff, r.reason) == (cutoff, reason)


def test_text_functions(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).collect()[0].x
    assert val(T.slugify(F.lit(" Arm & Leg -- Chair! "))) == "arm-and-leg-chair"
    assert val(T.norm_bullet(F.lit(" Wooden  wood legs, chairs!? "))) == "wood leg, chairs"
    assert val(T.first_sentences(F.lit("One. Two! Three?"), 2)) == "One. Two!"
    assert val(T.token_jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0
    assert val(T.source_product_id(F.lit(None).cast("string"), F.lit("https://x/p/55/name"), F.lit("product_dp_7"))) == "55"
    assert val(T.text_quality(F.lit(""))) == -1000 and val(T.cleaner_string(F.lit("abc"), F.lit("abd"))) == "abc"
    assert val(T.split_levels(F.lit("a::0::b::a"))) == ["a", "b"]
    assert val(V.parse_vector(F.lit("[1, x, 2.5]"))) == [1.0, 2.5] and val(V.unit_vector(F.array(F.lit(0.0)))) == []
    assert val(V.norm_similarity(F.lit(3.0))) == 1.0


def test_snapshot_has_all_products(spark):
    sf = "/root/testdata/sf0.01"
    ids = [r.product_id for r in view(spark, sf, "fx_products").select("product_id").collect()]
    assert max(ids) > 200
    dp = {str(i) for i in ids if i % 2 == 0}
    want = [f"product_dp_{i}" if i % 2 == 0 else f"product_0123456789ab_{i - i % 4}" for i in ids if i % 2 == 0 or str(i - i % 4) not in dp]
    assert sorted(r.product_id for r in QUERIES["s11_stage_index_snapshot"](spark, sf).collect()) == sorted(want)


def test_ambiguous_names_are_rejected(spark):
    rows = lambda *r: spark.createDataFrame(r, "source_product_id string, product_name string, brand string")
    matches, rejects = E.match_products(rows(("product_x", "Chair", "B"), ("product_y", "Desk", "B"), ("product_1", "Sofa", "B")), rows(("other_a", "chair ", "b"), ("other_b", "Chair", "B"), ("other_c", "desk", "b"), ("product_dp_1", "Z", "Z"), ("old_1", "Z", "Z")))
    got = {r.canonical_key.split(":")[0] + ":" + r.strategy for r in matches.collect()}
    assert got == {"dp:tail_id", "fallback:brand_name", "normalized_catalog:catalog_only", "image_index:index_only"}
    assert [(r.catalog_id, r.reason) for r in rejects.collect()] == [("product_x", "ambiguous_name")]


def test_greedy_order_is_never_behind(spark):
    rows = spark.createDataFrame([(1, p, p, "t", f, v) for p, f, v in [(1, "a", "x"), (1, "b", "x"), (2, "a", "x"), (3, "a", "y"), (3, "b", "y"), (3, "c", "y")]], "product_id long, image_id long, position long, visual_type string, field string, value string")
    assert [(r.position, r.new_pairs) for r in K.oracle_order(rows).orderBy("step").collect()] == [(3, 3), (1, 2), (2, 0)]


def test_coverage_counts_all_images_and_shows_twelve(spark):
    more = [(1, p, p, "t", f"f{p}", "x") for p in range(1, 16)] + [(1, 16, 16, "t", f"g{k}", "x") for k in range(5)] + [(1, 17, 17, "t", "h", "unknown")]
    rows = spark.createDataFrame(more, "product_id long, image_id long, position long, visual_type string, field string, value string")
    path = K.coverage_trajectory(rows)
    assert [(r.position, r.cumulative, r.coverage) for r in path.orderBy("position").collect()] == [(p, p, round(p / 20, 6)) for p in range(1, 13)]
    assert [(r.products, r.median_at, r.never) for r in K.threshold_crossing(path).collect()] == [(1, None, 1.0)]
    card = K.cap_scorecard(K.coverage_trajectory(rows, most=None), image_cost=1.0).collect()
    assert {r.cap: (r.mean_coverage, r.savings) for r in card} == {c: (round(c / 20, 6), 17 - c) for c in (4, 6, 8, 10, 12)}
    assert [(r.position, r.step, r.new_pairs) for r in K.oracle_order(rows).orderBy("step").collect()] == [(16, 1, 5), *((p, p + 1, 1) for p in range(1, 12))]
    assert [r.position for r in K.oracle_order(rows, 99).orderBy("step").collect()][-1] == 17


def test_replace_and_rerun(spark):
    old = spark.createDataFrame([(1, 10), (2, 20)], "product_id long, image_id long")
    new = spark.createDataFrame([(1, 11)], "product_id long, image_id long")
    once = E.replace_product_images(old, new)
    assert ordered(once.collect()) == [(1, 11), (2, 20)] == ordered(E.replace_product_images(once, new).collect())

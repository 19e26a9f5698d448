"""Snapshots, payloads, staging, sort modes, client rows, logs, greedy orders and facets."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from fernhill.functions import text as T
from fernhill.operators import coverage as K, evaluation as V, retrieval as R, snapshots as Sn
from fernhill.sources import catalog as S, payload as P


def test_snapshots_are_named_by_content(spark, tmp_path):
    store = Sn.SnapshotStore(spark, f"file://{tmp_path}/s")
    rows = [(1, 10, 1, 0.5), (1, 11, 2, 0.4), (2, 10, 1, None), (None, 12, 1, 0.1)]
    make = lambda r: spark.createDataFrame(r, "query_id long, product_id long, rank long, score double")
    one = store.write(make(rows))
    assert store.write(make(rows[::-1]).repartition(3).select("score", "rank", "product_id", "query_id")) == one
    assert [p.name for p in (tmp_path / "s").iterdir() if not p.name.startswith(".")] == [one]
    other = [store.write(make(r)) for r in (rows[:3], rows + rows[:1], [*rows[:3], (None, 12, 1, 0.2)], [*rows[:3], (12, None, 1, 0.1)], [])]
    assert len({one, *other}) == 6
    assert sorted(map(tuple, store.read(one).collect()), key=repr) == sorted(rows, key=repr)
    assert store.read(other[-1]).count() == 0


def test_difference_of_results(spark):
    make = lambda r: spark.createDataFrame(r, "query_id long, product_id long, rank long, score double")
    old = make([(1, 10, 1, 0.5), (1, 11, 2, 0.4), (1, 12, 3, 0.3), (1, 13, 4, 0.2), (None, 9, 1, 0.1)])
    new = make([(1, 11, 1, 0.4), (1, 10, 2, 0.39), (1, 12, 3, 0.31), (1, 14, 4, 0.2), (None, 9, 1, 0.1)])
    got = {(r.query_id, r.product_id): (r.change, r.old_rank, r.new_rank) for r in Sn.diff_results(old, new).collect()}
    assert got == {(1, 10): ("moved", 1, 2), (1, 11): ("moved", 2, 1), (1, 12): ("rescored", 3, 3), (1, 13): ("lost", 4, None), (1, 14): ("added", None, 4)}
    assert Sn.diff_results(old, old).count() == 0 and Sn.diff_results(make([]), make([])).count() == 0
    assert {r.change for r in Sn.diff_results(make([]), new).collect()} == {"added"}
    top = Sn.top_results(old, [F.desc("rank")], 2).where("query_id = 1").orderBy("rank")
    assert [(r.product_id, r.rank) for r in top.collect()] == [(13, 1), (12, 2)]


def test_payloads_and_why_there_are_none(spark):
    esc = lambda x: x.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;")
    page = lambda body, q='"', c="image-column": f"<html>\n<div\n class=\"a {c} b\" data-x=\"1\" data-source-data={q}{body}{q} ></div>"
    whole = {"id": 77, "name": " A  \"big\"\n<chair> ", "manufacturer": {"name": "M&M"}, "dp_categories": [{"level": 0, "name": "Seats"}, {"level": "1", "name": " Stools "}, {"level": 1, "name": "Stools"}, {"level": 2, "name": "Bar"}, {"level": None, "name": "Loose"}, None, {"level": 0, "name": " "}], "default_image": {"url": "u0"}, "additional_images": [{"url": "u1"}, {"url": "u0"}, {"url": ""}, None]}
    bare = {"id": "x-5", "dp_categories": [{"level": 3, "name": "Only"}], "extra": {"deep": [1, {"a": "}"}]}}
    rows = [
        (1, page(esc(json.dumps(whole)))), (2, page(json.dumps(bare), "'")), (3, page(esc(json.dumps(whole))[:50])), (4, page("[1]")), (5, page("")), (6, page("null")), (7, page("{}")),
        (8, page(esc(json.dumps(whole)), c="image-columns")), (9, "<p>nothing</p>"), (10, ""), (11, None), (12, "  \n"), (13, page(esc(json.dumps({"id": "9", "dp_categories": "none", "name": "kept"})))), (1, page(esc(json.dumps(whole)))),
    ]
    got = P.read_payloads(spark.createDataFrame(rows, "page_id int, html string").withColumn("brand", F.lit("clash")), site="s/")
    by = {r.page_id: r for r in got.collect()}
    assert got.count() == len(rows) and got.columns.count("brand") == 1
    assert {k: r.flag_reason for k, r in by.items()} == {1: None, 2: None, 3: "broken_payload", 4: "broken_payload", 5: "broken_payload", 6: "broken_payload", 7: "no_id", 8: "no_payload", 9: "no_payload", 10: "empty_page", 11: "empty_page", 12: "empty_page", 13: None}
    r = by[1]
    assert (r.source_product_id, r.product_name, r.brand, r.website, r.a_level, r.b_level, r.c_level, r.raw_category, r.default_image_url, r.image_urls) == ("77", 'A "big" <chair>', "M&M", "s/77", ["Seats"], ["Stools"], ["Bar"], "Bar :: Stools", "u0", ["u0", "u1"])
    assert (by[2].source_product_id, by[2].website, by[2].b_level, by[2].image_urls) == ("x-5", "s/5", ["Only"], [])
    assert by[13].product_name == "kept" and by[13].a_level == [] and by[3].product_name is None and by[7].source_product_id == ""


def test_the_last_row_of_a_catalog_counts(spark, tmp_path):
    one = {"products": [{"product_id": " 1 ", "name": "a", "image_urls": [" u ", "", None]}, {"product_id": "1", "name": "b", "product_image": "v"}, None, {"product_id": "2"}], "images": [{"image_id": "i", "product_id": "1", "image_url": "w"}, {"image_id": "i", "product_id": "1", "image_url": " v "}, {"image_id": "j", "product_id": "404"}], "source_catalog": {"x": 1}}
    (tmp_path / "a.json").write_text(json.dumps(one, indent=1))
    products, images = S.stage_catalog_snapshot(spark, f"file://{tmp_path}/a.json", "sys")
    assert sorted((r.source_system, r.source_product_id, r.product_name, r.product_image_url, r.image_urls) for r in products.collect()) == [("sys", "1", "b", "v", []), ("sys", "2", "", "", [])]
    assert [(r.source_image_id, r.source_product_id, r.image_url, r.is_catalog_primary_image) for r in images.collect()] == [("i", "1", "v", True)]
    assert json.loads(products.where("source_product_id = '1'").first().raw_payload)["name"] == "b"
    (tmp_path / "e.json").write_text("{}")
    assert [x.count() for x in S.stage_catalog_snapshot(spark, f"file://{tmp_path}/e.json", "sys")] == [0, 0]


def test_audit_rows_are_appended(spark, tmp_path):
    at = datetime.datetime(2024, 5, 1)
    S.audit_run(spark, f"file://{tmp_path}/a", "s", "t", "p", 3, {"b": 1, "a": 2}, at)
    log = S.audit_run(spark, f"file://{tmp_path}/a", "s", "t", "p", 4)
    assert sorted((r.record_count, r.notes) for r in log.collect()) == [(3, '{"a": 2, "b": 1}'), (4, "{}")]
    assert log.where("run_at IS NULL").count() == 0 and log.where("record_count = 3").first().run_at == at


def test_orders_of_results(spark):
    rows = [(1, "b", "B", "x", 0.5, None, 1, False), (2, "A", "b", "x", 0.5, "2024-01-02", 2, None), (3, "a", "A", "x", 0.9, "2024-01-01", 1, False), (4, "c", "A", "x", 0.1, "2024-01-02", None, True)]
    table = spark.createDataFrame(rows, "product_id int, product_name string, brand string, query_id string, score double, ai_refreshed_at string, confidence int, is_exact_source boolean")
    order = lambda m, **b: [r.product_id for r in R.sort_results(table, m, **b).orderBy("place").collect()]
    assert order("auto") == order("anything") == [4, 3, 2, 1]
    assert order("refreshed_desc") == [2, 4, 3, 1] and order("refreshed_asc") == [1, 3, 2, 4]
    assert order("name") == [2, 3, 1, 4] and order("name", limit=2) == [2, 3]


def test_client_rows(spark):
    image = "struct<image_id:int,embedding:array<double>,secret:string,score:double,free_text:string>"
    images = [(k, [1.0] if k % 2 else None, "s", 0.5, "f") for k in range(5)]
    table = spark.createDataFrame([(1, images, images[1], "in"), (2, None, None, "in")], f"product_id int, matching_images array<{image}>, hero_image {image}, internal string")
    got = {r.product_id: r for r in R.client_projection(table).collect()}
    assert got[1].asDict(True) == {"product_id": 1, "matching_images": [{"image_id": k, "score": 0.5, "has_stored_embedding": k % 2 == 1} for k in range(3)], "hero_image": {"image_id": 1, "score": 0.5, "has_stored_embedding": True}}
    assert got[2].matching_images == [] and got[2].hero_image is None
    full = R.client_projection(table, debug=True).where("product_id = 1").first()
    assert len(full.matching_images) == 5 and full.hero_image.free_text == "f" and full.hero_image.embedding == [1.0]


def test_category_falls_back_to_itself(spark):
    rules = [("Stools", ["bar stool", "Stool"]), ("Seats", ["seat"])]
    rows = [("  A bar STOOL seat ",), ("seats",), ("  Desk ",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").coalesce(1).select(T.canonical_category(F.col("c"), rules)).collect()]
    assert got == ["Stools", "Seats", "Desk", "", ""]
    assert spark.createDataFrame(rows[:1], "c string").select(T.canonical_category(F.col("c"), [])).first()[0] == "A bar STOOL seat"


def test_corrections_count_once(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 3)
    rows = [(at, " u ", "f", "a", "a ", False), (at, "u", "f", "b", None, None), (at, "u", "g", "a", "b", False), (at, "u", "g", "a", "c", True), (None, None, None, None, None, None)]
    table = spark.createDataFrame(rows, "corrected_at timestamp, image_url string, field string, model_value string, user_value string, was_skipped boolean")
    V.append_corrections(table, f"file://{tmp_path}/log")
    log = V.append_corrections(table.limit(3), f"file://{tmp_path}/log")
    got = {r.field: (r.corrections, r.skipped, r.accepted, r.changed, r.images) for r in V.correction_summary(log).collect()}
    assert got == {"f": (2, 0, 2, 0, 1), "g": (2, 1, 0, 1, 1), "": (1, 0, 1, 0, 1)}


@pytest.mark.parametrize("seed", [1, 2])
def test_lazy_greedy_equals_greedy(spark, seed):
    r = random.Random(seed)
    rows = [(p, k, k, "t", f"f{r.randint(0, 4)}", r.choice(["x", "y", "z", "unknown"])) for p in range(6) for k in range(1, 25) for _ in range(r.randint(1, 6))]
    got = {}
    for x in K.oracle_order(spark.createDataFrame(rows, "product_id long, image_id long, position long, visual_type string, field string, value string")).collect():
        got.setdefault(x.product_id, []).append((x.step, x.position, x.new_pairs, x.cumulative))
    for p in range(6):
        held = {k: {(f, v) for q, i, _, _, f, v in rows if (q, i) == (p, k) and v != "unknown"} for k in range(1, 25)}
        seen, want = set(), []
        for step in range(1, 13):
            best = min(held, key=lambda k: (-len(held[k] - seen), k))
            new = held.pop(best) - seen
            seen |= new
            want.append((step, best, len(new), len(seen)))
        assert sorted(got[p]) == want


@pytest.mark.parametrize("kind", ["long", "string"])
def test_facets_by_bitmaps(spark, kind):
    r = random.Random(7)
    rows = [(i, r.choice([i % 50, i % 50 + 40_000, -(i % 50)]), f, r.choice(["a", "b", "c", "odd", "", "unknown"])) for i in range(400) for f in ("p", "q", "s")]
    one = {}
    for i, product, _, _ in rows:
        one[i] = product
    rows = [(i, one[i], f, v) for i, _, f, v in rows]
    table = spark.createDataFrame(rows, "image_id long, product_id long, field string, value string").withColumn("product_id", F.col("product_id").cast(kind))
    vocab = spark.createDataFrame([(f, v) for f in "pqs" for v in "abcz"], "field string, value string")
    for filters in ({"p": "a", "q": "b"}, {"p": "a"}, {}):
        got = {(x.field, x.value): (x.products, x.legacy) for x in R.facet_counts(table, filters, vocab).collect()}
        want = {(f, v): (0, False) for f in "pqs" for v in "abcz"}
        has = {(i, f): v for i, _, f, v in rows}
        hits: dict = {}
        for i, p, f, v in rows:
            if v not in ("", "unknown") and all(has[i, g] == w for g, w in filters.items() if g != f):
                hits.setdefault((f, v), set()).add(p)
        want |= {k: (len(ps), k[1] == "odd") for k, ps in hits.items()}
        assert got == want

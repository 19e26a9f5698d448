"""Exact and approximate nearest vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernhill.operators import vector_search as N


def tables(spark, sf, step=20):
    emb = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    return emb.select(F.col("vec_id").alias("image_id"), F.col("label").alias("product_id"), "embedding"), emb.where(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def plain_topk(images, queries, k, key):
    unit = lambda v: np.array(v, float) / (np.linalg.norm(v) or 1)
    out = []
    for q, qv, *scope in queries:
        near = [(-(round(float(unit(qv) @ unit(v)), 6) + 0.0), *key(i, rest), i) for i, v, *rest in images if v is not None and (not scope or rest[-1] == scope[0])]
        out += [(q, x[-1], -x[0], n + 1) for n, x in enumerate(sorted(near)[:k])]
    return sorted(out)


def test_top_k_does_not_depend_on_cells(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(i, r.integers(-2, 3, 3).astype(float).tolist(), int(r.integers(0, 5)), "ab"[i % 2]) for i in range(90)] + [(900, None, 1, "a"), (901, [0.0, 0.0, 0.0], 0, "b")]
    asked = [(i, v, s) for i, v, _, s in rows[:17]] + [(77, None, "a")]
    images, queries = spark.createDataFrame(rows, "image_id long, embedding array<float>, product_id int, kind string"), spark.createDataFrame(asked, "query_id long, embedding array<float>, kind string")
    plain, by_product = ([x for x in rows], [(i, v) for i, v, _ in asked if v]), lambda i, rest: (rest[0],)
    for images_in_cell, queries_in_cell, step in ((16384, 1024, 2048), (7, 3, 4), (1000, 1, 1)):
        monkeypatch.setattr(N, "CELL_IMAGES", images_in_cell)
        monkeypatch.setattr(N, "CELL_QUERIES", queries_in_cell)
        monkeypatch.setattr(N, "SLICE", step)
        got = lambda *a, **b: sorted(map(tuple, N.vector_topk(images.repartition(3), queries, 5, *a, **b).collect()))
        assert got() == plain_topk(*plain, 5, lambda i, rest: ())
        assert got(ties=["product_id"]) == plain_topk(*plain, 5, by_product)
    assert got(ties=["product_id"], scope="kind") == plain_topk(rows, [(i, v, s) for i, v, s in asked if v], 5, by_product)
    assert N.vector_topk(images.limit(0), queries, 5).count() == 0 == N.vector_topk(images, queries.limit(0), 5).count()


def test_vectors_of_several_lengths_are_an_error(spark):
    images = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "image_id long, embedding array<float>")
    with pytest.raises(Exception, match="one length"):
        N.vector_topk(images, images.withColumnRenamed("image_id", "query_id"), 1).collect()


def test_product_similarity_is_the_best_of_other_images(spark, monkeypatch):
    images, queries = tables(spark, "sf0.001")
    want = {}
    rows, asked = images.collect(), queries.collect()
    v = np.array([r.embedding for r in rows], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    at = {r.image_id: n for n, r in enumerate(rows)}
    for q in asked:
        for r, x in zip(rows, np.round(v @ v[at[q.query_id]], 6)):
            if r.image_id != q.query_id:
                want[q.query_id, r.product_id] = max(want.get((q.query_id, r.product_id), -2), x)
    for size in (16384, 60):
        monkeypatch.setattr(N, "CELL_IMAGES", size)
        got = {(r.query_id, r.product_id): r.similarity for r in N.product_similarity(images, queries).collect()}
        assert got == pytest.approx(want, abs=1.1e-6)


def test_index_finds_nine_of_ten_and_scores_a_tenth(spark):
    images, queries = tables(spark, "sf0.1")
    index = N.build_index(images)
    want = N.vector_topk(images, queries, 10)
    found = index.search(queries, 10)
    n, asked = images.count(), queries.count()
    near = index.candidates(queries, len(index.centroids) // 2, 150)
    assert near.count() <= 0.1 * n * asked
    assert found.join(want.select("query_id", "image_id"), ["query_id", "image_id"]).count() >= 0.9 * want.count()
    same = found.join(want.select("query_id", "image_id", F.col("similarity").alias("exact")), ["query_id", "image_id"])
    assert same.where("abs(similarity - exact) > 1.1e-6").count() == 0 and found.groupBy("query_id").count().where("count <> 10").count() == 0
    assert index.sizes.sum() == n == index.rows.select("image_id").distinct().count()


def test_a_list_of_any_size_is_parted(spark, monkeypatch):
    images, queries = tables(spark, "sf0.001", 100)
    want = sorted(map(tuple, N.build_index(images, lists=2).search(queries, 3, probes=2, rescore=500).collect()))
    assert want == sorted(map(tuple, N.vector_topk(images, queries, 3).collect()))
    monkeypatch.setattr(N, "CELL_IMAGES", 40)
    monkeypatch.setattr(N, "CELL_QUERIES", 2)
    index = N.build_index(images, lists=2)
    sizes = [r["count"] for r in index.rows.groupBy("list", "chunk").count().collect()]
    assert sum(sizes) == 500 and max(sizes) < 80
    assert sorted(map(tuple, index.search(queries, 3, probes=2, rescore=500).collect())) == want
    assert N.ann_topk(images.limit(0), queries, 3).count() == 0

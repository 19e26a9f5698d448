"""Cases of the third round's findings."""

import math
import random

from pyspark.sql import functions as F

from fernhill.functions import text as T
from fernhill.operators import coverage as K, phrases as P, retrieval as R, vector_search as N
from fernhill.plans import lookup_queries as L


def test_words_end_at_other_letters(spark):
    texts = ["ósin y", "de sinó", "a_no", "no", "ano", "mesh mesh", "émesh mesh", "two legé arms"]
    got = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    assert [r.negated for r in L.negation(got).orderBy("doc_id").collect()] == [True, True, False, True, False, False, False, False]
    assert [r.x for r in got.orderBy("doc_id").select(T.is_absence(F.concat(F.lit("é"), "text")).alias("x")).collect()] == [False, False, False, True, False, False, False, False]
    assert [r.x for r in got.where("doc_id > 4").orderBy("doc_id").select(T.norm_bullet(F.col("text")).alias("x")).collect()] == ["mesh", "émesh", "two legé arms"]
    assert [r.x for r in got.where("doc_id = 7").select(P.low_value_bullet(F.col("text")).alias("x")).collect()] == [True]


def test_images_that_share_vectors(spark):
    r = random.Random(3)
    vectors = {v: [r.choice([0.0, 0.5, 1.0]) for _ in range(3)] + [0.25] for v in range(12)}
    images = [(i, r.randint(0, 5), r.choice("ab"), r.randint(0, 13)) for i in range(300)]
    queries = [(q, r.choice("ab"), [r.random() for _ in range(4)]) for q in range(5)]
    got = R.nearest_images(
        spark.createDataFrame(images, "image_id long, product_id long, family string, vec_id long"), spark.createDataFrame(queries, "query_id long, family string, embedding array<double>"),
        spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"), 40,
    )
    cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.dist(a, [0] * 4) / math.dist(b, [0] * 4), 6)
    want = []
    for q, family, e in queries:
        near = sorted((-cosine(e, vectors[v]), p, i) for i, p, f, v in images if f == family and v in vectors)
        want += [(q, i, -s) for s, p, i in near[:40]]
    assert sorted((x.query_id, x.image_id, x.similarity) for x in got.collect()) == sorted(want)


def test_curves_read_the_trajectory_once(spark, tmp_path):
    path = f"file://{tmp_path}/path"
    spark.createDataFrame([(p, "t", k, (p + k) % 3, 0.5 * (k % 3)) for p in range(8) for k in range(1, 5)], "product_id long, visual_type string, position long, new_pairs long, coverage double").write.parquet(path)
    table = spark.read.parquet(path)
    for found in (K.marginal_curve(table), K.threshold_crossing(table)):
        assert found.count() and not [f for f in found.inputFiles() if f.startswith(path)]


def test_greedy_order_across_batches(spark):
    rows = [(p, k, f"f{k % 3}", f"v{(p * k) % 5}") for p in range(9) for k in range(1, 16)]
    table = spark.createDataFrame(rows, "product_id long, position long, field string, value string")
    want = sorted(map(tuple, K.oracle_order(table).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        assert sorted(map(tuple, K.oracle_order(table).collect())) == want and len(want) == 9 * 12
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_query_travels_once_for_a_chunk(spark):
    r = random.Random(4)
    images = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(600)], "image_id long, embedding array<double>")
    index = N.build_index(images, lists=40)
    queries = images.where("image_id < 20").withColumnRenamed("image_id", "query_id")
    assert index.chunks == 1
    assert index.candidates(queries, 20, 10).count() == 200
    assert index.rows.select("chunk").distinct().count() == 1 < index.rows.select("list").distinct().count()

"""What grows with the tables: work that a plan does once, and rows that its exchanges carry."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from fernhill.functions import vectors as V
from fernhill.operators import consensus as C, dictionary as D, vector_search as N
from fernhill.plans import delivery_queries as B, retrieval_queries as Q


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def exchanges(df):
    """The exchanges of a plan as it is before it runs."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange " in line and "Broadcast" not in line]


def test_words_of_a_text_are_made_once_and_only_texts_move(spark):
    conv = spark.createDataFrame([(1, 1, "of the end, with the start"), (1, 2, "the"), (2, 1, "thee und"), (2, 2, None)], "conv_id long, turn long, text string")
    found = Q.phrase_category(conv)
    assert optimized(found).count("split(") == 1
    assert len(exchanges(found)) == 1 and "window" not in exchanges(found)[0]
    assert sorted(map(tuple, found.collect())) == [(1001, "with the", "pair"), (1002, "the", "article"), (2001, "und", "german")]


def test_a_phrase_counts_once_at_its_first_place(spark):
    texts = spark.createDataFrame([(1, "a b a b"), (2, "b"), (3, None)], "id int, text string")
    phrases = spark.createDataFrame([("a b", "x"), ("a b", "x"), ("b", "y"), ("", "z"), (None, "z")], "phrase string, result string")
    got = D.phrase_hits(texts, phrases, "id", F.split("text", " "))
    assert sorted((r.id, r.phrase, r.result, r.at) for r in got.collect()) == [(1, "a b", "x", 0), (1, "b", "y", 1), (2, "b", "y", 0)]


def test_token_sums_need_one_exchange_of_texts(spark):
    rows = [(1, ["ab", "cd"]), (1, ["ab", None]), (2, []), (3, None)]
    found = V.hash_embed(spark.createDataFrame(rows, "id int, tokens array<string>"))
    assert len(exchanges(found)) == 1 and "Join" not in optimized(found)
    got = {r.id: r.vector for r in found.collect()}
    want = V.hash_embed(spark.createDataFrame([(1, ["ab", "ab", "cd"])], "id int, tokens array<string>")).first().vector
    assert got == {1: want, 2: [0.0] * 192, 3: [0.0] * 192} and abs(sum(x * x for x in want) - 1) < 1e-4


def test_pages_of_a_small_file_are_read_in_several_tasks(spark):
    products = spark.createDataFrame([(k, f"large ring {k}", "b", "SMALL", "ring", "large") for k in range(1, 40)], "product_id long, product_name string, brand string, a_level string, b_level string, c_level string").coalesce(1)
    found = B.page_attributes(products)
    assert "RepartitionByExpression" in optimized(found)
    assert found.count() == 39 and found.where("flag_reason IS NULL").count() > 20


def test_traits_are_dealt_once_for_the_best_image(spark):
    rows = [(p, i, f, f"v{(p * i + len(f)) % 3}") for p in range(4) for i in range(9) for f in ("a", "bb")] + [(9, 1, "a", None), (9, 2, "a", None), (9, 3, "a", "x"), (None, 1, "a", "x"), (8, 1, None, "x")]
    traits = spark.createDataFrame(rows, "product_id long, image_id long, field string, value string")
    agreed, best = C.product_consensus(traits)
    assert len(exchanges(best)) == 1
    hits = traits.join(agreed, ["product_id", "field"]).groupBy("product_id", "image_id").agg(F.sum((F.col("value") == F.col("consensus")).cast("long")).alias("n"))
    want = {}
    for r in hits.collect():
        want[r.product_id] = min(want.get(r.product_id, (9, 0, 0)), (r.n is None, -(r.n or 0), r.image_id))
    assert {r.product_id: (r.agreements is None, -(r.agreements or 0), r.image_id) for r in best.collect()} == want


def test_a_kernel_holds_few_similarities():
    r = np.random.default_rng(2)
    q, v = r.normal(size=(1000, 8)), r.normal(size=(5000, 8))
    tracemalloc.start()
    i, j, near = N.top_pairs(q, v, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
    every = np.round(q @ v.T, 6) + 0.0
    assert (j.reshape(1000, 10) == np.argsort(-every, 1, kind="stable")[:, :10]).all() and (i == np.repeat(np.arange(1000), 10)).all()
    assert (near == every[i, j]).all()

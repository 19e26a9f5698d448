"""Phrases of a large dictionary."""

import random

from pyspark.sql import functions as F

from fernhill.operators import dictionary as D


def test_ten_thousand_phrases_without_a_nested_loop(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    phrases = sorted({" ".join(r.choice(words) for _ in range(r.choice([1, 2, 2, 3, 5]))) for _ in range(12_000)})[:10_000]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(200)] + [(900, None), (901, ""), (902, "W1, w2! W1 w2")]
    table = spark.createDataFrame([(p, f"r{i}") for i, p in enumerate(phrases)], "phrase string, result string")
    found = D.phrase_match(spark.createDataFrame(texts, "id int, text string"), table, "id")
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = {}
    known = set(phrases)
    for i, text in texts:
        parts = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        hits = [(-len(p), at, p) for n in (1, 2, 3, 5) for at in range(len(parts) - n + 1) if (p := " ".join(parts[at : at + n])) in known]
        if hits:
            want[i] = min(hits)[2]
    assert {x.id: x.phrase for x in found.collect()} == want
    assert D.phrase_match(spark.createDataFrame(texts, "id int, text string"), table.limit(0), "id").count() == 0


def test_the_longest_brand_goes_from_everywhere(spark):
    texts = spark.createDataFrame([(1, "Chair by Acme Steel"), (2, "acme  acme stool"), (3, "no brand"), (4, None)], "id int, text string")
    brands = spark.createDataFrame([("Acme",), ("ACME Steel",), ("",), (None,), ("Acme",)], "brand string")
    got = D.annotate_queries(texts, brands).orderBy("id").select("id", "brand", "residual").collect()
    assert [tuple(x) for x in got] == [(1, "ACME Steel", "chair by"), (2, "Acme", "stool")]
    assert D.annotate_queries(texts.where(F.lit(False)), brands).count() == 0

"""Language, toxicity and quality models, decontamination and the pipeline."""

import re
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from fernhill.llm import decontamination as dc, language_id as li, quality as q, toxicity as tx

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_language_on_held_out_documents(spark):
    rows = li.op4_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert sum(held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(docs):
    train = docs([(1, "the cat and the hat", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "x", None)], "doc_id long, text string, lang string")
    known = li.prototypes(train)
    assert sorted(known) == ["de", "en"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.identify(docs([(1, None), (2, ""), (3, "123 !"), (4, "und die Hunde" * 500), (None, "the hat")]), known).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "de" and got[None][0] == "en"
    assert li.prototypes(train.limit(0)) == {} and li.identify(docs([(1, "a")]), {}).collect()[0].lang_pred == "und"


def test_toxicity_learns_words(docs):
    texts = [f"word{i % 17} other{i % 5} {'vile' if i % 3 == 0 else 'mild'} end{i % 7}" for i in range(240)]
    frame = docs([*enumerate(texts), (900, None), (901, "no label")])
    labels = docs([(i, int(i % 3 == 0)) for i in range(240)] + [(900, 1), (5, None)], "doc_id long, toxic int")
    weights = tx.train(frame, labels)
    got = {r.doc_id: r.toxicity for r in tx.score_toxicity(docs([(1, "a VILE thing"), (2, "a mild thing"), (3, None), (4, ""), (4, "vile " * 20000)]), weights).collect() if r.doc_id != 4}
    assert got[1] > 0.5 > got[2] and 0 <= got[3] <= 1
    assert (np.count_nonzero(weights) < 500) and not tx.train(frame.limit(0), labels).any()
    assert tx.score_toxicity(docs([]), weights).count() == 0


def statistics_brute(t):
    t = t or ""
    w = WORDS.findall(t)
    c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    again = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(x in q.SYMBOLS for x in t), len(lines) - len(set(lines)), len(again)


def test_statistics(docs):
    rows = [(1, None), (2, ""), (3, "a b c a b c\na b c\na b c"), (4, "é ß\x0b日本 #*$%&|<>\n \n\n"), (5, "\n\nx\nx\nx"), (6, "one two three " * 4000), (None, "no id")]
    got = {r.doc_id: tuple(r[c] for c in q.COUNTS) for r in q.document_statistics(docs(rows)).collect()}
    assert got == {i: statistics_brute(t) for i, t in rows}


def test_trees_fall_with_the_named_features():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] - x[:, 1] + 0.5 * rng.normal(size=3000) > 0).astype(float)
    trees = q.fit_trees(x, y, falling=[1], rounds=20)
    assert ((trees.score(x) >= 0.5) == (y == 1)).mean() > 0.85
    grid = np.repeat(rng.normal(size=(50, 3)), 40, 0)
    grid[:, 1] = np.tile(np.linspace(-3, 3, 40), 50)
    assert (np.diff(trees.score(grid).reshape(50, 40), axis=1) <= 1e-12).all()


def test_quality_without_labels(docs):
    rows = docs([(1, " ".join(f"w{k}" for k in range(60))), (2, "short"), (3, "a b c " * 50), (4, None)])
    got = {r.doc_id: (r.base_failed, r.kept) for r in q.score_quality(rows, docs([], "doc_id long, quality int")).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (True, False), 4: (True, False)}


def test_decontamination(docs):
    item = " ".join(f"item{k}" for k in range(30))
    changed = item.replace("item12", "other").replace("item20", "else")
    half = " ".join(f"item{k}" for k in range(9)) + " " + " ".join(f"new{k}" for k in range(40))
    rows = [(1, f"before {item} after"), (2, f"x, {changed.upper()}! y"), (3, half), (4, None), (5, "clean words " * 3000), (6, "tiny item of eight words here now ok"), (None, item), (1, f"before {item} after")]
    items = docs([(10, item), (11, "tiny item of eight words here now ok"), (12, None), (None, item), (13, "too short")], "item_id long, text string")
    got = dc.find_leaks(docs(rows), items)
    found = Counter((r.doc_id, r.item_id, r.overlap_words, r.matched_words) for r in got.collect())
    assert found == Counter({(1, 10, 30, 30): 1, (2, 10, 30, 28): 1, (6, 11, 8, 8): 1, (None, 10, 30, 30): 1})
    assert dc.find_leaks(docs([]), items).count() == 0 and dc.find_leaks(docs(rows), items.limit(0)).count() == 0


def test_masks_miss_no_fifth():
    spans = lambda mask: {k for k, x in enumerate(mask) if x == "1"}
    for n in (13, 15, 20, 25):  # any longer stretch holds one of these with as few substitutions
        places = [frozenset(k + o for k in spans(mask)) for mask in dc.MASKS for o in range(n - len(mask) + 1)]
        assert all(any(p.isdisjoint(gone) for p in places) for gone in combinations(range(n), n // 5))
    for n in range(1, dc.LONG):
        assert all(any(spans(mask) and spans(mask).isdisjoint(gone) for mask in dc.short_masks(n)) for gone in combinations(range(n), n // 5))


def test_decontamination_with_a_fifth_substituted(docs):
    rows, items, want = [], [], {}
    for n in (*range(1, 14), 15, 20, 40):
        item = [f"n{n}w{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        some = list(combinations(range(n), n // 5))[: 100 if n < 14 else 40]
        for gone in [*some, tuple(range(4, n, 5))]:
            rows.append((len(rows), " ".join(["a", "b", *("x" if k in gone else w for k, w in enumerate(item)), "c"])))
            want[rows[-1][0]] = n
        if n > 4:
            rows.append((len(rows), " ".join("x" if k <= n // 5 else w for k, w in enumerate(item[:13]))))  # one too many
    got = dc.find_leaks(docs(rows), docs(items, "item_id long, text string")).collect()
    assert {r.doc_id: r.item_id for r in got if r.doc_id in want} == want
    assert all(r.matched_words >= 0.8 * r.overlap_words and r.overlap_words >= min(13, r.item_id) for r in got)
    assert not {r.doc_id for r in got if r.item_id < 14} - set(want)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, want = docs, {r.doc_id for r in docs.collect()}
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, kept, SF)
        out.write.parquet(f"file://{tmp_path}/{k}")
        out = spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < 4:
            assert out.columns == docs.columns
            assert out.where("n_chars <> length(text)").count() == 0
            kept = out
    assert [name for name, _ in cp.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "packing"]
    left = {r.doc_id for r in kept.select("doc_id").collect()}
    assert left <= want and len(left) > 0.6 * len(want)
    assert {r.doc_id for r in out.select("doc_id").collect()} == left
    assert dc.find_leaks(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert cp.run(spark, SF).select(F.countDistinct("doc_id")).collect()[0][0] == len(left)

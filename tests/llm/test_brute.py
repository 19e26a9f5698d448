"""Models, decontamination and the pipeline's stages against plain versions, and held-out quality."""

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from fernhill.llm import decontamination as dc, language_id as li, quality as q, toxicity as tx

SF = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# ---- language --------------------------------------------------------------------------------


def plain_profile(text):
    """The sum over all letters of the bound vectors of the letter and its neighbours, one by one."""
    letters, slots = li._letter_vectors().astype(np.int64), li._slots()
    out = np.zeros(li.DIM, np.int64)
    t = f" {text.lower()} "
    for before, at, after in zip(t, t[1:], t[2:]):
        if slots[ord(at)]:
            a, b, c = (letters[slots[ord(x)]] for x in (before, at, after))
            out += np.roll(a, 2) * np.roll(b, 1) * c
    return out


def odd_texts(seed, n):
    r = random.Random(seed)
    alphabets = ["abc dé.", "日本語文字 。", "aİßΣσ 1_", "\n\t !?", "abcdefghij klmnop"]
    return ["".join(r.choice(r.choice(alphabets)) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["", "a", "İ", "日" * 90]


@pytest.mark.parametrize("chars,grams", [(1_000_000, 20_000), (7, 5), (1, 1), (64, 3)])
def test_profiles_equal_plain_sums(monkeypatch, chars, grams):
    monkeypatch.setattr(li, "CHARS", chars)
    monkeypatch.setattr(li, "GRAMS", grams)
    texts = odd_texts(1, 40)
    assert (li.profiles(texts) == np.array([plain_profile(t) for t in texts])).all()


def test_a_large_alphabet_takes_little_memory():
    import tracemalloc

    r = np.random.default_rng(2)
    text = "".join(map(chr, r.integers(0x4E00, 0x9FA5, 600_000)))
    li.profiles(["warm"])
    tracemalloc.start()
    found = li.profiles([text])
    assert tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()
    half = len(text) // 2
    assert np.abs(found - li.profiles([text[:half]]) - li.profiles([text[half:]])).max() <= 4  # but for the grams at the cut


def test_language_equals_a_plain_classifier(docs):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the hat", "en"), ("this is english text", "en"), ("der Hund und die Katze", "de"), ("und das ist deutsch", "de"), ("日本語の文字", "ja"), (None, "en"), ("no language", None), ("12", "de")])]
    train += [train[0]]
    known = li.prototypes(docs(train, "doc_id long, text string, lang string"))
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    want = {lang: unit(sum(unit(plain_profile(t)) for _, t, x in train if x == lang and t)) for lang in ("de", "en", "ja")}
    assert known.keys() == want.keys() and all(np.allclose(known[k], want[k], atol=1e-5) for k in want)
    rows = [*enumerate(odd_texts(3, 60)), (500, None), (500, None), (501, "the the the"), (None, "und")]
    frame = docs([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, lang_pred string, score double")

    def one(t):
        v = plain_profile(t or "")
        cosines = [float(unit(v) @ want[k]) for k in want]
        return ("und", 0.0) if not v.any() else ([*want][int(np.argmax(cosines))], (1 + max(cosines)) / 2)

    order = lambda x: (x[0] is None, x[0] or 0)
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in li.identify(frame, known).collect()), key=order)
    plain = sorted(((i, *one(t)) for i, t in rows), key=order)
    assert [x[:2] for x in got] == [x[:2] for x in plain] and np.allclose([x[2] for x in got], [x[2] for x in plain], atol=1e-5)
    assert li.identify(frame.limit(0), known).count() == 0


# ---- toxicity --------------------------------------------------------------------------------


def test_ftrl_equals_a_plain_version():
    r = random.Random(4)
    rows = [sorted(r.sample(range(40), r.randint(0, 8))) for _ in range(120)]
    labels = [int((3 in x) or (7 in x and r.random() < 0.8)) for x in rows]
    z, n, bias = Counter(), Counter(), 2**tx.BITS
    alpha, beta, l1, l2 = 0.5, 1.0, 0.5, 1.0

    def weight(i):
        cut = 0.0 if i == bias else l1
        return 0.0 if abs(z[i]) <= cut else (math.copysign(cut, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(3):
        for x, y in zip(rows, labels):
            w = {i: weight(i) for i in [*x, bias]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in w:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    got = tx.fit_ftrl([tx._pack(np.array(x, np.int64)) for x in rows], labels, epochs=3, l1=l1)
    want = np.zeros(2**tx.BITS + 1)
    for i in [*range(40), bias]:
        want[i] = weight(i)
    assert np.allclose(got, want, atol=1e-9) and np.count_nonzero(got) < 40


def test_features_are_words_pairs_and_pairs_around_one_word():
    text = "One two, THREE four_five two"
    doc, found = tx.features([b"", text.encode(), text.lower().encode(), b"one"])
    by = [set(found[doc == k]) for k in range(4)]
    assert not by[0] and by[1] == by[2] and len(by[3]) == 1
    # 5 different words of 6, 5 neighbours and 4 pairs around a word
    assert len(found[doc == 1]) == 6 + 5 + 4 and len(by[1]) == 5 + 5 + 4


def test_scores_equal_sums_of_weights(docs):
    r = np.random.default_rng(5)
    texts = ["vile words here", "", None, "vile VILE vile", "nothing known"]
    weights = np.zeros(2**tx.BITS + 1)
    _, some = tx.features([b"vile words here"])
    weights[some], weights[-1] = r.normal(size=len(some)), -0.3
    frame = docs([(i, t, 9.0) for i, t in enumerate(texts)] * 2, "doc_id long, text string, toxicity double")
    got = tx.score_toxicity(frame, weights)
    assert got.columns == frame.columns and got.count() == 10
    for row in got.collect():
        _, keys = tx.features([(texts[row.doc_id] or "").encode()])
        assert row.toxicity == pytest.approx(1 / (1 + math.exp(-weights[-1] - weights[np.unique(keys)].sum())))
    assert [row.toxicity for row in got.where("doc_id in (1, 2)").collect()] == [pytest.approx(1 / (1 + math.exp(0.3)))] * 4


def auc(scores, labels):
    one, zero = ([s for s, y in zip(scores, labels) if y == k] for k in (1, 0))
    return sum((a > b) + 0.5 * (a == b) for a in one for b in zero) / (len(one) * len(zero))


def test_toxicity_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = tx.op6_toxicity(spark, SF).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    assert len(rows) > 50 and auc([r.score for r in rows], [r.toxic for r in rows]) > 0.85


# ---- quality ---------------------------------------------------------------------------------


def test_quality_on_the_other_half_of_the_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").where("quality IS NOT NULL")
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = q.score_quality(docs, labels.where(half)).join(labels.where(~half).select("doc_id", "quality"), "doc_id").collect()
    good = [r.kept == bool(r.quality) for r in rows if not r.base_failed]
    share = Counter(r.quality for r in rows if not r.base_failed)
    assert len(good) > 50 and sum(good) / len(good) >= max(share.values()) / len(good)


def test_quality_of_odd_rows(docs):
    words = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(i, words(i, 60 + i % 7) + (" #*$%" * 30 if i % 2 else "")) for i in range(80)]
    rows += [rows[0], rows[0], (None, "a b"), (None, None), (900, words(1, 49)), (901, words(1, 50)), (902, words(1, 70) + " a b c" * 40)]
    labels = [(i, 1 - i % 2) for i in range(80)] + [(3, 0), (None, 1), (901, None)]
    frame = docs([(i, t, True, 5) for i, t in rows], "doc_id long, text string, kept boolean, n_words int")
    got = q.score_quality(frame, docs(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows) and Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    by = {r.doc_id: r for r in got}
    assert by[900].base_failed and not by[901].base_failed and by[902].base_failed and by[None].base_failed and not by[902].kept
    assert sum(by[i].kept == (i % 2 == 0) for i in range(80)) >= 76
    assert q.score_quality(frame.limit(0), docs(labels, "doc_id long, quality int")).count() == 0


# ---- decontamination -------------------------------------------------------------------------


def plain_leaks(rows, items, least=13, share=0.8):
    """Every item laid on every text at every shift, every stretch of it."""
    words = lambda t: [w.lower() for w in re.findall(r"[A-Za-z0-9]+", t or "")]
    out = set()
    for i, text in rows:
        for j, item in items:
            a, b = words(text), words(item)
            need = min(least, len(b))
            for shift in range(-len(b), len(a)) if b and j is not None and item is not None else ():
                same = [0 <= k + shift < len(a) and a[k + shift] == b[k] for k in range(len(b))]
                lo, hi = max(0, -shift), min(len(b), len(a) - shift)
                if any(sum(same[x:y]) >= share * (y - x) - 1e-9 for x in range(lo, hi) for y in range(x + need, hi + 1)):
                    out.add((i, j))
                    break
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_leaks_equal_all_alignments(docs, seed):
    r = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(40 if seed < 3 else 6)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(text(r.choice([3, 8, 12, 13, 14, 20, 30])))) for k in range(12)] + [(None, "x y z"), (99, None), (98, "")]
    rows = []
    for k in range(40):
        words = text(r.randint(0, 30))
        _, item = r.choice(items[:12])
        part = item.split()[r.randint(0, 4) :]
        part = [w if r.random() > r.choice([0, 0.1, 0.2, 0.3]) else "zz" for w in part]
        rows.append((k, " ".join(words[:10] + part + words[10:]).upper() if k % 5 == 0 else ", ".join(words[:10] + part + words[10:])))
    rows += [(100, None), (101, ""), rows[0]]
    got = {(x.doc_id, x.item_id) for x in dc.find_leaks(docs(rows), docs(items, "item_id long, text string")).collect()}
    assert got == plain_leaks(rows, items)


def test_a_text_of_one_word_many_times(docs):
    rows = [(1, "same " * 60_000), (2, "same " * 12), (3, "other " * 50)]
    items = [(1, "same " * 20), (2, "same " * 12), (3, "same same other")]
    got = {(r.doc_id, r.item_id, r.overlap_words) for r in dc.find_leaks(docs(rows), docs(items, "item_id long, text string")).collect()}
    assert got == {(1, 1, 20), (1, 2, 12), (2, 2, 12)}


# ---- pipeline --------------------------------------------------------------------------------


def corpus():
    r = random.Random(9)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared = ["a line that three documents hold, once each", "Another shared line of some length"]
    rows = [(i, text(60)) for i in range(30)]
    rows += [(40 + k, "\n".join([text(20), shared[k % 2].upper() if k == 2 else f" {shared[k % 2]} ", text(20)])) for k in range(8)]
    near = text(80).split()
    rows += [(60 + k, " ".join(near[:78 - k] + ["x"] * k)) for k in range(5)] + [(70, " ".join(near)), (70, " ".join(near)), (71, text(70)), (71, text(70))]
    rows += [(80, None), (81, ""), (82, "\n\n"), (None, text(50)), (None, None), (83, "one two three")]
    return [(i, t, "en", None, len(t or ""), f"extra{k}") for k, (i, t) in enumerate(rows)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_key string"


@pytest.fixture
def tables(spark, docs, tmp_path):
    items = [(1, "leak " + " ".join(f"b{k}" for k in range(20))), (2, None)]
    docs(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs([(i, 0, int(i < 10)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    rows = corpus() + [(90, f"before {items[0][1]} after", "en", None, 5, "x"), (91, "leak b1 b2", "en", None, 5, "y")]
    return f"file://{tmp_path}", rows, items


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_stage_toxicity(spark, docs, tables):
    sf, rows, _ = tables
    toxic = [(i, f"{t} vile" if i is not None and i < 10 else t, *x) for i, t, *x in rows]
    frame = docs(toxic, SCHEMA)
    weights = tx.train(frame, spark.read.parquet(f"{sf}/labels.parquet"))
    def score(t):
        _, keys = tx.features([(t or "").encode()])
        return 1 / (1 + math.exp(-weights[-1] - weights[np.unique(keys)].sum()))
    got = cp.reject_toxic(spark, frame, sf)
    assert got.columns == frame.columns and rows_of(got) == Counter(r for r in toxic if score(r[1]) < 0.5)
    assert rows_of(got) != rows_of(frame) and cp.reject_toxic(spark, frame.limit(0), sf).count() == 0


def test_stage_line_dedup(spark, docs, tables):
    sf, rows, _ = tables
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders: dict = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    order = lambda i: (i is not None, i)
    def clean(i, t):
        return "\n".join(x for x in (t or "").split("\n") if len(holders.get(key(x), ())) < 3 or i == max(holders[key(x)], key=order))
    got = {(r.doc_id, r.text_key): (r.text or "", r.n_chars) for r in cp.dedup_lines(spark, docs(rows, SCHEMA), sf).collect()}
    assert got.keys() == {(r[0], r[5]) for r in rows}
    for i, t, *_, k in rows:
        assert got[i, k] == (clean(i, t), len(clean(i, t)))
    assert cp.dedup_lines(spark, docs([], SCHEMA), sf).count() == 0


def shingles(t):
    w = ["".join(c.lower() if c.isascii() else c for c in x) for x in WORDS.findall(t or "")]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_stage_near_duplicates(spark, docs, tables):
    sf, rows, _ = tables
    rows = [r for r in rows if r[0] is not None]
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least: dict = {}
    for k, r in enumerate(rows):
        least[find(k)] = min(least.get(find(k), r[0]), r[0])
    want = Counter(r for k, r in enumerate(rows) if r[0] == least[find(k)])
    got = cp.dedup_near(spark, docs(rows, SCHEMA), sf)
    assert got.columns == docs(rows, SCHEMA).columns and rows_of(got) == want and sum(want.values()) < len(rows)
    assert cp.dedup_near(spark, docs([], SCHEMA), sf).count() == 0


def test_stage_decontamination(spark, docs, tables):
    sf, rows, items = tables
    gone = {(i, t) for i, t, *_ in rows if plain_leaks([(i, t)], items)}
    got = cp.drop_leaks(spark, docs(rows, SCHEMA), sf)
    assert rows_of(got) == Counter(r for r in rows if (r[0], r[1]) not in gone) and {i for i, _ in gone} == {90}
    assert cp.drop_leaks(spark, docs([], SCHEMA), sf).count() == 0


def test_stage_packing(spark, docs, tables):
    sf, rows, _ = tables
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r[0], tuple([*library.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in rows)
    got: Counter = Counter()
    pieces = cp.pack(spark, docs(rows, SCHEMA), sf).collect()
    for p in pieces:
        assert p.start == 0 and p.length == p.doc_tokens  # all are shorter than a sequence
        got[p.doc_id, tuple(np.frombuffer(p.ids, "<u4").tolist())] += 1
    assert got == want
    ends: dict = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == ends.get(p.sequence_id, 0)
        ends[p.sequence_id] = p.offset + p.length
    assert max(ends.values()) <= 2048 and cp.pack(spark, docs([], SCHEMA), sf).count() == 0

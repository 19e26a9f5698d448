"""Packing and wavelet output against the tokenizers themselves."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fernhill.llm import _tokens, token_output as out
from fernhill.llm.packing import first_fit_decreasing, pack_documents

ROWS = [(3, "Hello there, world.\n\nTwo  spaces and ÀÉ."), (1, None), (2, ""), (7, "a b " * 3000), (7, "x"), (None, "no id"), (5, "Iİ.Σσ <|endoftext|> don't"), (8, "a <|endoftext|> b"), (9, "x.<|ENDOFTEXT|>.y <|startoftext|>"), (10, "日本。 a\u2003 b\xa0 c — d. 😀 e, ÷. " + "q" * 3000)]


def ids_of(name, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for _, x in ROWS]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_of_text_have_the_text_s_ids(name):
    r = random.Random(1)
    alphabet = [*"aB é'sS.,;!?\n\t  0 9Σσİß\xa0\x1c -_|<>日本ÀÉ", "<|endoftext|>", "'ll", "  ", "\n\n", ". ", "\u2003", "\u3000", "😀", "—", "÷", "<|", "\x7f", "\u0301"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    t = Tokenizer.from_file(public_tokenizers.path(name))
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time by the pieces that are known
        ids, counts = _tokens.encoder(public_tokenizers.path(name)).encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    ids, counts = _tokens.encoder(public_tokenizers.path(name)).encode(pa.array(["x", None, *texts])[1:4])
    assert counts[0] == 0 and ids.tolist() == want[0] + want[1]


def test_pieces_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(_tokens, "spans", lambda data, start, end: (end - start).astype(np.uint64) << np.uint64(40))
    t, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), _tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), "<u2")
    for text in ("one two ten", "ten six two and seventeen", "six and seventeen eighteens"):
        assert own.encode(pa.array([text]))[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_first_fit_decreasing_is_first_fit():
    r = np.random.default_rng(2)
    for n in (1, 2, 7, 200):
        sizes = r.integers(1, 100, n)
        bins, offsets = first_fit_decreasing(sizes, 100)
        room: list[int] = []
        for i in np.argsort(-sizes, kind="stable"):
            b = next((k for k, x in enumerate(room) if x >= sizes[i]), len(room))
            room += [100] * (b == len(room))
            assert (bins[i], offsets[i]) == (b, 100 - room[b])
            room[b] -= sizes[i]


def test_packing_round_trip(docs):
    pieces = pack_documents(docs(ROWS), public_tokenizers.path("byte_bpe_50k.json"), capacity=512, docs_per_group=2).collect()
    want = sorted(tuple(x) for x in ids_of("byte_bpe_50k.json", 1))
    by_doc: dict = {}
    sequences: dict = {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted(tuple(i for _, ids in sorted(v) for i in ids) for v in by_doc.values()) == want
    for v in sequences.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 512
    assert pack_documents(docs([]), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_repeated_rows_spread_over_the_groups(spark, tmp_path):
    path = f"file://{tmp_path}/same"
    spark.range(100_000).selectExpr("cast(null as bigint) AS doc_id", "case when id % 2 = 0 then 'same text' end AS text").repartition(4).write.parquet(path)
    pieces = pack_documents(spark.read.parquet(path), public_tokenizers.path("byte_bpe_50k.json"), from_files=True)
    found = pieces.selectExpr("sequence_id >> 40 AS g", "length").groupBy("g").agg({"*": "count", "length": "sum"}).collect()
    assert sum(r["count(1)"] for r in found) == 100_000 and len(found) == 100_000 // 512
    assert max(r["count(1)"] for r in found) < 700 and sum(r["sum(length)"] for r in found) == 50_000 * 3 + 50_000


def test_wavelet_matrix():
    ids = np.random.default_rng(3).integers(0, 37, 3000).astype(np.uint16)
    m = out.WaveletMatrix.from_bytes(out.WaveletMatrix.build(ids, 6).to_bytes())
    assert (m.decode() == ids).all()
    for i in (0, 511, 512, 2999):
        assert m.access(i) == ids[i]
    for v in (0, 5, 36):
        places = np.flatnonzero(ids == v)
        assert m.count(v) == len(places) and m.count(v, 100, 900) == ((places >= 100) & (places < 900)).sum()
        assert [m.occurrence(v, k) for k in range(len(places))] == places.tolist()


def test_shards(spark, docs, tmp_path):
    path = f"file://{tmp_path}/shards"
    out.write_shards(docs(ROWS), path, public_tokenizers.path("word_bpe_49k.json"), docs_per_shard=3)
    shards = spark.read.parquet(path)
    assert shards.count() > 1
    ids = ids_of("word_bpe_49k.json", 2)
    got = out.read_documents(shards).orderBy("start").collect()
    key = lambda x: -1 if x is None else x
    assert [r.doc_id for r in got] == sorted((i for i, _ in ROWS), key=key)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((str(i), x) for (i, _), x in zip(ROWS, ids))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert out.count_token(shards, 2).groupBy().sum("n").collect()[0][0] == sum(x.count(2) for x in ids)
    assert out.find_token(shards, 2, 2).where("n > 0").count() > 0
    empty = f"file://{tmp_path}/none"
    out.write_shards(docs([]), empty, public_tokenizers.path("word_bpe_49k.json"))
    assert out.read_documents(spark.read.schema(shards.schema).parquet(empty)).count() == 0

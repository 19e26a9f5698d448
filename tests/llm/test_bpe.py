"""Encoding by the word trie, and decoding, against the tokenizers library."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, decoders, models, pre_tokenizers

from fernhill.llm import _tokens, bpe
from test_tokens import ROWS

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def texts_for(vocab, seed):
    r = random.Random(seed)
    odd = [*"aB é'sS.,;!?\n\t  0 9Σσİß\xa0\x1c -_|<>日本ÀÉ", "<|endoftext|>", "<|startoftext|>", "'ll", ". ", " ", "　", "😀", "<|", "\x7f", "́"]
    out = ["".join(r.choice(odd) for _ in range(r.randint(0, 40))) for _ in range(800)]
    out += ["".join(r.choice("aabbcdelnrst") for _ in range(r.randint(1, 30))) for _ in range(3000)]
    out += ["".join(r.choice("a=") for _ in range(r.randint(1, 60))) for _ in range(300)]
    out += ["".join(w.replace("</w>", "").replace("Ġ", " ") for w in r.sample(vocab, 3)) for _ in range(2000)]
    return out + [c * n for c in ("a", "=", "ha") for n in range(0, 300, 7)]


@pytest.mark.parametrize("name", FILES)
def test_trie_gives_the_library_s_ids_and_texts(name):
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), bpe.TrieEncoder(path)
    table, spell = bpe.decoder(path)
    for seed in (1, 2):  # the second time with nodes of the first
        texts = texts_for(list(library.get_vocab()), seed)
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        ids, counts = own.encode(pa.array(texts))
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == want
        assert [spell([table[i] for i in x]) for x in got] == [library.decode(x, skip_special_tokens=False) for x in got]


def test_shared_beginnings_are_computed_once(monkeypatch):
    model = json.loads(Tokenizer.from_file(public_tokenizers.path(FILES[0])).to_str())["model"]
    trie, steps = bpe.WordTrie(model), []
    step = trie._step
    trie._step = lambda word, states, *more: steps.append(word[: len(states) + 1]) or step(word, states, *more)
    trie.encode({"interest", "interesting", "interested"})
    # seven shared letters of "interest", then its marked end; "t" once within; "ed" and "ing" with marked ends
    assert len(steps) == 7 + 1 + 1 + 2 + 3
    trie.encode({"interested"})
    assert len(steps) == 14
    monkeypatch.setattr(bpe, "NODES", 5)
    monkeypatch.setattr(bpe, "PAIRS", 2)
    monkeypatch.setattr(bpe, "LONG_WORD", 6)
    library = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    for word in ("interest", "into", "in", "unbelievable", "abc"):
        assert trie.encode({word})[word] == library.encode(word, add_special_tokens=False).ids
    assert len(trie.last) < 12


def test_other_tokenizers_are_encoded_whole_or_refused(tmp_path):
    vocab = {c: i for i, c in enumerate("abc")} | {"ab": 3, "abc": 4, "bc": 5}
    t = Tokenizer(models.BPE(vocab=vocab, merges=[("a", "b"), ("ab", "c"), ("b", "c")]))
    t.pre_tokenizer, t.decoder = pre_tokenizers.Sequence([pre_tokenizers.Split("c", "merged_with_next"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]), decoders.ByteLevel()
    t.save(path := str(tmp_path / "own.json"))
    texts = ["abcab", "abc", "bcbcab", "", "cabcabba"]
    want = [e.ids for e in t.encode_batch(texts)]
    for own in (bpe.TrieEncoder(path), _tokens.Encoder(path, "<u2")):
        ids, counts = own.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.save(path)
    with pytest.raises(ValueError):
        bpe.TrieEncoder(path)


@pytest.mark.parametrize("name", FILES)
def test_documents_round_trip(docs, name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    rows = [(i, t, "x", [1]) for i, t in ROWS] + [(7, "x", None, None), (11, "word" * 50_000, "y", None)]
    table = docs(rows, "doc_id long, text string, lang string, ids array<int>")
    ids = bpe.encode_documents(table.repartition(3), path)
    assert ids.columns == ["doc_id", "lang", "ids"]
    want = [(i, lang, library.encode(t or "", add_special_tokens=False).ids) for i, t, lang, _ in rows]
    assert sorted(((r.doc_id, r.lang, list(r.ids)) for r in ids.collect()), key=repr) == sorted(want, key=repr)
    back = bpe.decode_documents(ids.withColumn("text", ids["doc_id"]), path)
    assert back.columns == ["doc_id", "lang", "text"]
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((i, lang, library.decode(x, skip_special_tokens=False)) for i, lang, x in want), key=repr)
    assert bpe.encode_documents(docs([]), path).count() == 0
    both = bpe.encode_documents(table.repartition(3), path, out_col="tokens", decoded_col="lang")
    assert both.columns == ["doc_id", "ids", "tokens", "lang"]
    assert sorted(((r.doc_id, list(r.tokens), r.lang) for r in both.collect()), key=repr) == sorted(((i, x, library.decode(x, skip_special_tokens=False)) for i, _, x in want), key=repr)
    odd = docs([(1, None), (2, []), (3, [0, None, -1, 10**8, 1])], "doc_id long, ids array<int>")
    assert [r.text for r in bpe.decode_documents(odd, path).orderBy("doc_id").collect()] == ["", "", library.decode([0, 1], skip_special_tokens=False)]


def test_op11_digests(spark):
    got = {r.doc_id: r for r in bpe.op11_bpe(spark, "/root/testdata/sf0.001").collect()}
    library = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(got)
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))

"""Language ID with hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fernhill.llm._shared import bounded_sample, documents, id_crc

DIM = 512
#: Letters below this code point have a vector each; others share the slots above it by a hash.
OWN, SLOTS = 592, 1024
N = 3
#: Characters of a piece of text, and different n-grams whose vectors are there at once.
CHARS, GRAMS = 1_000_000, 20_000

_tables: dict = {}


def _letter_vectors() -> np.ndarray:
    """A random vector of +1 and -1 for each letter slot; slot 0 is the space between words."""
    if "letters" not in _tables:
        _tables["letters"] = np.random.default_rng(7).choice(np.array([-1, 1], np.int8), (SLOTS, DIM))
    return _tables["letters"]


def _slots() -> np.ndarray:
    """Slot of each code point: 0 unless it is a letter."""
    if "slots" not in _tables:
        code = np.arange(0x110000)
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        slot = np.where(code < OWN, code, OWN + code * 2654435761 % (SLOTS - OWN))
        _tables["slots"] = np.where(letter, slot, 0).astype(np.int64)
    return _tables["slots"]


def _gram_vectors(grams: np.ndarray) -> np.ndarray:
    """n-gram vectors: the letters' vectors, permuted by place (rolled) and bound (multiplied)."""
    known, rows = _tables.setdefault("grams", ({}, []))
    if len(known) > 60_000:
        known.clear()
        rows.clear()
    new = [g for g in grams.tolist() if g not in known]
    if new:
        g = np.array(new)
        letters = _letter_vectors()
        made = np.ones((len(g), DIM), np.int8)
        for place in range(N):
            made *= np.roll(letters[g // SLOTS ** (N - 1 - place) % SLOTS], N - 1 - place, axis=1)
        for key, row in zip(new, made):
            known[key] = len(rows)
            rows.append(row)
    return np.array([rows[known[g]] for g in grams.tolist()], np.float32).reshape(-1, DIM)


def profiles(texts: list[str]) -> np.ndarray:
    """The bundled (summed) n-gram vectors of each text; zero where a text has no letter.

    Texts are taken in pieces of ``CHARS`` characters, whose grams add up, and grams in slices of ``GRAMS``,
    so that neither a long text nor a large alphabet needs much memory.
    """
    out = np.zeros((len(texts), DIM), np.float32)
    pieces: list[tuple[int, str, bool, bool]] = []
    size = 0
    for i, text in enumerate(texts):
        text = text.lower()
        for a in range(0, len(text), CHARS):
            # a neighbour on each side, which is no middle letter here
            pieces.append((i, text[max(0, a - 1) : a + CHARS + 1], a > 0, a + CHARS < len(text)))
            size += len(pieces[-1][1])
            if size >= CHARS:
                _bundle(pieces, out)
                pieces, size = [], 0
    if pieces:
        _bundle(pieces, out)
    return out


def _bundle(pieces: list[tuple[int, str, bool, bool]], out: np.ndarray) -> None:
    """Add the n-gram vectors of some pieces to their texts' sums."""
    sizes = np.fromiter((len(t) for _, t, _, _ in pieces), np.int64, len(pieces))
    starts = 1 + np.cumsum(sizes + 1) - sizes - 1
    code = np.frombuffer(("\n" + "\n".join(t for _, t, _, _ in pieces) + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    slot = _slots()[code]
    own = np.ones(len(slot), bool)
    own[starts[[before for _, _, before, _ in pieces]]] = False
    own[(starts + sizes - 1)[[after for _, _, _, after in pieces]]] = False
    keep = np.ones(len(slot), bool)
    keep[1:] = (slot[1:] > 0) | (slot[:-1] > 0)  # one space for any run of other characters
    at = np.flatnonzero(keep)
    slot, own = slot[at], own[at]
    gram = slot[:-2] * SLOTS**2 + slot[1:-1] * SLOTS + slot[2:]
    middle = (slot[1:-1] > 0) & own[1:-1]  # the middle letter gives the text
    gram, piece = gram[middle], np.searchsorted(starts, at[1:-1][middle], "right") - 1
    order = np.argsort(gram, kind="stable")
    gram, piece = gram[order], piece[order]
    heads = np.flatnonzero(np.diff(gram, prepend=-1))
    text = np.fromiter((i for i, _, _, _ in pieces), np.int64, len(pieces))
    for k in range(0, len(heads), GRAMS):
        some = heads[k : k + GRAMS]
        a, z = some[0], heads[k + GRAMS] if k + GRAMS < len(heads) else len(gram)
        column = np.repeat(np.arange(len(some)), np.diff(np.append(some, z)))
        counts = np.bincount(piece[a:z] * len(some) + column, minlength=len(pieces) * len(some)).reshape(len(pieces), -1)
        np.add.at(out, text, counts.astype(np.float32) @ _gram_vectors(gram[some]))


def _groups(batches, size: int = 128, max_chars: int = CHARS):
    for batch in batches:
        start, chars, texts = 0, 0, []
        for i, t in enumerate(batch.column(batch.schema.get_field_index("text"))):
            texts.append(t.as_py() or "")
            chars += len(texts[-1])
            if len(texts) == size or chars >= max_chars or i == batch.num_rows - 1:
                yield batch.slice(start, len(texts)), texts
                start, chars, texts = i + 1, 0, []


def prototypes(docs: DataFrame, max_train_rows: int = 20_000) -> dict[str, np.ndarray]:
    """A unit vector for each language: the sum of its documents' unit profiles.

    Learns from at most ``max_train_rows`` documents with a language, those with the smallest id
    hashes. Tasks add up their documents and Spark adds the sums, so that only a vector for each
    language comes to the driver. Rows that repeat count as often as they come; null texts and
    languages are left out, a text without letters adds nothing; an empty table gives no language.
    """
    some = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = bounded_sample(some.select("doc_id").distinct(), "doc_id", max_train_rows)

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for part, texts in _groups(batches):
            vectors = profiles(texts)
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            langs = part.column(1).to_pylist()
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + vectors[[x == lang for x in langs]].sum(0, dtype=np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    added = some.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id").select("text", "lang").mapInArrow(run, "lang string, v array<double>")
    rows = added.select("lang", F.posexplode("v").alias("dim", "x")).groupBy("lang", "dim").agg(F.round(F.sum("x"), 6).alias("x")).collect()
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r.lang, np.zeros(DIM))[r.dim] = r.x
    return {lang: v / max(np.linalg.norm(v), 1e-9) for lang, v in sorted(out.items())}


def identify(docs: DataFrame, known: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the language whose prototype has the largest cosine with the text.

    The score is (1 + cosine) / 2. Text that is null or has no letter, or any text when no language
    was learned, is ``und`` with score 0. Ties go to the language first in the alphabet. Rows that repeat
    come back as often; an empty table gives none.
    """
    names = [*known]
    matrix = np.array([known[k] for k in names], np.float32).reshape(-1, DIM)

    def run(batches):
        for part, texts in _groups(batches):
            vectors = profiles(texts)
            length = np.linalg.norm(vectors, axis=1)
            cosine = vectors @ matrix.T / np.maximum(length, 1e-9)[:, None]
            none = (length == 0) | (not names)
            best = cosine.argmax(1) if names else np.zeros(len(texts), int)
            pred = ["und" if x else names[i] for x, i in zip(none, best)]
            score = np.where(none, 0.0, np.clip((1 + (cosine.max(1) if names else 0)) / 2, 0, 1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    known = prototypes(docs.where(id_crc() % 4 != 2).select("doc_id", "lang", "text"))
    found = identify(docs.select("doc_id", "text"), known)
    return found.select("doc_id", (id_crc() % 4 == 2).alias("held_out"), "lang_pred", "score")

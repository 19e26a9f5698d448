"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from fernhill.llm._shared import bounded_sample, documents, id_crc
from fernhill.llm._words import Block, U, blocks, mix

BITS = 18

# letters, digits and bytes of wider characters make words; A-Z count as a-z
_BREAKS = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hashed feature of every word, word pair and pair around one word."""
    b = Block(texts, _LOWER, _BREAKS)
    words = b.words()
    found, docs = [words], [b.doc]
    for gap in (1, 2):
        same = b.doc[gap:] == b.doc[:-gap]
        found.append(mix(words[:-gap] * U(0x9E3779B97F4A7C15) + words[gap:] + U(gap))[same])
        docs.append(b.doc[gap:][same])
    return np.concatenate(docs), (np.concatenate(found) >> U(64 - BITS)).astype(np.int64)


def _pack(row: np.ndarray) -> bytes:
    """Distinct features of a text in ascending order, as compressed steps."""
    return zstandard.compress(np.diff(row, prepend=0).astype("<u4").tobytes(), 3)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(data), "<u4"), dtype=np.int64)


def fit_ftrl(rows: list[bytes], labels: list[int], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0) -> np.ndarray:
    """Weights (the last is the intercept) after some passes of FTRL-proximal.

    Each row has distinct features, as ``_pack`` made them. Rates are per coordinate; a weight is nonzero only
    where its sum of gradients exceeds ``l1``. The intercept is not penalised.
    """
    z, n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)
    penalty = np.full(2**BITS + 1, l1)
    penalty[-1] = 0

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) > penalty[i], (np.sign(zi) * penalty[i] - zi) / ((beta + np.sqrt(n[i])) / alpha + l2), 0.0)

    for _ in range(epochs):
        for row, label in zip(rows, labels):
            i = np.append(_unpack(row), 2**BITS)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weights(slice(None))


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = 20_000) -> np.ndarray:
    """Learn from at most ``max_train_rows`` labelled documents, those with the smallest id hashes.

    Tasks extract the features; FTRL goes through examples one by one, so that one task fits the
    bounded sample, in an order by another hash of the ids. Rows that repeat an id all count. Labels or texts that are null are left out; without both labels the
    weights are all zero but for the intercept.
    """
    marks = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = bounded_sample(marks, "doc_id", max_train_rows)
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    rows = rows.join(F.broadcast(chosen), "doc_id").select(F.xxhash64(F.lit(5), "doc_id").alias("order"), "toxic", "text")

    def extract(batches):
        for part, texts in blocks(batches):
            doc, found = features(texts)
            keys = np.unique(doc * 2**BITS + found)
            packed = [_pack(x) for x in np.split(keys % 2**BITS, np.searchsorted(keys, np.arange(1, len(texts)) * 2**BITS))]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(texts), np.int32)), part.column(0), part.column(1), pa.array(packed, pa.binary())], ["part", "order", "toxic", "features"])

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("features", "ascending")])
        w = fit_ftrl(table.column("features").to_pylist(), table.column("toxic").to_pylist())
        some = np.flatnonzero(w)
        return pa.table({"feature": some, "weight": w[some]})

    found = rows.mapInArrow(extract, "part int, order long, toxic int, features binary").groupBy("part").applyInArrow(fit, "feature long, weight double")
    out = np.zeros(2**BITS + 1)
    for r in found.collect():  # a row per feature slot at most
        out[r.feature] = r.weight
    return out


def score_toxicity(docs: DataFrame, weights: np.ndarray, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """The input with a column ``out_col``: the model's chance of the toxic label for the whole text.

    The weights go to the tasks as index and value arrays, at most 2^18 of them. Null or empty text
    gets the intercept's score; an input column of that name is replaced, repeated rows stay; an empty
    table gives none.
    """
    index = np.flatnonzero(weights[:-1])
    sparse, bias = (index, weights[index]), float(weights[-1])

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        dense = np.zeros(2**BITS)
        dense[sparse[0]] = sparse[1]
        for column in parts:
            found = [np.zeros(0)]
            for _, texts in blocks([pa.RecordBatch.from_arrays([column], ["text"])]):
                doc, keys = features(texts)
                some = dense[keys] != 0
                keys = np.unique(doc[some] * 2**BITS + keys[some])
                total = bias + np.bincount(keys >> BITS, dense[keys % 2**BITS], len(texts))
                found.append(1 / (1 + np.exp(-total)))
            yield pa.array(np.concatenate(found))

    return docs.withColumn(out_col, score(F.col(text_col)))


def op6_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    allowed = id_crc() % 5 != 0  # the bounded sample is drawn from these alone
    weights = train(docs.where(allowed), documents(spark, sf_dir, "labels").where(allowed))
    scored = score_toxicity(docs, weights)
    return scored.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))

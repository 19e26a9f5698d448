"""Quality rules: document statistics, base rules, and gradient-boosted trees with monotone splits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fernhill.llm._shared import bounded_sample, documents, materialise
from fernhill.llm._words import Block, blocks, heads, order_of, seen_twice, windows, with_doc

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

FEATURES = ["log_words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "digit_share", "upper_share", "punct_share", "words_per_line", "wide_share", "longest_word"]
#: The verdict may only fall as these rise.
FALLING = ("symbols_per_word", "dup_line_share", "repeat_share")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _marks(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _DIGIT, _UPPER = _marks(SYMBOLS.encode()), _marks(b"0123456789"), _marks(bytes(range(65, 91)))
_PUNCT = _marks(bytes(c for c in range(33, 127) if not chr(c).isalnum()))


def statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Counts and features of some whole texts."""
    b = Block(texts)
    words, n = b.words(), b.n
    n_words = np.bincount(b.doc, minlength=n)
    wide = b.data & 0xC0 == 0x80
    word_chars = b.per_doc(b.inside & ~wide)
    # lines with a word, by document; compared as they are
    lines = [[x for x in t.split(b"\n") if not x.isspace() and x] for t in texts]
    n_lines = np.fromiter(map(len, lines), np.int64, n)
    n_dup = n_lines - np.fromiter((len(set(x)) for x in lines), np.int64, n)
    # words in 3-word windows found twice or more
    at, triples = windows(words, b.doc, 3)
    at = at[seen_twice(with_doc(triples, b.doc[at]))]
    again = np.zeros(len(words) + 2, bool)
    for k in range(3):
        again[at + k] = True
    n_repeat = np.bincount(b.doc[again[: len(words)]], minlength=n)
    keys = with_doc(words, b.doc)
    order = order_of(keys)
    distinct = np.bincount(b.doc[order[heads(keys[order])]], minlength=n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, b.doc, b.word_end - b.word_start)
    size, some = np.maximum(b.end - b.start, 1), np.maximum(n_words, 1)
    n_symbols = b.per_doc(_SYMBOL[b.data])
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
        "log_words": np.log1p(n_words), "word_length": word_chars / some, "symbols_per_word": n_symbols / some, "dup_line_share": n_dup / np.maximum(n_lines, 1),
        "repeat_share": n_repeat / some, "distinct_share": distinct / some, "digit_share": b.per_doc(_DIGIT[b.data]) / size, "upper_share": b.per_doc(_UPPER[b.data]) / size,
        "punct_share": b.per_doc(_PUNCT[b.data]) / size, "words_per_line": n_words / np.maximum(n_lines, 1), "wide_share": b.per_doc(wide) / size, "longest_word": longest.astype(float),
    }


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts, features) of every whole text.

    Null text has no words; a null id stays null; rows that repeat come back as often; an empty table
    gives none.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), *((c, pa.float64()) for c in FEATURES)])

    def run(batches):
        for part, texts in blocks(batches):
            got = statistics(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(got[f.name], f.type) for f in schema if f.name != "doc_id")], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in FEATURES)]))


@dataclass
class Trees:
    """Trees as flat arrays [tree, node]; a leaf has feature -1 and its children are itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for f, t, left, right, v in zip(self.feature, self.threshold, self.left, self.right, self.value):
            node = np.zeros(len(x), np.int64)
            while (f[node] >= 0).any():
                node = np.where((f[node] < 0) | (x[rows, f[node]] <= t[node]), left[node], right[node])
            total += v[node]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, falling: list[int], rounds: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, l2: float = 1.0, least: float = 3.0) -> Trees:
    """Boosted trees for log-loss on histogram splits.

    A split on a falling feature must not give its right side the larger value, and both sides'
    subtrees are held to their side of the middle, so the whole score falls with the feature.
    """
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    total, size = np.full(len(x), bias), 2 ** (depth + 1) - 1
    out = [np.full((rounds, size), -1), np.zeros((rounds, size)), np.tile(np.arange(size), (rounds, 1)), np.tile(np.arange(size), (rounds, 1)), np.zeros((rounds, size))]
    for r in range(rounds):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        low, high = np.full(size, -np.inf), np.full(size, np.inf)
        node = np.zeros(len(x), np.int64)
        for level in range(depth + 1):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                if not len(rows):
                    continue
                g, h = grad[rows], hess[rows]
                out[4][r, k] = np.clip(-g.sum() / (h.sum() + l2), low[k], high[k])
                if level == depth or h.sum() < 2 * least:
                    continue
                best = (1e-6, -1, -1, 0.0, 0.0)
                for j, e in enumerate(edges):
                    gl = np.cumsum(np.bincount(binned[rows, j], g, len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, j], h, len(e) + 1))[:-1]
                    gr, hr = g.sum() - gl, h.sum() - hl
                    vl, vr = np.clip(-gl / (hl + l2), low[k], high[k]), np.clip(-gr / (hr + l2), low[k], high[k])
                    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - g.sum() ** 2 / (h.sum() + l2)
                    gain[(hl < least) | (hr < least) | ((vl < vr) if j in falling else False)] = 0
                    if len(gain) and gain.max() > best[0]:
                        i = int(gain.argmax())
                        best = (gain[i], j, i, vl[i], vr[i])
                if best[1] < 0:
                    continue
                _, j, i, vl, vr = best
                a, b = 2 * k + 1, 2 * k + 2
                out[0][r, k], out[1][r, k], out[2][r, k], out[3][r, k] = j, edges[j][i], a, b
                low[[a, b]], high[[a, b]] = low[k], high[k]
                if j in falling:
                    low[a] = high[b] = (vl + vr) / 2
                node[rows] = np.where(binned[rows, j] <= i, a, b)
        out[4][r] *= rate
        total += out[4][r][node]
    return Trees(*out, bias)


def score_quality(docs: DataFrame, labels: DataFrame, max_train_rows: int = 20_000) -> DataFrame:
    """Counts, base rules and the trees' verdict for every document.

    Statistics of all documents are written once; the trees learn on the driver from the statistics
    of at most ``max_train_rows`` labelled documents (the smallest hashes of their ids), and are
    applied to all rows in batches. Without labels of both kinds the verdict is the base rules'. A
    labelled id that repeats counts once, with its least features; rows that repeat come back as often;
    an empty table gives none.
    """
    stats = materialise(document_statistics(docs), "quality")
    marks = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = bounded_sample(marks, "doc_id", max_train_rows)
    sample = stats.select("doc_id", F.struct(*FEATURES).alias("x")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("quality").alias("quality"))
    rows = np.array([(*r.x, r.quality) for r in sample.orderBy("doc_id").collect()], float).reshape(-1, len(FEATURES) + 1)
    x, y = rows[:, :-1], rows[:, -1]
    trees = fit_trees(x, y, [FEATURES.index(f) for f in FALLING]) if len(set(y)) == 2 else None

    @F.pandas_udf("double")
    def verdict(*columns):
        import pandas as pd

        values = np.stack([c.to_numpy() for c in columns], 1)
        return pd.Series(trees.score(values) if trees else np.ones(len(values)))

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumns({"base_failed": failed, "quality_score": verdict(*FEATURES)}).withColumn("kept", ~F.col("base_failed") & (F.col("quality_score") >= 0.5))


def op8_quality_rules(spark, sf_dir):
    found = score_quality(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "labels"))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "quality_score")

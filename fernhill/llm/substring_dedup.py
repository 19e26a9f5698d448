"""Substring dedup with fixed-block anchors: repeated word windows go from every document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fernhill.llm import _exchange as ex
from fernhill.llm._shared import documents
from fernhill.llm._words import Block, windows


def drop_repeated_windows(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a window of ``window`` words that also starts anywhere else.

    Every document is cut into non-overlapping reference blocks of ``(window + 1) // 2`` words: any
    repeated window holds a whole block of its other occurrence. All rolling windows of a block's
    length probe the blocks; a hit is extended to the full windows around it, which are kept as
    repeated if their word sequence occurs twice (64 bits of hash within a bucket), and overlapping
    ones join to maximal exact repeats.

    Returns (doc_id, n_words, n_removed, spans, text): spans are [first, end) word numbers of the removed runs,
    text is the kept words joined by one space. Null text has no words; rows that repeat a text lose
    it, whatever their ids; a null id stays null; an empty table gives none.
    """
    block = (window + 1) // 2
    chunks = ex.chunk_table(docs, id_col, text_col)
    n_probe = ex.buckets_for(chunks, ex.CHUNK // 6)

    def probe_keys(ids, texts):
        b = Block(texts)
        first, keys = windows(b.words(), b.doc, block)
        return keys, None, (first - b.first_word()[b.doc[first]]) % block == 0

    hits = ex.answered(chunks, ex.found_elsewhere(ex.send(chunks, probe_keys, n_probe, False), False))

    def extended(b: Block, words, answers):
        """First words and keys of the windows that hold a hit."""
        first, keys = windows(words, b.doc, block)
        near = np.zeros(len(words) + 1, np.int64)
        near[first[ex.bits_of(ex.Distinct(keys, n_probe), answers)]] = 1
        total = np.concatenate(([0], np.cumsum(near)))
        first, keys = windows(words, b.doc, window)
        some = total[first + window - block + 1] > total[first]
        return first[some], keys[some]

    def candidates(batches):
        for batch in batches:
            for chunk, data, answers in zip(*(batch.column(i).to_pylist() for i in range(3))):
                b = Block(ex.open_chunk(data)[1])
                first, keys = extended(b, b.words(), answers)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([first.astype("<i4").tobytes()], pa.binary()), pa.array([keys.tobytes()], pa.binary())], ["chunk", "first", "keys"])

    # the extended windows are few: a table of their own, so that probes are hashed no third time
    found = ex.materialise(hits.mapInArrow(candidates, "chunk long, first binary, keys binary"), "windows")
    n_exact = ex.buckets_for(chunks, ex.CHUNK // 24)

    def exact(batches):
        for batch in batches:
            for chunk, keys in zip(*(batch.column(i).to_pylist() for i in range(2))):
                yield ex.sent_rows(chunk, np.frombuffer(keys, np.uint64), None, None, n_exact, True)

    repeated = ex.found_elsewhere(found.select("chunk", "keys").mapInArrow(exact, ex.SENT), True)

    def removal(batches):
        for batch in batches:
            numbers, firsts, keys, answers = (batch.column(i).to_pylist() for i in range(4))
            out = [np.frombuffer(f, "<i4")[ex.bits_of(ex.Distinct(np.frombuffer(k, np.uint64), n_exact), a)].tobytes() for f, k, a in zip(firsts, keys, answers)]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(out, pa.binary())], ["chunk", "first"])

    by_chunk = repeated.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    gone = found.join(by_chunk, "chunk").select("chunk", "first", "keys", "answers").mapInArrow(removal, "chunk long, first binary")

    def kept(batches):
        for batch in batches:
            for data, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, texts = ex.open_chunk(data)
                b = Block(texts)
                cover = np.zeros(len(b.doc) + 1, np.int64)
                if first is not None:
                    at = np.frombuffer(first, "<i4").astype(np.int64)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                removed = np.cumsum(cover[:-1]) > 0
                bounds = b.first_word()
                counts = np.diff(np.concatenate(([0], np.cumsum(removed)))[bounds])
                out, spans = [], []
                for i, text in enumerate(texts):
                    words = text.split()
                    if not counts[i]:
                        spans.append([])
                        out.append(b" ".join(words).decode())
                        continue
                    gone_words = removed[bounds[i] : bounds[i + 1]]
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone_words.astype(np.int8), [0]))))
                    spans.append(edges.tolist())
                    ends = [0, *edges.tolist(), len(words)]
                    out.append(b" ".join([w for a, z in zip(ends[::2], ends[1::2]) for w in words[a:z]]).decode())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if x == ex.NO_ID else x for x in ids.tolist()], pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(out, pa.string())],
                    ["doc_id", "n_words", "n_removed", "spans", "text"],
                )

    return chunks.join(gone, "chunk", "left").select("data", "first").mapInArrow(kept, "doc_id long, n_words long, n_removed long, spans array<long>, text string")


def op5_substring_dedup(spark, sf_dir):
    out = drop_repeated_windows(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM w),
k AS (SELECT doc_id, pos, ws[pos] AS word, CASE WHEN pos + 34 <= len(ws) THEN md5(array_to_string(ws[pos : pos + 34], ' ')) END AS win FROM p),
c AS (SELECT win FROM k WHERE win IS NOT NULL GROUP BY win HAVING count(*) >= 2),
f AS (SELECT k.doc_id, k.pos, k.word, c.win IS NOT NULL AS hit FROM k LEFT JOIN c ON k.win = c.win),
g AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM f),
r AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""

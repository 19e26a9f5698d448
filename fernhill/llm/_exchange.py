"""Which hashed keys occur elsewhere in the corpus, asked a chunk of documents at a time.

Spark moves one row per chunk and bucket with the chunk's distinct keys in a binary column, each
bucket is resolved in one task of bounded size, and one bit per key goes back to its chunk. A key
held by a third of all documents comes once from each chunk, so no key is hot. The number of buckets
follows the input, which keeps each bucket's memory the same at every size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from fernhill.llm._shared import materialise
from fernhill.llm._words import U, blocks, heads, order_of

#: Bytes of text in a chunk; a longer document is a chunk of its own.
CHUNK = 4_000_000
#: Keys that a bucket holds, about.
BUCKET_KEYS = 3_000_000
#: Stands for a null document id.
NO_ID = -(2**63)


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_of: int = CHUNK) -> DataFrame:
    """(chunk, data): all documents in compressed chunks of about ``size_of`` bytes, written once to the shared folder."""

    def run(batches):
        k, held, size = 0, ([], []), 0

        def row():
            ids, texts = held
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            data = np.array([len(ids), *ids], np.int64).tobytes() + sizes.tobytes() + b"".join(texts)
            chunk = (TaskContext.get().partitionId() << 32) + k
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([zstandard.compress(data, 3)], pa.binary())], ["chunk", "data"])

        for part, texts in blocks(batches, max_bytes=size_of // 4):
            new = sum(map(len, texts))
            if size and size + new > size_of:
                yield row()
                k, held, size = k + 1, ([], []), 0
            held[0].extend(NO_ID if x is None else x for x in part.column(0).to_pylist())
            held[1].extend(texts)
            size += new
        if held[0]:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(run, "chunk long, data binary"), "chunks")


def open_chunk(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ids, sizes = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n)
    ends = 8 + 16 * n + np.cumsum(sizes)
    return ids, [raw[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist())]


def buckets_for(chunks: DataFrame, keys_per_chunk: int) -> int:
    return max(1, -(-chunks.count() * keys_per_chunk // BUCKET_KEYS))


class Distinct:
    """Distinct keys of a chunk in order, which is also the order of their buckets; keys must be spread evenly."""

    def __init__(self, keys: np.ndarray, n_buckets: int):
        self.order = order_of(keys)
        ordered = keys[self.order]
        self.starts = heads(ordered)
        self.keys = ordered[self.starts]
        self.sizes = np.diff(np.append(self.starts, len(keys)))
        bucket = (self.keys >> U(32)) * U(n_buckets) >> U(32)
        self.cuts = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=np.uint64))

    def reduce(self, ufunc: np.ufunc, values: np.ndarray) -> np.ndarray:
        """The ufunc over the values of each distinct key."""
        return ufunc.reduceat(values[self.order], self.starts) if len(self.starts) else values[:0]

    def spread(self, values: np.ndarray) -> np.ndarray:
        """The distinct keys' values for each key that was given."""
        out = np.empty(len(self.order), values.dtype)
        out[self.order] = np.repeat(values, self.sizes)
        return out


def send(chunks: DataFrame, keys_of: Callable, n_buckets: int, wide: bool) -> DataFrame:
    """(bucket, chunk, keys, twice, mark): what ``keys_of(ids, texts)`` finds in each chunk.

    It returns keys, the owner of each (two owners make a key repeated within the chunk; None: each
    key has its own) and a mark of each (None: all). Keys go as 32 bits unless ``wide``: a false match
    then only costs a later exact look.
    """

    def run(batches):
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, owner, mark = keys_of(*open_chunk(data.as_py()))
                yield sent_rows(chunk, keys, owner, mark, n_buckets, wide)

    return chunks.mapInArrow(run, SENT)


SENT = "bucket int, chunk long, keys binary, twice binary, mark binary"


def sent_rows(chunk: int, keys: np.ndarray, owner: np.ndarray | None, mark: np.ndarray | None, n_buckets: int, wide: bool) -> pa.RecordBatch:
    """The distinct keys of a chunk, a row for each bucket."""
    d = Distinct(keys, n_buckets)
    twice = d.sizes > 1 if owner is None else d.reduce(np.maximum, owner) != d.reduce(np.minimum, owner)
    marked = np.ones(len(d.keys), bool) if mark is None else d.reduce(np.logical_or, mark)
    full = np.flatnonzero(np.diff(d.cuts)).tolist()
    part = lambda x: [x[d.cuts[b] : d.cuts[b + 1]] for b in full]
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int64()), pa.array([k.astype("<u8" if wide else "<u4").tobytes() for k in part(d.keys)], pa.binary()), *(pa.array([np.packbits(x).tobytes() for x in part(y)], pa.binary()) for y in (twice, marked))],
        ["bucket", "chunk", "keys", "twice", "mark"],
    )


def found_elsewhere(sent: DataFrame, wide: bool, hot: tuple[int, ...] = ()) -> DataFrame:
    """(chunk, bits): whether each key has two occurrences or more, of which one is marked.

    For each number in ``hot``, as many bits follow that tell which keys that many chunks hold.
    """

    def run(table: pa.Table) -> pa.Table:
        kind = "<u8" if wide else "<u4"
        rows = [np.frombuffer(x.as_py(), kind) for x in table.column("keys")]
        sizes = [len(x) for x in rows]
        bits = [np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n) for x, n in zip(table.column(c), sizes)]).astype(bool) for c in ("twice", "mark")]
        keys = np.concatenate(rows)
        if wide:
            order = order_of(keys)
            ordered = keys[order]
        else:
            packed = keys.astype(np.uint64) << U(32) | np.arange(len(keys), dtype=np.uint64)
            packed.sort()
            ordered, order = packed >> U(32), (packed & U(2**32 - 1)).astype(np.int64)
        starts = heads(ordered)
        count = np.diff(np.append(starts, len(keys)))
        hit = ((count > 1) | np.logical_or.reduceat(bits[0][order], starts)) & np.logical_or.reduceat(bits[1][order], starts)
        ends, out = np.cumsum(sizes), []
        for answer in (hit, *(count >= h for h in hot)):
            back = np.empty(len(keys), bool)
            back[order] = np.repeat(answer, count)
            out.append(back)
        bits = [np.packbits(np.concatenate([x[e - n : e] for x in out])).tobytes() for n, e in zip(sizes, ends)]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, "chunk long, bucket int, bits binary")


def answered(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """(chunk, data, answers): each chunk with the bits of its buckets."""
    by_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    return chunks.join(by_chunk, "chunk", "left")


def bits_of(d: Distinct, answers: list[dict] | None, row: int = 0, rows: int = 1) -> np.ndarray:
    """The answer to each key that was given to ``d``; answers have ``rows`` bits for each key."""
    out = np.zeros(len(d.keys), bool)
    for x in answers or []:
        a, b = d.cuts[x["bucket"]], d.cuts[x["bucket"] + 1]
        out[a:b] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=rows * (b - a))[row * (b - a) : (row + 1) * (b - a)]
    return d.spread(out)

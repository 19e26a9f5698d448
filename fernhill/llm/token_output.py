"""Token ids in wavelet-matrix shards: one compressed file holds ids, rank and select."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from fernhill.llm._shared import documents, shared_dir
from fernhill.llm._tokens import binaries, encoder, text_groups, with_end

#: Up to so many shards their offsets (16 bytes each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_SHARDS = 1_000_000
#: Bits between two stored counts of ones.
BLOCK = 512


class WaveletMatrix:
    """Bit-planes of ``n`` ids from the highest bit down, each stably parted by its bit.

    ``planes`` holds the packed bits, ``ranks`` the ones before each block of ``BLOCK`` bits and
    ``zeros`` the zeros of each plane.
    """

    def __init__(self, n: int, width: int, planes: list[np.ndarray], ranks: list[np.ndarray], zeros: list[int]):
        self.n, self.width, self.planes, self.ranks, self.zeros = n, width, planes, ranks, zeros

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        planes, ranks, zeros = [], [], []
        for bit in range(width - 1, -1, -1):
            ones = (ids >> bit) & 1 == 1
            planes.append(np.packbits(ones, bitorder="little"))
            padded = np.zeros(-(-len(ids) // BLOCK) * BLOCK, np.uint8)
            padded[: len(ids)] = ones
            counts = padded.reshape(-1, BLOCK).sum(1, dtype=np.uint32)
            ranks.append(np.concatenate(([0], np.cumsum(counts))).astype("<u4"))
            zeros.append(len(ids) - int(ranks[-1][-1]))
            ids = np.concatenate((ids[~ones], ids[ones]))
        return cls(len(ids), width, planes, ranks, zeros)

    def rank1(self, level: int, i: int) -> int:
        """Ones of a plane before bit ``i``."""
        block = i // BLOCK
        bits = self.planes[level][block * BLOCK // 8 : -(-i // 8)]
        if i % 8 and len(bits):
            bits = bits.copy()
            bits[-1] &= (1 << i % 8) - 1
        return int(self.ranks[level][block]) + int(np.unpackbits(bits).sum())

    def select(self, level: int, bit: int, k: int) -> int:
        """Place of the ``k``-th (from 0) bit of this value in a plane."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.width):
            bit = int(self.planes[level][i // 8]) >> i % 8 & 1
            value, ones = value * 2 + bit, self.rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        for level in range(self.width):
            a, b = self.rank1(level, start), self.rank1(level, end)
            if value >> (self.width - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id from ``start`` to before ``end``."""
        a, b = self._range(value, start, self.n if end is None else end)
        return b - a

    def occurrence(self, value: int, k: int) -> int:
        """Place of the ``k``-th (from 0) occurrence of an id."""
        a, b = self._range(value, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in range(self.width - 1, -1, -1):
            bit = value >> (self.width - 1 - level) & 1
            at = self.select(level, bit, at - self.zeros[level] * bit)
        return at

    def decode(self) -> np.ndarray:
        """All ids, by undoing the stable partitions from the lowest plane up."""
        ids = np.zeros(self.n, np.uint32)
        for level in range(self.width - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            above = np.empty_like(ids)
            above[~ones] = ids[: self.zeros[level]]
            above[ones] = ids[self.zeros[level] :] | np.uint32(1 << (self.width - 1 - level))
            ids = above
        return ids

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.width, *self.zeros], "<i8").tobytes()
        return head + b"".join(p.tobytes() for p in self.planes) + b"".join(r.tobytes() for r in self.ranks)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        n, width = (int(x) for x in np.frombuffer(data, "<i8", 2))
        zeros = np.frombuffer(data, "<i8", width, 16).tolist()
        size, blocks, at = -(-n // 8), -(-n // BLOCK) + 1, 16 + 8 * width
        planes = [np.frombuffer(data, np.uint8, size, at + k * size) for k in range(width)]
        ranks = [np.frombuffer(data, "<u4", blocks, at + width * size + 4 * k * blocks) for k in range(width)]
        return cls(n, width, planes, ranks, zeros)


_SHARD = "shard int, n_tokens long, first_doc long, doc_ids array<long>, doc_tokens array<long>, wavelet binary"


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, docs_per_shard: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts, in ascending id order, as one wavelet matrix per shard.

    Rows are range-partitioned by id and each partition becomes one row in one Parquet file: ids and
    token counts of its documents, and the wavelet matrix of their ids, each document's closed by
    ``end_id``. Spark's writer commits the files, so a repeated or lost task leaves no trace. Null text
    is empty, a null id comes first, rows that repeat an id lie next to each other. An empty table
    gives no shard.
    """
    shards = max(1, docs.count() // docs_per_shard)

    def run(batches):
        doc_ids, lengths, parts = [], [], []
        for part, texts in text_groups(batches, "text"):
            found, counts = encoder(tokenizer).encode(texts)
            doc_ids += part.column(0).to_pylist()
            lengths += (counts + 1).tolist()
            parts.append(with_end(found, counts, end_id))
        if doc_ids:
            ids = np.concatenate(parts)
            data = WaveletMatrix.build(ids, max(1, int(ids.max()).bit_length())).to_bytes()
            yield pa.RecordBatch.from_pylist(
                [{"shard": TaskContext.get().partitionId(), "n_tokens": len(ids), "first_doc": doc_ids[0], "doc_ids": doc_ids, "doc_tokens": lengths, "wavelet": data}],
                pa.schema([("shard", pa.int32()), ("n_tokens", pa.int64()), ("first_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("wavelet", pa.binary())]),
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, _SHARD).write.option("compression", "zstd").parquet(path)


def shard_offsets(shards: DataFrame) -> DataFrame:
    """(shard, before): ids in all earlier shards; a row per shard, so one small window."""
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return shards.select("shard", F.coalesce(before, F.lit(0)).alias("before"))


def read_documents(shards: DataFrame) -> DataFrame:
    """Decode every shard: (doc_id, start, n_tokens, ids), ids as little-endian 32-bit integers."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = WaveletMatrix.from_bytes(row["wavelet"]).decode()
                ends = np.cumsum(row["doc_tokens"])
                for i in range(0, len(ends), 256):
                    stops, counts = ends[i : i + 256], np.array(row["doc_tokens"][i : i + 256])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["shard"]] * len(stops), pa.int32()), pa.array(row["doc_ids"][i : i + 256], pa.int64()), pa.array(stops - counts, pa.int64()), pa.array(counts, pa.int64()), binaries(ids[stops[0] - counts[0] : stops[-1]].astype("<u4"), counts)],
                        ["shard", "doc_id", "local", "n_tokens", "ids"],
                    )

    found = shards.select("shard", "doc_ids", "doc_tokens", "wavelet").mapInArrow(run, "shard int, doc_id long, local long, n_tokens long, ids binary")
    offsets = shard_offsets(shards)
    if shards.count() <= BROADCAST_SHARDS:  # read from the files' footers
        offsets = F.broadcast(offsets)
    return found.join(offsets, "shard").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids")


def count_token(shards: DataFrame, token: int) -> DataFrame:
    """(shard, n): occurrences of an id, by rank alone."""
    return _lookup(shards, token, 0).select("shard", "n")


def find_token(shards: DataFrame, token: int, first: int = 10) -> DataFrame:
    """(shard, n, places): count, and the first places of an id in each shard, by select."""
    return _lookup(shards, token, first)


def _lookup(shards: DataFrame, token: int, first: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                matrix = WaveletMatrix.from_bytes(row["wavelet"])
                n = matrix.count(token) if token >> matrix.width == 0 else 0
                rows.append({"shard": row["shard"], "n": n, "places": [matrix.occurrence(token, k) for k in range(min(n, first))]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("places", pa.list_(pa.int64()))]))

    return shards.select("shard", "wavelet").mapInArrow(run, "shard int, n long, places array<long>")


def op2_token_output(spark, sf_dir):
    import public_tokenizers

    path = shared_dir(spark, "token-shards")
    write_shards(documents(spark, sf_dir).select("doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"))
    found = read_documents(spark.read.parquet(path))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

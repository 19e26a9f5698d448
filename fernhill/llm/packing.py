"""Packing documents into training sequences: first-fit decreasing in randomised groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from fernhill.llm._shared import documents, small_batches
from fernhill.llm._tokens import binaries, encoder, text_groups, with_end


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item; every size must be 1 to ``capacity``.

    A tournament tree holds the largest free room below each node, so that the first bin with room
    for an item is found by going down from the root, to the left where the left winner has room.
    """
    order = np.argsort(-sizes, kind="stable")
    leaves = 1 << max(0, int(len(sizes) - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def tokenise(docs: DataFrame, tokenizer: str, end_id: int, groups: int, id_col: str = "doc_id", text_col: str = "text", salt: Column | None = None) -> DataFrame:
    """(group, doc_id, ids): the ids of each text and ``end_id`` as little-endian 16-bit integers.

    Null text counts as empty; the group is drawn by a hash of id, whole text and ``salt``.
    """

    def run(batches):
        for part, texts in text_groups(batches, "text"):
            ids, counts = encoder(tokenizer).encode(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), binaries(with_end(ids, counts, end_id), counts + 1)], ["group", "doc_id", "ids"])

    group = F.pmod(F.xxhash64(F.lit(11), F.col(id_col), F.col(text_col), *([] if salt is None else [salt])), F.lit(groups))
    return docs.select(group.alias("group"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "group long, doc_id long, ids binary")


def pack(tokens: DataFrame, capacity: int = 2048) -> DataFrame:
    """Pack tokenised documents (``tokenise``) into sequences of at most ``capacity`` ids.

    A document is cut into full sequences and a rest; the rests of a group are packed by first-fit
    decreasing. Groups are independent and of bounded size, so any number of executors shares them
    and a lost one repeats only its own. Returns a row per piece with ``ids`` (little-endian 32-bit)
    and a ``sequence_id`` that no other group has. Repeated rows are packed as often as they come;
    an empty table gives none.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        group = table.column("group")[0].as_py()
        order = pc.sort_indices(table.append_column("size", pc.binary_length(table.column("ids"))), [("doc_id", "ascending"), ("size", "ascending")])
        docs, ids = table.column("doc_id").take(order).to_pylist(), table.column("ids").take(order).to_pylist()
        total = np.array([len(x) // 2 for x in ids], np.int64)
        full, rest = total // capacity, total % capacity
        bins, offsets = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        some = rest > 0
        bins[some], offsets[some] = first_fit_decreasing(rest[some], capacity)
        sequence = int(bins.max(initial=-1)) + 1
        out: list[tuple] = []
        for i, doc in enumerate(docs):
            wide = np.frombuffer(ids[i], "<u2").astype("<u4").tobytes()
            for k in range(int(full[i])):
                out.append((doc, k * capacity, capacity, int(total[i]), sequence, 0, wide[4 * k * capacity : 4 * (k + 1) * capacity]))
                sequence += 1
            if rest[i]:
                out.append((doc, int(full[i]) * capacity, int(rest[i]), int(total[i]), int(bins[i]), int(offsets[i]), wide[4 * int(full[i]) * capacity :]))
        columns = [list(c) for c in zip(*out)]
        columns[4] = [(group << 40) + s for s in columns[4]]
        return pa.table(columns, schema=_PIECES)

    return tokens.groupBy("group").applyInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, docs_per_group: int = 512, id_col: str = "doc_id", text_col: str = "text", from_files: bool = False) -> DataFrame:
    """``tokenise`` and ``pack``; the number of groups follows the number of rows.

    ``from_files`` says that ``docs`` is a scan of files, whose rows a repeated task numbers alike: then
    the row's number is part of what draws its group, so that rows that repeat id and text spread over
    the groups however many they are. Other tables draw by id and text alone, and rows that repeat both
    share a group. Columns but id and text are left out; null ids stay; texts of any length are cut.
    """
    small_batches(docs.sparkSession)
    groups = max(1, docs.count() // docs_per_group)
    return pack(tokenise(docs, tokenizer, end_id, groups, id_col, text_col, F.monotonically_increasing_id() if from_files else None), capacity)


def op1_packing(spark, sf_dir):
    import public_tokenizers

    pieces = pack_documents(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), from_files=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

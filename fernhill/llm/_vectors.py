"""Vectors as exact integers: rows of little-endian 32-bit components, and sums of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from fernhill.llm._shared import materialise

#: Squared length of an integer vector up to which every squared distance is a 64-bit integer.
LARGEST = 1 << 60


def usable(vector: str, dims: int) -> Column:
    """Whether a vector has ``dims`` components, all of them finite numbers."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def whole_numbers(rows: DataFrame, vector: str, dims: int, scale: int, keep: list[str], name: str) -> DataFrame:
    """(row, ``keep`` columns, q), written once: q holds floor(scale * component) of every usable vector.

    ``row`` is a number that no other row has; as the table is written, it stays the same when tasks repeat.
    """

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            q = np.floor(x * scale)
            if (np.einsum("ij,ij->i", q, q) > LARGEST).any():
                raise ValueError("a vector is too long for squared distances of 64 bits")
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(q))), *batch.columns[:-1], packed(q.astype("<i4"))], ["row", *keep, "q"])
            row += len(q)

    some = rows.where(usable(vector, dims)).select(*keep, F.col(vector).cast("array<double>").alias("\0x"))
    schema = StructType([StructField("row", LongType()), *some.schema.fields[:-1], StructField("q", BinaryType())])
    return materialise(some.mapInArrow(run, schema), name)


def packed(values: np.ndarray) -> pa.Array:
    """Each row of a matrix as its bytes."""
    n, size = len(values), values.shape[1] * values.itemsize
    ends = np.arange(n + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.Array, width: int, kind: str = "<i4") -> np.ndarray:
    """The matrix of rows of ``width`` numbers that ``packed`` made."""
    joined = b"".join(x for x in column.to_pylist())
    return np.frombuffer(joined, kind).reshape(-1, width)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of two matrices of one shape."""
    d = a.astype(np.int64) - b
    return np.einsum("ij,ij->i", d, d)


def sums_by(values: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of each group, and how many rows it has."""
    order = np.argsort(group, kind="stable")
    counts = np.bincount(group, minlength=groups)
    out = np.zeros((groups, values.shape[1]), np.int64)
    some = np.flatnonzero(counts)
    if len(some):
        out[some] = np.add.reduceat(values[order].astype(np.int64), (np.cumsum(counts) - counts)[some], axis=0)
    return out, counts


def mean_rows(partials: DataFrame, keys: list[str]) -> dict[tuple, list[int]]:
    """The floor of the mean of each component by key, from (keys, n, sums) of all tasks; exact."""
    flat = partials.select(*keys, "n", F.posexplode("sums").alias("place", "s"))
    total = flat.groupBy(*keys, "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    means: dict[tuple, list[int]] = {}
    for r in sorted(total.collect(), key=lambda r: r.place):
        means.setdefault(tuple(r[k] for k in keys), []).append(int(r.s) // r.n)
    return means


def partial_rows(found: dict[tuple, tuple[np.ndarray, np.ndarray]], names: list[str]) -> pa.RecordBatch:
    """(names, n, sums) of the groups that have rows; found: for a key's first parts, sums and counts by its last."""
    rows: list[tuple] = []
    for first, (sums, counts) in found.items():
        rows += [(*first, int(g), int(counts[g]), sums[g].tolist()) for g in np.flatnonzero(counts)]
    columns = list(zip(*rows)) if rows else [[]] * (len(names) + 2)
    kinds = [pa.int32()] * len(names) + [pa.int64(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*names, "n", "sums"])

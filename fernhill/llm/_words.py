"""Words and 64-bit hashes of whole texts, a block of documents at a time, in numpy.

Bytes are read eight at a time, and each lane is mixed into the hash of those before; hashes of
windows are made of the hashes of two halves, mixed again. Nothing is linear in the text, so no
regular pair of texts collides by construction: unequal ranges agree with a chance of about 2^-64,
and whoever must be exact compares the texts where hashes agree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Ranges of more bytes are hashed by blake2b, one by one.
LONG = 1024
_FIRST, _NEXT, _STIR = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93)
_LOW = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs, of which ``a`` is a mixed hash already; (a, b) and (b, a) differ."""
    x = a * _NEXT
    x += b
    x ^= x >> U(32)
    x *= _STIR
    x ^= x >> U(29)
    return x


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number: a view of ``data``."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data), strides=(1,))


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes [start, end); eight bytes must follow the last."""
    view, n = lanes(data), end - start
    out = mix((view[start] & _LOW[np.minimum(n, 8)]) + n.astype(np.uint64) * _FIRST)
    for i in np.flatnonzero(n > LONG).tolist():
        out[i] = int.from_bytes(blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    left, at = np.flatnonzero((n > 8) & (n <= LONG)), 8
    while len(left):
        rest = n[left] - at
        out[left] = join(out[left], view[start[left] + at] & _LOW[np.minimum(rest, 8)])
        left, at = left[rest > 8], at + 8
    return out


def rolling(parts: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` neighbours, by doubling."""
    have = 1
    while 2 * have <= size:
        parts = join(parts[: len(parts) - have], parts[have:])
        have *= 2
    more = size - have
    return join(parts[: len(parts) - more], parts[more:]) if more else parts


def order_of(keys: np.ndarray) -> np.ndarray:
    """The order of 64-bit keys; far faster than argsort, since places travel in the keys' low bits."""
    mask = U((1 << int(len(keys)).bit_length()) - 1)
    packed = (keys & ~mask) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order = (packed & mask).astype(np.int64)
    found = keys[order]
    fall = np.flatnonzero(found[1:] < found[:-1])
    if len(fall):  # keys that differ in their low bits alone
        head = found & ~mask
        some = np.flatnonzero(np.isin(head, head[fall]))
        order[some] = order[some][np.argsort(found[some], kind="stable")]
    return order


def heads(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)


class Block:
    """Some documents' bytes with one space between; ``start`` and ``end`` are each document's bounds."""

    def __init__(self, texts: list[bytes], table: np.ndarray | None = None, breaks: np.ndarray = SPACE):
        """table: maps bytes before anything else looks at them; breaks: bytes that part words."""
        self.n = len(texts)
        sizes = np.fromiter(map(len, texts), np.int64, self.n)
        self.start = np.concatenate(([1], 1 + np.cumsum(sizes + 1)))[: self.n].astype(np.int64) if self.n else np.zeros(0, np.int64)
        self.end = self.start + sizes
        self.data = np.frombuffer(b" " + b" ".join(texts) + b" " * 9, np.uint8)
        if table is not None:
            self.data = table[self.data]
        inside = ~breaks[self.data]
        inside[self.end] = False
        edge = np.diff(inside.view(np.int8))
        self.word_start, self.word_end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        self.doc = np.searchsorted(self.start, self.word_start, "right") - 1
        self.inside = inside

    def words(self) -> np.ndarray:
        return spans(self.data, self.word_start, self.word_end)

    def first_word(self) -> np.ndarray:
        """Number of the first word of each document, and of the end."""
        return np.searchsorted(self.doc, np.arange(self.n + 1))

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each document are marked."""
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[self.end] - total[self.start]


def windows(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all windows of ``size`` words within one document."""
    if len(words) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(doc[size - 1 :] == doc[: len(doc) - size + 1])
    return first, rolling(words, size)[first]


def with_doc(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that differ between documents."""
    return mix(keys + (doc.astype(np.uint64) + U(1)) * U(0x9E3779B97F4A7C15))


def seen_twice(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs again."""
    order = order_of(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", max_bytes: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts as UTF-8 (null: empty), of about ``max_bytes`` each."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)) if len(column) else []
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            part = batch.slice(start, stop - start)
            yield part, [t or b"" for t in part.column(part.schema.get_field_index(text)).cast(pa.binary()).to_pylist()]
            start = stop

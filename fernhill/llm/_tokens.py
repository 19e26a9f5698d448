"""Token ids of whole texts by a public tokenizer file, inside Spark tasks."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fernhill.llm._words import U, _LOW, heads, lanes, order_of, spans

#: Pieces of text after which a worker starts to collect anew, and the most bytes of one.
REMEMBERED, SHORT = 1_000_000, 256

# A piece that stays as it is between line ends.
_PLAIN = re.compile(r"[ \n]?\S+")
_SPACE = 32
_VISIBLE, _ALNUM, _STOP = (np.zeros(256, bool) for _ in range(3))
_VISIBLE[0x21:0x7F] = True
_ALNUM[[c for c in range(128) if chr(c).isalnum()]] = True
_STOP[[10, 44, 46]] = True
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
# Letters of two bytes; one of them has a small form that ends with a mark, which is no letter.
_LETTER = np.array([unicodedata.category(chr(c))[0] == "L" and c != 0x130 for c in range(0x800)])
# Normalizers and pre-tokenizers for which ``_cuts`` holds.
_KNOWN = [
    (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    ),
]
# First two bytes of white space of three bytes and its neighbours.
_WIDE_SPACE = [0xE19A, 0xE280, 0xE281, 0xE380]
_encoders: dict[tuple[str, str], Encoder] = {}


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at each text, before a space behind something visible, and between a letter or digit and one of ". , \\n".

    Both public pre-tokenizers always cut there, so that ids of the pieces are ids of the text.
    """
    cut = np.zeros(len(data) + 1, bool)
    before, at = data[:-1], data[1:]
    space, stop = at == _SPACE, _STOP[at]
    cut[1:-1] = (space & _VISIBLE[before]) | (stop & _ALNUM[before])
    wide = np.flatnonzero((space | stop) & (before >= 0x80)) + 1
    wide = wide[wide >= 4]
    lead2, lead3 = data[wide - 2], data[wide - 3]
    two = (lead2 >= 0xC3) & (lead2 <= 0xDF)
    code = (lead2.astype(np.int64) & 0x1F) << 6 | (data[wide - 1] & 0x3F)
    three = (lead3 >= 0xE0) & (lead3 <= 0xEF) & ~np.isin(lead3.astype(np.int64) << 8 | lead2, _WIDE_SPACE)
    visible = two | three | (data[wide - 4] >= 0xF0)
    cut[wide] = np.where(data[wide] == _SPACE, visible, two & _LETTER[np.where(two, code, 0)])
    cut[offsets] = True
    cut[len(data)] = False
    return np.flatnonzero(cut)


def _same(a: np.ndarray, at_a: np.ndarray, n_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether pairs of byte ranges are equal."""
    x, y = lanes(a), lanes(b)
    same = (n_a == n_b) & ((x[at_a] ^ y[at_b]) & _LOW[np.minimum(n_a, 8)] == 0)
    left, k = np.flatnonzero(same & (n_a > 8)), 8
    while len(left):
        rest = n_a[left] - k
        same[left] = (x[at_a[left] + k] ^ y[at_b[left] + k]) & _LOW[np.minimum(rest, 8)] == 0
        left, k = left[same[left] & (rest > 8)], k + 8
    return same


class Encoder:
    """Ids of many texts at once: pieces are found, told apart and put together in numpy; a tokenizer sees each new piece once."""

    remembered = REMEMBERED

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), dtype
        if self.tokenizer.get_vocab_size() > np.iinfo(dtype).max + 1:
            raise ValueError(f"{path} has more ids than {dtype} holds")
        about = json.loads(self.tokenizer.to_str())
        self.parts = (about["normalizer"], about["pre_tokenizer"]) in _KNOWN  # else texts are encoded as a whole
        self.folds = self.parts and bool(about["normalizer"])  # lowers letters and drops white space
        self.marks = [x["content"].lower().encode() for x in about["added_tokens"]]
        self._forget()

    def _forget(self) -> None:
        # known pieces in the order of their hashes, the bytes of each and its ids
        self.hash, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.bytes, self.ids = np.zeros(8, np.uint8), np.zeros(0, self.dtype)
        self.at, self.size, self.ids_at, self.ids_size = (np.zeros(0, np.int64) for _ in range(4))

    def _marked(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that spell one of the tokenizer's own tokens; these are encoded as a whole."""
        found = []
        for mark in self.marks:
            at = np.flatnonzero(_FOLD[data] == mark[0]) if chr(mark[0]).isalpha() else np.flatnonzero(data == mark[0])
            for k in range(1, len(mark)):
                at = at[at + k < len(data)]
                at = at[_FOLD[data[at + k]] == mark[k]]
            found += at.tolist()
        return np.unique(np.searchsorted(offsets, found, "right") - 1)

    def _plain(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain pieces and how many each has, as one text with line ends between them; offsets tell them apart."""
        got = self.tokenizer.encode("\n" + "\n".join(pieces), add_special_tokens=False)
        ids = np.array(got.ids, self.dtype)
        at = np.array([a for a, _ in got.offsets], np.int64)
        ends = np.cumsum([len(p) + 1 for p in pieces])  # of each piece, before the next line end
        inside = ~np.isin(at, np.concatenate(([0], ends[:-1])))
        return ids[inside], np.diff(np.searchsorted(at[inside], ends), prepend=0)

    def _ask(self, pieces: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Ids of some pieces in parts, and where in the parts' sum each piece begins and how many it has."""
        plain = [i for i, p in enumerate(pieces) if self.parts and len(p) < 64 and _PLAIN.fullmatch(p)]
        parts, sizes = [], np.zeros(len(pieces), np.int64)
        for k in range(0, len(plain), 4096):
            some = plain[k : k + 4096]
            ids, sizes[some] = self._plain([pieces[i] for i in some])
            parts.append(ids)
        others = np.setdiff1d(np.arange(len(pieces)), plain)
        for i in others.tolist():
            parts.append(np.array(self.tokenizer.encode(pieces[i], add_special_tokens=False).ids, self.dtype))
            sizes[i] = len(parts[-1])
        order = np.concatenate((np.array(plain, np.int64), others))
        at = np.empty(len(pieces), np.int64)
        at[order] = np.cumsum(sizes[order]) - sizes[order]
        return parts, at, sizes

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row (null: none), and how many each text has."""
        column = pc.fill_null(column, "").cast(pa.large_binary())
        _, ends, body = column.buffers()
        offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
        offsets, first = offsets - offsets[0], int(offsets[0])
        n_bytes = int(offsets[-1])
        if not n_bytes:
            return np.zeros(0, self.dtype), np.zeros(len(column), np.int64)
        if len(self.at) > self.remembered:
            self._forget()
        data = np.zeros(n_bytes + 8, np.uint8)
        data[:n_bytes] = np.frombuffer(body, np.uint8)[first : first + n_bytes]
        start = _cuts(data[:n_bytes], offsets) if self.parts else np.unique(offsets[:-1][offsets[1:] > offsets[:-1]])
        direct = np.full(len(start), not self.parts)
        if len(marked := self._marked(data[:n_bytes], offsets)):
            owner = np.searchsorted(offsets, start, "right") - 1
            keep = ~np.isin(owner, marked) | np.isin(start, offsets)
            start, direct = start[keep], (direct | np.isin(owner, marked))[keep]
        stop = np.append(start[1:], n_bytes)
        bounds = np.searchsorted(start, offsets)
        if self.folds:
            data[:n_bytes][np.repeat(~direct, stop - start)] = _FOLD[data[:n_bytes]][np.repeat(~direct, stop - start)] if direct.any() else _FOLD[data[:n_bytes]]
            start = start + ((data[start] == _SPACE) & ~direct)
        size = stop - start
        direct |= size > SHORT

        short = np.flatnonzero(~direct)
        keys = spans(data, start[short], stop[short])
        order = order_of(keys)
        begins = heads(keys[order])
        rep, kind = short[order[begins]], np.empty(len(short), np.int64)
        kind[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(order))))
        of = rep[kind]
        odd = ~_same(data, start[short], size[short], data, start[of], size[of])  # equal hashes, other bytes
        direct[short[odd]] = True

        keys = keys[order[begins]]
        place = np.minimum(np.searchsorted(self.hash, keys), max(0, len(self.hash) - 1))
        there = self.hash[place] == keys if len(self.hash) else np.zeros(len(keys), bool)
        row = np.where(there, self.row[place] if len(self.row) else 0, -1)
        hit = np.flatnonzero(there)
        wrong = hit[~_same(data, start[rep[hit]], size[rep[hit]], self.bytes, self.at[row[hit]], self.size[row[hit]])]
        row[wrong] = -1
        new = np.flatnonzero(row < 0)
        rows = np.full(len(start), -1, np.int64)
        asked = np.concatenate((rep[new], np.flatnonzero(direct)))
        text = data.tobytes()
        parts, at, sizes = self._ask([text[a:z].decode() for a, z in zip(start[asked].tolist(), stop[asked].tolist())])
        ids = np.concatenate([self.ids, *parts])
        ids_at, ids_size = np.concatenate((self.ids_at, len(self.ids) + at)), np.concatenate((self.ids_size, sizes))
        row[new] = len(self.at) + np.arange(len(new))
        rows[short] = row[kind]
        rows[direct] = len(self.at) + len(new) + np.arange(len(asked) - len(new))
        if len(new):
            self._remember(np.setdiff1d(new, wrong), new, keys, row, rep, data, start, size, ids, ids_at, ids_size)

        lengths = ids_size[rows]
        total = np.concatenate(([0], np.cumsum(lengths)))
        out = ids[np.repeat(ids_at[rows] - total[:-1], lengths) + np.arange(int(total[-1]))]
        return out, np.diff(total[bounds])

    def _remember(self, indexed, new, keys, row, rep, data, start, size, ids, ids_at, ids_size) -> None:
        n = len(self.at) + len(new)
        own = size[rep[new]]
        at = len(self.bytes) - 8 + np.cumsum(own) - own
        body = data[np.repeat(start[rep[new]] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))]
        self.bytes = np.concatenate((self.bytes[:-8], body, np.zeros(8, np.uint8)))
        self.at, self.size = np.concatenate((self.at, at)), np.concatenate((self.size, own))
        self.ids_at, self.ids_size = ids_at[:n], ids_size[:n]
        self.ids = ids[: int((self.ids_at + self.ids_size).max())]
        merged, rows = np.concatenate((self.hash, keys[indexed])), np.concatenate((self.row, row[indexed]))
        order = np.argsort(merged, kind="stable")  # two sorted runs
        self.hash, self.row = merged[order], rows[order]


def encoder(path: str, dtype: str = "<u2") -> Encoder:
    """The worker's encoder for a tokenizer file; one per worker and file."""
    if (path, dtype) not in _encoders:
        _encoders[path, dtype] = Encoder(path, dtype)
    return _encoders[path, dtype]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> np.ndarray:
    """The ids of all texts, each text's closed by ``end_id``."""
    out = np.full(len(ids) + len(counts), end_id, ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out


def binaries(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Neighbouring parts of an array, as its bytes."""
    ends = np.concatenate(([0], np.cumsum(counts))) * flat.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def text_groups(batches: Iterable[pa.RecordBatch], text: str, max_bytes: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with their texts, each of about ``max_bytes`` at most or one text."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)) if len(column) else []
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            part = batch.slice(start, stop - start)
            yield part, part.column(part.schema.get_field_index(text))
            start = stop

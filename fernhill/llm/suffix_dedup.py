"""Suffix-array dedup: byte strings that an earlier document has are cut from later ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from fernhill.llm import _exchange as ex
from fernhill.llm._induced import suffix_order
from fernhill.llm._shared import documents
from fernhill.llm._words import U, join, lanes, mix

#: Bytes of the substrings whose least hash names the shard of a window.
ANCHOR = 16
#: Runs of an anchor that so many chunks hold are dealt by a second hash of their windows as well.
HOT = 512


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


class _Runs:
    """Maximal runs of windows of one document that share their least anchor hash.

    ``start`` and ``count`` are the first window of each run, as a place in ``data``, and how many
    windows it has; ``key`` is the least hash and ``doc`` the document. Equal windows have equal keys.
    """

    def __init__(self, texts: list[bytes], window: int):
        self.data = b"\0".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.cumsum(sizes + 1) - sizes - 1
        self.last = self.first + sizes
        raw = np.frombuffer(self.data + bytes(8), np.uint8)
        if len(self.data) < window:
            self.start = self.count = self.doc = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        eight = lanes(raw)
        self.anchors = join(mix(eight[: len(self.data) - ANCHOR + 1]), eight[8 : len(self.data) - ANCHOR + 9])
        least = _sliding_least(self.anchors, window - ANCHOR + 1)
        inside = np.zeros(len(self.data) + 1, np.int8)  # +1 and -1 around the window starts of each document
        long = np.flatnonzero(sizes >= window)
        np.add.at(inside, self.first[long], 1)
        np.add.at(inside, self.last[long] - window + 1, -1)
        valid = np.cumsum(inside[: len(least)]) > 0
        change = np.concatenate(([True], (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])))
        edges = np.append(np.flatnonzero(change), len(least))
        start = edges[:-1]
        keep = valid[start]
        self.start, self.count = start[keep], np.diff(edges)[keep]
        self.width = window - ANCHOR + 1
        self.key = mix(least[self.start])  # evenly spread, as least hashes are not
        self.doc = np.searchsorted(self.first, self.start, "right") - 1


    def split(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, count, doc, key) of some runs, cut where the least of a window's other anchor hashes changes.

        The keys name both hashes; equal windows still have equal keys.
        """
        start, count, doc = self.start[some], self.count[some], self.doc[some]
        at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        run = np.repeat(np.arange(len(start)), count)
        second = np.empty(len(at), np.uint64)
        for k in range(0, len(at), 1 << 14):
            near = self.anchors[at[k : k + (1 << 14), None] + np.arange(self.width)]
            near[near == near.min(1, keepdims=True)] = U(2**64 - 1)
            second[k : k + (1 << 14)] = near.min(1)
        cut = np.flatnonzero(np.concatenate(([True], (second[1:] != second[:-1]) | (run[1:] != run[:-1]))))
        return at[cut], np.diff(np.append(cut, len(at))), doc[run[cut]], join(self.key[some][run[cut]], second[cut])


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.array([a.nbytes], np.int64).tobytes() + a.tobytes() for a in arrays), 3)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(data), 0, []
    for kind in kinds:
        size = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw[at + 8 : at + 8 + size], kind))
        at += 8 + size
    return out


def _earlier_in_shard(strings: list[np.ndarray], lengths: list[np.ndarray], owners: list[np.ndarray], window: int) -> list[np.ndarray]:
    """For each chunk of a shard: whether each window of each string starts in a document before the string's owner.

    The shard's distinct strings are joined with marks between, its suffixes are put in order with
    their common prefixes, and windows with a common prefix of ``window`` bytes are one class whose
    smallest owner decides.
    """
    owner, length = np.concatenate(owners), np.concatenate(lengths).astype(np.int64)
    data = np.concatenate(strings)
    ends = np.cumsum(length)
    known: dict[bytes, int] = {}
    body, cuts = data.tobytes(), [0, *ends.tolist()]
    which = np.array([known.setdefault(body[x:z], len(known)) for x, z in zip(cuts[:-1], cuts[1:])], np.int64)
    first = np.unique(which, return_index=True)[1]
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, which, owner)
    size = length[first]
    offset = np.cumsum(size + 1) - size - 1
    text = np.zeros(int((size + 1).sum()), np.int16)
    source = np.repeat(ends[first] - size - offset, size) + (place := np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size))
    text[place] = data[source].astype(np.int16) + 1
    order, lcp = suffix_order(text, 257, window)
    live = np.zeros(len(text), bool)
    live[place] = True
    tail = np.add.outer(offset + size, -np.arange(1, window)).ravel()
    live[tail] = False
    group = np.cumsum(lcp < window)
    order_live = live[order]
    group, at = group[order_live], order[order_live]
    smallest = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    string_of = np.repeat(np.arange(len(size)), size + 1)
    np.minimum.at(smallest, group, least[string_of[at]])
    by_place = np.zeros(len(text), np.int64)
    by_place[at] = smallest[group]
    out, k = [], 0
    for lens, own in zip(lengths, owners):
        lens = lens.astype(np.int64)
        counts = lens - window + 1
        starts = offset[which[k : k + len(lens)]]
        places = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        out.append(by_place[places] < np.repeat(own, counts))
        k += len(lens)
    return out


def drop_earlier_strings(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte covered by a ``window``-byte string that also starts in a document with a smaller id.

    Windows go to the shard of the least hash of their 16-byte substrings, so that all places of a
    string meet in one shard whatever its documents. A first exchange of those hashes alone leaves out
    what only one document has, and names the hot ones, whose windows are dealt by their second least
    hash as well; the rest is sent as runs of neighbouring windows, equal runs once per
    chunk with their smallest id. Each shard is a suffix array with common prefixes, made by induced
    sorting with disk-backed queues (``_induced``), and answers with a bit per window.

    Returns (doc_id, n_bytes, n_removed, spans, kept): spans are [first, end) bytes of maximal removed
    runs, kept the other bytes (which need not be whole characters). Null text is empty; a null id is
    before all others; rows of one id never cut each other; an empty table gives none. Runs and windows
    are compared by their bytes.
    """
    chunks = ex.chunk_table(docs, id_col, text_col)
    n_asked = ex.buckets_for(chunks, ex.CHUNK // 16)
    shards = max(1, chunks.count())

    def asked(ids, texts):
        runs = _Runs(texts, window)
        return runs.key, ids[runs.doc], np.ones(len(runs.key), bool)

    shared = ex.answered(chunks, ex.found_elsewhere(ex.send(chunks, asked, n_asked, False), False, (HOT,)))

    def cut(texts, ids, answers):
        """Shared runs by shard, and in it by text: shard, start, count, owner, and whether a text is new."""
        runs = _Runs(texts, window)
        asked = ex.Distinct(runs.key, n_asked)
        some, hot = (ex.bits_of(asked, answers, k, 2) for k in (0, 1))
        parts = [(runs.start[some & ~hot], runs.count[some & ~hot], runs.doc[some & ~hot], runs.key[some & ~hot])]
        if (some & hot).any():
            parts.append(runs.split(some & hot))
        start, count, doc, key = (np.concatenate(x) for x in zip(*parts))
        owner, shard = ids[doc], ((key >> U(20)) % U(shards)).astype(np.int64)
        known: dict[bytes, int] = {}
        text = np.array([known.setdefault(runs.data[x : x + n], len(known)) for x, n in zip(start.tolist(), (count + window - 1).tolist())], np.int64)
        order = np.lexsort((owner, text, shard))
        shard, start, count, owner, text = (x[order] for x in (shard, start, count, owner, text))
        fresh = np.ones(len(text), bool)
        fresh[1:] = text[1:] != text[:-1]
        return runs.data, shard, start, count, owner, fresh

    def send_strings(batches):
        for batch in batches:
            for chunk, data, answers in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids, texts = ex.open_chunk(data)
                body, shard, start, count, owner, fresh = cut(texts, ids, answers)
                heads = np.flatnonzero(fresh)
                shard, start, owner, length = shard[heads], start[heads], owner[heads], count[heads] + window - 1
                found, at = np.unique(shard, return_index=True)
                out = []
                for a, z in zip(at.tolist(), [*at[1:].tolist(), len(shard)]):
                    joined = b"".join([body[x : x + n] for x, n in zip(start[a:z].tolist(), length[a:z].tolist())])
                    out.append(_pack(np.frombuffer(joined, np.uint8), length[a:z].astype("<i4"), owner[a:z]))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([chunk] * len(out), pa.int64()), pa.array(out, pa.binary())], ["shard", "chunk", "strings"])

    def resolve(table: pa.Table) -> pa.Table:
        parts = [_unpack(x.as_py(), "u1", "<i4", "<i8") for x in table.column("strings")]
        bits = _earlier_in_shard(*([p[k] for p in parts] for k in range(3)), window)
        return pa.table({"shard": table.column("shard"), "chunk": table.column("chunk"), "bits": pa.array([_pack(np.packbits(b)) for b in bits], pa.binary())})

    sent = shared.select("chunk", "data", "answers").mapInArrow(send_strings, "shard int, chunk long, strings binary")
    earlier = sent.groupBy("shard").applyInArrow(resolve, "shard int, chunk long, bits binary").groupBy("chunk").agg(F.collect_list(F.struct("shard", "bits")).alias("earlier"))

    def removed_bytes(texts, ids, answers, earlier):
        """A mark for each byte of the chunk."""
        body, shard, start, count, owner, fresh = cut(texts, ids, answers)
        cover = np.zeros(len(body) + 2, np.int32)
        if len(start):
            which = np.cumsum(fresh) - 1
            heads = np.flatnonzero(fresh)
            windows = count[heads]
            offset = np.cumsum(windows) - windows
            bits = np.zeros(int(windows.sum()), bool)
            for x in earlier or []:
                a, z = np.searchsorted(shard[heads], [x["shard"], x["shard"] + 1])
                n = int(windows[a:z].sum())
                bits[offset[a] : offset[a] + n] = np.unpackbits(_unpack(x["bits"], "u1")[0], count=n)
            inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            gone = bits[np.repeat(offset[which], count) + inner] | np.repeat(owner > owner[heads][which], count)
            at = (np.repeat(start, count) + inner)[gone]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
        return (np.cumsum(cover) > 0).view(np.int8)

    def kept(batches):
        for batch in batches:
            for data, answers, earlier in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids, texts = ex.open_chunk(data)
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                first = np.cumsum(sizes + 1) - sizes - 1
                edges = np.flatnonzero(np.diff(removed_bytes(texts, ids, answers, earlier), prepend=0, append=0))
                cuts = np.searchsorted(edges, first), np.searchsorted(edges, first + sizes, "right")
                n_removed, spans, left = [], [], []
                for i, text in enumerate(texts):
                    own = (edges[cuts[0][i] : cuts[1][i]] - first[i]).tolist()
                    n_removed.append(sum(own[1::2]) - sum(own[::2]))
                    spans.append(own)
                    ends = [0, *own, len(text)]
                    left.append(b"".join([text[a:z] for a, z in zip(ends[::2], ends[1::2])]) if own else text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if x == ex.NO_ID else x for x in ids.tolist()], pa.int64()), pa.array(sizes), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(left, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "spans", "kept"],
                )

    # the chunks are dealt by number already, so that only the answers move here
    return shared.join(earlier, "chunk", "left").select("data", "answers", "earlier").mapInArrow(kept, "doc_id long, n_bytes long, n_removed long, spans array<long>, kept binary")


def op3_suffix_dedup(spark, sf_dir):
    out = drop_earlier_strings(documents(spark, sf_dir).select("doc_id", "text"))
    n_spans = (F.size("spans") / 2).cast("long")
    return out.select("doc_id", "n_bytes", "n_removed", n_spans.alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

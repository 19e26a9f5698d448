"""Benchmark decontamination with spaced seeds: hashes that ignore fixed word positions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fernhill.llm._shared import documents, materialise
from fernhill.llm._words import Block, U, blocks, mix, order_of, with_doc
from fernhill.llm.toxicity import _BREAKS, _LOWER

#: Words at 0 are ignored, so that a seed matches across substitutions there. Every stretch
#: of 13 words or more of which a fifth at most are substituted has a seed that none of them touches.
MASKS = ("111101011", "11001100111", "1100000110111", "110110000111", "1101010001011", "11111001001", "111100101001")
#: Items of fewer words match as a whole; they have masks of their own length.
LONG = 13
#: Bits of the map that keeps most training windows from being shuffled: 2 MB, whatever the benchmark.
MAP_BITS = 24
#: Up to so many pairs of a document and an item, and bytes of their items, are broadcast; beyond, they are joined by shuffle.
BROADCAST_DOCS, BROADCAST_BYTES = 100_000, 64_000_000


#: A random odd factor for each place of a mask.
_ODD = np.random.default_rng(9).integers(1, 2**63, 32, np.uint64) * U(2) + U(1)


def short_masks(n: int) -> list[str]:
    """Masks of ``n`` < LONG words, one of which no fifth of the words touches."""
    lost = n // 5
    part = [i * (lost + 2) // n for i in range(n)] if lost else [0] * n
    return ["".join("01"[p not in gone] for p in part) for gone in combinations(range(lost + 2), lost)]


def seeds(b: Block, lengths: Iterable[int] = ()) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all seeds: under each mask in turn, then under those of short items' lengths."""
    words = b.words()
    firsts, keys = [], []
    for k, mask in [*enumerate(MASKS), *((100 * n + j, mask) for n in lengths for j, mask in enumerate(short_masks(n)))]:
        span = len(mask)
        if len(words) < span:
            continue
        first = np.flatnonzero(b.doc[span - 1 :] == b.doc[: len(b.doc) - span + 1])
        total = np.zeros(len(first), np.uint64)
        for place, x in enumerate(mask):
            if x == "1":
                total += words[first + place] * _ODD[place]
        firsts.append(first)
        keys.append(mix(total + U(k)))
    return (np.concatenate(firsts), np.concatenate(keys)) if firsts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> U(64 - MAP_BITS)).astype(np.int64), (keys & U(2**MAP_BITS - 1)).astype(np.int64)


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """(key, item_id, item_at, short) of all seeds of the items; short: words of an item under LONG, else 0."""

    def run(batches):
        for part, texts in blocks(batches):
            n = np.diff(Block(texts, _LOWER, _BREAKS).first_word())
            for short in np.unique(np.where(n < LONG, n, 0)[n > 0]).tolist():
                some = np.flatnonzero(n == short if short else n >= LONG)
                b = Block([texts[i] for i in some], _LOWER, _BREAKS)
                first, keys = seeds(b, [short] if short else [])
                ids = np.array(part.column(0).to_pylist(), np.int64)[some]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[b.doc[first]]), pa.array(first - b.first_word()[b.doc[first]]), pa.array(np.full(len(first), short))], ["key", "item_id", "item_at", "short"])

    return items.mapInArrow(run, "key long, item_id long, item_at long, short long")


def seed_map(found: DataFrame) -> np.ndarray:
    """A bit map of the seeds' slots, OR-ed over tasks; 2 MB for any benchmark."""

    def each(batches):
        bits = np.zeros(2**MAP_BITS, bool)
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            for slot in _slots(keys):
                bits[slot] = True
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["one", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in table.column("bits")])
        return pa.table({"bits": pa.array([bits.tobytes()], pa.binary())})

    rows = found.select("key").coalesce(16).mapInArrow(each, "one int, bits binary").groupBy("one").applyInArrow(merge, "bits binary").collect()
    return np.frombuffer(rows[0].bits, np.uint8) if rows else np.zeros(2**MAP_BITS // 8, np.uint8)


def best_overlap(doc: np.ndarray, item: np.ndarray, shift: int, share: float, least: int) -> tuple[int, int, int]:
    """(words, matched, first doc word) of the best stretch of an item laid on a text at ``shift``.

    The best of the stretches of ``least`` words or more has the largest sum of matches weighed against
    mismatches; it is none if that is negative, so that it holds at least ``share`` matches.
    """
    a, z = max(0, -shift), min(len(item), len(doc) - shift)
    if z - a < least:
        return 0, 0, 0
    same = item[a:z] == doc[a + shift : z + shift]
    total = np.concatenate(([0.0], np.cumsum(np.where(same, 1 - share, -share) + 1e-9)))
    gain = total[least:] - np.minimum.accumulate(total[: len(total) - least])
    if gain.max() < 0:
        return 0, 0, 0
    end = int(gain.argmax()) + least
    start = int(total[: end - least + 1].argmin())
    return end - start, int(same[start:end].sum()), a + shift + start


def shared_shifts(b: Block, q: Block, lengths: Iterable[int]) -> Iterator[list[int]]:
    """For each text of ``b`` and the item of the same number in ``q``, the shifts at which they share a seed, ascending.

    A mark for each possible shift holds them, so that a text of one word many times takes no more than its length.
    """
    first, keys = seeds(b, lengths)
    doc = b.doc[first]
    keys, place = with_doc(keys, doc), first - b.first_word()[doc]
    order = order_of(keys)
    keys, place = keys[order], place[order]
    item_first, item_keys = seeds(q, lengths)
    of = q.doc[item_first]
    item_keys, item_place = with_doc(item_keys, of), item_first - q.first_word()[of]
    low, high = np.searchsorted(keys, item_keys, "left"), np.searchsorted(keys, item_keys, "right")
    hit = np.flatnonzero(high > low)
    hit = hit[np.argsort(of[hit], kind="stable")]
    cuts = np.searchsorted(of[hit], np.arange(b.n + 1))
    n, n_item = np.diff(b.first_word()), np.diff(q.first_word())
    for i in range(b.n):
        mark = np.zeros(int(n[i] + n_item[i]) + 1, bool)
        for k in hit[cuts[i] : cuts[i + 1]].tolist():
            mark[place[low[k] : high[k]] - item_place[k] + n_item[i]] = True
        yield (np.flatnonzero(mark) - n_item[i]).tolist()


def find_leaks(docs: DataFrame, items: DataFrame, min_words: int = 13, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, item_id, overlap_words, matched_words, first_word) of benchmark text in documents.

    Words are runs of letters and digits with A-Z lowered. Every window of every whole text is hashed
    under each mask and joined with the items' hashes; around a hit the item is laid on the text,
    and it counts as a leak if a stretch has ``min_words`` words or more (the whole item, if it is
    shorter) of which at least ``share`` are equal. The masks hit all of these for 13 words or more
    and a share of 0.8 or more. Items without words are not searched. Repeated documents give one row (``text_key``,
    xxhash64 of the text, tells texts of one id apart); null texts, null ids of items and empty tables give none.
    """
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    wanted = materialise(benchmark_seeds(items), "seeds")
    bits = seed_map(wanted)
    lengths = sorted(r.short for r in wanted.where("short > 0").select("short").distinct().collect())

    def probes(batches):
        there = np.unpackbits(bits).view(bool)
        for part, texts in blocks(batches):
            b = Block(texts, _LOWER, _BREAKS)
            first, keys = seeds(b, lengths)
            one, two = _slots(keys)
            some = there[one] & there[two]
            keys, doc = keys[some], b.doc[first[some]]
            order = np.lexsort((keys, doc))  # a key of a text goes once, wherever it is there
            keys, doc = keys[order], doc[order]
            once = np.concatenate((np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])))
            keys, doc = keys[once], pa.array(doc[once])
            yield pa.RecordBatch.from_arrays([part.column(0).take(doc), part.column(1).take(doc), pa.array(keys.view(np.int64))], ["doc_id", "text_key", "key"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    hits = rows.mapInArrow(probes, "doc_id long, text_key long, key long").join(wanted.select("key", "item_id").distinct(), "key")
    places = hits.select("doc_id", "text_key", "item_id").distinct()
    places = materialise(places.join(items.withColumnRenamed("text", "item"), "item_id"), "places")
    n_places, size = places.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("item")), F.lit(0))).first()
    near = F.broadcast(places) if n_places <= BROADCAST_DOCS and size <= BROADCAST_BYTES else places
    pairs = rows.join(near.withColumnsRenamed({"doc_id": "id", "text_key": "k"}), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("k"))).select("doc_id", "text_key", "item_id", "text", "item")

    def verify(batches):
        for part, texts in blocks(batches):
            b = Block(texts, _LOWER, _BREAKS)
            q = Block([t.encode() for t in part.column(4).to_pylist()], _LOWER, _BREAKS)
            words, item_words, at, item_at = b.words(), q.words(), b.first_word(), q.first_word()
            out = []
            for i, shifts in enumerate(shared_shifts(b, q, lengths)):
                text, item = words[at[i] : at[i + 1]], item_words[item_at[i] : item_at[i + 1]]
                least = max(1, min(min_words, len(item)))
                n, matched, first = max((best_overlap(text, item, s, share, least) for s in shifts), key=lambda x: x[:2], default=(0, 0, 0))
                if n:
                    out.append((i, n, matched, first))
            take = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(take) for k in range(3)), *(pa.array([x[k] for x in out], pa.int64()) for k in (1, 2, 3))], ["doc_id", "text_key", "item_id", "overlap_words", "matched_words", "first_word"])

    return pairs.mapInArrow(verify, "doc_id long, text_key long, item_id long, overlap_words long, matched_words long, first_word long").dropDuplicates()


def op9_decontamination(spark, sf_dir):
    found = find_leaks(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "overlap_words", "matched_words", "first_word")

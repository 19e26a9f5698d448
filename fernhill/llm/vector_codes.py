"""Product codes of vectors: exact codebooks by rounds over Hilbert-sorted blocks with boxes and sums."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fernhill.llm._shared import documents, materialise
from fernhill.llm._vectors import mean_rows, packed, partial_rows, sums_by, unpacked, whole_numbers

#: Pieces of a block, and bits of each component in its place on the curve.
BLOCK, BITS = 128, 3
#: Up to this squared length products of floats are exact integers.
_EXACT = 1 << 50


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of points on a Hilbert curve through a grid of 2^bits cells a side; bits * width is 63 at most.

    Each level's half-space bits are read off in the frame that the levels above have left: a one in a
    dimension turns over the lower bits of the first, a zero swaps them with the first's.
    """
    x = cells.astype(np.int64).copy()
    n, width = x.shape
    for level in range(bits - 1, 0, -1):
        one, below = 1 << level, (1 << level) - 1
        for d in range(width):
            high = x[:, d] & one > 0
            x[high, 0] ^= below
            swap = np.where(high, 0, (x[:, 0] ^ x[:, d]) & below)
            x[:, 0] ^= swap
            x[:, d] ^= swap
    for d in range(1, width):  # Gray code across dimensions, then of the last one's levels
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[:, -1] & (1 << level) > 0, (1 << level) - 1, 0)
    x ^= flip[:, None]
    out = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(width):
            out = out << 1 | (x[:, d] >> level & 1)
    return out


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """For each block's box and each entry whether it can be the nearest of any point in the box.

    An entry whose least distance to the box exceeds the smallest of all greatest distances is out;
    distances are exact integers, so that ties stay in.
    """
    out = np.empty((len(low), len(entries)), bool)
    step = max(1, 2**18 // max(1, entries.size))
    for at in range(0, len(low), step):
        a, z = low[at : at + step, None].astype(np.int64), high[at : at + step, None].astype(np.int64)
        under, over = a - entries, entries - z
        near = np.maximum(np.maximum(under, over), 0)
        far = np.maximum(-under, -over)
        out[at : at + step] = (near * near).sum(2) <= (far * far).sum(2).min(1)[:, None]
    return out


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of a few entries for each point (ties: the first) and the squared distance, in exact integers."""
    x, c = points.astype(np.int64), entries.astype(np.int64)
    xx, cc = (x * x).sum(1), (c * c).sum(1)
    if max(xx.max(initial=0), cc.max(initial=0)) <= _EXACT:
        d = xx[:, None] - 2 * (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64) + cc
    else:
        d = sum((x[:, k, None] - c[:, k]) ** 2 for k in range(x.shape[1]))
    found = d.argmin(1)
    return found, d[np.arange(len(x)), found]


@dataclass
class VectorCodes:
    """codes: (row, id, label, code array<int>, error long) of each vector; codebooks[part][entry]: its components."""

    codes: DataFrame
    codebooks: np.ndarray


_BLOCKS = "part int, n int, rows binary, points binary, low binary, high binary, sums binary"


def hilbert_blocks(base: DataFrame, dims: int, parts: int, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """Flat blocks of ``BLOCK`` pieces: a piece is one part of a vector, and a block holds neighbours on the curve.

    Pieces are range-partitioned by part, place on the curve and row number. The row number parts equal
    pieces too, so that a vector which a third of all rows repeat fills many partitions. ``low`` and
    ``high`` scale the curve; what lies outside counts as its edge, which costs locality only.
    """
    width = dims // parts
    span = np.maximum(high - low, 1).astype(np.float64)
    used = min(width, 63)  # the curve of wide pieces runs through their first components
    bits = min(BITS, 63 // used)

    def cut(batches):
        for batch in batches:
            rows, q = batch.column(0), unpacked(batch.column(1), dims)
            cells = np.clip((q - low) / span * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
            for p in range(parts):
                own = slice(p * width, (p + 1) * width)
                place = hilbert(cells[:, own][:, :used], bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), p, np.int32)), pa.array(place), rows, packed(np.ascontiguousarray(q[:, own]))], ["part", "place", "row", "piece"])

    def gather(batches):
        rest = None
        for batch in batches:
            part, row, points = batch.column(0).to_numpy(), batch.column(2).to_numpy(), unpacked(batch.column(3), width)
            if rest is not None:
                part, row, points = np.concatenate((rest[0], part)), np.concatenate((rest[1], row)), np.concatenate((rest[2], points))
            starts = [s for a, z in _runs(part) for s in range(a, z, BLOCK)]
            yield _block_rows(part, row, points, [*starts])  # the last one, which may go on in the next batch, waits
            rest = tuple(x[starts[-1] :] for x in (part, row, points)) if starts else rest
        if rest is not None:
            yield _block_rows(*rest, [0, len(rest[0])])

    pieces = base.select("row", "q").mapInArrow(cut, "part int, place long, row long, piece binary")
    n = max(1, base.count() * parts // 65536)
    dealt = pieces.repartitionByRange(n, "part", "place", "row").sortWithinPartitions("part", "place", "row")
    return materialise(dealt.mapInArrow(gather, _BLOCKS), "hilbert-blocks")


def _runs(part: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(part)) + 1
    bounds = [0, *edges.tolist(), len(part)]
    return [(a, z) for a, z in zip(bounds, bounds[1:]) if z > a]


def _block_rows(part: np.ndarray, row: np.ndarray, points: np.ndarray, bounds: list[int]) -> pa.RecordBatch:
    """Blocks from each bound to the next."""
    spans = list(zip(bounds, bounds[1:]))
    cut = lambda f: [f(slice(a, z)).tobytes() for a, z in spans]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int(part[a]) for a, _ in spans], pa.int32()), pa.array([z - a for a, z in spans], pa.int32()),
            pa.array(cut(lambda s: row[s].astype("<i8")), pa.binary()), pa.array(cut(lambda s: points[s].astype("<i4")), pa.binary()),
            pa.array(cut(lambda s: points[s].min(0).astype("<i4")), pa.binary()), pa.array(cut(lambda s: points[s].max(0).astype("<i4")), pa.binary()),
            pa.array(cut(lambda s: points[s].sum(0, dtype=np.int64).astype("<i8")), pa.binary()),
        ],
        ["part", "n", "rows", "points", "low", "high", "sums"],
    )


def _lists(batch: pa.RecordBatch, codebooks: np.ndarray):
    """(block, part, shortlisted entries) of each block."""
    width = codebooks.shape[2]
    part, low, high = batch.column(0).to_numpy(), unpacked(batch.column(4), width), unpacked(batch.column(5), width)
    for p in np.unique(part).tolist():
        some = np.flatnonzero(part == p)
        for b, able in zip(some.tolist(), shortlists(low[some], high[some], codebooks[p].astype(np.int64))):
            yield b, p, np.flatnonzero(able)


def code_vectors(
    rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, dims: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> VectorCodes:
    """Codebooks and codes of every vector of ``dims`` finite components.

    Components become the integers floor(scale * x), and a vector is cut into ``parts`` pieces. Each
    part's codebook starts as that part of the ``entries`` vectors of smallest id; in each of
    ``rounds`` rounds every piece goes to its nearest entry (ties: the lower index) and each entry
    becomes the floor of its pieces' mean; unused ones stay. A last pass gives codes and errors.

    Pieces are sorted along a Hilbert curve once and written as flat blocks. A round reads the blocks:
    from a block's box each entry's least and greatest distance leave a shortlist; with one entry on it
    the block's stored sum is all that is needed, else a small kernel compares the block's pieces with
    the shortlist. Tasks send one sum per entry, so no vector moves in a round. The driver holds the
    codebooks, ``parts * entries`` pieces. Pieces of a vector meet again by its row number.

    Vectors that are null, of another length, or with null or non-finite components are left out.
    Repeated rows count as often as they come; those that repeat an id are ordered by their integers'
    bytes; null ids come last and stay; with fewer than ``entries`` vectors there are fewer entries; an
    empty table gives none. Other columns are ignored. ``dims`` must be a multiple of ``parts``.
    """
    if dims % parts:
        raise ValueError(f"{dims} components cannot be cut into {parts} equal parts")
    spark, width = rows.sparkSession, dims // parts
    named = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    base = whole_numbers(named, "vector", dims, scale, ["id", "label"], "vectors")
    first = base.orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    seeds = np.array([np.frombuffer(r.q, "<i4") for r in first], np.int64).reshape(-1, dims)
    codebooks = np.ascontiguousarray(seeds.reshape(len(seeds), parts, width).transpose(1, 0, 2))
    low, high = (seeds.min(0), seeds.max(0)) if len(seeds) else (np.zeros(dims), np.ones(dims))
    blocks = hilbert_blocks(base, dims, parts, low, high)

    for _ in range(rounds if len(seeds) else 0):
        shared = spark.sparkContext.broadcast(codebooks)

        def total(batches, shared=shared):
            now = shared.value
            sums, counts = np.zeros(now.shape, np.int64), np.zeros(now.shape[:2], np.int64)
            for batch in batches:
                whole = unpacked(batch.column(6), width, "<i8")
                for b, p, able in _lists(batch, now):
                    if len(able) == 1:
                        sums[p, able[0]] += whole[b]
                        counts[p, able[0]] += batch.column(1)[b].as_py()
                        continue
                    points = np.frombuffer(batch.column(3)[b].as_py(), "<i4").reshape(-1, width)
                    more, n = sums_by(points, nearest(points, now[p][able])[0], len(able))
                    sums[p, able] += more
                    counts[p, able] += n
            yield partial_rows({(p,): (sums[p], counts[p]) for p in range(parts)}, ["part", "entry"])

        partials = blocks.mapInArrow(total, "part int, entry int, n long, sums array<long>")
        moved = codebooks.copy()
        for key, mean in mean_rows(partials, ["part", "entry"]).items():
            moved[key] = mean
        if (moved == codebooks).all():  # further rounds would change nothing
            break
        codebooks = moved

    shared = spark.sparkContext.broadcast(codebooks)

    def final(batches):
        for batch in batches:
            for b, p, able in _lists(batch, shared.value):
                points = np.frombuffer(batch.column(3)[b].as_py(), "<i4").reshape(-1, width)
                found, error = nearest(points, shared.value[p][able])
                row = np.frombuffer(batch.column(2)[b].as_py(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.full(len(row), p, np.int32)), pa.array(able[found].astype(np.int32)), pa.array(error)], ["row", "part", "entry", "error"])

    found = blocks.mapInArrow(final, "row long, part int, entry int, error long")
    entry = [F.max(F.when(F.col("part") == p, F.col("entry"))) for p in range(parts)]
    codes = found.groupBy("row").agg(F.array(*entry).alias("code"), F.sum("error").alias("error"))
    return VectorCodes(base.select("row", "id", "label").join(codes, "row").select("row", "id", "label", "code", "error"), codebooks)


def op13_vector_codes(spark, sf_dir):
    made = code_vectors(documents(spark, sf_dir, "embeddings"))
    digits = F.array_join(F.transform("code", lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")
    codes = materialise(made.codes.select("id", "label", digits.alias("code"), "error"), "vector-codes")
    by_label = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    named = ",".join(map(str, made.codebooks.ravel().tolist()))
    found = codes.join(by_label, codes["label"].eqNullSafe(by_label["of"]))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.sha2(F.lit(named), 256).alias("codebooks_sha256"))


def _sql(parts: int = 4, entries: int = 256, rounds: int = 4, width: int = 16) -> str:
    """The same rounds as a chain of tables: b0 holds the first codebooks, a0 the first assignment, and so on."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {parts * width} AND len(embedding) = {parts * width})""",
        f"p AS MATERIALIZED (SELECT vec_id, part, q[part * {width} + 1 : part * {width} + {width}] AS x FROM v, range({parts}) t(part))",
        f"""b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c
            FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries}))""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, part, any_value(x) AS x, min({{'d': d, 'entry': entry}}) AS best FROM
            (SELECT vec_id, p.part, x, entry, CAST(list_sum(list_transform(range(1, {width + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT) AS d
             FROM p JOIN b{r} ON p.part = b{r}.part) GROUP BY vec_id, part)""")
        if r < rounds:
            steps.append(f"""b{r + 1} AS MATERIALIZED (SELECT part, entry, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY i) AS c FROM
                (SELECT part, best.entry AS entry, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, {width + 1}) t(i) GROUP BY ALL) GROUP BY part, entry
                UNION ALL SELECT part, entry, c FROM b{r} WHERE (part, entry) NOT IN (SELECT (part, best.entry) FROM a{r}))""")
    steps.append(f"""m AS MATERIALIZED (SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)""")
    return f"""WITH {", ".join(steps)}
    SELECT v.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
    FROM v JOIN m USING (vec_id)"""


ORACLE_SQL = _sql()

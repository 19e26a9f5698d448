"""Centroid clustering of integer vectors; Ptolemy's inequality over pairs of pivots spares most distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType

from fernhill.llm._shared import documents, materialise
from fernhill.llm._vectors import mean_rows, packed, partial_rows, squared, sums_by, unpacked, whole_numbers

#: Vectors from which pivots are made, and pivots.
POOL, PIVOTS = 4096, 8
#: Roots, products and sums of the bounds are each off by less than 2^-50 of their size.
_SLACK = 2.0**-48


def choose_pivots(pool: np.ndarray, most: int = PIVOTS, rounds: int = 10) -> np.ndarray:
    """Distinct points near which centroids may end: those that the same rounds give over the pool."""
    points = np.unique(pool[:most], axis=0)
    for _ in range(rounds if len(points) else 0):
        sums, counts = sums_by(pool, assign(pool, None, points, None)[0], len(points))
        points = np.unique(np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], points), axis=0)
    return points


def pairs_of(n: int) -> list[tuple[int, int]]:
    """The fixed pairs of ``n`` pivots: neighbours in a ring."""
    return [(i, (i + 1) % n) for i in range(n if n > 2 else n - 1)]


class Bounds:
    """Lower and upper bounds of distances between vectors and centroids, from both sides' distances to pivots.

    For pivots p and q Ptolemy's inequality gives |xp * cq - xq * cp| <= xc * pq <= xp * cq + xq * cp.
    Bounds are widened by more than their rounding errors, so that none leaves out a nearest centroid.
    """

    def __init__(self, pivots: np.ndarray, centroids: np.ndarray):
        self.pairs = pairs_of(len(pivots))
        self.apart = [float(np.sqrt(float(squared(pivots[p : p + 1], pivots[q : q + 1])[0]))) for p, q in self.pairs]
        self.of = [np.sqrt(squared(centroids, p[None]).astype(np.float64)) for p in pivots]

    def __call__(self, cached: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each row of squared pivot distances to each centroid."""
        x = np.sqrt(cached.astype(np.float64))
        low, high = np.zeros((len(x), len(self.of[0]))), np.full((len(x), len(self.of[0])), np.inf)
        for (p, q), apart in zip(self.pairs, self.apart):
            one, two = np.multiply.outer(x[:, p], self.of[q]), np.multiply.outer(x[:, q], self.of[p])
            both = one + two
            np.maximum(low, (np.abs(one - two) - both * _SLACK) / apart, out=low)
            np.minimum(high, both / apart, out=high)
        return low * (1 - _SLACK), high * (1 + _SLACK)


def assign(q: np.ndarray, cached: np.ndarray | None, centroids: np.ndarray, bounds: Bounds | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector (ties: the smaller number), the squared distance, and how many distances were computed.

    The centroid with the smallest upper bound comes first; then, in the order of their numbers, all
    whose lower bound does not exceed the best exact distance.
    """
    if bounds is None or not bounds.pairs:
        low = np.zeros((len(q), len(centroids)))
        first = np.zeros(len(q), np.int64)
    else:
        low, high = bounds(cached)
        first = high.argmin(1)
        low *= low
        low *= 1 - _SLACK
    best, cluster, computed = squared(q, centroids[first]), first.copy(), len(q)
    for j in range(len(centroids)):
        left = np.flatnonzero((low[:, j] <= best) & (first != j))
        computed += len(left)
        d = squared(q[left], centroids[j : j + 1])
        better = (d < best[left]) | ((d == best[left]) & (j < cluster[left]))
        best[left[better]], cluster[left[better]] = d[better], j
    return cluster, best, computed


def _slices(batches, dims: int, pivots: int, k: int):
    """(part, q, cached) of few enough rows that the bounds to all centroids are some 16 MB."""
    step = max(64, 2**21 // max(1, k))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, unpacked(part.column(part.num_columns - 2), dims), unpacked(part.column(part.num_columns - 1), pivots, "<i8")


def cluster_vectors(
    rows: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of every vector of ``dims`` finite components.

    Components become the integers floor(scale * x), so that every sum, mean and distance is exact and
    no order of tasks shows. Centroids start as the ``k`` vectors with the smallest sha256 of
    ``seed:id``; each of ``rounds`` rounds assigns all vectors (ties: the smaller number) and replaces
    each centroid by the floor of its vectors' mean; an empty one stays. A last pass assigns all again.

    A first pass writes integers and squared distances to ``PIVOTS`` pivots, which are cluster
    means of the ``POOL`` vectors that come first by the seed's hash (they decide about speed alone). A round is one
    read of that table: tasks keep a sum for each centroid and send at most ``k`` rows, so no vector
    moves and a large cluster is no hot key. The driver holds ``k`` centroids, pool and pivots.

    Vectors that are null, of another length, or with null or non-finite components are left out;
    repeated rows count as often as they come, those that repeat an id are ordered by their integers' bytes;
    null ids come last among the seeds and stay in the result; with fewer than ``k`` vectors there are
    fewer centroids; an empty table gives none. Other columns are ignored. Squared lengths of over
    2^60 in integers are an error.
    """
    spark = rows.sparkSession
    named = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    base = whole_numbers(named, "vector", dims, scale, ["id"], "vectors")
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = base.orderBy(code.asc_nulls_last(), F.col("id").asc_nulls_last(), "q").limit(max(k, POOL)).select("q").collect()
    pool = np.array([np.frombuffer(r.q, "<i4") for r in first], np.int64).reshape(-1, dims)
    centroids, pivots = pool[:k].copy(), choose_pivots(pool)
    n_pivots = max(1, len(pivots))

    def measure(batches):
        for batch in batches:
            q = unpacked(batch.column(1), dims)
            cached = np.stack([squared(q, p[None]) for p in pivots], 1) if len(pivots) else np.zeros((len(q), 1), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed(cached.astype("<i8"))], ["id", "q", "cached"])

    schema = base.select("id", "q").schema.add("cached", BinaryType())
    table = materialise(base.select("id", "q").mapInArrow(measure, schema), "pivot-distances")

    def nearest(shared, batches):
        now = shared.value
        bounds = Bounds(pivots, now)
        for part, q, cached in _slices(batches, dims, n_pivots, len(now)):
            yield part, q, *assign(q, cached, now, bounds)[:2]

    for _ in range(rounds if len(centroids) else 0):
        shared = spark.sparkContext.broadcast(centroids)

        def total(batches, shared=shared):
            sums, counts = np.zeros(shared.value.shape, np.int64), np.zeros(len(shared.value), np.int64)
            for _, q, cluster, _ in nearest(shared, batches):
                more, n = sums_by(q, cluster, len(counts))
                sums, counts = sums + more, counts + n
            yield partial_rows({(): (sums, counts)}, ["cluster"])

        partials = table.select("q", "cached").mapInArrow(total, "cluster int, n long, sums array<long>")
        moved = centroids.copy()
        for key, mean in mean_rows(partials, ["cluster"]).items():
            moved[key] = mean
        if (moved == centroids).all():  # further rounds would change nothing
            break
        centroids = moved

    shared = spark.sparkContext.broadcast(centroids)

    def final(batches):
        for part, _, cluster, best in nearest(shared, batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cluster.astype(np.int32)), pa.array(best)], ["id", "cluster", "distance"])

    out = base.select("id").schema.add("cluster", IntegerType()).add("distance", LongType())
    found = materialise(table.mapInArrow(final, out), "clusters")
    inertia = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    about = [(j, inertia.get(j, 0), sum(inertia.values()), c) for j, c in enumerate(centroids.tolist())]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    # a row per centroid: k bounds what is broadcast
    return found.join(F.broadcast(about), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op12_centroids(spark, sf_dir):
    found = cluster_vectors(documents(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


def _sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """The same rounds as a chain of tables: c0 holds the first centroids, a0 the first assignment, and so on."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster, q AS c FROM v
            QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id)) <= {k})""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(q) AS q, min({{'d': d, 'cluster': cluster}}) AS best FROM
            (SELECT vec_id, q, cluster, CAST(list_sum(list_transform(range(1, {dims + 1}), lambda i: (q[i] - c[i]) * (q[i] - c[i]))) AS BIGINT) AS d FROM v, c{r}) GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT cluster, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY i) AS c FROM
                (SELECT best.cluster AS cluster, i, sum(q[i]) AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY ALL) GROUP BY cluster
                UNION ALL SELECT cluster, c FROM c{r} WHERE cluster NOT IN (SELECT best.cluster FROM a{r}))""")
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, CAST(cluster AS INT) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
        CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} ON best.cluster = cluster"""


ORACLE_SQL = _sql()

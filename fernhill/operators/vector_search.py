"""Nearest vectors: exact search as a grid of cells, and an inverted-file index with compact codes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fernhill.tables import written

#: Images and queries of a cell (on the average; a hash deals them), and images and queries that a kernel takes at once.
CELL_IMAGES, CELL_QUERIES, SLICE, BLOCK = 16384, 1024, 2048, 128
#: Vectors from which an index learns, the most lists, and bytes of a code.
SAMPLE, MOST_LISTS, CODE = 20_000, 4096, 16


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length one; a zero vector stays."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    v = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if not n or len(v) % n or len(np.unique(np.diff(column.offsets.to_numpy()))) > 1:
        raise ValueError("vectors must have one length")
    v = v.reshape(n, -1)
    return v / np.where((size := np.linalg.norm(v, axis=1)) > 0, size, 1)[:, None]


def first_k(near: np.ndarray, k: int) -> np.ndarray:
    """A mask of the k largest of each row; among equal ones the leftmost."""
    if near.shape[1] <= k:
        return near > -np.inf
    least = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
    above, equal = near > least, near == least
    return (above | (equal & (np.cumsum(equal, 1) <= k - above.sum(1, keepdims=True)))) & (near > -np.inf)


def top_pairs(q: np.ndarray, v: np.ndarray, k: int, digits: int | None = 6, probed: np.ndarray | None = None, lists: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, image, similarity) of each query's k best, a block of queries at a time, so that a task holds few similarities.

    With ``lists``, the list of each image, only those count that the query has ``probed`` (query, list).
    """
    found = [_block_pairs(q[at : at + BLOCK], v, k, digits, None if probed is None else probed[at : at + BLOCK], lists) for at in range(0, max(1, len(q)), BLOCK)]
    return np.concatenate([x[0] + n * BLOCK for n, x in enumerate(found)]), np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found])


def _block_pairs(q: np.ndarray, v: np.ndarray, k: int, digits: int | None, probed: np.ndarray | None, lists: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``top_pairs`` of a block of queries, a slice of images at a time: what is kept is k for each query."""
    kept: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    for at in range(0, len(v), SLICE):
        near = q @ v[at : at + SLICE].T
        near = near if digits is None else np.round(near, digits) + 0.0
        if lists is not None:
            near[~probed[:, lists[at : at + SLICE]]] = -np.inf
        i, j = np.nonzero(first_k(near, k))
        found = [np.concatenate(x) for x in zip(kept, (i, j + at, near[i, j]))]
        order = np.lexsort((found[1], -found[2], found[0]))
        i = found[0][order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        kept = tuple(x[order][place < k] for x in found)
    return kept


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _vector(column: str) -> Column:
    return F.col(column).cast("array<double>")


def _most(rows: DataFrame, scope: str | None) -> int:
    """Rows of the largest scope."""
    return rows.count() if scope is None else rows.groupBy(scope).count().agg(F.max("count")).first()[0] or 0


def _grid(images: DataFrame, queries: DataFrame, id_col: str, vec_col: str, extra: Sequence[str], kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str, scope: str | None = None) -> DataFrame:
    """``kernel`` on every cell of a grid: a hash deals images into rows and queries into columns of it.

    An image goes to each column and a query to each row, so that each pair meets in one cell, and a
    cell is of bounded size whatever the tables' sizes. Copies of a vector differ in their ids. With a
    ``scope``, a column of both, there is a grid for each of its values.
    """
    vectors, asked = images.where(F.col(vec_col).isNotNull()), queries.where("embedding IS NOT NULL")
    across, down = (max(1, -(-_most(t, scope) // size)) for t, size in ((asked, CELL_QUERIES), (vectors, CELL_IMAGES)))
    side = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = F.col(scope).alias("scope") if scope else F.lit(0).alias("scope")
    left = vectors.select(of, side(id_col, down).alias("down"), every(across).alias("across"), id_col, *extra, _vector(vec_col).alias("v"))
    right = asked.select(of, every(down).alias("down"), side("query_id", across).alias("across"), "query_id", _vector("embedding").alias("v"))

    def cell(images: pa.Table, queries: pa.Table) -> pa.Table:
        some = images.num_rows and queries.num_rows
        return kernel(images if some else images.slice(0, 0), queries if some else queries.slice(0, 0))

    keys = ["scope", "down", "across"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, schema)


def vector_topk(images: DataFrame, queries: DataFrame, k: int, id_col: str = "image_id", vec_col: str = "embedding", ties: Sequence[str] = (), scope: str | None = None) -> DataFrame:
    """(query_id, image_id, similarity, rank): exact cosine top-k of each query.

    queries has (query_id, embedding); with a ``scope`` both tables have that column, and a query sees
    images of its own scope only. Similarities are rounded to 6 places before they are ranked; ties go
    by the columns ``ties`` of the images, then by id. Images and queries meet in the cells of a grid,
    where each query keeps its k best; those of all cells are ranked once more. Rows without a vector
    are left out; without images or queries there are no rows; vectors of several lengths are an error.
    """
    ties = [c for c in ties if c != id_col]
    order = [*ties, id_col]
    fields = [*(f"{c} {_kind(images, c)}" for c in order), "similarity double"]

    def best(images: pa.Table, queries: pa.Table) -> pa.Table:
        images = images.sort_by([(c, "ascending") for c in order])
        i, j, near = top_pairs(unit_rows(queries["v"]), unit_rows(images["v"]), k) if images.num_rows else ([], [], [])
        i, j = pa.array(i, pa.int64()), pa.array(j, pa.int64())
        return pa.table([queries["query_id"].take(i), *(images[c].take(j) for c in order), pa.array(near, pa.float64())], names=["query_id", *order, "similarity"])

    found = _grid(images, queries, id_col, vec_col, ties, best, ", ".join([f"query_id {_kind(queries, 'query_id')}", *fields]), scope)
    w = W.partitionBy("query_id").orderBy(F.desc("similarity"), *order)
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("query_id", id_col, "similarity", "rank")


def product_similarity(images: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, product_id, similarity): the best similarity of a product's other images to each query.

    images: (image_id, product_id, embedding); an image is another one if its id is not the query's.
    Pairs meet as in ``vector_topk``; a cell keeps one number for each query and product in it.
    """

    def best(images: pa.Table, queries: pa.Table) -> pa.Table:
        if not images.num_rows:
            return pa.table([queries["query_id"], images["product_id"], pa.array([], pa.float64())], names=["query_id", "product_id", "similarity"])
        names, queries_of, found = images["product_id"].combine_chunks().dictionary_encode(), [], []
        which, ids, q, v = names.indices.to_numpy(), queries["query_id"].to_numpy(), unit_rows(queries["v"]), unit_rows(images["v"])
        order = np.argsort(which, kind="stable")
        starts = np.searchsorted(which[order], np.arange(len(names.dictionary)))
        image = images["image_id"].to_numpy()[order]
        for at in range(0, len(q), 128):
            near = np.round(q[at : at + 128] @ v[order].T, 6) + 0.0
            near[ids[at : at + 128, None] == image[None, :]] = -np.inf
            most = np.maximum.reduceat(near, starts, axis=1)
            i, j = np.nonzero(most > -np.inf)
            queries_of.append(i + at)
            found.append((j, most[i, j]))
        i, j, near = np.concatenate(queries_of), np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        return pa.table([queries["query_id"].take(pa.array(i)), names.dictionary.take(pa.array(j)), pa.array(near)], names=["query_id", "product_id", "similarity"])

    schema = f"query_id {_kind(queries, 'query_id')}, product_id {_kind(images, 'product_id')}, similarity double"
    found = _grid(images, queries, "image_id", "embedding", ["product_id"], best, schema)
    return found.groupBy("query_id", "product_id").agg(F.max("similarity").alias("similarity"))


def _means(x: np.ndarray, k: int, rounds: int, seed: int, unit: bool) -> np.ndarray:
    """k means of the rows of x, from rows drawn by a seed; an empty one stays."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([nearest_rows(x[at : at + 4096], c) for at in range(0, len(x), 4096)])
        order, counts = np.argsort(own, kind="stable"), np.bincount(own, minlength=len(c))
        some = np.flatnonzero(counts)
        c[some] = np.add.reduceat(x[order], (np.cumsum(counts) - counts)[some], axis=0) / counts[some, None]
        if unit:
            c /= np.where((size := np.linalg.norm(c, axis=1)) > 0, size, 1)[:, None]
    return c


def nearest_rows(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


@dataclass
class VectorIndex:
    """rows: (list, chunk, id, code) of every vector, written; sizes[list]: its rows; chunks: the number of chunks, of bounded size, by id hash."""

    rows: DataFrame
    images: DataFrame
    id_col: str
    centroids: np.ndarray
    books: list[np.ndarray]
    sizes: np.ndarray
    chunks: int

    def candidates(self, queries: DataFrame, probes: int, rescore: int) -> DataFrame:
        """(query_id, id, approx): for each query the ``rescore`` best codes in its ``probes`` nearest lists.

        Rows and queries meet in the cells of a grid, whatever their lists, so that a query travels once for
        each cell row and gets ``rescore`` codes from it, however many lists it probes.
        """
        centroids, books, id_col, kind = self.centroids, self.books, self.id_col, _kind(queries, "query_id")
        asked = queries.where("embedding IS NOT NULL").select("query_id", _vector("embedding").alias("v"))
        across, down = max(1, -(-asked.count() // (8 * CELL_QUERIES))), self.chunks
        side = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = asked.select(side("query_id", across).alias("across"), every(down).alias("chunk"), "query_id", "v")
        right = self.rows.select(every(across).alias("across"), "chunk", "list", id_col, "code")

        def score(queries: pa.Table, rows: pa.Table) -> pa.Table:
            found = [[], [], []]
            if rows.num_rows and queries.num_rows:
                rows = rows.sort_by(id_col)
                codes, lists = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(rows.num_rows, -1), rows["list"].to_numpy()
                v, q = np.concatenate([book[codes[:, m]] for m, book in enumerate(books)], 1), unit_rows(queries["v"])
                for at in range(0, len(q), CELL_QUERIES):
                    some = q[at : at + CELL_QUERIES]
                    probed = np.zeros((len(some), len(centroids)), bool)
                    np.put_along_axis(probed, np.argsort(-(some @ centroids.T), 1, kind="stable")[:, :probes], True, 1)
                    i, j, near = top_pairs(some, v, rescore, None, probed, lists)
                    for x, more in zip(found, (i + at, j, near)):
                        x.append(more)
            i, j, near = (np.concatenate(x) if x else np.zeros(0) for x in found)
            return pa.table([queries["query_id"].take(pa.array(i.astype(np.int64))), rows[id_col].take(pa.array(j.astype(np.int64))), pa.array(near)], names=["query_id", id_col, "approx"])

        keys = ["across", "chunk"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, f"query_id {kind}, {id_col} {_kind(self.rows, id_col)}, approx double")
        best = W.partitionBy("query_id").orderBy(F.desc("approx"), id_col)
        return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= rescore).drop("n")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, rescore: int | None = None) -> DataFrame:
        """(query_id, id, similarity, rank): the k best by exact cosine among ``rescore`` candidates (15 k), ties by id.

        Without ``probes`` half of the lists are probed, which the codes make cheap: they are an eighth of the vectors' bytes or less.
        """
        near = self.candidates(queries, probes or max(1, len(self.centroids) // 2), rescore or 15 * k)
        id_col = self.id_col
        vectors = self.images.select(id_col, _vector("embedding").alias("iv"))
        rows = near.join(queries.select("query_id", _vector("embedding").alias("qv")), "query_id").join(vectors, id_col)

        def exact(batches):
            for batch in batches:
                if batch.num_rows:
                    q, v = unit_rows(batch.column(2)), unit_rows(batch.column(3))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(np.einsum("ij,ij->i", q, v), 6) + 0.0)], ["query_id", id_col, "similarity"])

        schema = f"query_id {_kind(queries, 'query_id')}, {id_col} {_kind(self.images, id_col)}, similarity double"
        scored = rows.select("query_id", id_col, "qv", "iv").mapInArrow(exact, schema)
        best = W.partitionBy("query_id").orderBy(F.desc("similarity"), id_col)
        return scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


def build_index(images: DataFrame, id_col: str = "image_id", lists: int | None = None, sample: int = SAMPLE, seed: int = 5) -> VectorIndex:
    """An inverted-file index of all images that have a vector (id, embedding).

    List centroids and code books are fitted on the ``sample`` vectors with the smallest id hashes;
    every vector gets a list and a code of ``CODE`` bytes at most (a byte for each of as many parts of the
    vector). There are four lists for the root of the number of vectors, ``MOST_LISTS`` at most; no group
    is by list, so that none grows with the table.
    """
    some = images.where("embedding IS NOT NULL").select(id_col, _vector("embedding").alias("embedding"))
    chosen = some.orderBy(F.xxhash64(id_col), id_col).limit(sample).toArrow()
    n = some.count()
    if not n:
        return VectorIndex(written(some.selectExpr("0 AS list", "0 AS chunk", id_col, "binary('') AS code"), "index"), images, id_col, np.zeros((0, 0)), [], np.zeros(0, np.int64), 1)
    x = unit_rows(chosen["embedding"])
    centroids = _means(x, lists or min(MOST_LISTS, max(1, int(4 * n**0.5))), 8, seed, True)
    parts = np.array_split(np.arange(x.shape[1]), min(CODE, x.shape[1]))
    books = [_means(x[:, p], 256, 6, seed + m, False) for m, p in enumerate(parts)]

    def file(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = unit_rows(batch.column(1))
            own = (v @ centroids.T).argmax(1)
            codes = np.stack([nearest_rows(v[:, p], book) for p, book in zip(parts, books)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", id_col, "code"])

    filed = written(some.mapInArrow(file, f"list int, {id_col} {_kind(images, id_col)}, code binary"), "index")
    sizes = np.zeros(len(centroids), np.int64)
    for r in filed.groupBy("list").count().collect():  # a row per list
        sizes[r[0]] = r[1]
    chunks = -(-n // CELL_IMAGES)
    rows = filed.withColumn("chunk", F.pmod(F.xxhash64(id_col), F.lit(chunks)).cast("int"))
    return VectorIndex(rows, images, id_col, centroids, books, sizes, chunks)


def ann_topk(images: DataFrame, queries: DataFrame, k: int, probes: int | None = None, rescore: int | None = None) -> DataFrame:
    """Approximate top-k (query_id, image_id, similarity, rank) by ``build_index`` and its search."""
    return build_index(images).search(queries, k, probes, rescore)

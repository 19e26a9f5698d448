"""Clustering and codes of vectors against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from fernhill.llm import _vectors, centroids, vector_codes as codes

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string"


def plain_clusters(rows, k, rounds, dims, seed="3"):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    means = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(means))
    for _ in range(rounds):
        groups: dict = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        means = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else means[j] for j in range(len(means))]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    total = {j: sum(d for _, c, d in found if c == j) for j in range(len(means))}
    return sorted(((i, j, d, total[j], sum(total.values()), means[j]) for i, j, d in found), key=repr)


def vectors(n, dims, seed, spread=0.3):
    r = random.Random(seed)
    middle = [[r.uniform(-1, 1) for _ in range(dims)] for _ in range(4)]
    return [(i, [float(np.float32(c + r.gauss(0, spread))) for c in r.choice(middle)], r.choice([1, 2, None]), "x") for i in range(n)]


@pytest.mark.parametrize("seed,k,spread", [(1, 8, 0.3), (2, 3, 0.01), (3, 1, 1.0), (4, 5, 0.0)])
def test_clusters_equal_plain_rounds(spark, seed, k, spread):
    rows = vectors(150, 6, seed, spread)
    got = centroids.cluster_vectors(spark.createDataFrame(rows, SCHEMA), k=k, rounds=4, dims=6)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_clusters(rows, k, 4, 6)


def test_clusters_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1, "a"), (2, [], 1, "a"), (3, [1.0], 1, "a"), (4, [nan, 1.0], 1, "a"), (5, [inf, 1.0], 1, "a"), (6, [None, 1.0], 1, "a"), (None, [0.5, -0.5], None, None)]
    rows += [(7, [0.1, 0.1], 1, "b")] * 60 + [(7, [0.1, 0.2], 1, "b"), (8, [-3.0, -0.0005], 2, "c"), (9, [1000000.0, -7.0], 2, "c"), (10, [0.0, 0.0], 2, "c"), (11, [0.2, 0.0], 2, "c")]
    got = centroids.cluster_vectors(spark.createDataFrame(rows, SCHEMA).repartition(7), k=4, rounds=3, dims=2)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_clusters(rows, 4, 3, 2)
    assert centroids.cluster_vectors(spark.createDataFrame([], SCHEMA), dims=2).count() == 0
    assert centroids.cluster_vectors(spark.createDataFrame(rows[:6], SCHEMA), dims=2).count() == 0
    assert centroids.cluster_vectors(spark.createDataFrame(rows[6:7], SCHEMA), dims=2).count() == 1
    with pytest.raises(Exception, match="too long"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e8, 1.0], 1, "")], SCHEMA), dims=2).count()


def test_bounds_hold_and_spare_distances():
    r = np.random.default_rng(5)
    for dims, spread in ((3, 4), (16, 60), (64, 2**20)):
        middle = r.integers(-spread * 8, spread * 8, (6, dims))
        x = middle[r.integers(0, 6, 900)] + r.integers(-spread, spread, (900, dims))
        pivots, now = centroids.choose_pivots(x[:200]), x[:6] + 1
        cached = np.stack([_vectors.squared(x, p[None]) for p in pivots], 1)
        low, high = centroids.Bounds(pivots, now)(cached)
        true = np.stack([np.sqrt(_vectors.squared(x, c[None]).astype(np.longdouble)) for c in now], 1)
        assert (low <= true).all() and (true <= high).all()
        cluster, best, computed = centroids.assign(x, cached, now, centroids.Bounds(pivots, now))
        every = np.stack([_vectors.squared(x, c[None]) for c in now], 1)
        assert (cluster == every.argmin(1)).all() and (best == every.min(1)).all()
        assert computed < 0.7 * every.size


def plain_codes(rows, parts, entries, rounds, dims):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))
    w = dims // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups: dict = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else c0 for e, c0 in enumerate(books[p])]
    out = []
    for i, v, label in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, label, [e for _, e in found], sum(d for d, _ in found)))
    return sorted(out, key=repr), books


@pytest.mark.parametrize("seed,entries,spread", [(1, 16, 0.3), (2, 5, 0.01), (3, 300, 1.0), (4, 4, 0.0)])
def test_codes_equal_plain_rounds(spark, seed, entries, spread, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 8)
    rows = vectors(200, 8, seed, spread)
    got = codes.code_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5), parts=2, entries=entries, rounds=3, dims=8)
    want, books = plain_codes(rows, 2, entries, 3, 8)
    assert sorted(((r.id, r.label, list(r.code), r.error) for r in got.codes.collect()), key=repr) == want
    assert got.codebooks.tolist() == books


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1, "a"), (2, [], 1, "a"), (3, [1.0], 1, "a"), (4, [nan, 1.0], 1, "a"), (5, [inf, 1.0], 1, "a"), (6, [None, 1.0], 1, "a"), (None, [0.5, -0.5], None, None)]
    rows += [(7, [0.1, 0.1], 1, "b")] * 400 + [(7, [0.1, 0.2], 1, "b"), (8, [-3.0, -0.0005], 2, "c"), (9, [700000.0, -700000.0], 2, "c")]
    got = codes.code_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), parts=2, entries=4, rounds=2, dims=2)
    assert sorted(((r.id, r.label, list(r.code), r.error) for r in got.codes.collect()), key=repr) == plain_codes(rows, 2, 4, 2, 2)[0]
    assert codes.code_vectors(spark.createDataFrame([], SCHEMA), dims=64).codes.count() == 0
    with pytest.raises(ValueError):
        codes.code_vectors(spark.createDataFrame(rows, SCHEMA), dims=63)


@pytest.mark.parametrize("width,bits", [(1, 3), (2, 3), (3, 2), (4, 3)])
def test_curve_visits_every_cell_by_steps_to_neighbours(width, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * width, indexing="ij"), -1).reshape(-1, width)
    place = codes.hilbert(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_shortlists_keep_every_nearest_entry():
    r = np.random.default_rng(3)
    for size in (3, 40):
        entries = r.integers(-50, 50, (size, 5))
        points = r.integers(-50, 50, (30, 1, 5)) + r.integers(-6, 6, (30, 20, 5))
        able = codes.shortlists(points.min(1), points.max(1), entries)
        for block, some in zip(points, able):
            whole, d = codes.nearest(block, entries)
            few = np.flatnonzero(some)
            assert (few[codes.nearest(block, entries[few])[0]] == whole).all()
    assert not able.all()
    big = np.array([[2**29, 5]]), np.array([[2**29 + 3, 5], [2**29 - 3, 5], [0, 0]])
    assert codes.nearest(*big)[0].tolist() == [0] and codes.nearest(*big)[1].tolist() == [9]


def test_skewed_pieces_fill_many_partitions(spark):
    rows = [(i, [0.25, -0.5, 0.125, 1.0], 1, "") for i in range(3000)]
    base = _vectors.whole_numbers(spark.createDataFrame(rows, SCHEMA).select("vec_id", "embedding"), "embedding", 4, 1024, ["vec_id"], "v")
    zero, one = np.zeros(4), np.ones(4)
    blocks = codes.hilbert_blocks(base, 4, 2, zero, one)
    assert blocks.groupBy("part").sum("n").count() == 2 and blocks.selectExpr("max(n)").first()[0] <= codes.BLOCK

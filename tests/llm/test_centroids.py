from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from roomledger.llm import centroids as C


def brute(rows, k, rounds, dimension):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted((r for r in kept if r[0] is not None), key=key)[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((distance(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds if centres else 0):
        own = [nearest(v)[1] for _, v in kept]
        groups = [[v for (_, v), n in zip(kept, own) if n == c] for c in range(len(centres))]
        centres = [[sum(x) // len(g) for x in zip(*g)] if g else old for g, old in zip(groups, centres)]
    out = [(i, *reversed(nearest(v))) for i, v in kept] if centres else []
    total = sum(d for _, _, d in out)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, n, d, sum(e for _, m, e in out if m == n), total, sha[n]) for i, n, d in out), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, cluster int")


def found(spark, rows, k, rounds, dimension):
    out = C.with_inertia(*C.clusters(table(spark, rows), k, rounds, dimension))
    return sorted((tuple(r) for r in out.collect()), key=repr)


def vectors(n, dimension, seed, spread=1.0):
    return np.random.default_rng(seed).normal(0, spread, (n, dimension)).astype(np.float32).tolist()


@pytest.mark.parametrize("k,dimension,spread", [(5, 3, 1.0), (40, 8, 0.01), (1, 2, 1.0), (60, 4, 1.0)])
def test_against_all_distances(spark, k, dimension, spread):
    rows = list(enumerate(vectors(50, dimension, k, spread)))
    rows += rows[:7] + [(100, None), (101, [1.0]), (102, [None] * dimension), (103, [float("nan")] * dimension), (104, [float("inf")] * dimension)]
    rows += [(None, rows[3][1]), (None, [0.5] * dimension), (105, [0.0] * dimension)]
    assert found(spark, rows, k, 3, dimension) == brute(rows, k, 3, dimension)


def test_ties_go_to_the_smaller_number():
    centres = np.array([[4, 0], [0, 4], [-4, 0], [0, -4], [4, 0]])
    number, distance, _ = C.SortedLists(centres).nearest(np.array([[0, 0], [2, 2], [-1, -1], [4, 0]]))
    assert number.tolist() == [0, 0, 2, 0] and distance.tolist() == [16, 8, 10, 0]


def test_walks_end_early_and_find_the_nearest():
    random = np.random.default_rng(0)
    for dims in (1, 2, 3, 16):
        centres, points = random.integers(-300, 300, (200, dims)), random.integers(-300, 300, (700, dims))
        number, distance, measured = C.SortedLists(centres).nearest(points)
        every = ((points[:, None, :] - centres[None]) ** 2).sum(axis=2)
        assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
        assert dims > 3 or measured < every.size / 2
    assert C.SortedLists(centres).nearest(points[:0])[2] == 0


def test_one_vector_may_be_a_third_of_all(spark):
    rows = [(i, [0.25, -0.25]) if i % 3 == 0 else (i, v) for i, v in enumerate(vectors(300, 2, 4))]
    assert found(spark, rows, 6, 2, 2) == brute(rows, 6, 2, 2)


def test_empty_tables_and_vectors_without_id(spark):
    assert found(spark, [], 3, 2, 2) == [] == found(spark, [(1, None)], 3, 2, 2) == found(spark, [(None, [1.0, 2.0])], 3, 2, 2)


def test_extreme_components(spark):
    big = float(C.LARGEST // 256)
    rows = [(0, [big, -big]), (1, [-big, big]), (2, [big, big])]
    assert found(spark, rows, 2, 2, 2) == brute(rows, 2, 2, 2)
    with pytest.raises(PySparkException, match="too large for exact distances"):
        found(spark, [(0, [3e30, 1.0])], 1, 1, 2)


def test_other_columns_do_not_clash(spark):
    rows = table(spark, [(1, [1.0, 2.0])]).withColumns({"distance": F.lit("x"), "v": F.lit(1), "inertia": F.lit(2)})
    assert C.with_inertia(*C.clusters(rows, 1, 1, 2)).first().distance == 0

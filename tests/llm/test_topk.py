from __future__ import annotations

import numpy as np
import pytest

from roomledger.llm import topk

KINDS = ["random", "clustered", "equal", "long tail"]


def vectors(kind, n=900, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    if kind == "clustered":
        return np.floor(rng.normal(size=(9, dim))[rng.integers(0, 9, n)] * 200 + rng.normal(size=(n, dim)) * 3).astype(np.int64)
    if kind == "equal":
        return np.repeat(rng.integers(-5, 5, size=(3, dim)), n // 3, axis=0)
    if kind == "long tail":
        return np.floor(rng.normal(size=(n, dim)) * rng.pareto(1, size=(n, 1)) * 100).astype(np.int64)
    return rng.integers(-256, 256, size=(n, dim))


def brute(ids, vectors, own, query, k):
    scores = vectors @ query
    order = np.lexsort((ids, -scores))
    return [(int(scores[i]), int(ids[i])) for i in order if ids[i] != own][:k]


@pytest.mark.parametrize("kind", KINDS)
def test_a_tree_against_brute_force(kind):
    v = vectors(kind)
    ids = np.random.default_rng(2).permutation(len(v)) * 3
    tree = topk.build_tree("t", ids, v, leaf=16, fanout=4)
    for i in range(0, len(v), 90):
        assert topk.search_tree(tree, v[i], int(ids[i]), 5) == brute(ids, v, ids[i], v[i], 5)
    assert topk.search_tree(tree, np.zeros(6, np.int64), -1, 5) == [(0, i) for i in sorted(ids)[:5]]


def test_bounds_save_work_and_cover():
    v, counts = vectors("clustered", 4096), {}
    tree = topk.build_tree("t", np.arange(len(v)), v)
    for i in range(20):
        topk.search_tree(tree, v[i], i, 5, counts)
    assert counts["entries"] < 20 * len(v) * 0.5
    for node in range(len(tree["radius"])):
        if tree["leaf"][node]:
            part = tree["vectors"][tree["first"][node] : tree["last"][node]]
            apart = np.sqrt(((part - tree["centres"][node]) ** 2).sum(axis=1))
            assert (apart <= tree["radius"][node] + 1e-6).all() and len(part) <= topk.LEAF


def frame(spark, v, ids=None):
    rows = [(int(i), (x / 256).tolist(), "clash") for i, x in zip(range(len(v)) if ids is None else ids, v)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def test_search_of_many_trees_and_query_blocks(spark):
    v = vectors("clustered", 600)
    rows = topk.quantised(frame(spark, v))
    found = topk.search(topk.index(rows, tree_size=70), rows.where("vec_id % 20 = 0"), 5, block=7).collect()
    expected = {(q, r + 1, i, s) for q in range(0, 600, 20) for r, (s, i) in enumerate(brute(np.arange(600), v, q, v[q], 5))}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in found} == expected and len(found) == len(expected)


def test_odd_rows(spark):
    rows = spark.createDataFrame(
        [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (2, [0.5, 0.25]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [-0.001, 0.0])],
        "vec_id long, embedding array<double>",
    )
    assert {(r.vec_id, tuple(r.v)) for r in topk.quantised(rows).collect()} == {(1, (128, 64)), (2, (128, 64)), (7, (-1, 0))}
    found = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(rows, rows.where("vec_id = 1"), 5).collect()}
    assert found == {(1, 1, 2, 20480), (1, 2, 2, 20480), (1, 3, 7, -128)}
    repeated = rows.where("vec_id = 1").unionByName(rows.where("vec_id = 1")).unionByName(spark.createDataFrame([(1, [9.0, 9.0])], rows.schema))
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(rows, repeated, 5).collect()} == found
    assert topk.top_k(rows.where("false"), rows, 5).count() == 0
    assert topk.top_k(rows, rows.where("false"), 5).count() == 0

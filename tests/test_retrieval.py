from __future__ import annotations

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomledger.functions import vectors as V
from roomledger.operators import retrieval as R
from roomledger.sources import stores

WAYS = {
    "broadcast": R.nearest_documents,
    "stream": partial(R.nearest_documents, broadcast_bytes=2500),
    "stream in one part": R.nearest_by_stream,
    "cells": R.nearest_by_cells,
    "small blocks": partial(R.nearest_by_cells, pivots=7, block_documents=20, block_questions=15),
    "one pivot": partial(R.nearest_by_cells, pivots=1, block_documents=50, block_questions=1000),
}


def frames(spark, questions, documents):
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(questions)], "question_id long, embedding array<float>")
    d = spark.createDataFrame([(f"d{i:05}", v.tolist()) for i, v in enumerate(documents)], "doc_id string, embedding array<float>")
    return q, d


def brute_force(questions, documents, k):
    out = set()
    for i, q in enumerate(questions.astype(np.float32).astype(float)):
        distances = np.add.accumulate((documents.astype(np.float32).astype(float) - q) ** 2, axis=1)[:, -1]
        for rank, j in enumerate(np.lexsort((np.arange(len(documents)), distances))[:k]):
            out.add((i, rank + 1, f"d{j:05}", round(round(float(distances[j]), 6), 5)))
    return out


def found(df):
    rows = df.collect()
    result = {(r.question_id, r["rank"], r.doc_id, round(r.distance, 5)) for r in rows}
    assert len(rows) == len(result)
    return result


def vectors(kind, n, seed):
    rng = np.random.default_rng(seed)
    if kind == "random":
        return rng.normal(size=(n, 8))
    if kind == "clustered":
        return rng.normal(size=(5, 8))[rng.integers(0, 5, n)] * 10 + rng.normal(size=(n, 8)) * 0.1
    if kind == "a third equal":
        data = rng.normal(size=(n, 8))
        data[: n // 3] = data[0]
        return rng.permutation(data)
    if kind == "grid":
        return rng.integers(0, 3, size=(n, 3)).astype(float)
    if kind == "short":
        return rng.normal(size=(n, 8)) * 2e-4
    if kind == "near copies":
        return rng.normal(size=8) * 250 + rng.normal(size=(n, 8)) * 1e-4
    return rng.normal(size=(n, 8)) * 1e5


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("kind", ["random", "clustered", "a third equal", "grid", "short", "near copies", "long"])
def test_neighbours_against_brute_force(spark, kind, way):
    documents, questions = vectors(kind, 300, 1), vectors(kind, 90, 2)
    if kind == "long":
        documents, questions = np.round(documents, 1), np.round(questions, 1)
    q, d = frames(spark, questions, documents)
    result = WAYS[way](q, d, 5)
    if kind == "long":  # squared distances near 1e11: compare which documents, not six decimals
        assert {r[:3] for r in found(result)} == {r[:3] for r in brute_force(questions, documents, 5)}
    else:
        assert found(result) == brute_force(questions, documents, 5)


@pytest.mark.parametrize("way", WAYS)
def test_fewer_documents_than_asked_for(spark, way):
    documents, questions = vectors("random", 3, 1), vectors("random", 4, 2)
    q, d = frames(spark, questions, documents)
    assert found(WAYS[way](q, d, 5)) == brute_force(questions, documents, 5)
    assert WAYS[way](q, d.where("false"), 5).count() == 0
    assert WAYS[way](q.where("false"), d, 5).count() == 0


@pytest.mark.parametrize("way", WAYS)
def test_rows_without_vector_take_no_part(spark, way):
    q, d = frames(spark, vectors("random", 6, 1), vectors("random", 40, 2))
    holes = lambda df, key: df.withColumn("embedding", F.when(F.hash(key) % 3 != 0, F.col("embedding")))
    with_holes = WAYS[way](holes(q, "question_id"), holes(d, "doc_id"), 5)
    without = R.nearest_documents(
        holes(q, "question_id").where("embedding is not null"), holes(d, "doc_id").where("embedding is not null"), 5
    )
    assert found(with_holes) == found(without) != set()


def test_ranks_do_not_depend_on_the_way(spark):
    documents = np.zeros((7, 3))
    documents[0, 0], documents[6, 0] = 6e-4, 8e-4
    q, d = frames(spark, np.zeros((1, 3)), documents)
    for way in WAYS.values():
        assert [r.doc_id for r in way(q, d, 6).orderBy("rank").collect()] == [f"d{i:05}" for i in (1, 2, 3, 4, 5, 0)]


def test_fifty_pages_and_a_plan_that_does_not_grow(spark, monkeypatch):
    documents, questions = vectors("clustered", 400, 1), vectors("clustered", 60, 2)
    q, d = frames(spark, questions, documents)
    size, steps = R._bytes(d, "doc_id"), []
    for pages in (2, 50):
        out = R.nearest_by_stream(q, d, 5, -(-size // pages))
        text = out._jdf.queryExecution().executedPlan().toString()
        steps.append([text.count(step) for step in ("Exchange", "Union", "MapInArrow", "Join", "Scan")])
        assert "WindowGroupLimit" in text
        assert found(out) == brute_force(questions, documents, 5)
    assert steps[0] == steps[1]
    monkeypatch.setattr(type(d), "toArrow", lambda self: pytest.fail("rows collected"))
    collect = type(d).collect
    monkeypatch.setattr(type(d), "collect", lambda self: collect(self) if self.columns == ["bytes"] else pytest.fail("rows collected"))
    R.nearest_by_stream(q, d, 5, size // 50)


def test_questions_and_documents_of_other_float_types(spark):
    documents, questions = vectors("random", 100, 1), vectors("random", 20, 2)
    q, d = frames(spark, questions, documents)
    wide = q.withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert found(R.nearest_by_stream(wide, d, 5, 2000)) == brute_force(questions, documents, 5)


@pytest.mark.parametrize("dims", [1, 16, 17, 70])
def test_bounded_search_in_one_page(dims):
    rng = np.random.default_rng(dims)
    left, right = rng.normal(size=(40, dims)), np.concatenate([rng.normal(size=(300, dims)), np.zeros((30, dims))])
    _, _, values = V.nearest(left, right, 5)
    bounds = values.reshape(40, 5)[:, 4].copy()
    expected = V.nearest(left, right, 5)
    bounds[::4] = np.inf
    for got, want in zip(V.nearest_within(left, right, 5, bounds), expected):
        assert (got == want).all()
    tight = np.full(40, -1.0)
    assert all(len(part) == 0 for part in V.nearest_within(left, right, 5, tight))
    rows, _, distances = V.nearest_within(left, right, 5, bounds * 0.9)
    assert (distances <= (bounds * 0.9)[rows]).all()


def test_vectors_of_different_length_are_refused(spark):
    d = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "doc_id string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0])], "question_id long, embedding array<float>")
    with pytest.raises(ValueError, match="different length"):
        R.nearest_documents(q, d)


def test_few_cells_are_visited_where_data_has_clusters():
    documents, questions = vectors("clustered", 1000, 5), vectors("clustered", 200, 5)
    centres = documents[:20]
    distances = np.sqrt(np.maximum(V.rough_distances(documents, centres)[0], 0.0))
    cell = distances.argmin(axis=1)
    radii = np.array([distances[cell == c, c].max(initial=0.0) for c in range(20)])
    counts = np.bincount(cell, minlength=20)
    visited = V.visited_cells(questions, centres, radii, counts, 5)
    met = (visited * counts).sum() / (len(questions) * len(documents))
    assert met < 0.6
    rows, cols, _ = V.nearest(questions, documents, 5)
    assert visited[rows, cell[cols]].all()


def documents_frame(spark):
    graph = {"type": "graph", "image_base64": "aW1n", "graph_name": "g", "description": "a chart"}
    return spark.createDataFrame(
        [("d1", "first", {"category": "c"}), ("d2", "second", {"category": "c"}), ("g1", "Graph: g", graph),
         ("g2", "Graph: h", {**graph, "image_base64": "b3RoZXI="}), ("g3", "bare", {"type": "graph"})],
        "doc_id string, page_content string, metadata map<string,string>",
    )


@pytest.mark.parametrize("broadcast_bytes", [R.BROADCAST_BYTES, 0])
def test_a_document_that_all_questions_retrieve(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(R, "HOT_ROWS", 10)
    monkeypatch.setattr(R, "BROADCAST_BYTES", broadcast_bytes)
    n = 300
    questions = spark.range(n).selectExpr("concat('q', id) as question_id")
    retrieved = questions.selectExpr("question_id", "explode(array(struct(1 as rank, 'd1' as doc_id, 0.1D as distance), struct(2 as rank, 'g1' as doc_id, 0.2D as distance))) as r")
    rows = R.per_question(questions, retrieved.select("question_id", "r.*"), documents_frame(spark)).collect()
    assert len(rows) == n == len({r.question_id for r in rows})
    assert {(r.context, r.has_relevant_info, r.graph) for r in rows} == {("first\n\nGraph: g", True, "aW1n")}


def test_the_text_join_reads_no_images(spark, tmp_path):
    path = stores.save_documents(documents_frame(spark), str(tmp_path / "store"))
    retrieved = spark.createDataFrame([("q1", 1, "d1", 0.2)], "question_id string, rank int, doc_id string, distance double")
    text = R.with_documents(retrieved, stores.load_documents(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert "page_content:string,type:string" in text and "image_base64" not in text


@pytest.mark.parametrize("broadcast_bytes", [R.BROADCAST_BYTES, 0])
def test_per_question(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(R, "BROADCAST_BYTES", broadcast_bytes)
    questions = spark.createDataFrame([("q1", 1), ("q2", 2), ("q3", 3), ("q4", 4)], "question_id string, extra int")
    retrieved = spark.createDataFrame(
        [("q1", 2, "d1", 0.2), ("q1", 1, "d2", 0.1), ("q1", 4, "g1", 0.4), ("q1", 3, "g2", 0.3),
         ("q2", 1, "g1", 0.1), ("q4", 1, "g3", 0.1), ("q4", 2, "d1", 0.2)],
        "question_id string, rank int, doc_id string, distance double",
    )
    rows = {r.question_id: r for r in R.per_question(questions, retrieved, documents_frame(spark)).collect()}
    assert rows["q1"].context == "second\n\nfirst\n\nGraph: h\n\nGraph: g"
    assert (rows["q1"].has_relevant_info, rows["q1"].graph, rows["q1"].graph_description) == (True, "b3RoZXI=", "a chart")
    assert (rows["q2"].has_relevant_info, rows["q2"].graph) == (False, "aW1n")
    assert (rows["q3"].has_relevant_info, rows["q3"].context, rows["q3"].graph) == (False, None, None)
    assert (rows["q4"].has_relevant_info, rows["q4"].graph, rows["q4"].graph_description) == (True, None, "")
    assert [rows[f"q{i}"].extra for i in range(1, 5)] == [1, 2, 3, 4]


def test_copies_beyond_the_smallest_keys_are_left_out(spark, monkeypatch):
    distinct, questions = vectors("random", 20, 1), vectors("random", 40, 2)
    documents = distinct[np.random.default_rng(3).integers(0, 20, 3000)]
    q, d = frames(spark, questions, documents)
    assert R._findable(d, 5).count() == 100
    keyless = d.limit(0).unionByName(spark.createDataFrame([(None, distinct[0].tolist())] * 30, d.schema))
    assert R._findable(keyless, 5).count() == 5
    monkeypatch.setattr(R, "nearest_by_stream", lambda *a: pytest.fail("copies are compared"))
    assert found(R.nearest_documents(q, d, 5, 100 * 150)) == brute_force(questions, documents, 5)


def test_questions_of_one_task_are_dealt_out(spark, monkeypatch):
    documents, questions = vectors("random", 100, 1), vectors("random", 60, 2)
    q, d = frames(spark, questions, documents)
    monkeypatch.setattr(R, "PAIRS_SENT", 600)
    out = R.nearest_documents(q.coalesce(1), d, 5)
    assert out.rdd.getNumPartitions() == 10
    assert found(out) == brute_force(questions, documents, 5)


def test_many_pairs_are_cut_into_pages_and_strips(spark, monkeypatch):
    documents, questions = vectors("clustered", 300, 1), vectors("clustered", 90, 2)
    q, d = frames(spark, questions, documents)
    monkeypatch.setattr(R, "PAIRS_AT_ONCE", 1500)
    assert R._grid(1000, 27_000, 1000) == (5, 4)
    assert found(R.nearest_by_stream(q, d)) == brute_force(questions, documents, 5)


def test_small_pages_do_not_repeat_questions_without_end():
    assert [R._grid(size << 20, 1, 1 << 18)[0] for size in (1, 64, 900, 6400)] == [4, 16, 16, 100]


def test_small_blocks_grow_with_their_cell():
    rows = np.array([0, 1, 250, 6_400, 38_000, 615_000])
    assert R._pieces(rows, 100).tolist() == [0, 1, 3, 4, 4, 19]


def test_candidates_of_single_precision_lose_none():
    rng = np.random.default_rng(4)
    for right in (rng.normal(size=(9000, 6)), rng.normal(size=(9000, 6)) * 1e-6 + 300, rng.integers(0, 2, (9000, 6)) * 1e-25):
        left = right[rng.integers(0, 9000, 30)] + rng.normal(size=(30, 6)) * 1e-9
        distances = np.add.accumulate((left[:, None] - right[None]) ** 2, axis=2)[:, :, -1]
        rows, cols, values = V.nearest(left, right, 7)
        best = np.argsort(distances, axis=1, kind="stable")[:, :7]
        assert (cols.reshape(30, 7) == best).all()
        assert (values.reshape(30, 7) == np.take_along_axis(distances, best, axis=1)).all()

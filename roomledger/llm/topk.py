"""Exact top-k by inner product with M-trees.

Vectors are dealt to trees of bounded size: rows near the same pivot first, then cut into trees of at most
``TREE`` vectors. A tree is stored as one page of arrays: routing nodes with centre, covering radius and distance
to the parent's centre, and leaf entries with the distance to their leaf's centre. All trees together form the
index: a table that Spark partitions as it likes, so its size is limited by nothing.

A search is best first. With |v - c| <= r inside a node, a query's product with what the node holds is at most
``q.c + |q| r``; nodes are opened in the order of that bound until it falls under the k-th best product. Before a
child's own ``q.c`` is computed, the stored distance d to its parent p bounds it: ``q.p + |q| (d + r)``; leaf
entries are skipped in the same way. Bounds get a margin for rounding; products of the remaining entries
are integers and exact, so the result is exact.

Queries are sent to the trees in blocks of bounded size; each block reads the index once, and a task
returns k rows a query and tree. No pair of a query and a vector is ever a row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomledger.llm.common import ship
from roomledger.session import materialize

#: Vectors in a tree, in a leaf, and routing nodes under one parent.
TREE = 4096
LEAF = 64
FANOUT = 16
#: Vectors, one from each hash range, that rows are brought together by before they are cut into trees.
PIVOTS = 256
#: Queries that are sent to the executors at once.
QUERY_BLOCK = 8192

#: Columns of a stored tree.
PAGE = (
    "tree string, dim int, vec_ids array<long>, vectors binary, entry_distance array<double>, first array<int>, last array<int>,"
    " leaf array<boolean>, centres binary, radius array<double>, parent_distance array<double>"
)

PAGE_SCHEMA = pa.schema(
    [
        ("tree", pa.string()),
        ("dim", pa.int32()),
        ("vec_ids", pa.list_(pa.int64())),
        ("vectors", pa.binary()),
        ("entry_distance", pa.list_(pa.float64())),
        ("first", pa.list_(pa.int32())),
        ("last", pa.list_(pa.int32())),
        ("leaf", pa.list_(pa.bool_())),
        ("centres", pa.binary()),
        ("radius", pa.list_(pa.float64())),
        ("parent_distance", pa.list_(pa.float64())),
    ]
)


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id``, ``v``: components as ``floor(scale * x)``; vectors with NULL or non-finite components go, and NULL ids."""
    value = F.transform("embedding", lambda x: x.cast("double"))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(usable).select(F.col("vec_id").cast("long"), F.transform(value, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _grouped(vectors: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers in groups of at most ``size``, near ones together: split along the two far-apart rows, again and again."""
    done, waiting = [], [np.arange(len(vectors))]
    while waiting:
        rows = waiting.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        part = vectors[rows]
        a = part[((part - part.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        b = part[((part - a) ** 2).sum(axis=1).argmax()]
        order = np.argsort(part @ (a - b), kind="stable")
        cut = -(-len(rows) // 2 // size) * size if len(rows) > 2 * size else len(rows) // 2
        waiting += [rows[order[:cut]], rows[order[cut:]]]
    return done


def build_tree(name: str, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT) -> dict:
    """One tree, bulk-loaded from the leaves up; node 0 is the root."""
    points = vectors.astype(np.float64)
    groups = _grouped(points, leaf)
    order = np.concatenate(groups)
    ids, vectors, points = ids[order], vectors[order], points[order]
    ends = np.cumsum([len(g) for g in groups])
    level = [{"first": int(e - len(g)), "last": int(e), "leaf": True, "kids": []} for e, g in zip(ends, groups)]
    while True:
        for node in level:
            part = points[node["first"] : node["last"]] if node["leaf"] else points[node["rows"]]
            node["centre"] = part.mean(axis=0)
            node["radius"] = float(np.sqrt(((part - node["centre"]) ** 2).sum(axis=1).max()))
            node.setdefault("rows", np.arange(node["first"], node["last"]))
        if len(level) == 1:
            break
        kids = _grouped(np.stack([n["centre"] for n in level]), fanout)
        level = [{"first": 0, "last": 0, "leaf": False, "kids": [level[i] for i in k], "rows": np.concatenate([level[i]["rows"] for i in k])} for k in kids]
    nodes, parents = [level[0]], [-1]
    for number, node in enumerate(nodes):  # breadth first, so that the children of a node are neighbours
        if not node["leaf"]:
            node["first"], node["last"] = len(nodes), len(nodes) + len(node["kids"])
            nodes += node["kids"]
            parents += [number] * len(node["kids"])
    entry = np.zeros(len(ids))
    for node in nodes:
        if node["leaf"]:
            part = points[node["first"] : node["last"]]
            entry[node["first"] : node["last"]] = np.sqrt(((part - node["centre"]) ** 2).sum(axis=1))
    centres = np.stack([n["centre"] for n in nodes])
    apart = [0.0] + [float(np.sqrt(((n["centre"] - nodes[p]["centre"]) ** 2).sum())) for n, p in zip(nodes[1:], parents[1:])]
    return {
        "tree": name,
        "dim": vectors.shape[1],
        "vec_ids": ids,
        "vectors": vectors.astype(np.int64),
        "entry_distance": entry,
        "first": np.array([n["first"] for n in nodes]),
        "last": np.array([n["last"] for n in nodes]),
        "leaf": np.array([n["leaf"] for n in nodes]),
        "centres": centres,
        "radius": np.array([n["radius"] for n in nodes]),
        "parent_distance": np.array(apart),
    }


def search_tree(tree: dict, query: np.ndarray, own_id: int, k: int, counts: dict | None = None) -> list[tuple[int, int]]:
    """(score, vec_id) of the k best, best first; ``counts`` adds up nodes and entries whose product was computed."""
    q = query.astype(np.float64)
    length = float(np.sqrt(q @ q))
    slack = 1e-9 * (1.0 + length * (float(np.abs(tree["centres"]).max()) * q.size + float(tree["radius"].max())))
    centres, radius, apart = tree["centres"], tree["radius"], tree["parent_distance"]
    product = np.full(len(radius), np.nan)
    product[0] = centres[0] @ q
    queue = [(-(product[0] + length * radius[0]), 0)]
    best: list[tuple[int, int]] = []  # a heap of (score, -vec_id); its first element is the worst that is kept
    limit = -np.inf
    while queue:
        bound, node = heapq.heappop(queue)
        if -bound + slack < limit:
            break
        first, last = int(tree["first"][node]), int(tree["last"][node])
        if tree["leaf"][node]:
            some = np.flatnonzero(product[node] + length * tree["entry_distance"][first:last] + slack >= limit) + first
            if counts is not None:
                counts["entries"] = counts.get("entries", 0) + len(some)
            scores = tree["vectors"][some] @ query
            for at in np.flatnonzero(scores >= limit):
                row = (int(scores[at]), -int(tree["vec_ids"][some[at]]))
                if -row[1] == own_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, row)
                elif row > best[0]:
                    heapq.heapreplace(best, row)
            if len(best) == k:
                limit = best[0][0]
        else:
            kids = np.arange(first, last)
            kids = kids[product[node] + length * (apart[kids] + radius[kids]) + slack >= limit]
            if counts is not None:
                counts["nodes"] = counts.get("nodes", 0) + len(kids)
            product[kids] = centres[kids] @ q
            for kid, high in zip(kids, product[kids] + length * radius[kids]):
                if high + slack >= limit:
                    heapq.heappush(queue, (-float(high), int(kid)))
    return [(score, -negative) for score, negative in sorted(best, reverse=True)]


def _tree_row(tree: dict) -> dict:
    row = {k: v.tolist() for k, v in tree.items() if isinstance(v, np.ndarray) and k not in ("vectors", "centres")}
    return row | {"tree": tree["tree"], "dim": tree["dim"], "vectors": tree["vectors"].tobytes(), "centres": tree["centres"].tobytes()}


def index(rows: DataFrame, tree_size: int = TREE) -> DataFrame:
    """The trees of ``vec_id``, ``v``: one row a tree. All vectors must have the same number of components."""
    ship(rows.sparkSession)
    picked = rows.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(PIVOTS)).alias("place")).agg(F.min_by("v", "vec_id").alias("v"))
    pivots = [r.v for r in picked.orderBy("place").collect()]
    if not pivots:
        return rows.sparkSession.createDataFrame([], PAGE)
    sent = rows.sparkSession.sparkContext.broadcast(np.array(pivots, dtype=np.float64))

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        at = np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, sent.value.shape[1]))
        return pd.Series((at @ sent.value.T * 2 - (sent.value**2).sum(axis=1)).argmax(axis=1).astype(np.int32))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def made(ids, vectors):
            return pa.RecordBatch.from_pylist([_tree_row(build_tree(f"{ids.min()}-{ids.max()}-{len(ids)}", ids, vectors))], PAGE_SCHEMA)

        n = 0
        for batch in batches:
            flat = batch.column("v")
            held.append((batch.column("vec_id").to_numpy(), np.asarray(flat.flatten()).reshape(len(batch), -1)))
            n += len(batch)
            while n >= tree_size:
                ids, vectors = (np.concatenate(x) for x in zip(*held))
                yield made(ids[:tree_size], vectors[:tree_size])
                held, n = [(ids[tree_size:], vectors[tree_size:])], n - tree_size
        if n:
            yield made(*(np.concatenate(x) for x in zip(*held)))

    # a range of (pivot, hash): a pivot with many vectors, or many equal vectors, spreads over several tasks
    near = rows.select("vec_id", "v", nearest("v").alias("pivot"))
    dealt = near.repartitionByRange("pivot", F.xxhash64("vec_id")).sortWithinPartitions("pivot", "vec_id")
    return dealt.select("vec_id", "v").mapInArrow(build, PAGE)


def _opened(row: dict) -> dict:
    tree = {k: np.array(v) for k, v in row.items() if k not in ("tree", "dim", "vectors", "centres")}
    return tree | {"vectors": np.frombuffer(row["vectors"], dtype=np.int64).reshape(-1, row["dim"]), "centres": np.frombuffer(row["centres"], dtype=np.float64).reshape(-1, row["dim"])}


def search(trees: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best vectors of each query, not counting rows with its own id.

    Equal scores: the smaller ``vec_id`` first. Fewer than k vectors: all. Vectors with the same id count as
    they are there; as a query an id is searched once, with its smallest vector (component by component). The trees are read once for each ``block`` queries (about; queries are dealt by hash).
    """
    ship(trees.sparkSession)
    queries = materialize(queries.groupBy("vec_id").agg(F.min("v").alias("v")))
    blocks = max(1, -(-queries.count() // block))
    spark = trees.sparkSession
    found = None
    for number in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).collect()
        sent = spark.sparkContext.broadcast((np.array([r.vec_id for r in rows], dtype=np.int64), np.array([r.v for r in rows], dtype=np.int64)))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, vectors = sent.value
            for batch in batches:
                for row in batch.to_pylist():
                    tree, out = _opened(row), []
                    for query_id, query in zip(ids.tolist(), vectors):
                        out += [(query_id, v, s) for s, v in search_tree(tree, query, query_id, k)]
                    columns = list(zip(*out)) or [[], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

        part = trees.mapInArrow(best, "query_id long, vec_id long, score long")
        found = part if found is None else found.unionByName(part)
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; Spark keeps k rows of a query in each task before it shuffles them."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Index ``vectors`` and search it for ``queries``; both ``vec_id``, ``embedding``. See ``quantised`` and ``search``."""
    return search(materialize(index(quantised(vectors))), quantised(queries), k)


ORACLE = """
with v as (select vec_id, [floor(256 * x::double)::bigint for x in embedding] v from embeddings
 where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scored as (select q.vec_id query_id, o.vec_id, list_sum([q.v[i] * o.v[i] for i in range(1, len(q.v) + 1)])::bigint score
 from (select vec_id, min(v) v from v where vec_id % 50 = 0 group by vec_id) q join v o on o.vec_id <> q.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5"""

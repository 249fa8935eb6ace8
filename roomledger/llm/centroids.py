"""Centroid clustering of integer vectors; the nearest centroid by the threshold algorithm.

The centroids' values are kept as one sorted list a dimension. From a vector's own value each list is walked
outward, nearest value first. A centroid met for the first time is measured exactly. The values at the frontier
bound every centroid not met yet: its squared distance is at least the sum of the squared gaps there. The walk ends
when that sum strictly exceeds the best distance (a centroid at the same distance may have a smaller number), or
when every centroid was met.

Each round is one pass over the stored vectors. Tasks add up their vectors by centroid, so one row a task, centroid
and dimension is shuffled and centroids times dimensions rows reach the driver, whatever the table's size and
however many vectors one centroid takes.

Vectors that are NULL, of another length, or hold NULL or non-finite components take no part. Repeated rows and
equal vectors are vectors of their own; a NULL ``vec_id`` starts no centroid and is otherwise treated alike. With
fewer vectors than centroids there are fewer centroids; no vectors give no rows. Components beyond
``LARGEST / scale`` have squared distances that no 64-bit number holds and stop the job. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomledger.llm.common import ship
from roomledger.session import literal_table, materialize

CENTROIDS = 40
ROUNDS = 5
DIMENSION = 64
SCALE = 256
SEED = 2
#: Largest component (after scaling) whose squared distances, added up over 64 dimensions, fit a long.
LARGEST = 1 << 27
#: Vectors whose walk is advanced together in a task.
TOGETHER = 512


def quantised(vectors: DataFrame, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``v``: components as ``floor(scale * x)``, worked out in doubles."""
    value = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce((F.size("embedding") == dimension) & finite, F.lit(False))
    message = F.concat(F.lit("a component is too large for exact distances: vector "), F.coalesce(F.col("vec_id").cast("string"), F.lit("without id")))
    fits = F.forall(value, lambda x: F.abs(x * scale) <= LARGEST)
    whole = F.when(fits, F.transform(value, lambda x: F.floor(x * scale).cast("long"))).otherwise(F.raise_error(message).cast("array<bigint>"))
    return vectors.where(usable).select("vec_id", whole.alias("v"))


def first_centroids(vectors: DataFrame, centroids: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors whose ``seed:vec_id`` has the smallest SHA-256, in that order (then by components)."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    chosen = vectors.where(F.col("vec_id").isNotNull()).select(key.alias("key"), "v").orderBy("key", "v").limit(centroids)
    return _matrix(chosen.toArrow()["v"].combine_chunks())


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(len(column), -1 if len(column) else 0)


class SortedLists:
    """The centroids' values in ascending order, one list a dimension, with a sentinel at both ends."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")
        far = np.full((1, centroids.shape[1]), np.iinfo(np.int64).max // 2)
        self.values = np.concatenate([-far, np.take_along_axis(centroids, self.order, axis=0), far])

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each vector's nearest centroid, and how many distances were worked out."""
        parts = [self._walk(vectors[i : i + TOGETHER]) for i in range(0, len(vectors), TOGETHER)]
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), 0
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), sum(p[2] for p in parts)

    def _walk(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        n, dims = vectors.shape
        k = len(self.centroids)
        number, best = np.full(n, k, np.int32), np.full(n, np.iinfo(np.int64).max)
        met, measured = np.zeros((n, k), bool), 0
        # Next entry on either side of the own value, as positions in the lists with sentinels.
        below = np.stack([np.searchsorted(self.values[:, d], vectors[:, d], side="right") for d in range(dims)], axis=1) - 1
        above, walking, every = below + 1, np.arange(n), np.arange(dims)
        while len(walking):
            own = vectors[walking]
            down, up = own - self.values[below[walking], every], self.values[above[walking], every] - own
            lower = down <= up
            at = np.where(lower, below[walking], above[walking]) - 1
            heads = self.order[at, every]
            below[walking] -= lower
            above[walking] += ~lower
            new = np.zeros((len(walking), k), bool)
            new[np.arange(len(walking))[:, None], heads] = True
            new &= ~met[walking]
            met[walking] |= new
            row, centroid = np.nonzero(new)
            distance = ((own[row] - self.centroids[centroid]) ** 2).sum(axis=1)
            measured += len(row)
            order = np.lexsort((centroid, distance, row))
            row, centroid, distance = row[order], centroid[order], distance[order]
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
            at, centroid, distance = walking[row[first]], centroid[first], distance[first]
            better = (distance < best[at]) | ((distance == best[at]) & (centroid < number[at]))
            number[at[better]], best[at[better]] = centroid[better], distance[better]
            frontier = (np.minimum(down, up) ** 2).sum(axis=1)
            walking = walking[(frontier <= best[walking]) & ~met[walking].all(axis=1)]
        return number, best, measured


def _assigning(lists: SortedLists) -> Callable:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, distance, _ = lists.nearest(_matrix(batch["v"]))
                yield pa.RecordBatch.from_pydict({"vec_id": batch["vec_id"], "cluster": pa.array(number), "distance": pa.array(distance)})

    return assign


def _adding(lists: SortedLists) -> Callable:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = lists.centroids.shape
        # Low and high halves apart: neither sum can pass 63 bits.
        low, high, count = np.zeros((k, dims), np.int64), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch["v"])
            number, _, _ = lists.nearest(vectors)
            np.add.at(low, number, vectors & 0xFFFF)
            np.add.at(high, number, vectors >> 16)
            count += np.bincount(number, minlength=k)
        cluster, dim = np.divmod(np.arange(k * dims), dims)
        rows = pa.RecordBatch.from_pydict(
            {
                "cluster": pa.array(cluster.astype(np.int32)),
                "dim": pa.array(dim.astype(np.int32)),
                "low": pa.array(low.ravel()),
                "high": pa.array(high.ravel()),
                "n": pa.array(np.repeat(count, dims)),
            }
        )
        yield rows.filter(pa.array(np.repeat(count > 0, dims)))

    return add


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every centroid that is nearest to some vectors becomes the floor of their mean."""
    sums = vectors.select("v").mapInArrow(_adding(SortedLists(centroids)), "cluster int, dim int, low long, high long, n long")
    total = F.sum("low").cast("decimal(38,0)") + F.sum("high").cast("decimal(38,0)") * F.lit(1 << 16)
    rows = sums.groupBy("cluster", "dim").agg(total.alias("total"), F.sum("n").alias("n")).collect()
    out = centroids.copy()
    for row in rows:
        out[row["cluster"], row["dim"]] = int(row["total"]) // row["n"]
    return out


def clusters(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of every vector that takes part (stored), and the final centroids."""
    ship(vectors.sparkSession)
    stored = materialize(quantised(vectors, dimension, scale))
    schema = f"vec_id {stored.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    centres = first_centroids(stored, centroids, seed)
    if not len(centres):
        return stored.sparkSession.createDataFrame([], schema), centres
    for _ in range(rounds):
        centres = moved(stored, centres)
    return materialize(stored.mapInArrow(_assigning(SortedLists(centres)), schema)), centres


def _digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def with_inertia(assigned: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds ``cluster_inertia``, ``inertia`` and ``centroid_sha256``: one row a centroid goes to every executor."""
    spark = assigned.sparkSession
    exact: Column = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {row["cluster"]: int(row["total"]) for row in assigned.groupBy("cluster").agg(exact.alias("total")).collect()}
    numbers = sorted(sums)
    totals = literal_table(
        spark,
        cluster=pa.array(numbers, pa.int32()),
        cluster_inertia=pa.array([sums[c] for c in numbers], pa.int64()),
        inertia=pa.array([sum(sums.values())] * len(numbers), pa.int64()),
        centroid_sha256=pa.array([_digest(centres[c]) for c in numbers], pa.string()),
    )
    return assigned.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """Every round as a comparison of all vectors with all centroids."""
    parts = [
        f"""kept as (
    select vec_id, row_number() over () as r, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v
    from embeddings
    where len(embedding) = {DIMENSION} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIMENSION})""",
        f"""c0 as (
    select (row_number() over (order by sha256('{SEED}:' || vec_id), v) - 1)::int as cluster, v
    from kept where vec_id is not null order by cluster limit {CENTROIDS})""",
    ]
    for i in range(ROUNDS + 1):
        parts.append(
            f"""a{i} as materialized (
    select r, any_value(vec_id) as vec_id, any_value(v) as v, min(struct_pack(d := d, c := c)) as m from (
        select k.r, k.vec_id, k.v, c.cluster as c,
               list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
        from kept k cross join c{i} c) group by r)"""
        )
        if i < ROUNDS:
            parts.append(
                f"""c{i + 1} as materialized (
    select cluster, coalesce(n.v, o.v) as v from c{i} o left join (
        select cluster, list((s - ((s % n) + n) % n) // n order by dim) as v from (
            select m.c as cluster, dim, sum(x)::hugeint as s, count(*)::hugeint as n from (
                select m, unnest(v) as x, unnest(range({DIMENSION})) as dim from a{i}) group by all) group by cluster) n
    using (cluster))"""
            )
    return (
        "with "
        + ",\n".join(parts)
        + f"""
select vec_id, m.c as cluster, m.d as distance, sum(m.d) over (partition by m.c)::bigint as cluster_inertia,
       sum(m.d) over ()::bigint as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{ROUNDS} join c{ROUNDS} c on c.cluster = m.c"""
    )


ORACLE = _oracle()

"""Near copies by SimHash fingerprints, compared bit-sliced.

1. Each document's fingerprint: the majority of each bit over the hashes of its word shingles.
2. Equal fingerprints become one node.
3. 64 bits are cut into ``SEGMENTS`` segments. Two fingerprints within the radius differ in at most
   ``radius`` segments, so they agree in some choice of ``SEGMENTS - radius`` of them. Every node goes to one
   bucket per choice: no link is missed. With 7 segments and radius 4 a bucket's key has 27 bits and there
   are 35 choices, so buckets stay small with billions of nodes; shuffled are 35 rows of 16 bytes a node.
4. Inside a bucket distances are counted on bit planes (``bitplanes``). Small buckets, the usual case, are
   compared together; in a large one each node searches those not yet reached. Only links to the smallest
   fingerprint of what hangs together are returned, never all pairs of a group.
5. Links of all buckets are joined to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomledger.llm import bitplanes
from roomledger.llm.common import ship, text_digest
from roomledger.llm.links import components
from roomledger.session import materialize

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
SEGMENTS = 7
#: Shingles whose bits are counted at once, which bounds memory for very long texts.
BLOCK = 1 << 15
#: Bucket rows that are compared at once; a larger bucket stays whole (16 bytes a row).
CHUNK = 1 << 17
#: Buckets up to this size are compared together.
SMALL = 64


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Lower-case A-Z, split at ASCII white space, hash every shingle (repeats too), take bit majorities.

    Fewer words than a shingle: the whole sequence is one. None, or NULL text: zero.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined, ends, at = b" ".join(parts), [], -1
    for part in parts:
        at += len(part) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    ends = ends[words - 1 :] or ends[-1:]
    digest, seed = xxhash.xxh64_intdigest, SEED
    ones = np.zeros(64, dtype=np.int64)
    for first in range(0, len(ends), BLOCK):
        some = ends[first : first + BLOCK]
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[first:], some)], dtype=np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(ends), bitorder="little").view(np.uint64)[0])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64)
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(prints.view(np.int64))], names=[*kept, "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed long) of every row."""
    ship(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_hashed, "doc_id long, fp long")


def masks(segments: int = SEGMENTS, radius: int = RADIUS) -> list[int]:
    """Bit masks of every choice of ``segments - radius`` segments, as signed longs."""
    bounds = [64 * i // segments for i in range(segments + 1)]
    parts = [(1 << high) - (1 << low) for low, high in zip(bounds, bounds[1:])]
    chosen = [sum(some) for some in combinations(parts, segments - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n places reaches by the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label[a] == label[b]).all():
            return label


def _small_buckets(keys: np.ndarray, values: np.ndarray, radius: int) -> np.ndarray:
    own = bitplanes.planes(values)
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for shift in range(1, min(SMALL, len(keys))):
        same = np.zeros(len(keys), dtype=bool)
        same[:-shift] = keys[:-shift] == keys[shift:]
        if not same.any():
            break
        found = np.flatnonzero(bitplanes.flags(bitplanes.near_shifted(own, shift, bitplanes.lanes(same), radius)))
        left.append(found)
        right.append(found + shift)
    return _joined(len(keys), np.concatenate(left), np.concatenate(right))


def _large_bucket(values: np.ndarray, radius: int) -> np.ndarray:
    """Each node reached searches those not yet reached, so a dense bucket costs little more than its size."""
    own, rest = bitplanes.planes(values), bitplanes.lanes(np.ones(len(values), dtype=bool))
    label = np.arange(len(values))
    for first in range(len(values)):
        if not int(rest[first >> 6]) >> (first & 63) & 1:
            continue
        rest[first >> 6] ^= np.uint64(1 << (first & 63))
        waiting = [first]
        while waiting:
            hits = bitplanes.near_value(own, int(values[waiting.pop()]), rest, radius)
            if hits.any():
                rest &= ~hits
                found = np.flatnonzero(bitplanes.flags(hits))
                label[found] = first
                waiting.extend(found.tolist())
    return label


def bucket_links(keys: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside buckets, given sorted keys: each value with the first one of what it hangs together with."""
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(edges)
    size = np.repeat(sizes, sizes)
    a, b = [], []
    some = (size > 1) & (size <= SMALL)
    if some.any():
        part = values[some]
        label = _small_buckets(keys[some], part, radius)
        tied = label != np.arange(len(label))
        a.append(part[tied])
        b.append(part[label[tied]])
    for first, count in zip(edges[:-1][sizes > SMALL], sizes[sizes > SMALL]):
        part = values[first : first + count]
        label = _large_bucket(part, radius)
        tied = label != np.arange(len(label))
        a.append(part[tied])
        b.append(part[label[tied]])
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(prints: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """``a``, ``b``: links that join all fingerprints within the radius; ``prints``: distinct ``fp``."""

    ship(prints.sparkSession)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(keys, values):
            a, b = bucket_links(keys, values, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        waiting, rows = [], 0
        for batch in batches:
            waiting.append((batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)))
            rows += len(batch)
            if rows >= CHUNK:
                keys, values = (np.concatenate(x) for x in zip(*waiting))
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield found(keys[:cut], values[:cut])
                waiting, rows = [(keys[cut:], values[cut:])], 0
        if waiting:
            yield found(*(np.concatenate(x) for x in zip(*waiting)))

    buckets = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks(segments, radius))]
    keyed = prints.select("fp", F.explode(F.array(*buckets)).alias("key"))
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(compare, "a long, b long").distinct()


def _labels(hashed: DataFrame, radius: int, row: Column) -> DataFrame:
    """``fp, first, component_rows``: of every fingerprint's component the smallest ``row``, and how many there are."""
    nodes = materialize(hashed.groupBy("fp").agg(F.min(row).alias("first"), F.count("*").alias("n")))
    roots = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = placed.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("component_rows"))
    return materialize(placed.drop("first").join(whole, "root").select("fp", "first", "component_rows"))


def near_copies(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` and ``component_rows`` of every row.

    ``component_id`` is the smallest ``doc_id`` in the component (NULL where all are NULL), ``component_rows`` its rows.
    Repeated rows come back as often as they are there. NULL, empty and word-free texts have fingerprint zero
    and are linked like any other. Other columns of the input are not read.
    """
    hashed = materialize(fingerprints(documents))
    labels = _labels(hashed, radius, F.col("doc_id")).withColumnRenamed("first", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return hashed.join(labels, "fp").select("doc_id", digits.alias("fingerprint"), "component_id", "component_rows")


def copied_rows(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``digest``, ``n``, ``first`` for each distinct row in a component of several rows.

    A row is known by ``doc_id`` and ``digest``, and stands ``n`` times. One of each component is ``first``: that of
    the smallest ``doc_id`` (NULL comes last), then of the smallest digest. Rows without copies are left out.
    """
    ship(documents.sparkSession)
    read = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_digest().alias("digest"))
    hashed = materialize(read.mapInArrow(_hashed, "doc_id long, digest binary, fp long"))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("digest"))
    several = _labels(hashed, radius, row).where("component_rows > 1").withColumn("row", F.col("first")).drop("first")
    joined = hashed.join(several, "fp").select("doc_id", "digest", (row == F.col("row")).alias("first"))
    return joined.groupBy("doc_id", "digest", "first").agg(F.count("*").alias("n")).select("doc_id", "digest", "n", "first")

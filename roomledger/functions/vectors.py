"""Vector kernels that run on Arrow batches inside Spark tasks, and the built-in text embedder."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tasks get these functions by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELLS_AT_ONCE = 1 << 22
# Left rows of a block of products, and how many pairs of a matrix cost as much as one pair by itself.
ROWS_AT_ONCE = 1024
PAIRS_WORTH = 16
DEFAULT_DIMENSION = 256

Embedder = Callable[[Column], Column]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix of doubles; all rows must have the same length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != lengths[0]).any():
        raise ValueError("vectors of different length in one column")
    return values.reshape(len(column), -1)


def present(batch):
    """The rows of a batch or table that have a vector."""
    return batch.filter(batch["embedding"].is_valid())


def _squares(vectors: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", vectors, vectors)


def rough_distances(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared L2 distances by the product form, and how far off those of a left row can be (one column)."""
    left_sq, right_sq = _squares(left)[:, None], _squares(right)[None, :]
    return left_sq + right_sq - 2.0 * (left @ right.T), rough_margin(left, right)


def rough_margin(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return 8.0 * (left.shape[1] + 4) * np.finfo(np.float64).eps * (_squares(left)[:, None] + _squares(right).max(initial=0.0))


def exact_distances(left: np.ndarray, right: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Squared L2 distances of some pairs by the difference form, added up in the order of the components.

    A pair's value depends on nothing else, and any engine that adds in this order gets the same double.
    """
    out = np.empty(len(rows))
    step = max(1, CELLS_AT_ONCE // max(1, left.shape[1]))
    for start in range(0, len(rows), step):
        part = slice(start, start + step)
        squares = (left[rows[part]] - right[cols[part]]) ** 2
        out[part] = np.add.accumulate(squares, axis=1)[:, -1] if squares.shape[1] else 0.0
    return out


def nearest(left: np.ndarray, right: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest right rows of each left row: left index, right index, squared distance; equal distances by right index."""
    return nearest_within(left, right, k, np.full(len(left), np.inf))


def nearest_within(left: np.ndarray, right: np.ndarray, k: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`nearest`, but only right rows at most ``bounds`` (squared, one for each left row) away.

    Products in single precision only choose candidates, with room for their error. Candidates are ordered by their
    exact distance, and the k-th of them bounds the search in the right rows that follow. Work is cut into blocks so
    that one block of products stays small.
    """
    k, n = min(k, len(right)), len(right)
    if not k or not len(left):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    single = _single(left, right)
    values, cols, count = np.full((len(left), k), np.inf), np.full((len(left), k), n), np.zeros(len(left), np.int64)
    step = max(k, CELLS_AT_ONCE // ROWS_AT_ONCE)
    for start in range(0, len(left), ROWS_AT_ONCE):
        own = slice(start, start + ROWS_AT_ONCE)
        for at in range(0, n, step):
            block = slice(at, at + step)
            reach = np.where(count[own] == k, np.minimum(values[own, k - 1], bounds[own]), bounds[own])
            row, col = _candidates(left[own], right[block], k, reach, None if single is None else single(own, block))
            exact = exact_distances(left[own], right[block], row, col)
            row, col = row + start, col + at
            # Right rows come in order, so a later one as far away as the k-th doesn't displace it.
            wanted = (exact <= bounds[row]) & ((count[row] < k) | (exact < values[row, k - 1]))
            _merge(values, cols, count, row[wanted], col[wanted], exact[wanted])
    rows, rank = np.nonzero(np.arange(k) < count[:, None])
    return rows, cols[rows, rank], values[rows, rank]


def _single(left: np.ndarray, right: np.ndarray) -> Callable | None:
    """For a block of rows its scores (half the right square less, a product is the larger the nearer) and limits.

    Vectors are moved to the middle of the right ones and scaled before they are rounded. None if that is impossible.
    """
    with np.errstate(all="ignore"):
        centre = right.mean(axis=0)
        a, b = left - centre, right - centre
        longest = np.nanmax(np.abs(a), initial=0.0), np.abs(b).max(initial=0.0)
        if not np.isfinite(longest).all():
            return None
        scale = 2.0 ** -np.ceil(np.log2(max(longest))) if max(longest) > 0.0 else 1.0
        if not np.isfinite(scale * scale) or scale * scale == 0.0:
            return None
        a, b = a * scale, b * scale
    a_sq, b_sq = _squares(a), _squares(b)
    far = b_sq.max(initial=0.0)
    # What rounding to single precision, adding up and moving can change, and a little for tiny numbers.
    moved = 4.0 * np.finfo(np.float64).eps * scale * (np.sqrt(_squares(left)) + np.sqrt(_squares(right).max(initial=0.0)))
    margin = 4.0 * (left.shape[1] + 8) * np.finfo(np.float32).eps * (a_sq + far) + 4.0 * moved * (np.sqrt(a_sq) + np.sqrt(far)) + 1e-30
    a = np.concatenate([a, np.ones((len(a), 1))], axis=1).astype(np.float32)
    b = np.concatenate([b, -0.5 * b_sq[:, None]], axis=1).astype(np.float32).T

    def scores(own: slice, block: slice) -> tuple[np.ndarray, np.ndarray, Callable]:
        return a[own] @ b[:, block], margin[own], lambda reach: 0.5 * (a_sq[own] - reach * scale * scale) - margin[own]

    return scores


def _candidates(left: np.ndarray, right: np.ndarray, k: int, reach: np.ndarray, single: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that can be at most ``reach`` (of a left row) apart, and of rows without one those that can be among its k nearest."""
    unlimited = np.flatnonzero(np.isposinf(reach))
    kth = min(k, len(right)) - 1
    hit = None
    if single is not None:
        scores, margin, limit_of = single
        with np.errstate(invalid="ignore", over="ignore"):
            limits = limit_of(reach)
            if len(unlimited):
                last = len(right) - 1 - kth
                limits[unlimited] = np.partition(scores[unlimited], last, axis=1)[:, last] - 2.0 * margin[unlimited]
            hit = scores >= limits.astype(np.float32)[:, None]
    if hit is None or np.count_nonzero(hit) * PAIRS_WORTH > hit.size + PAIRS_WORTH * k * len(left):  # too many to go on pair by pair
        with np.errstate(invalid="ignore", over="ignore"):
            rough, margin = rough_distances(left, right)
            limits = reach[:, None] + 2.0 * margin
            if len(unlimited):
                limits[unlimited] = np.partition(rough[unlimited], kth, axis=1)[:, kth : kth + 1] + 2.0 * margin[unlimited]
            near = rough <= limits
        hit = near if hit is None else hit & near
    return np.divmod(np.flatnonzero(hit), len(right))


def _merge(values: np.ndarray, cols: np.ndarray, count: np.ndarray, row: np.ndarray, col: np.ndarray, exact: np.ndarray) -> None:
    """Put new pairs, ordered by row, into the tables of the k nearest."""
    if not len(row):
        return
    k = values.shape[1]
    touched = np.unique(row)
    old, rank = np.nonzero(np.arange(k) < count[touched, None])
    old = touched[old]
    row, col, exact = np.concatenate([old, row]), np.concatenate([cols[old, rank], col]), np.concatenate([values[old, rank], exact])
    order = np.lexsort((col, exact, row))
    row, col, exact = row[order], col[order], exact[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    first = rank < k
    row, rank = row[first], rank[first]
    values[row, rank], cols[row, rank] = exact[first], col[first]
    count[touched] = np.bincount(np.searchsorted(touched, row), minlength=len(touched))


def visited_cells(
    questions: np.ndarray, centres: np.ndarray, radii: np.ndarray, counts: np.ndarray, k: int
) -> np.ndarray:
    """Which cells can hold one of a question's k nearest documents, as a matrix of booleans.

    Every centre is a document, so the k-th nearest centre bounds the search. No document of a
    cell is nearer than the cell's sphere allows, nor than the plane halfway between the cell's
    centre and the centre nearest to the question.
    """
    squares, margin = rough_distances(questions, centres)
    squares = np.maximum(squares, 0.0)
    distances, between = np.sqrt(squares), np.sqrt(np.maximum(rough_distances(centres, centres)[0], 0.0))
    home = squares.argmin(axis=1)
    if len(centres) > k:
        bound = np.partition(distances, k - 1, axis=1)[:, k - 1 : k]
    else:
        bound = np.full((len(questions), 1), np.inf)
    # A squared distance is off by the margin at most, so a distance by its root; radii have their own share.
    longest = max(_squares(centres).max(initial=0.0), _squares(questions).max(initial=0.0))
    slack = 4.0 * np.sqrt(margin + 8.0 * (questions.shape[1] + 4) * np.finfo(np.float64).eps * (longest + radii.max(initial=0.0) ** 2))
    sphere = distances - radii
    beyond = squares - squares[np.arange(len(home)), home][:, None] - 2.0 * margin
    gap = 2.0 * (between[home] + slack)
    plane = np.where(beyond > 0.0, beyond / np.where(gap > 0.0, gap, np.inf), 0.0)
    return (np.maximum(sphere, plane) <= bound + 2.0 * slack) & (counts > 0)


def ranked(question_ids: pa.Array, doc_ids: pa.Array, found: tuple) -> dict[str, pa.Array]:
    """Result columns of :func:`nearest`; ranks start at 1 for each question."""
    rows, cols, distances = found
    first = np.searchsorted(rows, rows)
    return {
        "question_id": question_ids.take(pa.array(rows)),
        "rank": pa.array((np.arange(len(rows)) - first + 1).astype(np.int32)),
        "doc_id": doc_ids.take(pa.array(cols)),
        "distance": pa.array(distances),
    }


def hashed_words(dimension: int = DEFAULT_DIMENSION) -> Embedder:
    """Embedder without a model: counts of hashed words, scaled to length 1.

    It compares words, not meanings. Words are split and hashed in the JVM; only bucket numbers
    go to the Arrow function, which counts them. The whole text is used and no row is shuffled.
    """

    @F.arrow_udf("array<float>")
    def count_buckets(buckets: pa.Array) -> pa.Array:
        rows = len(buckets)
        row = np.repeat(np.arange(rows), buckets.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        bucket = buckets.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.bincount(row * dimension + bucket, minlength=rows * dimension).reshape(rows, dimension)
        counts = counts.astype(np.float64)
        length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        unit = np.divide(counts, length, out=np.zeros_like(counts), where=length > 0)
        offsets = np.arange(0, (rows + 1) * dimension, dimension, dtype=np.int32)
        vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit.astype(np.float32).ravel()))
        return pa.array(vectors.cast(pa.list_(pa.float32())))

    def embed(text: Column) -> Column:
        words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        buckets = F.transform(
            words, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dimension).cast("int")
        )
        return count_buckets(F.coalesce(buckets, F.array().cast("array<int>")))

    return embed

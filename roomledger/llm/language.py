"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Texts become vectors of hashed letter n-grams (1 to 3 letters, lower case, word boundaries marked), weighted
by ``log(1 + tf) * idf`` and normalised. Each language gets up to ``CENTROIDS`` centroids by spherical k-means.
A text takes the language of the centroid with the largest cosine. A text is rejected if its cosine is far under
what nearly all sample texts of that language and of about its length reach: cosines grow with the length, for texts
of a language and, more slowly, for texts of none.

Document frequencies are counted over all training rows. Centroids are fitted on a bounded sample: at most
``SAMPLE`` distinct texts a language, one from each of so many hash ranges.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.llm.common import ship
from roomledger.session import materialize

DIMENSIONS = 4096
CENTROIDS = 4
SAMPLE = 512
#: Languages that one model may have; more is an error, as the centroids are sent to all executors.
MOST_LANGUAGES = 1000
#: A cluster with a smaller share of a language's sample is dropped if it is shown to be another language's.
SMALL_SHARE = 0.05
#: A text is rejected under this share of the cosine that all but ``LOW`` of the sample texts of its length reach.
MARGIN = 0.35
LOW = 0.05
#: Lengths are told apart by their binary logarithm; a limit rests on so many sample texts (if there are as many).
LENGTHS, LEAST_TEXTS = 32, 20
#: In texts of fewer n-grams (binary logarithm) than this the limit falls in proportion: a word or two say little.
SHORT = 7
#: Letters that are turned into n-grams at once, which bounds memory for very long texts.
BLOCK = 1 << 20
FACTOR, SPREAD = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter (or a mark, which belongs to one)."""
    return np.array([unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)])


def _is_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counts(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """n-grams per bucket; everything but letters is a word boundary."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    total, tail = np.zeros(dimensions, dtype=np.int64), np.zeros(1, dtype=np.uint64)
    for first in range(0, len(points), BLOCK):
        new = points[first : first + BLOCK]
        new = np.where(_letters()[new], new, 0).astype(np.uint64)
        if first + BLOCK >= len(points):
            new = np.append(new, np.uint64(0))
        part = np.concatenate((tail, new))
        two = part[:-1] * FACTOR + part[1:]
        three = two[:-1] * FACTOR + part[2:]
        held = (part > 0, (part[:-1] | part[1:]) > 0, part[1:-1] > 0)
        for n, (gram, keep) in enumerate(zip((part, two, three), held)):
            at = max(0, len(tail) - n)  # what ends in an earlier block was counted there
            mixed = (gram[at:][keep[at:]] + np.uint64(n)) * SPREAD >> np.uint64(40)
            total += np.bincount((mixed % np.uint64(dimensions)).astype(np.int64), minlength=dimensions)
        tail = part[-2:]
    return total


def _weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vector = np.log1p(tf) * idf
    norm = np.sqrt((vector * vector).sum())
    return (vector / norm if norm else vector).astype(np.float32)


def _length(grams: int) -> int:
    return min(LENGTHS - 1, max(0, int(grams).bit_length() - 1))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]  # of each centroid
    centroids: np.ndarray  # one row each
    limits: np.ndarray  # lowest cosine that is accepted, by centroid and length
    idf: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine (0 to 1), and whether the text is rejected."""
        if not text or not _is_letter(text):
            return UNKNOWN, 0.0, True
        if not self.languages:
            return UNKNOWN, 0.0, True
        grams = counts(text)
        cosine = self.centroids @ _weighted(grams, self.idf)
        best = int(cosine.argmax())
        limit = self.limits[best, _length(grams.sum())]
        return self.languages[best], float(min(1.0, max(0.0, cosine[best]))), bool(cosine[best] < limit)


def _clusters(vectors: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spherical k-means from the first rows (their order is random); returns centroids, each row's cluster and cosine."""
    centroids = vectors[:k].copy()
    for _ in range(rounds):
        own = (vectors @ centroids.T).argmax(axis=1)
        for c in range(len(centroids)):
            if (own == c).any():
                mean = vectors[own == c].sum(axis=0)
                centroids[c] = mean / max(np.sqrt((mean * mean).sum()), 1e-12)
    cosine = vectors @ centroids.T
    return centroids, cosine.argmax(axis=1), cosine.max(axis=1)


def _limits(lengths: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """Lowest accepted cosine by length. A limit rests on the sample texts of the nearest lengths and is no lower than
    that of shorter texts; it falls in proportion for short texts and for those shorter than all in the sample."""
    full, out = max(SHORT, int(lengths.min())), np.zeros(LENGTHS)
    for length in range(LENGTHS):
        away = np.abs(lengths - length)
        widths = np.sort(away)
        near = cosines[away <= widths[min(LEAST_TEXTS, len(widths)) - 1]]
        out[length] = MARGIN * np.quantile(near, LOW) * min(1.0, (length + 1) / (full + 1))
    return np.maximum.accumulate(out)


def _mislabelled(languages: np.ndarray, centroids: np.ndarray, share: np.ndarray, lengths: list, limits: dict[str, np.ndarray]) -> np.ndarray:
    """Which small clusters are another language's: nearer to one of its large clusters than to any of their own
    language, and as near as its texts of that length are. A rare script or dialect is far from all and stays."""
    large, out = share >= SMALL_SHARE, np.zeros(len(share), dtype=bool)
    for c in np.flatnonzero(~large):
        cosine = centroids @ centroids[c]
        own, other = cosine[large & (languages == languages[c])], np.flatnonzero(large & (languages != languages[c]))
        if len(own) and len(other):
            best = other[cosine[other].argmax()]
            out[c] = cosine[best] > own.max() and cosine[best] * MARGIN >= limits[languages[best]][int(np.median(lengths[c]))]
    return out


def train(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """``labelled``: ``text``, ``lang``. Rows with NULL in either, or without a letter, teach nothing."""
    ship(labelled.sparkSession)
    rows = labelled.select(F.col("text").cast("string"), F.col("lang").cast("string")).where(r"lang is not null and text rlike '\\p{L}'")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, texts = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                seen += counts(text.as_py()) > 0
                texts += 1
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS), pa.int32()), pa.array(np.concatenate(([texts], seen)), pa.int64())], names=["bucket", "n"])

    counted = rows.select("text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(DIMENSIONS + 1)
    for row in counted:
        seen[row.bucket] = row.n
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1

    # one text, that of the smallest hash, from each of ``sample`` ranges of hashes: bounded, and copies count once
    hashed = rows.select("lang", "text", F.xxhash64("text").alias("h"))
    places = hashed.groupBy("lang", F.pmod("h", F.lit(sample)).alias("place")).agg(F.min("h").alias("h"))
    chosen = materialize(places.select("lang", "h"))
    if chosen.select("lang").distinct().count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    texts = hashed.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("h")
        grams = [counts(t) for t in frame["text"]]
        found, own, cosine = _clusters(np.stack([_weighted(g, idf) for g in grams]), centroids)
        lengths = np.array([_length(g.sum()) for g in grams])
        rows = [(c.tolist(), lengths[own == i].tolist(), cosine[own == i].tolist()) for i, c in enumerate(found) if (own == i).any()]
        told = pd.DataFrame(rows, columns=["centroid", "lengths", "cosines"])
        return told.assign(lang=frame["lang"].iloc[0], part=range(len(rows)))[["lang", "part", "centroid", "lengths", "cosines"]]

    fitted = texts.groupBy("lang").applyInPandas(cluster, "lang string, part int, centroid array<float>, lengths array<int>, cosines array<double>")
    return _model(sorted(fitted.collect(), key=lambda r: (r.lang, r.part)), idf)


def _model(fitted: list, idf: np.ndarray) -> Model:
    """From the clusters of all languages: ``lang``, ``centroid``, and ``lengths`` and ``cosines`` of their texts."""
    languages, rows = np.array([r.lang for r in fitted], dtype=object), np.array([r.centroid for r in fitted], dtype=np.float32).reshape(len(fitted), DIMENSIONS)

    def limits(of: list) -> dict[str, np.ndarray]:
        by_language: dict[str, list] = {}
        for r in of:
            by_language.setdefault(r.lang, []).append(r)
        return {lang: _limits(np.concatenate([r.lengths for r in rs]), np.concatenate([r.cosines for r in rs])) for lang, rs in by_language.items()}

    sizes = np.array([len(r.lengths) for r in fitted])
    share = sizes / np.array([sizes[languages == lang].sum() for lang in languages])
    kept = ~_mislabelled(languages, rows, share, [r.lengths for r in fitted], limits(fitted)) if fitted else np.zeros(0, dtype=bool)
    found = limits([r for r, k in zip(fitted, kept) if k])
    return Model(tuple(languages[kept]), rows[kept], np.array([found[lang] for lang in languages[kept]]).reshape(-1, LENGTHS), idf)


def held_out(doc_id: str = "doc_id"):
    """Documents that are never learned from: one in five by a checksum of the id; none with a NULL id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """Every row with ``lang_pred``, ``score`` and ``rejected`` in place of columns of these names.

    NULL texts and texts without a letter are ``und``, score 0, rejected; so is all if nothing was learned.
    """
    ship(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    returned = [pa.field("lang_pred", pa.string()), pa.field("score", pa.float64()), pa.field("rejected", pa.bool_())]

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pa.Array) -> pa.Array:
        told = [sent.value.predict(t.as_py()) for t in texts]  # one text at a time is a Python object
        return pa.StructArray.from_arrays([pa.array([row[i] for row in told], f.type) for i, f in enumerate(returned)], fields=returned)

    kept = [F.col(f"`{c}`") for c in documents.columns if c.lower() not in ("lang_pred", "score", "rejected")]
    told = documents.select(*kept, predict(F.col("text").cast("string")).alias("__told"))
    return told.select(*kept, "__told.lang_pred", "__told.score", "__told.rejected")


def learn(documents: DataFrame) -> Model:
    """A model from the documents that are not held out."""
    return train(documents.where(~held_out()))

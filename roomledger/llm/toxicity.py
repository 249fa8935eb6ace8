"""Toxicity by cumulative-link ordinal regression on sparse text features.

Labelled documents have a severity grade 0, 1, ... One weight a feature is shared by all grades:
``P(grade <= k) = sigmoid(threshold[k] - w.x)`` with ordered thresholds. The result is the expected severity, the sum
over k >= 1 of ``P(grade >= k)``, and whether ``P(grade >= 1)`` is over ``LEAST_PROBABILITY``.

Features are the distinct words of a text (lower case) and the first 4, 5 and 6 letters of longer words. Those
are kept whose share differs between graded and clean documents by ``LEAST_Z`` standard errors, at most
``MOST_FEATURES``. The model is fitted on at most ``MOST_LABELLED`` labelled documents, one from each of so many hash
ranges of the ids (half of them for grade 0, copies counted once); every document is scored, whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.llm.common import ship
from roomledger.session import materialize

MOST_LABELLED = 20_000
MOST_FEATURES = 20_000
LEAST_DOCUMENTS = 8
LEAST_Z = 4.0
LEAST_PROBABILITY = 0.5
PREFIXES = (4, 5, 6)
PENALTY = 1e-4
ROUNDS = 300
CACHED_WORDS = 300_000
WORD = re.compile(r"[^\W_]+")


def word_features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def features(text: str | None) -> set[str]:
    return {f for w in set(WORD.findall((text or "").lower())) for f in word_features(w)}


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: list[float]  # ordered; empty if nothing was learned
    cache: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def score(self, text: str | None) -> float:
        held: set[str] = set()
        for word in set(WORD.findall((text or "").lower())):
            known = self.cache.get(word)
            if known is None:
                if len(self.cache) >= CACHED_WORDS:
                    self.cache.clear()
                known = self.cache[word] = tuple(f for f in word_features(word) if f in self.weights)
            held.update(known)
        return sum(self.weights[f] for f in sorted(held))

    def at_least(self, text: str | None) -> list[float]:
        """P(grade >= k) for k = 1, 2, ..."""
        if not self.thresholds:
            return [0.0]
        score = self.score(text)
        return [1 / (1 + np.exp(np.clip(t - score, -500, 500))) for t in self.thresholds]


def fit(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the whole penalised likelihood; ``rows``, ``columns``: where features are set."""
    top = int(grades.max())
    share = np.array([(grades <= k).mean() for k in range(top)]).clip(1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 0.1))
    x = np.concatenate((np.zeros(n_features), start[:1], gaps))
    first, second = np.zeros_like(x), np.zeros_like(x)
    n = len(grades)
    for step in range(1, ROUNDS + 1):
        w, free = x[:n_features], x[n_features:]
        thresholds = free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:]))))
        score = np.bincount(rows, weights=w[columns], minlength=n)
        bounds = np.concatenate(([-np.inf], thresholds, [np.inf]))
        high, low = (1 / (1 + np.exp(np.clip(score - b, -500, 500))) for b in (bounds[grades + 1], bounds[grades]))
        chance = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / chance, low * (1 - low) / chance
        by_score = (d_high - d_low) / n
        by_threshold = np.zeros(top)
        np.add.at(by_threshold, grades[grades < top], -d_high[grades < top] / n)
        np.add.at(by_threshold, grades[grades > 0] - 1, d_low[grades > 0] / n)
        tails = np.cumsum(by_threshold[::-1])[::-1]
        slope = np.concatenate((np.bincount(columns, weights=by_score[rows], minlength=n_features) + PENALTY * w, tails[:1], tails[1:] * np.exp(free[1:])))
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        x = x - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return x[:n_features], x[n_features] + np.concatenate(([0.0], np.cumsum(np.exp(x[n_features + 1 :]))))


def sampled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``h, grade, found``: the features of at most ``MOST_LABELLED`` labelled texts; ``labels``: ``doc_id, grade``.

    A document with several grades has the highest, and so have equal texts.
    """
    ship(documents.sparkSession)
    graded = labels.where("doc_id is not null and grade is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("grade").cast("int").alias("grade"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(MOST_LABELLED // 2))
    chosen = graded.groupBy((F.col("grade") > 0).alias("any"), place.alias("place")).agg(F.min(F.struct(F.xxhash64("doc_id"), "doc_id", "grade")).alias("one"))
    chosen = materialize(chosen.select("one.doc_id", "one.grade"))
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null").join(F.broadcast(chosen), "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([sorted(features(t.as_py())) for t in batch.column("text")], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("grade"), found], names=["h", "grade", "found"])

    once = texts.groupBy(F.xxhash64("text").alias("h")).agg(F.max("grade").alias("grade"), F.min("text").alias("text"))
    return once.select("h", "grade", "text").mapInArrow(cut, "h long, grade int, found array<string>")


def telling(sample: DataFrame) -> pd.DataFrame:
    """``feature, clean, graded, z`` of the features that are kept; bounded by ``MOST_FEATURES``."""
    sizes = {r.any: r.n for r in sample.groupBy((F.col("grade") > 0).alias("any")).agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(False, 0), sizes.get(True, 0)
    if not n0 or not n1:
        return pd.DataFrame({"feature": [], "clean": [], "graded": [], "z": []})
    each = sample.select(F.explode("found").alias("feature"), (F.col("grade") > 0).cast("long").alias("bad"))
    counted = each.groupBy("feature").agg(F.sum(1 - F.col("bad")).alias("clean"), F.sum("bad").alias("graded"))
    share = (F.col("clean") + F.col("graded") + 1) / (n0 + n1 + 2)
    z = (F.col("graded") / n1 - F.col("clean") / n0) / F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1))
    kept = counted.where(F.col("clean") + F.col("graded") >= LEAST_DOCUMENTS).withColumn("z", z).where(F.abs("z") >= LEAST_Z)
    return kept.orderBy(F.abs("z").desc(), "feature").limit(MOST_FEATURES).toPandas()


def train(documents: DataFrame, labels: DataFrame, evidence_grades: int = 0) -> Model:
    """``labels``: ``doc_id``, ``grade`` (0 is clean). Without clean or without graded documents nothing is learned.

    ``evidence_grades``: for labels that only say clean (0) or toxic (1), so many grades are told apart among the
    toxic documents by how many kept features they hold that no clean document does (equal shares).
    """
    sample = materialize(sampled(documents, labels))
    kept = telling(sample)
    if not len(kept):
        return Model({}, [])
    vocabulary = {f: i for i, f in enumerate(kept["feature"])}
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("array<int>")
    def numbered(found: pd.Series) -> pd.Series:
        return pd.Series([[sent.value[f] for f in row if f in sent.value] for row in found])

    held = sample.select("h", "grade", numbered("found").alias("at")).orderBy("h").toPandas()  # MOST_LABELLED rows at most
    grades = held["grade"].to_numpy(dtype=np.int64)
    rows = np.repeat(np.arange(len(held)), [len(a) for a in held["at"]])
    columns = np.concatenate([np.asarray(a, dtype=np.int64) for a in held["at"]])
    if evidence_grades:
        telltale = (kept["clean"] == 0).to_numpy()
        evidence = np.bincount(rows, weights=telltale[columns], minlength=len(grades))
        edges = np.quantile(evidence[grades > 0], np.arange(1, evidence_grades) / evidence_grades)
        grades = np.where(grades > 0, 1 + np.searchsorted(edges, evidence, side="left"), 0)
    _, ranks = np.unique(grades, return_inverse=True)
    weights, thresholds = fit(rows, columns, ranks, len(kept))
    return Model(dict(zip(kept["feature"], weights.tolist())), thresholds.tolist())


def rated(documents: DataFrame, model: Model) -> DataFrame:
    """Every row with ``severity`` (expected grade), ``grade`` (the likeliest) and ``toxic``; columns of these names go.

    NULL and empty texts are rated by the thresholds alone. If nothing was learned, all is 0 and not toxic.
    """
    ship(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("severity double, grade int, toxic boolean")
    def rate(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            above = sent.value.at_least(text)
            chances = -np.diff([1.0, *above, 0.0])
            rows.append((float(sum(above)), int(np.argmax(chances)), bool(above[0] >= LEAST_PROBABILITY)))
        return pd.DataFrame(rows, columns=["severity", "grade", "toxic"])

    kept = [F.col(f"`{c}`") for c in documents.columns if c.lower() not in ("severity", "grade", "toxic")]
    told = documents.select(*kept, rate(F.col("text").cast("string")).alias("__told"))
    return told.select(*kept, "__told.severity", "__told.grade", "__told.toxic")

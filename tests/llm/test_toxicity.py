from __future__ import annotations

import random

import numpy as np
import pytest

from roomledger.llm import toxicity as T


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in "ka lo mi ne".split() for b in "ra su ti vo xe".split()]
    rude = {1: ["bah", "meh"], 2: ["bozobo", "bozoka", "bozomi"], 3: ["scumbag"]}
    documents, labels = [], []
    for i in range(n):
        grade = rng.choice([0, 0, 0, 1, 2, 3])
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        for _ in range(3 if grade else 0):
            words.insert(rng.randrange(len(words)), rng.choice(rude[grade]))
        documents.append((i, " ".join(words).capitalize()))
        labels.append((i, grade))
    return documents, labels


def frames(spark, documents, labels):
    d = spark.createDataFrame(documents, "doc_id long, text string").selectExpr("*", "'clash' as grade", "0 as severity")
    return d, spark.createDataFrame(labels, "doc_id long, grade int").selectExpr("*", "'x' as text")


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    grades = np.repeat([0, 1, 2, 3], 30)
    columns = np.where(rng.random(120) < 0.8, grades, rng.integers(0, 4, 120))
    w, thresholds = T.fit(np.arange(120), columns, grades, 4)
    assert (np.diff(thresholds) > 0).all() and (np.diff(w) > 0).all()

    def loss(w, t):
        bounds = np.concatenate(([-np.inf], t, [np.inf]))
        p = 1 / (1 + np.exp(w[columns] - bounds[grades + 1])) - 1 / (1 + np.exp(w[columns] - bounds[grades]))
        return -np.log(p).mean() + T.PENALTY / 2 * (w**2).sum()

    best = loss(w, thresholds)
    for i in range(4):
        for step in (-0.3, 0.3):
            assert loss(w + step * np.eye(4)[i], thresholds) > best - 1e-3


def test_held_out_documents(spark):
    documents, labels = corpus()
    d, known = frames(spark, documents, labels[:400])
    rows = {r.doc_id: r for r in T.rated(d, T.train(d, known)).collect()}
    assert len(rows) == 600 and list(rows[0].asDict()) == ["doc_id", "text", "severity", "grade", "toxic"]
    held = [(rows[i], g) for i, g in labels[400:]]
    assert all(r.toxic == (g > 0) for r, g in held)
    assert np.mean([r.grade == g for r, g in held]) > 0.95
    means = [np.mean([r.severity for r, g in held if g == k]) for k in range(4)]
    assert means == sorted(means) and all(0 <= r.severity <= 3 for r, _ in held)


def test_binary_labels_with_grades_by_evidence(spark):
    documents, labels = corpus()
    d, known = frames(spark, documents, [(i, min(g, 1)) for i, g in labels[:400]])
    model = T.train(d, known, evidence_grades=3)
    rows = {r.doc_id: r for r in T.rated(d, model).collect()}
    assert all(rows[i].toxic == (g > 0) for i, g in labels[400:]) and len(model.thresholds) in (1, 2, 3)


def test_odd_rows(spark):
    documents, labels = corpus(200)
    odd = [(None, "bah meh bah"), (900, None), (901, ""), (902, "!!"), (903, "karo " * 100_000 + "scumbag"), (3, documents[3][1])]
    d, known = frames(spark, documents + odd, [*labels, (None, 1), (901, None), (3, 0), (777, 2)])
    model = T.train(d, known)
    rows = T.rated(d, model).collect()
    assert len(rows) == 206 and {r.toxic for r in rows if r.doc_id in (900, 901, 902)} == {False}
    assert T.rated(d.where("false"), model).count() == 0


@pytest.mark.parametrize("condition", ["false", "grade = 0", "grade > 0"])
def test_nothing_to_learn(spark, condition):
    documents, labels = corpus(60)
    d, known = frames(spark, documents, labels)
    model = T.train(d, known.where(condition))
    assert {(r.severity, r.grade, r.toxic) for r in T.rated(d, model).collect()} == {(0.0, 0, False)}

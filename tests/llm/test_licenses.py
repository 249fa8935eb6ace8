from __future__ import annotations

import re

from pyspark.sql import functions as F

from roomledger.llm import licenses as L

OWN = (
    L.Template("short", "one two", base=True),
    L.Template("long", "alpha beta gamma delta epsilon", 0.6, ("beta gamma", "omega psi")),
)


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(str.maketrans(L.UPPER, L.LOWER)))


def brute(text, templates):
    """Every template at every start."""
    own, every = words(text), L.with_keys(templates)
    places = []
    for number, t in enumerate(every):
        for start in range(len(own) - len(t.words) + 1):
            agree = sum(a == b for a, b in zip(own[start:], t.words))
            if agree >= t.need:
                places.append((number, start, agree))
    found = {every[n].text for n, _, _ in places}
    giving = {n for n, _, _ in places if n < len(templates) and all(k in found for k in templates[n].keys)}
    base = [s for n, s, _ in places if every[n].base]
    score = max((a / len(every[n].words) for n, _, a in places if n in giving), default=0.0)
    join = lambda ns: ",".join(sorted({every[n].label for n in ns}))
    return (
        len(own), len(base), min(base, default=None), max(base, default=None),
        join(n for n in giving if every[n].base), join(giving), score, sorted(places),
    )


def scanned(spark, texts, templates):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = L.labelled(L.scan(rows, templates), templates).orderBy("doc_id").collect()
    return [
        (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, sorted(tuple(p) for p in r.places)) for r in out
    ]


def test_against_every_template_at_every_start(spark):
    texts = [
        None, "", " .,;", "one", "one two", "One-TWO one\ttwo. one one two two", "oné two", "twoone two",
        "alpha beta gamma delta epsilon", "x alpha beta gamma y z omega psi", "omega psi alpha beta gamma delta eps",
        "alpha x gamma delta epsilon beta gamma omega psi", "epsilon " * 50 + "omega psi beta gamma", "alpha beta gamma x omega psi",
        "delta epsilon omega psi beta gamma", "one two " * 3000 + "alpha beta gamma delta epsilon" * 2,
    ]
    assert scanned(spark, texts, OWN) == [brute(t, OWN) for t in texts]


def test_published_texts(spark):
    mit = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights'
    )
    texts = [
        mit,
        mit.replace("free of charge", "for a fee"),
        "Licensed under CC BY-NC 4.0.",
        "Licensed under the Apache License, Version 2.0.\nAll rights reserved.",
        "This work is licensed under the GNU General Public License, version 3.",
        "You may use this, by permission.",
    ]
    rows = scanned(spark, texts, L.LICENCES)
    assert [r[5] for r in rows] == ["mit", "", "cc-by,cc-by-nc", "apache-2.0,reserved", "gpl,gpl-3.0", ""]
    assert [r[4] for r in rows] == ["", "", "cc-by", "reserved", "gpl", ""]
    assert rows == [brute(t, L.LICENCES) for t in texts]


def test_places_do_not_depend_on_the_indexed_words(spark):
    rows = spark.createDataFrame([("alpha beta x delta epsilon one two",)], "text string")
    every = {w for t in L.with_keys(OWN) for w in t.words}
    for rare in every:
        out = L.scan(rows, OWN, {w: 0 if w == rare else 9 for w in every}).first().places
        assert sorted(tuple(p) for p in out) == brute("alpha beta x delta epsilon one two", OWN)[-1]


def test_rows_ids_columns_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, "one two", 1, "a"), (None, "two", 2, "b"), (7, "one two", 3, "c"), (7, "one two", 3, "c")], "doc_id long, text string, places int, other string")
    out = L.labelled(L.scan(rows, OWN), OWN)
    assert sorted((r.doc_id or 0, r.other, r.n_base) for r in out.collect()) == [(0, "a", 1), (0, "b", 0), (7, "c", 1), (7, "c", 1)]
    assert sorted((s.label, s.start, s.length, s.agree) for s in L.spans(L.scan(rows, OWN), OWN).collect()) == [("short", 0, 2, 2)] * 3
    empty = L.scan(rows.where(F.lit(False)), OWN)
    assert L.labelled(empty, OWN).collect() == [] and L.spans(empty, OWN).collect() == []


def test_frequencies_cover_all_documents(spark):
    rows = spark.createDataFrame([("one one",), ("One two",), (None,)], "text string")
    counted = L.document_frequencies(rows, OWN)
    assert (counted[""], counted["one"], counted["two"], counted["alpha"]) == (3, 2, 1, 0)


def test_no_python_and_no_shuffle_of_texts(spark):
    rows = spark.createDataFrame([("one two",)], "text string")
    text = L.labelled(L.scan(rows, OWN), OWN)._jdf.queryExecution().toString()
    assert "Python" not in text and "Exchange" not in text

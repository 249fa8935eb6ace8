from __future__ import annotations

import random
import re

import pytest

from roomledger.llm import decontamination as D


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(documents, items, threshold=0.8):
    def held(parts, m):
        return {tuple(parts[i : i + m]) for i in range(len(parts) - m + 1)}

    sought, have, out = {}, {}, set()
    for i, text in items:
        if i is not None and words(text):
            sought.setdefault(i, set()).update(held(words(text), min(5, len(words(text)))))
    for i, text in documents:
        for m in range(1, 6):
            have.setdefault((i, None if i is not None else text), set()).update(held(words(text), m))
    for d, found in have.items():
        for i, want in sought.items():
            if len(found & want) >= threshold * len(want) - 1e-9:
                out.add((d[0], i, len(found & want), len(want)))
    return out


def matches(spark, documents, items, threshold=0.8):
    d = spark.createDataFrame(documents, "doc_id long, text string").selectExpr("*", "'x' as item_id", "1 as size")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 as doc_id")
    rows = D.contained_items(d, b, threshold).collect()
    found = {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in rows}
    assert all(r.containment == r.shared / r.item_shingles for r in rows)
    return found


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_damaged_passages_against_brute_force(spark, threshold):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop")
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 5, 6, 9, 17, 40, 90])))) for i in range(25)]
    documents = []
    for d in range(60):
        passage = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            passage[rng.randrange(len(passage))] = word()
        before = [word() for _ in range(rng.choice([0, 3, 400]))]
        documents.append((d, ", ".join(before + passage).upper()))
    expected = brute(documents, items, threshold)
    assert matches(spark, documents, items, threshold) == expected and expected


def test_odd_rows(spark):
    text = "one two three four five six seven"
    documents = [(1, text), (1, text), (2, None), (3, ""), (None, text), (None, "nothing"), (4, "one two three"), (5, "x " * 30_000 + text), (6, "one two three four five"), (6, "three four five six seven eight")]
    items = [(10, text), (10, text), (11, None), (12, "..."), (None, text), (13, "ONE-two; three: four, (five)")]
    expected = {(d, i, n, n) for d in (1, None, 5) for i, n in ((10, 3), (13, 1))} | {(6, 13, 1, 1)}
    assert matches(spark, documents, items) == brute(documents, items) == expected
    assert matches(spark, [(1, text)], []) == matches(spark, [], [(1, text)]) == set()


def test_items_shorter_than_a_shingle(spark):
    documents = [(1, "Now, what is the answer? Well"), (2, "what is an answer"), (3, "the answer"), (None, "is THE answer"), (4, "seven")]
    items = [(1, "what is the answer"), (2, "the answer"), (3, "seven!"), (4, ""), (5, "the answer is what we are after"), (5, "the answer")]
    found = matches(spark, documents, items)
    assert found == brute(documents, items) and {(d, i) for d, i, *_ in found} == {(1, 1), (1, 2), (3, 2), (None, 2), (4, 3)}


def test_a_document_in_several_rows_is_one(spark):
    text = "a b c d e f g h i j".split()
    documents = [(1, " ".join(text[k : k + 6])) for k in range(0, 5)] + [(2, " ".join(text[:6]))]
    items = [(7, " ".join(text))]
    assert matches(spark, documents, items) == brute(documents, items) == {(1, 7, 6, 6)}


def test_only_candidates_are_verified(spark):
    """A shingle that all items share doesn't bring every item to every document that holds it."""
    common = "all items begin like this"
    items = [(i, common + " " + " ".join(f"w{i}x{k}" for k in range(20))) for i in range(30)]
    documents = [(d, items[d][1]) for d in range(10)] + [(99, common)]
    assert matches(spark, documents, items) == brute(documents, items) == {(d, d, 21, 21) for d in range(10)}


def test_sql_finds_the_same(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    documents = [(1, "so what is the answer now"), (None, "What is the answer"), (2, "a b c d e f g"), (3, None)]
    items = [(1, "what is the answer"), (2, "a b c d e f g"), (3, "b"), (None, "a")]
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", documents), ("benchmark", "item_id", items)):
        con.execute(f"create table {name} ({key} bigint, text varchar)")
        con.executemany(f"insert into {name} values (?, ?)", rows)
    assert {r[:4] for r in con.execute(D.ORACLE).fetchall()} == matches(spark, documents, items) == brute(documents, items)


def test_the_search_stays_on_the_jvm_and_shuffles_hits_only(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    text = D._positions(d, [5], "doc_id").select(D._hash([5]).alias("h"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text

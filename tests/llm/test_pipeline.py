"""The registered queries against their SQL, and the pipeline against a plain version of its stages."""

from __future__ import annotations

import check
import corpus_pipeline
import pytest
from test_decontamination import brute as contained
from test_simhash import brute_components, brute_fingerprint

import __spark_entry__ as entry
from roomledger.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_rows_against_sql(spark, db, name):
    assert check.differences(entry.queries()[name](spark, FOLDER), db, entry.oracle_sql()[name]) == ""


def test_registered_names():
    names = [n.split("_")[0] for n in queries.QUERIES]
    assert names == [f"op{i}" for i in range(1, 14)]
    assert set(entry.queries()) >= {*queries.QUERIES, "pipeline"}


ROWS = [
    (1, "The quick brown fox runs over nine lazy dogs near the river bank today and sleeps"),
    (1, "The quick brown fox runs over nine lazy dogs near the river bank today and sleeps"),
    (2, "the quick brown fox runs over nine lazy dogs near the river bank today and sleeps"),
    (3, "Some other words about the weather in the northern parts of the country this week"),
    (4, None),
    (5, "12345 67890 !!"),
    (6, ""),
    (7, "Mixed text that quotes one two three four five six seven eight nine ten of the test"),
    (None, "A row that has no id but has enough words for a document of its own"),
    (8, 'Here a config says token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and then goes on'),
    (9, "Other config with the value 4785380592391139 that is only a card number you know"),
]


def stage(spark, number, rows, folder):
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.STAGES[number][1](spark, docs, folder)
    if number < 4:
        assert out.columns == docs.columns
    empty = corpus_pipeline.STAGES[number][1](spark, docs.where("false"), folder)
    assert empty.count() == 0
    return out.collect()


def test_stages_against_plain_versions(spark, tmp_path):
    folder = str(tmp_path)
    items = [(1, "one two three four five six seven eight nine ten"), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    kept = [(r.doc_id, r.text) for r in stage(spark, 0, ROWS, folder)]
    assert sorted(kept, key=repr) == sorted((r for r in ROWS if r[0] not in (4, 5, 6)), key=repr)

    components = brute_components([(i, brute_fingerprint(t)) for i, t in kept])
    expected = {(i, t) for (i, t), c in zip(kept, components) if i == c or c is None}
    deduped = [(r.doc_id, r.text) for r in stage(spark, 1, kept, folder)]
    assert set(deduped) == expected and len(deduped) == len(expected) and (2, ROWS[2][1]) not in expected

    leaks = {d for d, *_ in contained(deduped, items)}
    clean = [(r.doc_id, r.text) for r in stage(spark, 2, deduped, folder)]
    assert leaks == {7} and sorted(clean, key=repr) == sorted((r for r in deduped if r[0] not in leaks), key=repr)

    redacted = {r.doc_id: r for r in stage(spark, 3, clean, folder)}
    assert len(redacted) == len(clean) and redacted[8].text == 'Here a config says token = "[SECRET]" and then goes on'
    assert all(redacted[i].text == t for i, t in clean if i != 8) and all(r.n_chars == len(r.text) for r in redacted.values())

    coded = stage(spark, 4, [(i, r.text) for i, r in redacted.items()], folder)
    assert {r.doc_id for r in coded} == set(redacted) and all(r.exact and r.n_ids == len(r.ids) > 0 for r in coded)


def test_whole_pipeline(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert 0 < len(out) < documents.count() and len({r.doc_id for r in out}) == len(out)


def test_only_copies_go_where_ids_are_null_or_repeated(spark):
    other = "Twelve small boats left the harbour before the storm came over the hills that evening"
    third = "A cook in the old kitchen peels potatoes and onions while the soup boils on the stove"
    fox, copy, weather, no_id = ROWS[0][1], ROWS[2][1], ROWS[3][1], ROWS[8][1]
    rows = [(1, fox), (None, copy), (None, no_id), (None, other), (None, other), (5, third), (5, weather), (5, weather), (5, copy), (None, None)]
    kept = sorted(((r.doc_id, r.text) for r in stage(spark, 1, rows, None)), key=repr)
    assert kept == sorted([(1, fox), (None, no_id), (None, other), (5, third), (5, weather), (None, None)], key=repr)


def test_items_are_searched_by_row_where_ids_are_null_or_repeated(spark, tmp_path):
    item = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leak, clean = f"before {item} after", "a text of its own with more than five words"
    pieces = ["one two three four five six seven", "four five six seven eight nine ten"]
    rows = [(None, leak), (None, clean), (None, None), (7, leak), (7, clean), (7, clean), (8, pieces[0]), (8, pieces[1])]
    kept = sorted(((r.doc_id, r.text) for r in stage(spark, 2, rows, str(tmp_path))), key=repr)
    assert kept == sorted((r for r in rows if r[1] != leak), key=repr)

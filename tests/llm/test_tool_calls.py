from __future__ import annotations

import json
import random
import time

import pytest

from roomledger.llm import tool_calls as T

CALL = "conv_id long, turn long, call_id string, name string, arguments string, refers_to array<string>"
RESULT = "conv_id long, turn long, call_id string, content string"
TOOLS = {"find": {"q": ("string", True), "n": ("integer", False)}, "now": {}, "mix": {"x": ("number", True), "o": ("object", False), "l": ("array", False), "b": ("boolean", False)}}


def formatted(spark, calls, results):
    c = spark.createDataFrame(calls, CALL).selectExpr("*", "'clash' as status", "1 as level")
    r = spark.createDataFrame(results, RESULT).selectExpr("*", "'clash' as json")
    rows = T.formatted(c, r, T.schema_table(spark, TOOLS)).collect()
    assert len(rows) == len({(x.conv_id, x.call_id) for x in rows})
    return {(x.conv_id, x.call_id): x for x in rows}


def test_links_levels_and_json(spark):
    calls = [
        (1, 1, "a", "find", '{"q": "é \\"x\\"", "n": 3}', None),
        (1, 2, "b", "find", '{"n":1,"q":"y"}', ["a", "nowhere", "a"]),
        (1, 3, "c", "now", "{}", ["b", "a"]),
        (1, 4, "d", "now", "{}", ["e"]),
        (1, 5, "e", "now", "{}", ["d"]),
        (1, 6, "f", "now", "{}", ["e"]),
        (2, 1, "a", "now", "{}", ["c"]),
        (2, 2, "late", "now", "{}", []),
        (2, 1, "a", "now", "{}", ["c"]),
        (2, 9, "a", "find", "{}", None),
        (None, 1, "a", "now", "{}", None),
        (3, None, None, "now", "{}", None),
    ]
    results = [(1, 2, "a", "found\n1"), (1, 7, "a", "second"), (2, 1, "late", None), (2, 5, "ghost", "who?"), (4, None, "alone", "x")]
    rows = formatted(spark, calls, results)
    assert {k: (r.status, r.level, r.circular) for k, r in rows.items()} == {
        (1, "a"): ("linked", 0, False), (1, "b"): ("unanswered", 1, False), (1, "c"): ("unanswered", 2, False),
        (1, "d"): ("unanswered", None, True), (1, "e"): ("unanswered", None, True), (1, "f"): ("unanswered", None, True),
        (2, "a"): ("unanswered", 0, False), (2, "late"): ("early", 0, False), (2, "ghost"): ("orphan", None, False), (4, "alone"): ("orphan", None, False),
    }
    assert (rows[1, "a"].n_calls, rows[1, "a"].n_results, rows[2, "a"].n_calls) == (1, 2, 3)
    for row in rows.values():
        assert row.json == json.dumps(json.loads(row.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(rows[1, "a"].json) == {"arguments": {"n": 3, "q": 'é "x"'}, "call_id": "a", "name": "find", "problems": [], "result": "found\n1", "status": "linked"}


def test_arguments_against_schemas(spark):
    cases = {
        "ok": ("find", '{"q":"x"}', []),
        "missing": ("find", "{}", ["missing q"]),
        "types": ("find", '{"q":1,"n":"2"}', ["n is no integer", "q is no string"]),
        "extra": ("now", '{"a":1}', ["unexpected a"]),
        "null": ("find", '{"q":null}', ["q is no string"]),
        "text": ("find", "not json", ["arguments are no JSON object"]),
        "list": ("find", "[1]", ["arguments are no JSON object"]),
        "none": ("find", None, ["arguments are no JSON object"]),
        "twice": ("find", '{"q":"x","q":"y"}', ["arguments are no JSON object"]),
        "tool": ("nothing", "{}", ["unknown tool"]),
        "noname": (None, "{}", ["unknown tool"]),
        "mix": ("mix", '{"x":1.5,"o":{"b":[1,{"z":1,"a":2}]},"l":[],"b":true}', []),
        "whole": ("mix", '{"x":2}', []),
    }
    rows = formatted(spark, [(1, i, k, n, a, None) for i, (k, (n, a, _)) in enumerate(cases.items())], [])
    assert {k: rows[1, k].problems for k in cases} == {k: p for k, (_, _, p) in cases.items()}
    assert '"o":{"b":[1,{"a":2,"z":1}]}' in rows[1, "mix"].json
    assert json.loads(rows[1, "text"].json)["arguments"] == "not json" and json.loads(rows[1, "none"].json)["arguments"] is None


def test_a_long_chain_and_a_hot_identifier(spark):
    calls = [(1, i, f"c{i}", "now", "{}", [f"c{i - 1}"]) for i in range(12)] + [(2, 1, "same", "now", "{}", None)] * 500
    rows = formatted(spark, calls, [(2, 2, "same", "r")] * 300)
    assert [rows[1, f"c{i}"].level for i in range(12)] == list(range(12))
    assert (rows[2, "same"].n_calls, rows[2, "same"].n_results, rows[2, "same"].status) == (500, 300, "linked")


def plain_levels(refers):
    """Level by level over a dict of call -> calls it refers to."""
    level, left = {}, {c: {u for u in used if u in refers} for c, used in refers.items()}
    while free := [c for c, used in left.items() if used <= level.keys()]:
        for c in free:
            level[c] = 1 + max((level[u] for u in left.pop(c)), default=-1)
    return level


@pytest.mark.parametrize("seed", range(4))
def test_levels_of_any_graph(spark, seed):
    pick = random.Random(seed)
    n = 60
    refers = {f"c{i}": [f"c{pick.randrange(max(1, i - 4), i + (seed == 3 and i % 20 == 0) * 5 or i)}" for _ in range(pick.choice([0, 1, 1, 1, 1, 2, 3]))] if i > 1 else [] for i in range(n)}
    refers |= {"x": ["y"], "y": ["x"], "z": ["x", "c1"], "self": ["self"], "after": ["self"], "both": ["c59", "c58", "gone"]}
    rows = spark.createDataFrame([(k % 2, c, used) for k in range(2) for c, used in refers.items()], "conv_id long, call_id string, refers_to array<string>")
    found = T.levels(rows).collect()
    expected = plain_levels(refers)
    assert sorted((r.conv_id, r.call_id, r.level) for r in found) == sorted((k, c, v) for k in range(2) for c, v in expected.items())


def test_a_chain_of_5000_calls(spark):
    rows = spark.range(5000).selectExpr("1L as conv_id", "concat('c', id) as call_id", "array(concat('c', id - 1)) as refers_to")
    start = time.monotonic()
    found = T.levels(rows)
    assert found.where("call_id <> concat('c', level)").count() == 0 and found.count() == 5000
    assert time.monotonic() - start < 60
    assert found._jdf.queryExecution().toString().count("Join") < 20


def test_empty_tables(spark):
    assert formatted(spark, [], []) == {}
    assert len(formatted(spark, [], [(1, 1, "x", "y")])) == 1


def test_messages(spark):
    text = json.dumps({"tool_calls": [{"id": "k", "name": "find", "arguments": {"q": "x"}, "refers_to": ["j"]}, {"id": "l"}]})
    rows = [(1, 0, "assistant", "\n " + text), (1, 1, "tool", '{"tool_call_id":"k","content":"done"}'), (1, 2, "user", "{broken"), (1, 3, "user", None), (1, 4, "tool", "no json"), (None, None, None, None)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    calls = {r.call_id: r for r in T.calls_in(messages).collect()}
    assert json.loads(calls["k"].arguments) == {"q": "x"} and calls["k"].refers_to == ["j"] and calls["l"].name is None
    assert [tuple(r) for r in T.results_in(messages).collect()] == [(1, 1, "k", "done")]
    asked, answered = T.dialogue_calls(messages)
    assert {r.call_id for r in asked.collect()} == {"turn-2", "turn-3"} and [r.call_id for r in answered.collect()] == ["turn--1"]

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from roomledger.llm import sentencepiece_fst as S
from roomledger.llm.queries import TOKENIZER

ODD = ["", " ", "  a", "Hello  world\n a 😀", "def f(x):\n        return x\t\t1", "日本語 ขข", "   " * 30 + "abc" + " " * 17, "a" * 300, "\r\n \r\n", "<s> </s> <unk> <0x41>", "\x00\x01é̂", "x" * 20_000]


@pytest.fixture(scope="module")
def model():
    with open(TOKENIZER, "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def machine(model):
    return S.compiled(model)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)


def random_texts(n):
    rng = random.Random(4)
    return ["".join(rng.choice("abe the \n<>s/日x😀éà.Th  in") for _ in range(rng.randrange(60))) for _ in range(n)]


def test_same_ids_as_the_library_and_exact_round_trip(machine, library):
    for text in [*ODD, *random_texts(2000)]:
        ids = machine.encode(text)
        assert ids == library.encode(text), text
        assert machine.decode(ids) == library.decode(ids) == text


def test_the_mark_itself_becomes_a_space(machine, library):
    for text in ("a▁b", "▁", " ▁▁x"):
        assert machine.encode(text) == library.encode(text) and machine.decode(machine.encode(text)) == text.replace("▁", " ")


def test_bytes_that_are_no_text_decode_like_the_library(machine, library):
    ids = [library.piece_to_id(p) for p in ("<0xFF>", "<0xE6>", "<0x97>", "▁a", "<s>")]
    assert machine.decode(ids).count("�") >= 1


def test_cache_turnover_changes_nothing(model, machine, monkeypatch):
    monkeypatch.setattr(S, "CACHED_PARTS", 5)
    monkeypatch.setattr(S, "CACHED_LENGTH", 8)
    small, texts = S.compiled(model), random_texts(100)
    assert [small.encode(t) for t in texts] == [machine.encode(t) for t in texts]


def test_unigram_paths_against_all_segmentations():
    rng = random.Random(6)
    pieces = [("<unk>", 0.0, S.UNKNOWN), *((f"<0x{b:02X}>", 0.0, S.BYTE) for b in range(256))]
    pieces += [(p, -rng.random() * 5, S.NORMAL) for p in ("▁", "a", "b", "ab", "ba", "aab", "▁a", "▁ab", "bb", "abab")]
    machine = S.Transducer(pieces, S.UNIGRAM)
    weight = {p: -s for p, s, k in pieces if k == S.NORMAL}
    for text in ("abab", "aabbab", "bab ab", "abxab", "ababab", "x"):
        normal = machine.normalise(text)
        best = math.inf
        for cuts in itertools.product((0, 1), repeat=len(normal) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(normal)]
            parts = [normal[i:j] for i, j in zip(at, at[1:])]
            if all(p in weight or len(p) == 1 for p in parts):
                best = min(best, sum(weight.get(p, machine.fallback_weight) for p in parts))
        names = [machine.pieces[i] for i in machine.encode(text)]
        found = sum(-s if k == S.NORMAL else machine.fallback_weight for _, s, k in names)
        assert found == pytest.approx(best) and machine.decode(machine.encode(text)) == text


def test_tables(spark, model, library):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "▁"), (None, "x\n" * 5000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as ids")
    coded = S.tokenized(frame, model)
    assert coded.columns == ["doc_id", "text", "ids", "n_ids", "exact"]
    found = {(r.doc_id, r.text, None if r.ids is None else tuple(r.ids), r.n_ids, r.exact) for r in coded.collect()}
    assert found == {(i, t, None if t is None else tuple(library.encode(t)), None if t is None else len(library.encode(t)), None if t is None else t != "▁") for i, t in rows}
    back = S.detokenized(coded.drop("text"), model).where("exact").select("doc_id", "text").collect()
    assert sorted(map(repr, back)) == sorted(repr(r) for r in coded.where("exact").select("doc_id", "text").collect())
    assert S.tokenized(frame.where("false"), model).count() == 0
    assert S.read_model(spark, f"file://{TOKENIZER}") == model


def test_paths_are_kept_as_bytes_and_pairs_within_bounds(model, monkeypatch):
    machine = S.compiled(model)
    text = "Some words, and some words again: naïve 日本 \U0001f600\n"
    ids = machine.encode(text)
    assert machine.paths and all(type(path) is bytes for path in machine.paths.values())
    assert np.frombuffer(machine.encoded(text), np.int32).tolist() == ids and machine.decode(ids) == text
    monkeypatch.setattr(S, "CACHED_PAIRS", 3)
    small = S.compiled(model)
    assert small.encode(text) == ids and len(small.kept_pairs) <= 3


def test_a_worker_keeps_no_paths_or_pairs_after_a_task(spark, model):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(random_texts(400))], "doc_id long, text string").repartition(16)
    assert S.tokenized(texts, model).where("exact").count() > 0

    def kept(batches):
        machine = S._of(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(machine.paths) + len(machine.older) + len(machine.kept_pairs)] * len(batch))], names=["n"])

    assert {r.n for r in texts.select("doc_id").mapInArrow(kept, "n long").collect()} == {0}


def test_ids_go_out_in_small_pieces_and_in_order(machine, monkeypatch):
    texts = pa.array(["", None, *random_texts(50), "x" * 20_000, None, ""])
    (whole,) = S._encoded(machine, texts)
    monkeypatch.setattr(S, "PIECE_BYTES", 200)
    pieces = list(S._encoded(machine, texts))
    assert len(pieces) > 5 and pa.concat_arrays(pieces).to_pylist() == whole.to_pylist()
    assert all(sum(len(ids or []) for ids in p.field("ids")[:-1].to_pylist()) * 4 < 200 for p in pieces)
    assert [p.to_pylist() for p in S._encoded(machine, pa.array([None], pa.string()))] == [[{"ids": None, "n_ids": None, "exact": None}]]
    assert list(S._encoded(machine, pa.array([], pa.string()))) == []

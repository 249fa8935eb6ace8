from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
import xxhash

from roomledger.llm import language

SYLLABLES = {"xx": "ba lo mi tu re".split(), "yy": "schn ürg öff äkt auß".split(), "zz": "ción ñar ejo lla ique".split()}


def prose(rng, lang, n=None):
    words = ("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n or rng.randrange(3, 80)))
    return " ".join(words).capitalize() + "."


def brute_counts(text):
    letters = "".join(c if language._letters()[ord(c)] else "\x00" for c in text.lower())
    points = [0, *(ord(c) if c != "\x00" else 0 for c in letters), 0]
    total = np.zeros(language.DIMENSIONS, dtype=np.int64)
    for n in range(3):
        for i in range(len(points) - n):
            part = points[i : i + n + 1]
            if (n == 0 and not part[0]) or (n == 1 and not any(part)) or (n == 2 and not part[1]):
                continue
            value = 0
            for p in part:
                value = (value * 1_000_003 + p) % (1 << 64)
            total[((value + n) * 0x9E3779B97F4A7C15 % (1 << 64) >> 40) % language.DIMENSIONS] += 1
    return total


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1 << 20])
def test_counts_do_not_depend_on_blocks(monkeypatch, block):
    monkeypatch.setattr(language, "BLOCK", block)
    for text in ("", "a", "Ab cd", "  éà, 12x-yz!!", "日本 language", "abcabcabc"):
        assert (language.counts(text) == brute_counts(text)).all()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    made = [(i, prose(rng, lang), lang) for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(400))]
    return made + [(1000, None, "xx"), (1001, "", "yy"), (1002, "123 !?", "zz"), (1003, "Балалайка и медведь", None), (1004, "ba " * 50_000, "xx"), (None, "lomi tu", "xx"), (5, *made[5][1:])]


def test_held_out_rows_are_told_apart(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'clash' as lang_pred", "1 as score")
    told = language.identify(frame, language.learn(frame)).select("doc_id", "text", "lang", language.held_out().alias("held_out"), "lang_pred", "score", "rejected").collect()
    assert len(told) == len(rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in told)
    clear = [r for r in told if r.lang and r.doc_id not in (1000, 1001, 1002)]
    assert all(r.lang_pred == r.lang and not r.rejected and 0 < r.score <= 1 for r in clear)
    odd = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in told if r.doc_id in (1000, 1001, 1002)}
    assert set(odd.values()) == {("und", 0.0, True)}
    assert next(r for r in told if r.doc_id == 1003).rejected


def test_labels_of_held_out_rows_are_not_used(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wrong = frame.selectExpr("doc_id", "text", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 'wrong' else lang end as lang")
    model = language.learn(wrong)
    assert set(model.languages) == set(SYLLABLES)
    told = {r.lang_pred for r in language.identify(wrong, model).select("lang_pred").collect()}
    assert told == {*SYLLABLES, "und"}


def test_nothing_to_learn(spark, rows):
    frame = spark.createDataFrame(rows[:5], "doc_id long, text string, lang string")
    model = language.train(frame.where("false"))
    assert model.languages == () and model.predict("some text") == ("und", 0.0, True)
    assert language.identify(frame.where("false"), model).count() == 0


def test_the_sample_is_bounded_and_copies_count_once(spark):
    rng = random.Random(3)
    rows = [(prose(rng, "xx"), "xx") for _ in range(60)] + [("mi tu mi tu", "xx")] * 200 + [("öff äkt", "yy")]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"), sample=8, centroids=3)
    assert 1 <= sum(x == "xx" for x in model.languages) <= 3 and model.predict("äkt öff")[0] == "yy"


def noise(rng, first, last, words):
    return " ".join("".join(chr(rng.randrange(first, last)) for _ in range(rng.randrange(2, 10))) for _ in range(words))


@pytest.mark.parametrize("first,last", [(ord("a"), ord("z") + 1), (0x430, 0x450), (0x4E00, 0x9FA0)])
def test_random_letters_are_rejected_at_every_length(spark, first, last):
    rng = random.Random(4)
    frame = spark.createDataFrame([(prose(rng, lang, rng.choice([3, 10, 40, 200, 1000])), lang) for lang in SYLLABLES for _ in range(200)], "text string, lang string")
    model = language.train(frame)
    for words in (20, 100, 1000, 20_000):
        assert model.predict(noise(rng, first, last, words))[2]
    kept = [model.predict(prose(rng, lang, n)) for lang in SYLLABLES for n in (4, 20, 100, 500, 3000) for _ in range(10)]
    assert not any(rejected for *_, rejected in kept)


def test_a_rare_script_stays_and_wrong_labels_go(spark):
    """Two in a hundred texts of xx are in other letters, two in a hundred of yy are really in zz."""
    rng = random.Random(5)
    other = {"xx": lambda: noise(random.Random(rng.randrange(5)), 0x10D0, 0x10D8, 30), "yy": lambda: prose(rng, "zz", 30)}
    rows = [(i, other[lang]() if i % 50 == 0 and lang in other else prose(rng, lang, 30), lang) for i in range(300) for lang in SYLLABLES]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), centroids=8)
    assert model.predict(noise(random.Random(3), 0x10D0, 0x10D8, 30))[::2] == ("xx", False)
    assert all(model.predict(prose(rng, "zz", n))[::2] == ("zz", False) for n in (10, 30, 90) for _ in range(20))


def test_predictions_are_those_of_a_plain_version(spark, rows):
    """All of it in plain Python: document frequencies, sample order, spherical k-means, nearest centroid."""
    frame = spark.createDataFrame([r for r in rows if r[0] != 1004], "doc_id long, text string, lang string")
    told = language.identify(frame, language.learn(frame)).collect()
    learned = [(t, lang) for d, t, lang in rows if d != 1004 and t and lang and any(map(str.isalpha, t)) and (d is None or zlib.crc32(str(d).encode()) % 5)]
    idf = np.log((1 + len(learned)) / (1 + sum((brute_counts(t) > 0).astype(int) for t, _ in learned))) + 1

    def vector(text):
        weighted = [math.log(1 + n) * w for n, w in zip(brute_counts(text), idf)]
        norm = math.sqrt(sum(x * x for x in weighted))
        return np.array([x / norm for x in weighted])

    centroids = []
    for lang in SYLLABLES:
        places = {}
        for text in {t for t, known in learned if known == lang}:
            h = xxhash.xxh64_intdigest(text.encode(), 42)
            h -= (1 << 64) if h >> 63 else 0
            places[h % language.SAMPLE] = min(places.get(h % language.SAMPLE, (h, text)), (h, text))
        vectors = [vector(t) for _, t in sorted(places.values())]
        means = vectors[: language.CENTROIDS]
        for _ in range(12):
            groups = [[] for _ in means]
            for v in vectors:
                groups[max(range(len(means)), key=lambda c: (means[c] @ v, -c))].append(v)
            means = [sum(g) / math.sqrt((sum(g) ** 2).sum()) if g else m for g, m in zip(groups, means)]
        centroids += [(lang, m) for m in means]
    for r in told:
        if r.text and any(map(str.isalpha, r.text)):
            of = vector(r.text)
            lang, mean = max(centroids, key=lambda c: c[1] @ of)
            assert r.lang_pred == lang and abs(r.score - mean @ of) < 0.01

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roomledger.llm import divergence as D


def brute(rows, least, shown):
    held, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(str.maketrans(D.UPPER, D.LOWER)))
        groups.add((lang, source))
        held[lang, source].update(found)
        docs[lang].update(set(found))
    kept = {lang: [t for t, n in docs[lang].items() if n >= least] for lang, _ in groups}

    def shares(counts, lang):
        total = sum(counts[t] for t in kept[lang])
        return {t: 1 + D.SHARE * (counts[t] + 2) // (total + 2 * len(kept[lang])) for t in kept[lang]}

    diff = lambda p, q: (p - q) ** 2 // (p + q)
    p = {g: shares(held[g], g[0]) for g in groups}
    whole = {lang: shares(sum((held[g] for g in groups if g[0] == lang), Counter()), lang) for lang, _ in groups}
    out = []
    for lang, source in groups:
        own = p[lang, source]
        pairs = [(-sum(diff(own[t], p[lang, o][t]) for t in own), o.encode()) for k, o in groups if k == lang and o != source]
        terms = [(-diff(own[t], whole[lang][t]), t.encode()) for t in own if held[lang, source][t] and own[t] > whole[lang][t]]
        for part, values in (("pair", sorted(pairs)), ("term", sorted(terms)[:shown])):
            out += [(lang, source, part, i.decode(), -v, r) for r, (v, i) in enumerate(values, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, la, s, 0) for i, (la, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")


TEXTS = [
    "The cat, the dog; THE end.", "foo foo, foo. FOO", "don't stop-stop 4x4 x", "Ärger ärger ÄRGER", "a b c\x1cd e f", "\x0b\x0c\r\n\t ", "",
    None, "the the the the", "cat-dog cat dog", "1 2 3 !!!", "naïve 日本 日本語", "end",
]


def rows():
    out = []
    for i in range(240):
        lang = (None, "en", "de", "")[i % 4] if i % 3 else "en"
        out.append((lang, (None, "s1", "s2", "s3", "")[i % 5] if i % 7 else "s1", f"{TEXTS[i % 13] or ''} w{i % 30} {TEXTS[i * 5 % 13] or ''}" if i % 13 else TEXTS[i % 12]))
    return out + [("fr", "x", "123"), ("fr", "y", None), ("it", "only", "uno"), ("en", "empty", "")]


@pytest.mark.parametrize("least", [1, 3, 10, 60])
def test_against_term_by_term(spark, least):
    data = rows()
    found = sorted(tuple(r) for r in D.audit(table(spark, data), least, 4).collect())
    assert found == brute(data, least, 4)


def test_documents_with_several_chunks_of_a_term_count_once(spark):
    data = [("en", "s", "foo foo-a, a-foo; foo."), ("en", "t", "foo-a, Foo (foo)"), ("en", "t", "bar"), ("en", "u", "bar-x, bar")]
    docs = table(spark, data)
    counts = D.chunk_counts(docs)
    words = D.dictionary(counts)
    terms = D.term_counts(counts, words)
    assert {(r.lang, r.term, r.occurrences) for r in D.kept_terms(docs, words, terms, 2).collect()} == {("en", "foo", 7), ("en", "bar", 3), ("en", "a", 3)}
    assert {r.term for r in D.kept_terms(docs, words, terms, 3).collect()} == set()
    exact = D.document_counts(docs, words, terms.select("lang", "term").distinct())
    assert {(r.term, r.docs) for r in exact.collect()} == {("foo", 2), ("bar", 2), ("a", 2), ("x", 1)}


def test_undecided_terms_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    data = rows()
    assert sorted(tuple(r) for r in D.audit(table(spark, data), 10, 10).collect()) == brute(data, 10, 10)


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_pairs_of_a_term_across_batches(monkeypatch, rows):
    monkeypatch.setattr(D, "PAIRED_ROWS", rows)
    table = [(f"l{i % 2}", f"t{i}", f"s{j}", 10 * i + j * j, 3 + j) for i in range(12) for j in range(i)]
    table.sort()
    batches = pa.table(dict(zip(("lang", "term", "source", "p", "absent"), zip(*table)))).to_batches(max_chunksize=5)
    found = Counter()
    for batch in D._both(iter(batches)):
        for r in batch.to_pylist():
            found[r["lang"], r["source"], r["item"]] += r["value"]
    f = lambda a, b: (a - b) ** 2 // (a + b)
    expected = Counter()
    for la, t, s, p, p0 in table:
        for lb, u, o, q, q0 in table:
            if (la, t) == (lb, u) and s < o:
                expected[la, s, o] += f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
    assert found == expected


def test_chunks_are_cut_once(spark):
    data = [("en", f"s{i % 3}", "Same words again, same (SAME) same-again") for i in range(50)]
    counts = D.chunk_counts(table(spark, data))
    words = D.dictionary(counts).collect()
    assert sorted(r.chunk for r in words) == ["again", "same", "same-again", "words"]


def test_long_texts_and_slices(spark, monkeypatch):
    monkeypatch.setattr(D, "SLICE_BYTES", 1000)
    monkeypatch.setattr(D, "PAIRED_ROWS", 3)
    data = [("en", "a", "word " * 30_000 + "x" * 20_000), ("en", "b", "word other " * 10), ("en", "b", None)] * 2
    assert sorted(tuple(r) for r in D.audit(table(spark, data), 2, 10).collect()) == brute(data, 2, 10)


def test_empty_tables_and_other_columns(spark):
    assert D.audit(table(spark, rows()).where(F.lit(False))).collect() == []
    assert D.audit(table(spark, [(None, None, None)])).collect() == []
    more = table(spark, rows()).withColumns({"term": F.lit(1), "chunk": F.lit("x"), "docs": F.lit(0)})
    assert D.audit(more, 3).count() == D.audit(table(spark, rows()), 3).count()

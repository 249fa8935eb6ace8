"""Licence texts and notices in documents, by a positional index of rare words.

A template is a sequence of words and the number of them that must stand at their relative positions. If at most
``m`` words of a template may differ, one of any ``m + 1`` of its words is unchanged in every place of it. So the
index holds, for each template, just its ``m + 1`` rarest words (highest inverse document frequency, counted over
all documents), each with the templates it belongs to and its position there. A file's words are looked up in that
index; the starts that the postings agree on by relative position are compared word by word; and a template gives
its label where all its mandatory key phrases stand in the file too. No place is missed, whatever words are rare.

Everything is worked out inside a row by array functions: nothing but word counts (one row a vocabulary word and
task) is shuffled, so repeated rows, ties and frequent passages cost nothing beyond their own length.

NULL texts count as empty ones: no words, no labels, score 0. Ids may be NULL or repeated, each row stands for
itself. An empty table gives an empty result; other columns are kept by :func:`scan` unless its own have their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words in a text whose A-Z are lower-cased.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a longer template's words that must stand at their places.
AGREEMENT = 0.8


@dataclass(frozen=True)
class Template:
    """``label`` is None for a key phrase; ``base`` phrases count as places of their own."""

    label: str | None
    text: str
    agreement: float = 1.0
    keys: tuple[str, ...] = ()
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def need(self) -> int:
        return -int(-len(self.words) * self.agreement // 1)


# ---- Fixed values: passages of published licences, and short notices that name one ----

BASE = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
)

NOTICES = (
    Template("mit", "mit license"),
    Template("apache-2.0", "apache license version 2 0"),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl-2.0", "mozilla public license version 2 0"),
    Template("bsd", "bsd license"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc0", "cc0 1 0"),
    Template("cc-by", "creative commons attribution"),
)

PASSAGES = (
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        AGREEMENT,
        ("granted free of charge", "without restriction"),
    ),
    Template(
        "boost",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license",
        AGREEMENT,
        ("person or organization", "covered by this license"),
    ),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        AGREEMENT,
        ("apache license",),
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation",
        AGREEMENT,
        ("free software foundation", "general public license"),
    ),
    Template(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        AGREEMENT,
        ("mozilla public license",),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        AGREEMENT,
        ("source and binary forms", "following conditions"),
    ),
    Template(
        "bsd-3-clause",
        "may be used to endorse or promote products derived from this software without specific prior written permission",
        AGREEMENT,
        ("endorse or promote", "prior written permission"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        AGREEMENT,
        ("with or without fee",),
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable "
        "for any damages arising from the use of this software",
        AGREEMENT,
        ("express or implied warranty", "held liable"),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        AGREEMENT,
        ("free and unencumbered",),
    ),
    Template(
        "cc0",
        "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related "
        "or neighboring rights to this work",
        AGREEMENT,
        ("associated cc0", "waived all copyright"),
    ),
)

LICENCES = BASE + NOTICES + PASSAGES


def with_keys(templates: tuple[Template, ...]) -> tuple[Template, ...]:
    """The templates, and each key phrase of theirs as one without a label."""
    phrases = dict.fromkeys(" ".join(k.split()) for t in templates for k in t.keys)
    return templates + tuple(Template(None, p) for p in phrases)


def words_of(text: Column) -> Column:
    """All words in their order; none for NULL."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, NO_WORD), "")


def document_frequencies(documents: DataFrame, templates: tuple[Template, ...] = LICENCES) -> dict[str, int]:
    """In how many of all documents each template word stands; under ``''`` the number of documents."""
    vocabulary = sorted({w for t in with_keys(templates) for w in t.words})
    present = F.array_append(F.array_intersect(F.lit(vocabulary), words_of(F.col("text"))), "")
    counted = documents.select(F.explode(present).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return dict.fromkeys(["", *vocabulary], 0) | {row["word"]: row["n"] for row in counted.collect()}


def rare_words(template: Template, frequencies: dict[str, int]) -> list[int]:
    """Positions of the template's rarest words, one more than may differ; ties go to the first."""
    order = sorted(range(len(template.words)), key=lambda i: (frequencies.get(template.words[i], 0), i))
    return sorted(order[: len(template.words) - template.need + 1])


def postings(templates: tuple[Template, ...], frequencies: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """Indexed word -> (template number, position of the word in it)."""
    index: dict[str, list[tuple[int, int]]] = {}
    for number, template in enumerate(templates):
        for position in rare_words(template, frequencies):
            index.setdefault(template.words[position], []).append((number, position))
    return index


def scan(documents: DataFrame, templates: tuple[Template, ...] = LICENCES, frequencies: dict[str, int] | None = None) -> DataFrame:
    """The documents with ``n_words`` and ``places``: template number, first word and words in agreement of each place.

    ``frequencies`` only choose which words are indexed (the documents' own if not given); places don't depend on them.
    """
    frequencies = document_frequencies(documents, templates) if frequencies is None else frequencies
    every = with_keys(templates)
    index, count = postings(every, frequencies), len(every)
    indexed = sorted(index)
    posted = F.lit([" ".join(f"{t}:{p}" for t, p in index[w]) for w in indexed])
    posted = F.transform(posted, lambda x: F.transform(F.split(x, " "), lambda y: F.transform(F.split(y, ":"), lambda z: z.cast("int"))))
    contents = F.transform(F.lit([t.text for t in every]), lambda x: F.split(x, " +"))
    needs = F.lit([t.need for t in every])

    words, n = F.col("__words"), F.size("__words")
    at = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, i).isin(indexed))).otherwise(F.array().cast("array<int>"))

    def starts(i: Column) -> Column:
        """A start for each posting of the word at ``i``, as one number with its template; -1 if the template can't fit."""
        found = F.get(posted, F.array_position(F.lit(indexed), F.get(words, i)).cast("int") - 1)
        fits = lambda p: (i >= p[1]) & (i - p[1] + F.size(F.get(contents, p[0])) <= n)
        return F.transform(found, lambda p: F.when(fits(p), (i - p[1]).cast("long") * count + p[0]).otherwise(F.lit(-1).cast("long")))

    def place(code: Column) -> Column:
        template, start = F.pmod(code, F.lit(count)).cast("int"), F.floor(code / count).cast("int")
        own = F.slice(words, start + 1, F.size(F.get(contents, template)))
        agree = F.size(F.filter(F.zip_with(own, F.get(contents, template), lambda a, b: a == b), lambda same: same))
        return F.struct(template.alias("template"), start.alias("start"), agree.alias("agree"))

    candidates = F.array_distinct(F.array_remove(F.flatten(F.transform(F.col("__at"), starts)), F.lit(-1).cast("long")))
    compared = F.filter(F.transform(F.col("__candidates"), place), lambda p: p["agree"] >= F.get(needs, p["template"]))
    clean = documents.drop("n_words", "places", "__words", "__at", "__candidates")
    return (
        clean.withColumn("__words", words_of(F.col("text")))
        .withColumn("__at", at)
        .withColumn("__candidates", candidates)
        .withColumns({"n_words": n.cast("long"), "places": compared})
        .drop("__words", "__at", "__candidates")
    )


def labelled(scanned: DataFrame, templates: tuple[Template, ...] = LICENCES) -> DataFrame:
    """Adds ``n_base, first_word, last_word, base_labels, labels, score`` to scanned documents.

    ``score``: the largest share of words at their places over the templates that give a label; 0 without one.
    """
    every = with_keys(templates)
    numbers = {t.text: i for i, t in enumerate(every) if t.label is None}
    base = [i for i, t in enumerate(every) if t.base]
    labels = F.lit([t.label or "" for t in every])
    lengths = F.lit([len(t.words) for t in every])
    found = F.col("__found")
    giving = F.array_compact(
        F.array(*(F.when(_given(found, number, t, numbers), F.lit(number)) for number, t in enumerate(templates)))
    )
    base_places = F.filter("places", lambda p: p["template"].isin(base))
    base_starts = F.transform(F.col("__base"), lambda p: p["start"].cast("long"))
    named = lambda ts: F.array_join(F.array_sort(F.array_distinct(F.transform(ts, lambda t: F.get(labels, t)))), ",")
    shares = F.transform(
        F.filter("places", lambda p: F.array_contains(F.col("__giving"), p["template"])),
        lambda p: p["agree"].cast("double") / F.get(lengths, p["template"]).cast("double"),
    )
    return (
        scanned.withColumns({"__found": F.array_distinct(F.transform("places", lambda p: p["template"])), "__base": base_places})
        .withColumn("__giving", giving)
        .withColumns(
            {
                "n_base": F.size("__base").cast("long"),
                "first_word": F.array_min(base_starts),
                "last_word": F.array_max(base_starts),
                "base_labels": named(F.filter("__giving", lambda t: t.isin(base))),
                "labels": named(F.col("__giving")),
                "score": F.coalesce(F.array_max(shares), F.lit(0.0)),
            }
        )
        .drop("__found", "__base", "__giving")
    )


def _given(found: Column, number: int, template: Template, numbers: dict[str, int]) -> Column:
    """Whether the template stands in the file with all its key phrases."""
    present = F.array_contains(found, number)
    for key in template.keys:
        present = present & F.array_contains(found, numbers[" ".join(key.split())])
    return present


def spans(scanned: DataFrame, templates: tuple[Template, ...] = LICENCES) -> DataFrame:
    """One row for each place of a template with a label: the documents' columns, ``label, start, length, agree``."""
    every = with_keys(templates)
    kept = [c for c in scanned.columns if c not in ("n_words", "places", "label", "start", "length", "agree")]
    places = scanned.select(*kept, F.inline("places")).where(F.col("template") < len(templates))
    label = F.get(F.lit([t.label or "" for t in every]), F.col("template"))
    length = F.get(F.lit([len(t.words) for t in every]), F.col("template"))
    return places.select(*kept, label.alias("label"), "start", length.alias("length"), "agree")


def _oracle(templates: tuple[Template, ...] = LICENCES) -> str:
    """All template words against all words, without an index."""
    every = with_keys(templates)
    numbers = {t.text: i for i, t in enumerate(every) if t.label is None}
    text = lambda s: "'" + s + "'"
    words = ", ".join(f"({i}, {p}, {text(w)})" for i, t in enumerate(every) for p, w in enumerate(t.words))
    rows = ", ".join(f"({i}, {text(t.label or '')}, {len(t.words)}, {t.need}, {str(t.base).lower()})" for i, t in enumerate(every))
    keys = ", ".join(f"({i}, {numbers[' '.join(k.split())]})" for i, t in enumerate(templates) for k in t.keys)
    return f"""
with tw(t, p, word) as (values {words}),
tpl(t, label, len, need, base) as (values {rows}),
keys(t, key) as (values {keys}),
d as (
    select row_number() over () as r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws
    from documents),
w as (select r, len(ws) as n, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as pos from d),
places as (
    select r, t, start, agree, label, len, base
    from (select r, n, t, pos - p as start, count(*) as agree from w join tw using (word) group by all) join tpl using (t)
    where agree >= need and start >= 0 and start + len <= n),
found as (select distinct r, t from places),
missing as (
    select f.r, f.t from found f join keys k on k.t = f.t
    left join found g on g.r = f.r and g.t = k.key where g.t is null),
given as (
    select p.* from places p left join (select distinct r, t from missing) m on m.r = p.r and m.t = p.t
    where m.t is null and p.label <> ''),
agg as (
    select r, count(*) filter (base) as n_base, min(start) filter (base) as first_word, max(start) filter (base) as last_word,
           string_agg(distinct label, ',' order by label) filter (base) as base_labels,
           string_agg(distinct label, ',' order by label) as labels, max(agree::double / len::double) as score
    from given group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
       last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       coalesce(score, 0.0)::double as score
from d left join agg using (r)
"""


ORACLE = _oracle()

"""Source divergence audit: how differently the sources of a language use its terms.

Chunk factorization: a term never crosses ASCII white space, so documents are counted as white-space chunks
first, every globally distinct chunk is cut into terms once, and the terms are joined back to the counts. A chunk is
counted in lower case and without the characters at its ends that no term holds, so ``Word,`` and ``word`` are one.
Terms: runs of ASCII letters and of characters beyond ASCII, only A-Z lower-cased.

Documents without text count as empty ones, without language or source as ``''``; a repeated row counts as
often as it stands there, whatever its id. No row, language or source is too rare or too frequent to take
part. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roomledger.llm.common import sent_if_small, ship
from roomledger.session import materialize, scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A term, in a text whose A-Z are lower-cased, and the ASCII characters that stand in none.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
NOT_IN_TERMS = "".join(chr(c) for c in range(128) if not chr(c).isalpha())

#: Documents of a language that a term must stand in, ranks shown of each group's terms, and the scale of shares.
LEAST_DOCUMENTS = 10
TERMS_SHOWN = 10
SHARE = 1_000_000_000
#: Text counted at once in a task, and the most text (chunks with their terms) sent to every executor.
SLICE_BYTES = 16 << 20
BROADCAST_BYTES = 32 << 20
#: Rows (a source's share of a term) whose pairs are worked out at once in a task.
PAIRED_ROWS = 200_000


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A table of texts, written to the shared folder as Parquet (a checkpoint keeps rows uncompressed)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _plain(documents: DataFrame) -> DataFrame:
    return documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def _group_sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, and the sum of each value over the rows of a key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return (key[first], *(np.add.reduceat(v[order], first) for v in values))


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each occurs; sorts in place, as slices hold millions."""
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.diff(first, append=len(key))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """Documents slice by slice, with the document's place in the slice and the text of every chunk."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64))
        ends = np.flatnonzero(np.diff(sizes // SLICE_BYTES, append=-1)) + 1 if len(sizes) else []
        start = 0
        for end in ends:
            part, start = batch.slice(start, end - start), end
            yield part, *_chunks(part["text"])


def _chunks(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text))
    rows = np.repeat(np.arange(len(lists), dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))
    return rows, pc.ascii_trim(lists.flatten(), NOT_IN_TERMS)


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, and the distinct values by number."""
    encoded = values.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of each (lang, source) with the documents they stand in and their occurrences, slice by slice."""
    for part, rows, chunks in _cut(batches):
        codes, names = _codes(chunks)
        del chunks  # a slice's texts and numbers aren't needed at the same time
        (langs, lang), (sources, source) = _codes(part["lang"]), _codes(part["source"])
        groups, group = np.unique(langs.astype(np.int64) * len(source) + sources, return_inverse=True)
        n, width = part.num_rows, len(names)
        at = group.astype(np.int64)[rows]
        for factor, number in ((width, codes), (n, rows)):
            at *= factor
            at += number
        in_row, times = _runs(at)
        del at, rows, codes
        key, docs, occurrences = _group_sums(in_row // n, np.ones_like(times), times)
        of = groups[key // width]
        out = pa.RecordBatch.from_pydict(
            {
                "lang": lang.take(pa.array(of // len(source))),
                "source": source.take(pa.array(of % len(source))),
                "chunk": names.take(pa.array(key % width)),
                "docs": pa.array(docs),
                "occurrences": pa.array(occurrences),
            }
        )
        yield out.filter(pc.greater(pc.binary_length(out["chunk"]), 0))


def _distinct(part: pa.RecordBatch, rows: np.ndarray, codes: np.ndarray, names: pa.Array) -> pa.RecordBatch:
    in_row, _ = _runs(rows.astype(np.int64) * len(names) + codes)
    row = pa.array(in_row // len(names))
    return pa.RecordBatch.from_pydict({"row": part["row"].take(row), "lang": part["lang"].take(row), "chunk": names.take(pa.array(in_row % len(names)))})


def _holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's distinct chunks."""
    for part, rows, chunks in _cut(batches):
        yield _distinct(part, rows, *_codes(chunks))


def _holding_any(wanted: pa.Array) -> Callable:
    """As :func:`_holding`, for some (distinct) chunks only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, chunks in _cut(batches):
            codes = pc.fill_null(pc.index_in(chunks, value_set=wanted), -1).to_numpy(zero_copy_only=False)
            del chunks
            found = codes >= 0
            if found.any():
                yield _distinct(part, rows[found], codes[found], wanted)

    return run


def chunk_counts(documents: DataFrame) -> DataFrame:
    """``lang, source, chunk, docs, occurrences``: counted in each task first, then added up."""
    ship(documents.sparkSession)
    counted = _plain(documents).mapInArrow(_counted, "lang string, source string, chunk string, docs long, occurrences long")
    return counted.groupBy("lang", "source", "chunk").agg(F.sum("docs").alias("docs"), F.sum("occurrences").alias("occurrences"))


def terms_of(chunk: Column) -> Column:
    """The terms of a chunk (in lower case) in their order, repeats included."""
    return F.regexp_extract_all(chunk, F.lit(f"({TERM})"), F.lit(1))


def dictionary(counts: DataFrame) -> DataFrame:
    """``chunk, terms``: every distinct chunk cut into terms once."""
    return counts.select("chunk").distinct().select("chunk", terms_of(F.col("chunk")).alias("terms"))


def term_counts(counts: DataFrame, words: DataFrame) -> DataFrame:
    """``lang, source, term, occurrences, fewest, most``; the last two bound the documents that hold the term.

    A document with two chunks of a term counts twice in ``most``, and at most once in ``fewest``. ``words`` is the
    counts' :func:`dictionary`; a chunk stands there once, so no key is hot in the hashed side of the join.
    """
    joined = counts.join(words.hint("shuffle_hash"), "chunk").select("lang", "source", "docs", "occurrences", F.explode("terms").alias("term"))
    return joined.groupBy("lang", "source", "term").agg(
        F.sum("occurrences").alias("occurrences"), F.max("docs").alias("fewest"), F.sum("docs").alias("most")
    )


def document_counts(documents: DataFrame, words: DataFrame, wanted: DataFrame) -> DataFrame:
    """``lang, term, docs``: the exact number of documents with each of some terms (``lang, term``).

    Reads the documents again. Only chunks with a wanted term go on: picked in the tasks if these chunks were
    measured to be small enough to be sent there, by a shuffle of each document's distinct chunks if not.
    """
    ship(documents.sparkSession)
    terms = words.select("chunk", F.explode(F.array_distinct("terms")).alias("term"))
    chunks = materialize(terms.join(wanted.select("lang", "term"), "term"))
    size = chunks.agg(F.sum(F.octet_length("chunk") + 16)).first()[0] or 0
    rows = _plain(documents).withColumn("row", F.monotonically_increasing_id())
    pick = _holding_any(chunks.select("chunk").distinct().toArrow()["chunk"].combine_chunks()) if size <= BROADCAST_BYTES else _holding
    found = rows.mapInArrow(pick, "row long, lang string, chunk string").join(chunks, ["lang", "chunk"])
    return found.select("lang", "term", "row").distinct().groupBy("lang", "term").agg(F.count(F.lit(1)).alias("docs"))


def kept_terms(documents: DataFrame, words: DataFrame, terms: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang, term, occurrences`` of the terms in at least ``least`` documents of the language.

    Where the bounds of :func:`term_counts` don't decide, documents are counted exactly.
    """
    bounded = terms.groupBy("lang", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("fewest").alias("fewest"), F.sum("most").alias("most"))
    bounded = materialize(bounded.where(F.col("most") >= least))
    open_terms = bounded.where(F.col("fewest") < least)
    decided = bounded.where(F.col("fewest") >= least).drop("fewest", "most")
    if open_terms.isEmpty():
        return decided
    exact = document_counts(documents, words, open_terms).where(F.col("docs") >= least)
    return decided.unionByName(open_terms.join(exact, ["lang", "term"], "left_semi").drop("fewest", "most"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(SHARE * (count + 2) / (total + 2 * kept))``, exact; NULL where nothing is kept."""
    above = F.lit(SHARE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return F.when(kept > 0, F.call_function("div", above, (total + 2 * kept).cast("decimal(20,0)")) + 1)


def difference(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))``, exact: shares are at most SHARE + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(documents: DataFrame, least: int = LEAST_DOCUMENTS, terms_shown: int = TERMS_SHOWN) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from the others and from its language.

    Part ``pair``: every other source of the language by the summed difference of the shares of all kept terms.
    Part ``term``: the source's most over-used terms against the whole language. Ties go to the smaller item.
    A source without terms has a share for every kept term too; so pairs are worked out from the shares of absent
    terms and corrected where a term occurs: the shares of a term are brought together and paired there, summed in
    the task, and a source's terms are combined by share before they meet the other sources.
    """
    counts = _stored(chunk_counts(documents), "chunk-counts")
    words = _stored(dictionary(counts), "chunks")
    terms = _stored(term_counts(counts, words), "term-counts")
    kept = _stored(kept_terms(documents, words, terms, least), "kept-terms")
    held = _stored(terms.join(kept.select("lang", "term").hint("shuffle_hash"), ["lang", "term"]).select("lang", "source", "term", F.col("occurrences").alias("n")), "held-terms")

    languages = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("occurrences").alias("lang_total"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = (
        _plain(documents).select("lang", "source").distinct().join(languages, "lang", "left").join(totals, ["lang", "source"], "left")
        .select("lang", "source", F.coalesce("kept", zero).alias("kept"), F.coalesce("lang_total", zero).alias("lang_total"), F.coalesce("total", zero).alias("total"))
    )
    groups = materialize(groups.withColumn("absent", share(zero, F.col("total"), F.col("kept"))))
    small = sent_if_small(groups, groups.count())

    used = _stored(held.join(small, ["lang", "source"]).select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), "absent", "lang_total", "kept"), "term-shares")
    parts = _pairs(small, used).unionByName(_over_used(used, kept, terms_shown))
    return parts.select("lang", "source", "part", "item", "value", "rank")


def _ranked(values: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return values.withColumn("rank", F.row_number().over(order))


def _over_used(used: DataFrame, kept: DataFrame, shown: int) -> DataFrame:
    own, whole = F.col("p"), share(F.col("occurrences"), F.col("lang_total"), F.col("kept"))
    compared = used.join(kept, ["lang", "term"]).withColumn("q", whole).where(own > F.col("q"))
    ranked = _ranked(compared.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), difference(own, F.col("q")).alias("value")))
    return ranked.where(F.col("rank") <= shown)


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summed corrections of each two sources over the terms that both hold; rows come sorted by term, then source.

    Rows ``step`` apart that still belong to one term are a pair, so all pairs of a step are worked out at once, and a
    step needs no more memory than the rows. Pairs are added up before they leave the task.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < PAIRED_ROWS:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        term = _runs_of(whole)
        last = int(np.searchsorted(term, term[-1]))  # the last term may go on in the next batch
        yield from _paired(whole.slice(0, last), term[:last])
        held = whole.slice(last).to_batches()
    if held:
        whole = pa.Table.from_batches(held).combine_chunks()
        yield from _paired(whole, _runs_of(whole))


def _runs_of(rows: pa.Table) -> np.ndarray:
    """A number for each row that grows where (lang, term) changes."""
    new = np.zeros(rows.num_rows, bool)
    for name in ("lang", "term"):
        column = rows[name].combine_chunks()
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def _paired(rows: pa.Table, term: np.ndarray) -> Iterator[pa.RecordBatch]:
    lang, source = (rows[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
    langs, sources = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in (lang, source))
    n, p, absent = len(source.dictionary), rows["p"].to_numpy(), rows["absent"].to_numpy()
    f = lambda a, b: (a - b) ** 2 // (a + b)
    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for step in range(1, int(np.bincount(term).max(initial=0))):
        at = np.flatnonzero(term[step:] == term[:-step])
        a, b = at, at + step
        gain = f(p[a], p[b]) - f(p[a], absent[b]) - f(absent[a], p[b]) + f(absent[a], absent[b])
        new, added = _group_sums((langs[a] * n + sources[a]) * n + sources[b], gain)
        keys, sums = _group_sums(np.concatenate([keys, new]), np.concatenate([sums, added]))
    if len(keys):
        left, right = pa.array(keys // n % n), pa.array(keys % n)
        yield pa.RecordBatch.from_pydict(
            {
                "lang": lang.dictionary.take(pa.array(keys // n // n)),
                "source": source.dictionary.take(left),
                "item": source.dictionary.take(right),
                "value": pa.array(sums),
            }
        )


def _pairs(groups: DataFrame, used: DataFrame) -> DataFrame:
    other = groups.select("lang", F.col("source").alias("item"), F.col("absent").alias("other_absent"))
    none = F.coalesce(F.col("kept") * difference(F.col("absent"), F.col("other_absent")), F.lit(0).cast("long"))
    pairs = groups.join(other, "lang").where(F.col("source") != F.col("item"))
    everywhere_absent = pairs.select("lang", "source", "item", none.alias("value"))

    # A term of one source, as if the other didn't have it; counts for both directions of the pair.
    alike = used.groupBy("lang", "source", "p", "absent").agg(F.count(F.lit(1)).alias("terms"))
    gain = F.col("terms") * (difference(F.col("p"), F.col("other_absent")) - difference(F.col("absent"), F.col("other_absent")))
    one_sided = (
        alike.join(other, "lang").where(F.col("source") != F.col("item")).groupBy("lang", "source", "item").agg(F.sum(gain).alias("value"))
    )
    # A term of both: what the two one-sided corrections got wrong.
    placed = used.select("lang", "term", "source", "p", "absent").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    partial = placed.mapInArrow(_both, "lang string, source string, item string, value long")
    both = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    corrections = one_sided.unionByName(both)
    turned = corrections.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    summed = everywhere_absent.unionByName(corrections).unionByName(turned).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return _ranked(summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))


#: The same rows for DuckDB, term by term and pair by pair.
ORACLE = f"""
with d as (
    select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
           translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t
    from documents),
w as (select r, lang, source, unnest(regexp_extract_all(t, '{TERM}')) as term from d),
kept as (select lang, term, count(*) as n from w group by lang, term having count(distinct r) >= {LEAST_DOCUMENTS}),
v as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from kept group by lang),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from w group by lang, source, term),
dense as (
    select g.lang, g.source, k.term, k.n as lang_n, coalesce(c.n, 0) as n, v.v, v.total as lang_total,
           sum(coalesce(c.n, 0)) over (partition by g.lang, g.source) as total
    from g join kept k on k.lang = g.lang join v on v.lang = g.lang
    left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
p as (
    select lang, source, term, n, 1 + ({SHARE}::hugeint * (n + 2)) // (total + 2 * v) as p,
           1 + ({SHARE}::hugeint * (lang_n + 2)) // (lang_total + 2 * v) as q
    from dense),
pairs as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
    from g a join g b on a.lang = b.lang and a.source <> b.source
    left join (
        select x.lang, x.source, y.source as item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) as value
        from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) s
    on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (
    select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // (p + q) as value
    from p where n > 0 and p > q),
ranked as (
    select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
    from (select * from pairs union all select * from terms))
select lang, source, part, item, value::bigint as value, rank::int as rank
from ranked where part = 'pair' or rank <= {TERMS_SHOWN}
"""

"""Short benchmark items inside long documents: size-partitioned MinHash containment search.

An item matches a document that contains at least ``threshold`` of the item's distinct shingles. An item of fewer
words than a shingle is one shingle of its own length. Items are
partitioned by size (number of shingles, in powers of two). A partition of items of up to ``u`` shingles keeps
the ``floor((1 - threshold) * u) + 1`` smallest hash values of each item as its MinHash signature. A document
that lacks more than that share of shingles doesn't match, so every match holds at least one value of the
signature: the search misses nothing, however long the document is. (Comparing signatures of whole documents
would: a 40-shingle item in 20,000 shingles has a Jaccard similarity of 0.002.) Candidates are then verified by exact
containment of shingle texts, each against its own item only.

All on the JVM: the shingles of a document are hashed and probed one by one as they are generated, inside
one stage, and only hits are kept. Shorter shingles are generated only for lengths that some item has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomledger.llm.common import plain_words, sent_if_small, text_digest
from roomledger.session import materialize

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: In front of the digest that stands for a document without id.
NAMELESS = "#"


def _needed(size: Column, threshold: float) -> Column:
    return F.ceil(size * F.lit(float(threshold)) - F.lit(1e-9)).cast("int")


def _positions(rows: DataFrame, lengths: Sequence[int], *kept: str) -> DataFrame:
    """A row for each shingle of each length (in words): ``at`` is its first word, ``m`` its length."""
    worded = rows.withColumn("words", plain_words(F.col("text"))).where(F.size("words") >= min(lengths))
    last = F.size("words") - min(lengths)
    each = worded.select(*kept, "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    if len(lengths) == 1:
        return each.withColumn("m", F.lit(lengths[0]))
    return each.withColumn("m", F.explode(F.lit(list(lengths)))).where(F.col("at") + F.col("m") <= F.size("words"))


def _of_length(lengths: Sequence[int], made: Callable[..., Column]) -> Column:
    """``made`` from the words of a shingle, whichever length it has."""
    shingle = [made(*(F.get("words", F.col("at") + k) for k in range(m))) for m in lengths]
    told = shingle[0]
    for m, one in zip(lengths[1:], shingle[1:]):
        told = F.when(F.col("m") == m, one).otherwise(told)
    return told


def _hash(lengths: Sequence[int]) -> Column:
    return _of_length(lengths, F.xxhash64)


def _shingle(lengths: Sequence[int]) -> Column:
    return _of_length(lengths, lambda *words: F.concat_ws(" ", *words))


def item_shingles(items: DataFrame, n: int = SHINGLE_WORDS) -> DataFrame:
    """``item_id``, ``shingle``, ``h``, ``m``, ``item_shingles`` for each distinct shingle of ``m`` words of an item."""
    named = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    lengths = range(1, n + 1)
    own = _positions(named, lengths, "item_id").where(F.col("m") == F.least(F.lit(n), F.size("words")))
    each = own.select("item_id", _shingle(lengths).alias("shingle"), _hash(lengths).alias("h"), "m").distinct()
    counts = each.groupBy("item_id").agg(F.count("*").cast("int").alias("item_shingles"))
    return each.join(counts, "item_id")


def signatures(shingles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``h``, ``item_id``: the MinHash values of each item, as many as its size partition needs.

    Items are short by nature, so the values of one item are sorted as one array.
    """
    upper = F.pow(F.lit(2), F.ceil(F.log2("item_shingles")))
    kept = (F.floor((1 - threshold) * upper + 1e-9) + 1).cast("int")
    packed = shingles.groupBy("item_id", "item_shingles").agg(F.array_sort(F.collect_set("h")).alias("hashes"))
    return packed.select(F.explode(F.slice("hashes", F.lit(1), kept)).alias("h"), "item_id")


def contained_items(documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id``, ``item_id``, ``shared``, ``item_shingles``, ``containment`` of every match.

    Rows with the same ``doc_id`` (repeats, or a document in several rows) count as one document, and so do rows
    with the same ``item_id``. Rows without ``doc_id`` are documents by their text, and come back with a NULL id.
    NULL and empty texts, and items without an id, have no shingles and no match. Case and punctuation don't count.
    Other columns of the inputs are not read.
    """
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(NAMELESS), F.md5("text")))
    matches = _matches(texts.select(named.alias("document"), "text"), "document", items, threshold, n)
    doc_id = F.when(~F.col("document").startswith(NAMELESS), F.col("document").cast("long"))
    return matches.select(doc_id.alias("doc_id"), "item_id", "shared", "item_shingles", "containment")


def contaminated_texts(documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE_WORDS) -> DataFrame:
    """``digest`` (see ``text_digest``) of each text that contains an item, whatever its ``doc_id``: each row by itself."""
    texts = documents.select(text_digest().alias("digest"), F.col("text").cast("string")).where("text is not null")
    return _matches(texts, "digest", items, threshold, n).select("digest").distinct()


def _matches(texts: DataFrame, key: str, items: DataFrame, threshold: float, n: int) -> DataFrame:
    """Matches of ``texts``: ``key``, ``text``, without NULL. Rows with the same key count as one document."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    shingles = materialize(item_shingles(items, n))
    sought = materialize(signatures(shingles, threshold))
    lengths = [r.m for r in shingles.select("m").distinct().orderBy("m").collect()] or [n]
    n_shingles, n_sought = shingles.count(), sought.count()

    probes = _positions(texts, lengths, key).select(key, _hash(lengths).alias("h"))
    candidates = materialize(probes.join(sent_if_small(sought, n_sought), "h").select(key, "item_id").distinct())

    suspects = candidates.select(key).distinct()
    read_again = texts.join(sent_if_small(suspects, candidates.count()), key, "left_semi")
    found = _positions(read_again, lengths, key).select(key, _shingle(lengths).alias("shingle"))
    held = found.join(sent_if_small(shingles.select("shingle").distinct(), n_shingles), "shingle", "left_semi").distinct()
    wanted = candidates.join(shingles.select("item_id", "shingle", "item_shingles"), "item_id")
    counted = held.join(wanted, [key, "shingle"]).groupBy(key, "item_id", "item_shingles").agg(F.count("*").cast("int").alias("shared"))
    matches = counted.where(F.col("shared") >= _needed(F.col("item_shingles"), threshold))
    return matches.select(key, "item_id", "shared", "item_shingles", (F.col("shared") / F.col("item_shingles")).alias("containment"))


def _sql(threshold: float = THRESHOLD, n: int = SHINGLE_WORDS) -> str:
    """The same result in DuckDB SQL, by comparing all shingles."""
    words = r"[w for w in regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+') if w <> '']"
    shingles = "unnest([array_to_string(words[i:i + m - 1], ' ') for i in range(1, len(words) - m + 2)]) shingle"
    return f"""
with item_words as (
    select item_id, words, least(len(words), {n}) m
    from (select item_id, {words} words from benchmark where item_id is not null and text is not null) where len(words) > 0),
item as (select distinct item_id, {shingles} from item_words),
doc_words as (
    select coalesce(doc_id::varchar, '{NAMELESS}' || md5(text)) document, doc_id, {words} words from documents where text is not null),
doc as (
    select distinct document, doc_id, {shingles}
    from doc_words join (select distinct m from item_words) on len(words) >= m),
sized as (select item_id, count(*) item_shingles from item group by 1),
counted as (select document, doc_id, item_id, count(*) shared from doc join item using (shingle) group by 1, 2, 3)
select doc_id, item_id, shared::int shared, item_shingles::int item_shingles, shared / item_shingles containment
from counted join sized using (item_id) where shared >= ceil({threshold} * item_shingles - 1e-9)"""


ORACLE = _sql()

"""Secrets in texts: candidates by shape, false positives removed by a random forest.

1. Candidates. Texts are cut at white space, words that may hold a key are cut into fields at quotes, brackets,
   commas, semicolons, ``&``, ``?`` and assignment signs, and every field is looked at. A field is a candidate if it
   holds a long run of key characters with a digit, if it stands after an assignment sign and has a digit, or if a
   credential's name is assigned to it. Words are examined one by one as they are generated, with their neighbours,
   and only candidates are kept.
2. Features: length, shares of character classes, changes between classes, variety, dictionary coverage, path
   and address signs, credential and checksum words before it. The dictionary is the corpus: a run of letters is
   a word if it stands alone in ``DICTIONARY_COUNT`` places and once in ``DICTIONARY_CHARACTERS`` characters, so that
   what random keys share by chance is no word in any size of corpus.
3. A random forest (Spark ML) is trained on labelled findings and gives each candidate a probability.

Labelled findings are a table of candidates with ``label``. Where there is none, ``distant_labels`` labels the
clear cases of a corpus by rule and leaves the others to the forest. Training uses at most ``MOST_LABELLED``
findings, one from each of so many hash ranges of the values; everything else covers all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomledger.llm.common import BROADCAST_ROWS, sent_if_small, text_digest
from roomledger.session import materialize

MOST_LABELLED = 20_000
DICTIONARY_COUNT = 5
DICTIONARY_CHARACTERS = 5_000_000
LEAST_PROBABILITY = 0.5
PLACEHOLDER = "[SECRET]"

# Names of credentials, of checksums, and prefixes that providers give their keys.
CREDENTIAL = "(?i)(passw|passwd|pwd|secret|token|api.?key|access.?key|auth|bearer|credential|private.?key)"
CHECKSUM = "(?i)(sha-?1|sha-?256|md5|commit|checksum|digest|revision|uuid|etag|hash)"
PROVIDER = "^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[0-9A-Za-z]{36}|^xox[abprs]-[0-9A-Za-z-]{10}|^(sk|pk|rk)_(live|test)_[0-9A-Za-z]{16}|^AIza[0-9A-Za-z_-]{35}$|^eyJ[0-9A-Za-z_-]{10,}[.]eyJ|^glpat-[0-9A-Za-z_-]{20}"

FEATURES = (
    "length", "digits", "upper", "hex", "changes", "variety", "coverage", "path", "address", "credential", "checksum", "assigned", "quoted", "provider"
)


#: A field: printable ASCII without separators, at a word's end with the padding of base64. Between fields, assignment signs matter.
FIELD = r"""[!#-%*+\-./-9@A-Z\\^_a-z~]"""
FIELDS = rf"""([=:]+>?|{FIELD}+(?:={{1,2}}(?=["'`,;)}}\]]*$))?)"""
ASSIGNMENT = r"[=:]>?$"


def candidates(documents: DataFrame) -> DataFrame:
    """``doc_id, digest, at, field, value, name, before, word, after, assigned``.

    ``at`` is the number of the word, ``field`` that of the field in it, ``before`` the two words in front, ``name``
    what the value is assigned to in its word (else empty), ``digest`` that of the whole text: it is the key of what
    was found, as ids may be NULL or repeated. Rows with NULL in ``text`` have no candidate.
    """
    words = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+")
    worded = documents.select(F.col("doc_id").cast("long"), text_digest().alias("digest"), words.alias("words"))
    each = worded.select("doc_id", "digest", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("at"))
    word, last = F.get("words", F.col("at")), F.coalesce(F.get("words", F.col("at") - 1), F.lit(""))
    before = F.concat_ws(" ", F.get("words", F.col("at") - 2), last)
    long_run = (F.length(word) >= 16) & word.rlike(r"[0-9]") & word.rlike(r"[A-Za-z0-9+/_\-]{16}")
    follows = (F.length(word) >= 8) & last.rlike(ASSIGNMENT) & (word.rlike(r"[0-9]") | before.rlike(CREDENTIAL))
    # no pattern here looks again and again at the rest of a very long word
    assigns = (F.length(word) >= 12) & word.rlike(CREDENTIAL + r"""[a-z_\-]{0,40}["']{0,2}[=:]{1,3}>?["']{0,2}\S{8}""")
    found = each.where(long_run | follows | assigns).select(
        "doc_id", "digest", "at", last.rlike(ASSIGNMENT).alias("told"), word.alias("word"), before.alias("before"), F.coalesce(F.get("words", F.col("at") + 1), F.lit("")).alias("after")
    )
    cut = found.withColumn("fields", F.regexp_extract_all("word", F.lit(FIELDS), 1))
    signs = F.get("fields", F.col("field") - 1).rlike(r"^[=:]")
    each = cut.select("*", F.posexplode("fields").alias("field", "raw")).withColumn("name", F.when(signs, F.coalesce(F.get("fields", F.col("field") - 2), F.lit(""))).otherwise(""))
    first = (F.col("field") == 0) & F.col("told")
    value, digit = F.col("value"), F.col("value").rlike("[0-9]")
    each = each.withColumn("value", F.rtrim("raw", F.lit(".%-"))).withColumn("assigned", first | F.coalesce(signs, F.lit(False)))
    key = (F.length(value) >= 16) & digit & value.rlike(r"[A-Za-z0-9+/_\-]{16}")
    given = F.col("assigned") & (first & digit | _credential())
    chosen = each.where((F.length(value) >= 8) & ~value.rlike("^[=:]") & (key | given))
    return chosen.select("doc_id", "digest", "at", "field", "value", "name", "before", "word", "after", "assigned")


def _credential() -> Column:
    """Whether the name a value is assigned to, or without one the words in front, speak of a credential."""
    return F.when(F.col("name") != "", F.col("name").rlike(CREDENTIAL)).otherwise((F.col("field") == 0) & F.col("before").rlike(CREDENTIAL))


def dictionary(documents: DataFrame, found: DataFrame) -> DataFrame:
    """``run``: the letter runs of candidates that are words of the corpus."""
    runs = materialize(found.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("value"), F.lit(r"(\p{L}{3,})"), 1))).alias("run")).distinct())
    words = documents.select(F.explode(F.split(F.lower("text"), r"\P{L}+")).alias("run"))
    characters = documents.agg(F.sum(F.length("text"))).first()[0] or 0
    # where the runs are too many to be sent, words are counted in each task before they are shuffled
    small = runs.count() <= BROADCAST_ROWS
    counted = (words.join(F.broadcast(runs), "run") if small else words).groupBy("run").agg(F.count("*").alias("n"))
    often = counted.where(F.col("n") >= max(DICTIONARY_COUNT, characters / DICTIONARY_CHARACTERS)).select("run")
    return often if small else often.join(runs, "run", "left_semi")


def _count(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern))


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with the columns of ``FEATURES``; ``words`` from ``dictionary``."""
    values = found.select("value").distinct()
    runs = values.select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit(r"(\p{L}{3,})"), 1)).alias("run"))
    covered = runs.join(words, "run").groupBy("value").agg(F.sum(F.length("run")).alias("covered"))
    n = F.length("value").cast("double")
    told = found.join(covered, "value", "left")
    return told.select(
        *(c for c in found.columns if c != "assigned"),
        n.alias("length"),
        (_count("[0-9]") / n).alias("digits"),
        (_count("[A-Z]") / n).alias("upper"),
        F.col("value").rlike("^[0-9a-fA-F]+$").cast("double").alias("hex"),
        (_count("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|[A-Z](?=[a-z])") / n).alias("changes"),
        (F.size(F.array_distinct(F.split("value", ""))) / F.least(n, F.lit(36.0))).alias("variety"),
        (F.coalesce("covered", F.lit(0)) / n).alias("coverage"),
        (_count(r"[/.\\]") / n).alias("path"),
        F.col("value").rlike(r"@|^//|^www[.]").cast("double").alias("address"),
        _credential().cast("double").alias("credential"),
        F.when(F.col("name") != "", F.col("name").rlike(CHECKSUM)).otherwise(F.col("before").rlike(CHECKSUM)).cast("double").alias("checksum"),
        F.col("assigned").cast("double").alias("assigned"),
        F.col("word").rlike("[\"'`]").cast("double").alias("quoted"),
        F.col("value").rlike(PROVIDER).cast("double").alias("provider"),
    )


def distant_labels(featured: DataFrame) -> DataFrame:
    """The clear cases with ``label``: 1 a provider's key, or a random-looking value of a credential; 0 addresses,
    plain numbers, words, checksums and values without any sign of a credential."""
    random = (F.col("changes") >= 0.15) & (F.col("variety") >= 0.3) & (F.col("coverage") < 0.3)
    label = (
        F.when((F.col("provider") == 1) | (F.col("credential") == 1) & (F.col("assigned") == 1) & (F.col("length") >= 16) & random, 1.0)
        .when((F.col("address") == 1) | (F.col("digits") >= 0.9) | (F.col("coverage") >= 0.6) | (F.col("checksum") == 1), 0.0)
        .when((F.col("credential") == 0) & (F.col("assigned") == 0), 0.0)
    )
    return featured.withColumn("label", label).where("label is not null")


@dataclass(frozen=True)
class Forest:
    """A fitted forest, or the one label that all labelled findings had (``constant``)."""

    model: RandomForestClassificationModel | None
    constant: float = 0.0


def train(labelled: DataFrame, trees: int = 20, depth: int = 6) -> Forest:
    """``labelled``: columns of ``FEATURES``, ``value``, ``label``. Without both labels there is nothing to tell apart:
    every candidate then gets the only label there is, and none is a secret if there is no labelled finding."""
    place = F.pmod(F.xxhash64("value"), F.lit(MOST_LABELLED // 2))
    row = F.struct(F.xxhash64("value").alias("h"), *FEATURES)
    chosen = labelled.groupBy("label", place.alias("place")).agg(F.min(row).alias("row")).select("label", "place", "row.*")
    chosen = materialize(chosen.coalesce(1).sortWithinPartitions("label", "place"))
    labels = [r.label for r in chosen.select("label").distinct().collect()]
    if len(labels) < 2:
        return Forest(None, labels[0] if labels else 0.0)
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=7)
    return Forest(forest.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(chosen)))


def judged(featured: DataFrame, forest: Forest) -> DataFrame:
    """Candidates with ``probability`` and ``is_secret``."""
    if forest.model is None:
        scored = featured.withColumn("probability", F.lit(forest.constant))
    else:
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(featured)
        scored = forest.model.transform(vectors).withColumn("probability", vector_to_array("probability")[1])
    return scored.withColumn("is_secret", F.col("probability") >= LEAST_PROBABILITY)


def _judged_candidates(documents: DataFrame, labelled: DataFrame | None) -> DataFrame:
    found = materialize(candidates(documents))
    featured = materialize(with_features(found, dictionary(documents, found)))
    return judged(featured, train(distant_labels(featured) if labelled is None else labelled))


def findings(documents: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``doc_id, at, field, value, before, after, probability, is_secret`` of every candidate.

    Empty tables, and texts that are NULL, empty or without candidates, give no row. Only ``doc_id`` and ``text``
    are read. Repeated rows have their findings as often. ``labelled``: see ``train``; by default the clear cases
    among the candidates.
    """
    return _judged_candidates(documents, labelled).select("doc_id", "at", "field", "value", "before", "after", "probability", "is_secret")


def redacted(documents: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """All documents, with ``PLACEHOLDER`` in place of their secrets and ``n_chars`` (if there) counted anew.

    A secret goes from the word where it was found, in the rows with that very text, whatever their ids; the same
    characters elsewhere stay unless they were found there too. NULL stays NULL.
    """
    secrets = _judged_candidates(documents, labelled).where("is_secret").select("digest", "at", "value").distinct()
    # the secrets of one text are bounded by it; longer values first, as one may hold another
    one = F.struct("at", F.length("value").alias("size"), "value")
    lists = secrets.groupBy("digest").agg(F.sort_array(F.collect_set(one), asc=False).alias("__secrets"))
    lists = materialize(lists.withColumnRenamed("digest", "__digest"))
    entries = lists.agg(F.sum(F.size("__secrets") + 1)).first()[0] or 0
    joined = documents.withColumn("__of", text_digest()).join(sent_if_small(lists, entries), F.col("__of") == F.col("__digest"), "left")
    # white space and words in turns; a text that begins with white space has an empty word in front of it
    parts = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]+|[^\x20\x09-\x0D]+)"), 1)
    indented = F.col("text").rlike(r"^[\x20\x09-\x0D]").cast("int")

    def without(part: Column, i: Column) -> Column:
        here = F.filter("__secrets", lambda s: (s["at"] * 2 - indented) == i)
        return F.aggregate(here, part, lambda text, s: F.replace(text, s["value"], F.lit(PLACEHOLDER)))

    clean = F.array_join(F.transform(parts, without), "")
    changed = joined.withColumn("text", F.when(F.col("__secrets").isNotNull(), clean).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        kind = dict(documents.dtypes)["n_chars"]
        changed = changed.withColumn("n_chars", F.when(F.col("__secrets").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return changed.select(*(f"`{c}`" for c in documents.columns))

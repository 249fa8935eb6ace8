"""Exact nearest documents for every question, and what is drawn from them per question."""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roomledger import schema
from roomledger.functions import vectors as V
from roomledger.session import materialize
from roomledger.sources import stores

# A side up to this size (vectors as doubles, plus keys) is sent to every executor.
BROADCAST_BYTES = 64 << 20
# Pairs of a question and a document that one task compares, where more tasks repeat rows (a few seconds) and where they
# don't, and the most pages that pages smaller than BROADCAST_BYTES may give: questions are repeated for each.
PAIRS_AT_ONCE = 1_000_000_000
PAIRS_SENT = 200_000_000
MOST_PAGES = 16
# By cells: number of reference vectors, and the sizes of the blocks that meet in one task. Blocks grow once there are
# MOST_BLOCKS of a cell, up to the largest size; more blocks repeat more rows.
PIVOTS = 64
BLOCK_DOCUMENTS = 8_192
BLOCK_QUESTIONS = 8_192
MOST_BLOCKS = 4
LARGEST_BLOCK = 32_768
# Rows of one key that meet in a task, and the most keys with more that are sent to every executor.
HOT_ROWS = 10_000
MOST_BROADCAST_KEYS = 100_000
# Decimals of the distances shown. Ranks come from distances that are not rounded.
SHOWN_DECIMALS = 6


def nearest_documents(
    questions: DataFrame, documents: DataFrame, k: int = schema.NEIGHBOURS, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The k nearest documents per question by squared L2 distance, exactly.

    ``questions`` has ``question_id, embedding``; ``documents`` has ``doc_id, embedding``, with
    unique keys. Result: ``question_id, rank, doc_id, distance``. Equal distances are ordered by
    ``doc_id``; the distance shown is rounded to six decimals after ranking. Rows without a vector
    take no part; they are dropped inside the search, as a filter here would compute the vectors
    of a lazily embedded table twice. ``documents`` is read more than once, so pass a stored table.

    Of many documents with the same vector only the k smallest keys can be found, so the others are left out first
    if an estimate says that this at least halves the table. If what is left fits ``broadcast_bytes``, every task compares
    its questions with all of it; questions are dealt out to more tasks if theirs would be long. Otherwise questions
    stream past pages of documents, see :func:`nearest_by_stream`. :func:`nearest_by_cells` suits vectors with few dimensions.
    """
    questions, documents = questions.select("question_id", "embedding"), documents.select("doc_id", "embedding")
    present = documents.where(F.col("embedding").isNotNull())
    seen = present.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(F.xxhash64("embedding")).alias("vectors")).first()
    if 2 * k * seen["vectors"] <= seen["rows"]:
        documents = materialize(_findable(present, k))
    if _bytes(documents, "doc_id") <= broadcast_bytes:
        tasks = -(-questions.count() * documents.count() // PAIRS_SENT)
        return _shown(_by_broadcast(questions.repartition(tasks) if tasks > 1 else questions, documents, k))
    return nearest_by_stream(questions, documents, k, broadcast_bytes)


def _findable(documents: DataFrame, k: int) -> DataFrame:
    """Of the documents with one vector those with the k smallest keys, and k without a key.

    Spark keeps k of each vector in each task before it shuffles.
    """
    same = Window.partitionBy(F.xxhash64("embedding"), "embedding", F.col("doc_id").isNull()).orderBy("doc_id")
    return documents.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k).drop("nth")


def _bytes(vectors: DataFrame, key: str) -> int:
    size = F.sum(8 * F.size("embedding") + 32 + F.octet_length(F.col(key).cast("string")))
    return vectors.agg(F.coalesce(size, F.lit(0)).alias("bytes")).first()["bytes"]


def _shown(found: DataFrame) -> DataFrame:
    return found.withColumn("distance", F.round("distance", SHOWN_DECIMALS))


def _best(candidates: DataFrame, k: int) -> DataFrame:
    """The k nearest of each question; Spark keeps k in each task before it shuffles."""
    order = Window.partitionBy("question_id").orderBy("distance", "doc_id")
    ranked = candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return _shown(ranked.select("question_id", "rank", "doc_id", "distance"))


def nearest_by_stream(
    questions: DataFrame, documents: DataFrame, k: int = schema.NEIGHBOURS, page_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The same result for any number of questions and documents, which meet as pages of rows in tasks.

    Documents are cut by the hash of their key into pages, questions into strips. A task holds one page and one
    strip of questions streams past it, so questions are repeated once a page and documents once a strip. Pages have
    about ``page_bytes``, but more once there are ``MOST_PAGES``, up to ``BROADCAST_BYTES``; there are as many pages and strips as
    keep a task at ``PAIRS_AT_ONCE``. First every question meets one page; its k-th distance there bounds its neighbours
    and travels with the question, see :func:`~roomledger.functions.vectors.nearest_within`. Beyond the bound nothing is returned.

    Nothing but sums of sizes reaches the driver, and the plan is the same for any number of pages.
    """
    asked = materialize(questions.select("question_id", "embedding").where(F.col("embedding").isNotNull()))
    stored = documents.select("doc_id", "embedding")
    pages, strips = _grid(_bytes(stored, "doc_id"), stored.count() * asked.count(), page_bytes)
    paged = stored.withColumn("page", F.pmod(F.xxhash64("doc_id"), F.lit(pages)).cast("int"))
    unbounded = asked.withColumn("bound", F.lit(float("inf"))).withColumn("strip", F.pmod(F.xxhash64("question_id"), F.lit(strips)).cast("int"))

    def placed(rows: DataFrame, first: int) -> DataFrame:
        return rows.withColumn("page", ((F.col("page") - first) * strips + F.col("strip")).cast("int")).drop("strip")

    copies = paged.withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    first_page = placed(copies.where("page = 0"), 0)
    near = materialize(_met(first_page, placed(unbounded.withColumn("page", F.lit(0)), 0), strips, k))
    if pages == 1:
        return _best(near, k)
    bounds = near.where(F.col("rank") == k).select("question_id", F.col("distance").alias("found_bound"))
    bounded = unbounded.join(bounds, "question_id", "left").withColumn("bound", F.coalesce("found_bound", "bound"))
    visits = bounded.drop("found_bound").withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(pages - 1))))
    others = _met(placed(copies.where("page > 0"), 1), placed(visits, 1), (pages - 1) * strips, k)
    return _best(near.unionByName(others), k)


def _grid(document_bytes: int, pairs: int, page_bytes: int) -> tuple[int, int]:
    """Number of pages of documents and of strips of questions."""
    asked_for = -(-document_bytes // max(1, page_bytes))
    needed = -(-document_bytes // max(1, page_bytes, BROADCAST_BYTES))
    tasks = -(-pairs // PAIRS_AT_ONCE)
    pages = max(1, needed, min(asked_for, MOST_PAGES), math.ceil(math.sqrt(tasks)))
    return pages, max(1, -(-tasks // pages))


def _met(held: DataFrame, streamed: DataFrame, pages: int, k: int) -> DataFrame:
    """The k nearest documents within ``bound`` of each question, for each page that the question visits.

    ``held``: ``doc_id, embedding, page``; ``streamed``: ``question_id, embedding, bound, page``. A partition is a
    page (of a strip): its documents come first and become one matrix, its questions follow in batches.
    """
    result = _result_schema(streamed, held)
    none = {side: F.lit(None).cast(df.schema[key].dataType) for side, df, key in (("q", streamed, "question_id"), ("d", held, "doc_id"))}
    no_bound = F.lit(None).cast("double").alias("bound")
    documents = held.select("page", F.lit(0).alias("side"), none["q"].alias("question_id"), "doc_id", "embedding", no_bound)
    questions = streamed.select("page", F.lit(1).alias("side"), "question_id", none["d"].alias("doc_id"), "embedding", "bound")
    # Arrays of floats and of doubles meet as doubles, which keep every value.
    placed = documents.unionByName(questions).repartitionById(pages, F.col("page")).sortWithinPartitions("page", "side", "doc_id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, parts, ids, vectors = None, [], None, None
        for batch in map(V.present, batches):
            keys = batch["page"].to_numpy() * 2 + batch["side"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                own, side = divmod(int(keys[start]), 2)
                if own != page:
                    page, parts, ids, vectors = own, [], None, None
                if side == 0:
                    parts.append(part.select(["doc_id", "embedding"]))
                    continue
                if vectors is None and parts:
                    table = pa.Table.from_batches(parts).combine_chunks()
                    ids, vectors, parts = table["doc_id"].combine_chunks(), V.matrix(table["embedding"]), []
                if vectors is not None:
                    found = V.nearest_within(V.matrix(part["embedding"]), vectors, k, part["bound"].to_numpy())
                    yield pa.RecordBatch.from_pydict(V.ranked(part["question_id"], ids, found))

    return placed.mapInArrow(search, result)


def _result_schema(questions: DataFrame, documents: DataFrame) -> str:
    question_type = questions.schema["question_id"].dataType.simpleString()
    doc_type = documents.schema["doc_id"].dataType.simpleString()
    return f"question_id {question_type}, rank int, doc_id {doc_type}, distance double"


def _by_broadcast(questions: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    # The size of this table was checked by the caller.
    table = V.present(documents.toArrow()).combine_chunks().sort_by("doc_id")
    shared = questions.sparkSession.sparkContext.broadcast(
        (table["doc_id"].combine_chunks(), V.matrix(table["embedding"]))
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, vectors = shared.value
        for batch in map(V.present, batches):
            if batch.num_rows and len(doc_ids):
                found = V.nearest(V.matrix(batch["embedding"]), vectors, k)
                yield pa.RecordBatch.from_pydict(V.ranked(batch["question_id"], doc_ids, found))

    return questions.mapInArrow(search, _result_schema(questions, documents))


def nearest_by_cells(
    questions: DataFrame,
    documents: DataFrame,
    k: int = schema.NEIGHBOURS,
    pivots: int = PIVOTS,
    block_documents: int = BLOCK_DOCUMENTS,
    block_questions: int = BLOCK_QUESTIONS,
) -> DataFrame:
    """The same result by a partition of space into cells around pivots, for vectors with few dimensions.

    With many dimensions nearly every cell has to be visited, and :func:`nearest_by_stream` moves less.

    After the pivot-based kNN join of Lu, Shen, Chen and Ooi (PVLDB 5(10), 2012). Every document
    goes to the cell of its nearest pivot, and a question visits only the cells that can hold one
    of its nearest documents, see :func:`~roomledger.functions.vectors.visited_cells`. A cell with many documents is cut into blocks,
    the questions that visit a cell into chunks, and one task handles one block and one chunk, so
    neither a crowded cell nor a popular one gathers in one task. Blocks grow with their cell before they get many, as
    questions are repeated for each block and documents for each chunk. Each pair of block and chunk
    gives only its k nearest per question; these meet once more per question.

    The driver sees the pivots and two counts per cell: ``pivots`` rows whatever the table sizes.
    """
    questions = materialize(questions.select("question_id", "embedding"))
    documents = documents.select("doc_id", "embedding")
    ids = F.xxhash64(F.col("doc_id"))
    # A fixed number of reference vectors, spread by the hash of the key; a sample for pruning only.
    with_vector = documents.where(F.col("embedding").isNotNull())
    chosen = with_vector.orderBy(ids, "doc_id").limit(max(pivots, k)).toArrow()
    if not chosen.num_rows:
        return _shown(_by_broadcast(questions, with_vector, k))
    centres = V.matrix(chosen["embedding"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(V.present, batches):
            if not batch.num_rows:
                continue
            vectors = V.matrix(batch["embedding"])
            cell = V.rough_distances(vectors, centres)[0].argmin(axis=1)
            radius = np.sqrt(V.exact_distances(vectors, centres, np.arange(len(cell)), cell))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(radius)],
                names=["doc_id", "embedding", "cell", "radius"],
            )

    doc_type = documents.schema["doc_id"].dataType.simpleString()
    question_type = questions.schema["question_id"].dataType.simpleString()
    vector_type = questions.schema["embedding"].dataType.simpleString()
    placed = materialize(
        documents.mapInArrow(
            assign,
            f"doc_id {doc_type}, embedding {documents.schema['embedding'].dataType.simpleString()}, "
            "cell int, radius double",
        )
    )
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("radius")).toArrow()
    counts, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    radii[cells["cell"].to_numpy()] = cells["radius"].to_numpy()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(V.present, batches):
            if not batch.num_rows:
                continue
            visited = V.visited_cells(V.matrix(batch["embedding"]), centres, radii, counts, k)
            rows, cell = np.nonzero(visited)
            yield pa.RecordBatch.from_arrays(
                [*batch.take(pa.array(rows)).columns, pa.array(cell.astype(np.int32))],
                names=["question_id", "embedding", "cell"],
            )

    routed = questions.mapInArrow(route, f"question_id {question_type}, embedding {vector_type}, cell int")
    visits = np.zeros(len(centres), np.int64)
    for row in routed.groupBy("cell").count().collect():
        visits[row["cell"]] = row["count"]

    def per_cell(values: np.ndarray) -> Column:
        return F.element_at(F.lit(values.tolist()), F.col("cell") + 1).cast("int")

    blocks, chunks = _pieces(counts, block_documents), _pieces(visits, block_questions)
    block_count, chunk_count = per_cell(blocks), per_cell(chunks)
    left = (
        routed.withColumn("chunk", F.pmod(F.xxhash64(F.col("question_id")), chunk_count).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), block_count - 1)))
    )
    right = (
        placed.drop("radius")
        .where(chunk_count > 0)
        .withColumn("block", F.pmod(ids, block_count).cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), chunk_count - 1)))
    )

    def search(chunk: pa.Table, block: pa.Table) -> pa.Table:
        block = block.sort_by("doc_id")
        if chunk.num_rows and block.num_rows:
            found = V.nearest(V.matrix(chunk["embedding"]), V.matrix(block["embedding"]), k)
        else:
            found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        question_ids, doc_ids = chunk["question_id"].combine_chunks(), block["doc_id"].combine_chunks()
        return pa.Table.from_pydict(V.ranked(question_ids, doc_ids, found))

    keys = ["cell", "block", "chunk"]
    candidates = (
        left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, _result_schema(questions, documents))
    )
    return _best(candidates, k)


def _pieces(rows: np.ndarray, least: int) -> np.ndarray:
    """Into how many blocks each cell is cut: of ``least`` rows or more, once there are ``MOST_BLOCKS``."""
    return np.minimum(-(-rows // least), np.maximum(MOST_BLOCKS, -(-rows // max(least, LARGEST_BLOCK))))


def _join_hot(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """Join on ``key``, which is unique on the right and may be very frequent or NULL on the left.

    A key with more than ``HOT_ROWS`` rows is cut into parts by the hash of ``question_id``, and its right row is
    repeated for each part; the list of such keys has at most one row for ``HOT_ROWS`` rows of the left, which is read
    twice.
    """
    counted = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = materialize(counted.where(F.col("n") > HOT_ROWS).select(key, F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("parts")))
    n = hot.count()
    hot = F.broadcast(hot) if n <= MOST_BROADCAST_KEYS else hot
    parts, spread = F.coalesce("parts", F.lit(1)), F.xxhash64("question_id")
    if not n:  # the usual case
        salted, copies = left.withColumn("parts", F.lit(1)), right.withColumn("parts", F.lit(1))
    else:
        salted, copies = left.join(hot, key, "left"), right.join(hot, key, "left")
    salt = F.when(F.col(key).isNull(), -1 - F.pmod(spread, F.lit(10_000))).otherwise(F.pmod(spread, parts))
    salted = salted.withColumn("salt", salt.cast("int")).drop("parts")
    copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return salted.join(copies, [key, "salt"], how).drop("salt")


def _join_unique(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """Join on ``key``, which is unique on the right, a stored table that is measured first.

    Up to ``BROADCAST_BYTES`` it goes to every executor, and frequent keys of the left don't matter; beyond that see
    :func:`_join_hot`.
    """
    texts = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in right.columns]
    size = right.agg(F.coalesce(F.sum(reduce(operator.add, texts) + 64), F.lit(0)).alias("bytes")).first()["bytes"]
    if size <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), key, how)
    return _join_hot(materialize(left), right, key, how)


def with_documents(retrieved: DataFrame, documents: DataFrame) -> DataFrame:
    """Add text and type of the retrieved documents; images are not read from a stored table."""
    texts = stores.flat_documents(documents).select("doc_id", "page_content", "type")
    return _join_unique(retrieved, texts, "doc_id", "inner").select(
        "question_id", "rank", "doc_id", "distance", "page_content", "type"
    )


def _is_graph() -> Column:
    return F.coalesce(F.col("type"), F.lit("")) == "graph"


def prompt_context() -> Column:
    """Texts in rank order with a blank line between them, as an aggregate."""
    return F.expr(r"listagg(page_content, '\n\n') within group (order by rank)")


def has_relevant_info() -> Column:
    """Whether any retrieved document is not a chart, as an aggregate."""
    return F.coalesce(F.bool_or(~_is_graph()), F.lit(False))


def first_graph() -> Column:
    """Key of the first chart in rank order, as an aggregate."""
    return F.min_by(F.when(_is_graph(), F.col("doc_id")), F.when(_is_graph(), F.col("rank")))


def per_question(questions: DataFrame, retrieved: DataFrame, documents: DataFrame) -> DataFrame:
    """Context, relevance and first chart of every question; a question without documents stays.

    Only the one chart a question shows brings its image along.
    """
    found = (
        with_documents(retrieved, documents)
        .groupBy("question_id")
        .agg(
            prompt_context().alias("context"),
            has_relevant_info().alias("has_relevant_info"),
            first_graph().alias("graph_doc_id"),
        )
    )
    graphs = (
        stores.flat_documents(documents)
        .where("type = 'graph'")
        .select(
            F.col("doc_id").alias("graph_doc_id"),
            F.col("image_base64").alias("graph"),
            F.coalesce("description", F.lit("")).alias("graph_description"),
        )
    )
    return (
        _join_unique(questions.join(found, "question_id", "left"), graphs, "graph_doc_id", "left")
        .withColumn("has_relevant_info", F.coalesce("has_relevant_info", F.lit(False)))
        .drop("graph_doc_id")
    )

"""SentencePiece encoding and decoding with a weighted finite-state transducer.

The model file is compiled into three machines: the normaliser (white space to its mark, a mark in front), the
pieces (one arc each, from a string to an id), and byte fallback (a character without a piece to the ids of its
UTF-8 bytes). They are composed with each input, arc by arc as needed, and the shortest path in the tropical
semiring (weights are added along a path, the smallest total wins) is the encoding.

* unigram models: an arc weighs minus the piece's score, so the shortest path is the most likely segmentation.
* BPE models: merging knows no weights, but it has a local property: a sequence of pieces is what merging makes
  if and only if every two neighbours are what merging makes of their joined string. So states remember the last
  piece, and an arc weighs 0 if merging keeps the pair and infinity if not. Exactly one path is finite.

Pieces never reach over the start of a run of white-space marks (checked when compiling), so texts are cut there
and the paths of the parts, of which most repeat, are kept in a bounded cache, a new one each task. Ids equal those of the library.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.llm.common import ship

MARK = "▁"
#: Fixed values of the model file's format: types of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

#: Paths of parts that a task keeps, twice: recent ones and those before, as bytes of 32-bit ids. Longer parts are not kept.
CACHED_PARTS = 250_000
CACHED_LENGTH = 48
#: Pairs of pieces whose merging a task keeps in mind.
CACHED_PAIRS = 500_000
#: Bytes of ids that go out together, and one text's at most beyond.
PIECE_BYTES = 1 << 22
UNKNOWN_PENALTY = 10.0
INFINITY = math.inf


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
        else:
            size = {1: 8, 5: 4}.get(tag & 7)
            if size is None:
                size, at = number(at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Transducer:
    """The compiled machines of one model."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, dummy_prefix: bool = True, squeeze: bool = False):
        self.pieces, self.kind, self.dummy_prefix, self.squeeze = pieces, kind, dummy_prefix, squeeze
        self.arcs = {p: i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER_DEFINED, UNUSED)}
        self.weight = [-s for _, s, _ in pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN), 0)
        self.fallback_weight = UNKNOWN_PENALTY + max((w for w, (_, _, k) in zip(self.weight, pieces) if k == NORMAL), default=0.0)
        inner = {c for p in self.arcs if len(p) > 1 for c in p}
        alone = re.escape("\n") if "\n" not in inner else ""
        cuts = all(MARK not in p.lstrip(MARK) for p in self.arcs)
        self.part = re.compile(f"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+" if cuts and alone else f"{MARK}*[^{MARK}]+|{MARK}+" if cuts else "(?s).+")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.arcs.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.forget()
        self.output = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, _, k in pieces]

    def forget(self) -> None:
        """Let go of the paths and pairs kept so far; a worker may serve other work after this."""
        self.paths: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kept_pairs: dict[tuple[int, int], bool] = {}

    # the normaliser

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)

    # arc weights

    def _merged(self, text: str) -> list[int]:
        """What merging makes of a short string of pieces."""
        parts = list(text)
        while True:
            best, at = INFINITY, -1
            for i in range(len(parts) - 1):
                piece = self.arcs.get(parts[i] + parts[i + 1])
                if piece is not None and self.weight[piece] < best:
                    best, at = self.weight[piece], i
            if at < 0:
                return [self.arcs.get(p, -1) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _keeps(self, last: int, piece: int) -> bool:
        """Whether merging keeps the pair; ``last`` is -1 at the start and after byte fallback."""
        known = self.kept_pairs.get((last, piece))
        if known is None:
            text = self.pieces[piece][0]
            if last < 0:
                known = self._merged(text) == [piece]
            else:
                known = self._merged(self.pieces[last][0] + text) == [last, piece]
            if len(self.kept_pairs) >= CACHED_PAIRS:
                self.kept_pairs.clear()
            self.kept_pairs[last, piece] = known
        return known

    # shortest paths

    def _bytes_of(self, character: str) -> list[int]:
        encoded = character.encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in encoded] if all(b in self.bytes for b in encoded) else [self.unknown]

    def _finite(self, part: str) -> tuple[list[int], list[int]]:
        """For each place, the piece of the arc into it and where that starts; -1 stands for byte fallback.

        Every place has one finite path at most, so the first arc that fits settles it.
        """
        known = self.kept_pairs
        pieces, starts = [-1] * (len(part) + 1), [-1] * (len(part) + 1)
        for at, (piece, size) in self.automaton.iter(part):
            end = at + 1
            if starts[end] < 0:
                start = end - size
                last = pieces[start]
                keeps = known.get((last, piece))
                if self._keeps(last, piece) if keeps is None else keeps:
                    pieces[end], starts[end] = piece, start
        return pieces, starts

    def _lightest(self, part: str) -> tuple[list[int], list[int]]:
        """The same for a unigram model: the arc that ends the lightest path into each place."""
        n = len(part)
        total = [0.0] + [INFINITY] * n
        pieces, starts, reached = [-1] * (n + 1), [-1] * (n + 1), 0
        for at, (piece, size) in chain(self.automaton.iter(part), [(n, (-1, 1))]):
            while reached < min(at, n):  # all arcs into these places were seen
                reached += 1
                fallback = total[reached - 1] + self.fallback_weight
                if fallback < total[reached]:
                    total[reached], pieces[reached], starts[reached] = fallback, -1, -1
            if piece >= 0 and total[at + 1 - size] + self.weight[piece] < total[at + 1]:
                total[at + 1], pieces[at + 1], starts[at + 1] = total[at + 1 - size] + self.weight[piece], piece, at + 1 - size
        return pieces, starts

    def _shortest(self, part: str) -> bytes:
        pieces, starts = self._finite(part) if self.kind == BPE else self._lightest(part)
        path, end = [], len(part)
        while end:
            start = starts[end]
            if start < 0:
                start = end - 1
                path.extend(reversed(self._bytes_of(part[start:end])))
            else:
                path.append(pieces[end])
            end = start
        return array("i", path[::-1]).tobytes()

    def _path(self, part: str) -> bytes:
        path = self.older.get(part) or self._shortest(part)
        if len(part) <= CACHED_LENGTH:
            if len(self.paths) >= CACHED_PARTS:
                self.paths, self.older = {}, self.paths
            self.paths[part] = path
        return path

    def encoded(self, text: str) -> bytes:
        """The ids as 32-bit numbers, one after another."""
        path = self._path
        return b"".join([self.paths.get(p) or path(p) for p in self.part.findall(self.normalise(text))])

    def encode(self, text: str) -> list[int]:
        return array("i", self.encoded(text)).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Bytes that are no UTF-8 become U+FFFD; control pieces vanish; the mark in front is taken off."""
        text = b"".join(map(self.output.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def compiled(model: bytes) -> Transducer:
    """From the bytes of a model file. Models with a table of character replacements are refused."""
    pieces, kind, prefix, squeeze = [], UNIGRAM, True, True
    for field, value in _fields(model):
        if field == 1:
            piece = dict(_fields(value))
            score = memoryview(piece.get(2, bytes(4))).cast("f")[0]
            pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
        elif field == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
        elif field == 3:
            rules = dict(_fields(value))
            prefix, squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
            if rules.get(2) or not rules.get(5, 1):
                raise ValueError("models with character replacements or unescaped white space are not supported")
    if kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    return Transducer(pieces, kind, prefix, squeeze)


@cache
def _of(model: bytes) -> Transducer:
    return compiled(model)


def read_model(spark: SparkSession, path: str) -> bytes:
    """The model file's bytes, from any store that Spark reads; some MB at most, as vocabularies are."""
    return bytes(spark.read.format("binaryFile").load(path).first().content)


def _encoded(machine: Transducer, texts: pa.Array) -> Iterator[pa.Array]:
    """``ids``, ``n_ids`` and ``exact`` of all texts, in pieces of ``PIECE_BYTES``."""
    returned = pa.struct([("ids", pa.list_(pa.int32())), ("n_ids", pa.int32()), ("exact", pa.bool_())])
    ids, ends, exact = bytearray(), [0], []

    def piece() -> pa.Array:
        until, missing = np.array(ends, np.int32), np.array([e is None for e in exact], bool)
        lists = pa.ListArray.from_arrays(pa.array(until), pa.array(np.frombuffer(ids, np.int32)), mask=pa.array(missing))
        return pa.StructArray.from_arrays(
            [lists.cast(returned[0].type), pa.array(np.diff(until), pa.int32(), mask=missing), pa.array(exact, pa.bool_())], fields=list(returned)
        )

    for scalar in texts:
        text = scalar.as_py()
        own = b"" if text is None else machine.encoded(text)
        exact.append(None if text is None else machine.decode(array("i", own)) == text)
        ids += own
        ends.append(len(ids) // 4)
        if len(ids) >= PIECE_BYTES:
            yield piece()
            ids, ends, exact = bytearray(), [0], []
    if exact:
        yield piece()


def tokenized(documents: DataFrame, model: bytes) -> DataFrame:
    """Every row with ``ids``, ``n_ids`` and ``exact``: whether decoding the ids gives the text back.

    NULL texts have NULL in all three; empty texts have no ids. A text that holds the white-space mark itself is
    not exact, as the mark is decoded to a space. Columns of these names are replaced.
    """
    names = {"ids", "n_ids", "exact"}
    kept = [F.col(f"`{c}`") for c in documents.columns if c.lower() not in names]
    ship(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("ids array<int>, n_ids int, exact boolean")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = _of(sent.value)
        try:
            for texts in batches:
                yield from _encoded(machine, texts)
        finally:  # the process and its compiled model stay for later tasks, of other operators too
            machine.forget()

    told = documents.select(*kept, encode(F.col("text").cast("string")).alias("__told"))
    return told.select(*kept, "__told.ids", "__told.n_ids", "__told.exact")


def detokenized(rows: DataFrame, model: bytes) -> DataFrame:
    """Every row with ``text`` decoded from ``ids`` (NULL stays NULL; an id outside the vocabulary is an error)."""
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() != "text"]
    ship(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        machine = _of(sent.value)
        return pa.array([None if i is None else machine.decode(i) for i in ids.to_pylist()], pa.string())

    return rows.select(*kept, decode(F.col("ids").cast("array<int>")).alias("text"))

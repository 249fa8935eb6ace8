"""Records of a delimited text whose quoted fields may hold line breaks, put together from its lines inside tasks.

A line starts either a record or lies inside a quoted field, so it is a map from these two states to two states.
Lines without a quote keep the state. A quote opens a field only at its start; inside, a doubled quote is text.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Tasks get these functions by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WHOLE, HEAD, TAIL = 0, 1, 2
STATES = "file string, start long, from_record boolean, from_quote boolean"
PIECES = "file string, start long, kind int, header boolean, record string"


def ends_inside(line: str, inside: bool, separator: str) -> bool:
    """Whether the line ends inside a quoted field."""
    at = 0
    while True:
        if not inside:
            if line[at : at + 1] != '"':
                at = line.find(separator, at) + len(separator)
                if at < len(separator):
                    return False
                continue
            at += 1
        while True:
            quote = line.find('"', at)
            if quote < 0:
                return True
            at = quote + 1
            if line[at : at + 1] != '"':
                break
            at += 1
        inside = False
        at = line.find(separator, at) + len(separator)  # what follows the closing quote belongs to the field
        if at < len(separator):
            return False


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Parts of the batches that come from one split, in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = pa.StructArray.from_arrays([batch["file"], batch["start"]], ["file", "start"])
        ends = pc.run_end_encode(pc.binary_join_element_wise(batch["file"], batch["start"].cast(pa.string()), "\n")).run_ends.to_pylist()
        for begin, end in zip([0, *ends], ends):
            yield keys[begin]["file"].as_py(), keys[begin]["start"].as_py(), batch.slice(begin, end - begin)


def _quoted(lines: pa.Array) -> list[int]:
    return pc.indices_nonzero(pc.match_substring(lines, '"')).to_pylist()


def states(separator: str) -> Callable:
    """Per split: the state at its end for either state at its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ends = None, [False, True]
        for file, start, part in _runs(batches):
            if own != (file, start):
                if own:
                    yield _row(STATES, [*own, *ends])
                own, ends = (file, start), [False, True]
            for i in _quoted(part["value"]):
                line = part["value"][i].as_py()
                ends = [ends_inside(line, state, separator) for state in ends]
        if own:
            yield _row(STATES, [*own, *ends])

    return run


def _row(schema: str, values: list) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], types[t]) for v, (_, t) in zip(values, fields)], names=[n for n, _ in fields])


def pieces(separator: str) -> Callable:
    """Whole records of each split, and the pieces of records that cross its ends; ``inside``: state at its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, kind, first = None, None, WHOLE, False  # ``held``: lines of a record that isn't complete
        for file, start, part in _runs(batches):
            if own != (file, start):
                if held is not None:
                    yield _row(PIECES, [*own, TAIL if kind == WHOLE else kind, first, "\n".join(held)])
                own, first = (file, start), start == 0
                held, kind = ([], HEAD) if part["inside"][0].as_py() else (None, WHOLE)
            lines, done = part["value"], 0  # lines before ``done`` are settled
            for i in _quoted(lines):
                line = lines[i].as_py()
                if held is None:
                    if not ends_inside(line, False, separator):
                        continue
                    yield from _whole(own, lines.slice(done, i - done), first)
                    first = first and i == done
                    held, kind, done = [line], WHOLE, i + 1
                else:
                    held += lines.slice(done, i - done).to_pylist()
                    held.append(line)
                    done = i + 1
                    if not ends_inside(line, True, separator):
                        yield _row(PIECES, [*own, kind, first, "\n".join(held)])
                        held, kind, first = None, WHOLE, False
            if held is None:
                yield from _whole(own, lines.slice(done), first)
                first = first and done == len(lines)
            else:
                held += lines.slice(done).to_pylist()
        if held is not None:
            yield _row(PIECES, [*own, TAIL if kind == WHOLE else kind, first, "\n".join(held)])

    return run


def _whole(own: tuple[str, int], lines: pa.Array, first: bool) -> Iterator[pa.RecordBatch]:
    """Lines that are records; the first line of a file is its header."""
    n = len(lines)
    if n:
        columns = [pa.repeat(own[0], n), pa.repeat(own[1], n), pa.repeat(pa.scalar(WHOLE, pa.int32()), n), pa.array([first] + [False] * (n - 1)), lines]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "start", "kind", "header", "record"])

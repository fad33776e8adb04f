"""Matching lines of a text column with their matches' places, in one pass over Arrow batches.

Lines are cut and matched as columns (see ``functions.automaton``); a member is a
row and stays in its task, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..sources.matching import matcher
from .lines import Match, prefiltered

MATCHES = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def cut_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.BinaryArray]:
    """(row, line number, byte offset, line) of all lines of a column without nulls; the empty piece behind the last line feed is none."""
    edges = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    ends = edges[1:][np.diff(edges) > 0]
    ends = ends[data[ends - 1] != 10]
    # where lines stop, a text's end before the line feed that may stand there already for the next text
    stops = np.sort(np.concatenate([2 * ends, 2 * np.flatnonzero(data == 10) + 1]))
    starts = np.concatenate([[0], (stops[:-1] + 1) // 2]) if len(stops) else stops
    row = np.searchsorted(edges, starts, "right") - 1
    number = np.arange(len(row)) - np.searchsorted(row, row) + 1
    sizes = np.concatenate([[0], np.cumsum(stops // 2 - starts)]).astype(np.int32)
    lines = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(sizes), pa.py_buffer(data[data != 10])])
    return row, number, starts - edges[row], lines


def matches_of(lines: pa.BinaryArray, spans: pa.ListArray) -> pa.ListArray:
    """(text, start, end) of every match."""
    flat = spans.flatten().to_numpy()
    start, end = flat[::2], flat[1::2]
    ends = np.concatenate([[0], np.cumsum(spans.value_lengths().to_numpy() // 2)])
    edges = np.frombuffer(lines.buffers()[1], np.int32, len(lines) + 1, lines.offset * 4).astype(np.int64)
    base = np.repeat(edges[:-1], np.diff(ends)) + start
    size = end - start
    place = np.repeat(base - (np.cumsum(size) - size), size) + np.arange(size.sum())
    data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[place]
    text = pa.StringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(data))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([text, pa.array(start), pa.array(end)], names=["text", "start", "end"]))


def selected_lines(df: DataFrame, keys: list[str], m: Match, text: str = "text") -> DataFrame:
    """(keys, line_no, line) of the selected lines, the inversion included."""
    rows = prefiltered(df, m, text).filter(df[text] != "").select(*keys, text)
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("line_no", T.LongType()), T.StructField("line", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = matcher(m.patterns, m.fixed, m.ignore_case, m.smart_case, m.word)
        for batch in batches:
            row, number, _, lines = cut_lines(batch.column(len(keys)).cast(pa.binary()))
            bodies = pc.if_else(pc.ends_with(lines, b"\r"), pc.binary_slice(lines, 0, -1), lines) if m.crlf else lines
            at = np.flatnonzero(engine.hits(bodies) != m.invert)
            own = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(own) for k in range(len(keys))), pa.array(number[at]), lines.take(pa.array(at)).cast(pa.string())], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def matching_lines(df: DataFrame, keys: list[str], m: Match, text: str = "text", totals: bool = False) -> DataFrame:
    """(keys, line_no, byte_offset, line, matches): every line with a match, and all its matches, empty ones included.

    ``totals`` adds (first, last, member_lines, member_matches): whether the line
    is its member's first or last one with a match, and how many of both the member has.
    """
    rows = prefiltered(df, m, text).filter(df[text] != "").select(*keys, text)
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("line_no", T.LongType()), T.StructField("byte_offset", T.LongType()), T.StructField("line", T.StringType()), T.StructField("matches", MATCHES)])
    if totals:
        schema = T.StructType([*schema.fields, *(T.StructField(n, T.BooleanType()) for n in ("first", "last")), *(T.StructField(n, T.LongType()) for n in ("member_lines", "member_matches"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = matcher(m.patterns, m.fixed, m.ignore_case, m.smart_case, m.word)
        for batch in batches:
            row, number, offset, lines = cut_lines(batch.column(len(keys)).cast(pa.binary()))
            bodies = pc.if_else(pc.ends_with(lines, b"\r"), pc.binary_slice(lines, 0, -1), lines) if m.crlf else lines
            at = np.flatnonzero(engine.hits(bodies))
            pick = pa.array(at)
            found = bodies.take(pick)
            own = pa.array(row[at])
            matches = matches_of(found, engine.spans(found))
            columns = [*(batch.column(k).take(own) for k in range(len(keys))), pa.array(number[at]), pa.array(offset[at]), lines.take(pick).cast(pa.string()), matches]
            if totals:
                edge = np.diff(row[at], prepend=-1, append=-1) != 0
                begin, size = np.flatnonzero(edge[:-1]), np.bincount(row[at], minlength=len(batch))
                each = np.concatenate([[0], np.cumsum(matches.value_lengths().to_numpy())])
                n = each[np.append(begin[1:], len(at))] - each[begin] if len(at) else each[:0]
                columns += [pa.array(edge[:-1]), pa.array(edge[1:]), pa.array(size[row[at]]), pa.array(np.repeat(n, size[row[at]][begin]))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return rows.mapInArrow(run, schema)

"""Archives as DataFrames.

``scan`` reads inputs into one tagged table - members, lines, diagnostics and
an end row for every input that was walked to its end - from which ``members``,
``lines`` and ``diagnostics`` are filters.  Inputs on a file system that the
executors mount are read by a Python data source, in their order or the largest first, streaming in Arrow
batches; a search of large plain inputs reads ranges of them, a large zip is read in runs of entries.  An input,
a range or a run is a partition of its own, or if there are many small ones, as many as come to a partition's
bytes; stores that Arrow knows are read in ranges by the same source; all other inputs whose paths have a scheme go
through Spark's ``binaryFile`` source and the same walker.
"""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterator
from dataclasses import replace
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.scratch import scratch_root
from ..plans.select import shown_lines
from .matching import Selection, Wanted
from .ranged import opened, reachable
from .resolve import STDIN, Item, Resolved, has_scheme, resolve, spool_stdin
from .walk import Lines, Options, entry_runs, splittable, walk, walk_range

SCHEMA = (
    "rec_type string, item_index long, archive string, member_index long, member string, format string, codec string, "
    "line_no long, byte_offset long, line binary, eol binary, muted boolean, severity string, code string, message string, seen long, searched long, "
    "hit boolean, spans array<long>, n_lines long, n long, part long, beside boolean"
)
_FIELDS = [
    ("rec_type", pa.string()), ("item_index", pa.int64()), ("archive", pa.string()), ("member_index", pa.int64()), ("member", pa.string()), ("format", pa.string()), ("codec", pa.string()),
    ("line_no", pa.int64()), ("byte_offset", pa.int64()), ("line", pa.binary()), ("eol", pa.binary()), ("muted", pa.bool_()), ("severity", pa.string()), ("code", pa.string()),
    ("message", pa.string()), ("seen", pa.int64()), ("searched", pa.int64()), ("hit", pa.bool_()), ("spans", pa.list_(pa.int64())), ("n_lines", pa.int64()), ("n", pa.int64()), ("part", pa.int64()), ("beside", pa.bool_()),
]
ARROW = pa.schema(_FIELDS)
#: Where windows or a limit are asked for, the reader leaves out the lines that are not shown, and tells what the others are.
SHOWN = SCHEMA.replace("hit boolean, ", "") + ", kind string, group_break boolean"


#: Lines that one batch holds at least, unless it is the last or holds so many bytes.
BATCH_LINES, BATCH_BYTES = 1 << 14, 16 << 20


def _constant(value, kind: pa.DataType, n: int) -> pa.Array:
    return pa.nulls(n, kind) if value is None else pa.repeat(pa.scalar(value, kind), n)


def _batch(size: int, **columns) -> pa.RecordBatch:
    """Columns by name; single values are repeated, the rest is null."""
    arrays = []
    for name, kind in _FIELDS:
        v = columns.get(name)
        arrays.append(v if isinstance(v, pa.Array) else pa.array(v, kind) if isinstance(v, (list, np.ndarray)) else _constant(v, kind, size))
    return pa.RecordBatch.from_arrays(arrays, schema=ARROW)


class _Block(NamedTuple):
    """Lines of one member, and whose they are."""

    whose: int
    own: dict
    index: int
    name: str
    lines: Lines
    beside: bool | None = None


def _lines_batch(blocks: list[_Block], search: Selection | None) -> tuple[pa.RecordBatch, np.ndarray]:
    """Blocks of several members' lines as one batch, or what is wanted of them, and whose each line is."""
    lines = [x.lines for x in blocks]
    which = np.repeat(np.arange(len(blocks)), [len(x) for x in lines])
    numbers = np.concatenate([x.numbers for x in lines])
    every = Lines(
        np.arange(len(which)), np.concatenate([x.offsets for x in lines]), pa.concat_arrays([x.lines for x in lines]), list(chain.from_iterable(x.ends for x in lines)), list(chain.from_iterable(x.muted for x in lines)),
        None if lines[0].hits is None else np.concatenate([x.hits for x in lines]), None if lines[0].spans is None else pa.concat_arrays([x.spans for x in lines]),
    )
    if search:
        every = search.take(every) or every.taken(np.empty(0, np.int64))
    numbers, which = numbers[every.numbers], which[every.numbers]
    each = lambda values, kind: pa.array(values, kind).take(pa.array(which))
    own = {c: each([x.own[c] for x in blocks], kind) for c, kind in _OWN}
    found = {}
    if every.hits is not None:
        found = {"hit": every.hits, "n_lines": pa.array(every.hits.astype(np.int64)), "n": pa.array(every.hits.astype(np.int64))}
    if every.spans is not None:
        found |= {"spans": every.spans, "n": pc.cast(pc.divide(every.spans.value_lengths(), 2), pa.int64())}
    batch = _batch(
        len(which), rec_type="line", **own, member_index=each([x.index for x in blocks], pa.int64()), member=each([x.name for x in blocks], pa.string()), line_no=numbers,
        byte_offset=every.offsets, line=every.lines, eol=every.ends, muted=every.muted, beside=each([x.beside for x in blocks], pa.bool_()), **found,
    )
    return batch, np.array([x.whose for x in blocks])[which]


_OWN = [("item_index", pa.int64()), ("archive", pa.string()), ("part", pa.int64())]


def event_batches(events: Iterator[tuple], index: int, archive: str, part: int | None = None, search: Selection | None = None) -> Iterator[pa.RecordBatch]:
    """The walker's events as rows of ``SCHEMA``."""
    return input_batches(iter([(index, archive, part, events)]), search)


def input_batches(inputs: Iterator[tuple[int, str, int | None, Iterator[tuple]]], search: Selection | None = None) -> Iterator[pa.RecordBatch]:
    """The events of (index, archive, part, events) as rows of ``SCHEMA``: what is of one input or range stays together, a member's lines in order, other rows before or after them.

    ``search`` is done here, over the lines of many members at once, where the walk left it to its caller.
    """
    blocks: list[_Block] = []
    other: list[dict] = []
    told: list[int] = []  # whose the other rows are
    held = held_bytes = 0

    def flush():
        nonlocal held, held_bytes
        batches = [_batch(len(other), **{c: [x.get(c) for x in other] for c in dict.fromkeys(chain.from_iterable(other))})] if other else []
        if blocks:
            lines, of = _lines_batch(blocks, search)
            batches += [lines] if len(lines) else []
            if len(batches) == 2 and told[0] != whose:
                order = np.argsort(np.concatenate([told, of]), kind="stable")
                batches = pa.Table.from_batches(batches).take(pa.array(order)).combine_chunks().to_batches()
        yield from batches
        other.clear(), told.clear(), blocks.clear()
        held = held_bytes = 0

    for whose, (index, archive, part, events) in enumerate(inputs):
        name, own, n_bytes = "", {"item_index": index, "archive": archive, "part": part}, 0
        for e in events:
            if e[0] in ("lines", "beside"):
                blocks.append(_Block(whose, own, e[1], name, e[3]) if e[0] == "lines" else _Block(whose, own, e[1], name, e[2], True))
                held += len(blocks[-1].lines)
                held_bytes += blocks[-1].lines.lines.nbytes
            elif e[0] == "member":
                name = e[2]
                other.append(own | {"rec_type": "member", "member_index": e[1], "member": name, "format": e[3], "codec": e[4]})
            elif e[0] == "binary":
                other.append(own | {"rec_type": "binary", "member_index": e[1], "member": name, "byte_offset": e[2]})
            elif e[0] == "range":
                other.append(own | {"rec_type": "range", "member_index": 0, "member": "", "line_no": e[2], "byte_offset": e[3], "n": e[4], "muted": e[5]})
            elif e[0] == "part":
                other.append(own | {"rec_type": "part", "seen": e[1], "searched": e[2], "byte_offset": n_bytes})
            elif e[0] == "hits":
                other.append(own | {"rec_type": "hits", "member_index": e[1], "member": name, "n_lines": e[2], "n": e[3]})
            elif e[0] == "size":
                n_bytes += e[3]
            elif e[0] == "diag":
                other.append(own | {"rec_type": "diag", "member_index": e[1], "member": name if e[1] is not None else None, "severity": e[2], "code": e[3], "message": e[4]})
            else:
                other.append(own | {"rec_type": "end", "seen": e[1], "searched": e[2], "message": e[3], "byte_offset": n_bytes})
            told += [whose] * (len(other) - len(told))
            if held >= BATCH_LINES or held_bytes >= BATCH_BYTES or len(other) >= BATCH_LINES:
                yield from flush()
    yield from flush()


class _Piece(NamedTuple):
    """An input, or a range of a plain one (``part``) or a run of a zip's entries: (number, start, stop)."""

    item: Item
    names: tuple[str, ...]
    size: int | None
    part: tuple[int, int, int] | None = None
    run: tuple[int, int, int] | None = None


class _Pieces(InputPartition):
    """What a task reads."""

    def __init__(self, pieces: list[_Piece]):
        super().__init__(None)
        self.pieces = pieces


#: Bytes that a task reads at least where there are more inputs than tasks asked for, and what it takes to open one, as bytes.
TASK_BYTES, OPEN_BYTES = 32 << 20, 64 << 10


def grouped(pieces: list[_Piece], tasks: int) -> list[list[_Piece]]:
    """Pieces that follow one another, of about as many bytes together; one each up to ``tasks`` of them.  What has no size, as a pipe, stays alone."""
    if len(pieces) <= tasks:
        return [[p] for p in pieces]
    share = min(TASK_BYTES, sum((p.size or 0) + OPEN_BYTES for p in pieces) / tasks)
    out, held = [], share
    for p in pieces:
        cost = share if p.size is None else p.size + OPEN_BYTES
        if held + cost > share:
            out.append([])
            held = 0
        out[-1].append(p)
        held += cost
    return out


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = _options(json.loads(options.get("walk", "{}")))
        self.windows = json.loads(options.get("windows", "null"))
        self.plan = dict(options)

    def __getstate__(self) -> dict:
        return {"options": self.options, "windows": self.windows}  # tasks get their inputs with their partitions, not the list of all

    def partitions(self):
        names, items = {}, []
        for i in json.loads(self.plan["items"]):
            names[i["index"]] = tuple(i.pop("names"))
            items.append(Item(**i))
        all_runs = {int(k): r for k, r in json.loads(self.plan.get("runs", "{}")).items()}
        split = {int(k): n for k, n in json.loads(self.plan.get("split", "{}")).items()}
        pieces = []
        for i in items if self.plan.get("ordered") == "true" else sorted(items, key=lambda i: -(i.size or 0)):
            own, step, runs = names[i.index], split.get(i.index), all_runs.get(i.index)
            if runs:
                pieces += [_Piece(i, own, i.size // (len(runs) - 1), run=(k, a, b)) for k, (a, b) in enumerate(zip(runs, runs[1:]))]
            elif step:
                pieces += [_Piece(i, own, min(step, i.size - a), part=(k, a, min(a + step, i.size))) for k, a in enumerate(range(0, i.size, step))]
            else:
                pieces.append(_Piece(i, own, i.size))
        return [_Pieces(p) for p in grouped(pieces, int(self.plan.get("tasks", len(pieces))))] or [_Pieces([])]

    def read(self, partition):
        return _shown(input_batches(self._inputs(partition.pieces), self.options.left()), self.windows)

    def _inputs(self, pieces: list[_Piece]) -> Iterator[tuple[int, str, int | None, Iterator[tuple]]]:
        f = path = None
        try:
            for p in pieces:
                item, o = p.item, replace(self.options, names=p.names) if self.options.globs else self.options
                if path is None or path != item.path or item.size is None:
                    if f:
                        f.close()
                    f = path = None
                    try:
                        f, path = opened(item.path), item.path
                    except OSError as e:
                        yield item.index, item.display, None, iter([("diag", None, "error", "OPEN_FAILED", str(e)), ("end", 0, 0, None)])
                        continue
                else:
                    f.seek(0)
                if p.part:
                    yield item.index, item.display, p.part[0], walk_range(f, *p.part, item.size, o)
                    continue
                size = None if item.size is None else item.size if item.remote else os.fstat(f.fileno()).st_size
                yield item.index, item.display, None, walk(f, size, o, stream=item.size is None, run=p.run)
        finally:
            if f:
                f.close()


class ArchiveSource(DataSource):
    """``spark.read.format("archive")``; options: ``items`` and ``walk`` in JSON, or ``path``."""

    @classmethod
    def name(cls):
        return "archive"

    def schema(self):
        return SHOWN if json.loads(self.options.get("windows", "null")) else SCHEMA

    def reader(self, schema):
        options = dict(self.options)
        if "items" not in options:
            options["items"] = _items_json(resolve([options["path"]]).items)
        return ArchiveReader(options)


def _shown(batches: Iterator[pa.RecordBatch], windows: list | None) -> Iterator[pa.RecordBatch]:
    return shown_lines(batches, "hit", *windows) if windows else batches


def _options(d: dict) -> Options:
    return Options(tuple(d.get("globs", ())), d.get("text", False), d.get("crlf", False), d.get("lines", True), tuple(d.get("names", ())), d.get("literal", "").encode(), Wanted.read(d.get("wanted")), d.get("around", 0), later=True)


def _items_json(items: list[Item]) -> str:
    return json.dumps([vars(i) | {"names": i.names() if i.path != STDIN and i.display != "<stdin>" else []} for i in items])


#: Plain inputs beyond this size are read in ranges of it, zips in runs of entries that hold so much.
RANGE_BYTES = 64 << 20
#: Tasks that a scan has at least, if it has so many inputs, ranges and runs.
TASKS_A_CORE = 4


def in_ranges(item: Item, range_bytes: int | None = None) -> bool:
    """Whether an input is plain and large enough to be read in ranges."""
    if item.size is None or item.size <= (range_bytes or RANGE_BYTES):
        return False
    try:
        with opened(item.path) as f:
            return splittable(f, item.size)
    except OSError:
        return False  # its task tells why


def zip_runs(item: Item, run_bytes: int) -> list[int] | None:
    """A large zip's entries as runs, by its directory."""
    if item.size is None or item.size <= run_bytes:
        return None
    try:
        with opened(item.path) as f:
            return entry_runs(f, item.size, run_bytes)
    except OSError:
        return None


#: What one cell of Spark's ``binaryFile`` source can hold.
CELL_MOST = (1 << 31) - 1


def scan(
    spark: SparkSession, paths: list[str], archive_globs: list[str] | None = None, globs: list[str] | None = None, text: bool = False, crlf: bool = False, lines: bool = True, literal: str = "", wanted: Wanted | None = None, around: int = 0, range_bytes: int | None = None, ordered: bool = False,
    windows: tuple[int, int, int | None] | None = None,
) -> tuple[DataFrame, Resolved]:
    """The tagged table of all inputs, and how the paths were resolved; with ``wanted`` it has only the lines that a search asks for, with ``windows`` (lines before and after a hit, most hits of a member) those around its hits."""
    found = resolve(paths, archive_globs, spark)
    for item in found.items:
        if item.path == STDIN:
            item.path = spool_stdin(scratch_root(spark))
    spark.dataSource.register(ArchiveSource)
    how = {"globs": list(globs or ()), "text": text, "crlf": crlf, "lines": lines, "literal": literal, "wanted": wanted and wanted.written(), "around": around}
    remote = [i for i in found.items if i.remote and not reachable(i.path)]
    theirs = {i.index for i in remote}
    own = [i for i in found.items if i.index not in theirs]
    step = range_bytes or RANGE_BYTES
    split = {i.index: step for i in own if wanted and not wanted.limit and in_ranges(i, step)}
    runs = {i.index: r for i in own if (r := zip_runs(i, step))}
    scanned = spark.read.format("archive").option("runs", json.dumps(runs)).option("items", _items_json(own)).option("walk", json.dumps(how)).option("split", json.dumps(split)).option("ordered", ordered).option("windows", json.dumps(windows)).option("tasks", TASKS_A_CORE * spark.sparkContext.defaultParallelism).load()
    if remote:
        through = _through_spark(spark, remote, _options(how), windows)
        scanned = scanned.unionByName(through) if own else through
    return scanned, found


def _through_spark(spark: SparkSession, items: list[Item], o: Options, windows: tuple | None = None) -> DataFrame:
    """The rows of inputs in a store that only Spark opens: a file is one cell, and a larger one than a cell holds is reported as not read."""
    index = {i.path: (i.index, i.display) for i in items}

    def run(batches):
        for b in batches:
            for p, content, length in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                k, display = index[p]
                if content.is_valid:
                    data = content.as_buffer()
                    events = walk(io.BytesIO(data), len(data), replace(o, names=(display,)) if o.globs else o)
                else:
                    events = iter([("diag", None, "error", "OPEN_FAILED", f"{length} bytes are more than Spark reads at once"), ("end", 0, 0, None)])
                yield from _shown(event_batches(events, k, display, search=o.left()), windows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load([i.path for i in items])
    fits = F.col("length") <= CELL_MOST
    whole = files.filter(fits).select("path", "content", "length")
    if any((i.size or 0) > CELL_MOST for i in items):
        whole = whole.unionByName(files.filter(~fits).select("path", F.lit(None).cast("binary").alias("content"), "length"))
    return whole.mapInArrow(run, SHOWN if windows else SCHEMA)


def members(scanned: DataFrame) -> DataFrame:
    return scanned.filter("rec_type = 'member'").select("item_index", "archive", "member_index", "member", F.col("format").alias("outer_format"), F.col("codec").alias("inner_codec"))


def lines(scanned: DataFrame) -> DataFrame:
    return scanned.filter("rec_type = 'line'").select("item_index", "archive", "member_index", "member", "line_no", "byte_offset", "line", "eol", "muted")


def diagnostics(scanned: DataFrame) -> DataFrame:
    return scanned.filter("rec_type = 'diag'").select("item_index", "archive", "member_index", "member", "severity", "code", "message")


def outcomes(scanned: DataFrame, items: int | None = None) -> DataFrame:
    """One row an input: members seen and searched, errors and notes, and whether it was walked to its end."""
    return scanned.groupBy("item_index", "archive").agg(
        F.sum("seen").alias("members_seen"), F.sum("searched").alias("members_searched"), F.count_if((F.col("rec_type") == "diag") & (F.col("severity") == "error")).alias("n_errors"),
        F.count_if((F.col("rec_type") == "diag") & (F.col("severity") == "note")).alias("n_notes"), F.max(F.when(F.col("rec_type") == "end", F.col("message"))).alias("unverified_end"),
        F.bool_or(F.col("rec_type") == "end").alias("walked"),
    )

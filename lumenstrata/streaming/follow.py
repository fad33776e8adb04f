"""Growing plain files as a stream: what is appended is read once, in whole lines.

An offset says how far each file is read, always behind a line feed, so a line
still being written waits.  A batch reads the bytes between two offsets, one
task a file, with the search in the reader; line numbers, counts and verdicts go
on from batch to batch in the state of each file.  A file that is shorter than
it was gives a SHRANK error and is read from its start.  (One that was cut and
has grown past its old end between two batches can't be told from one that grew.)
Files are read as text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lines import Match
from ..sources.matching import Selection, Wanted
from ..sources.ranged import opened
from ..sources.streams import CHUNK, ReadError
from ..sources.walk import Options, _Cutter, lines_of

APPENDED = "rec_type string, archive string, line_no long, byte_offset long, line binary, code string, message string, n_lines long, restart boolean"
FOLLOWED = "rec_type string, archive string, line_no long, byte_offset long, line binary, code string, message string, matched boolean, partial boolean, exit_code int"
_FIELDS = pa.schema([
    ("rec_type", pa.string()), ("archive", pa.string()), ("line_no", pa.int64()), ("byte_offset", pa.int64()), ("line", pa.binary()), ("code", pa.string()), ("message", pa.string()), ("n_lines", pa.int64()),
    ("restart", pa.bool_()),
])


def whole_lines(path: str, size: int) -> int:
    """Where the last whole line of a file ends."""
    with open(path, "rb") as f:
        at = size
        while at > 0:
            start = max(0, at - CHUNK)
            f.seek(start)
            feed = f.read(at - start).rfind(b"\n")
            if feed >= 0:
                return start + feed + 1
            at = start
    return 0


class _Appended(InputPartition):
    def __init__(self, path: str, start: int, stop: int, restart: bool):
        super().__init__(path)
        self.path, self.start, self.stop, self.restart = path, start, stop, restart


class FollowReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.wanted = Wanted.read(json.loads(options["wanted"])) if "wanted" in options else None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for top, _, names in os.walk(self.folder):
            for name in names:
                path = os.path.join(top, name)
                try:
                    out[path] = whole_lines(path, os.stat(path).st_size)
                except OSError:
                    continue  # gone meanwhile: its lines were read or never were there
        return dict(sorted(out.items()))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Appended(p, start.get(p, 0), b, False) if b > start.get(p, 0) else _Appended(p, 0, b, True) for p, b in end.items() if b != start.get(p, 0)]

    def read(self, partition: _Appended) -> Iterator[pa.RecordBatch]:
        p, search = partition, Selection(self.wanted) if self.wanted else None

        def batch(n: int, **columns) -> pa.RecordBatch:
            columns |= {"archive": pa.repeat(p.path, n), "restart": pa.repeat(p.restart, n)}
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _FIELDS], schema=_FIELDS)

        def said(code: str, message: str) -> pa.RecordBatch:
            return batch(1, rec_type=pa.array(["diag"]), code=pa.array([code]), message=pa.array([message]))

        if p.restart:
            yield said("SHRANK", "the file got shorter and is read anew")
        cutter = _Cutter(Options(text=True))
        cutter.offset = p.start
        try:
            with opened(p.path) as f:
                f.seek(p.start)
                stretch = iter(lambda: f.read(min(CHUNK, p.stop - f.tell())), b"")
                for e in lines_of(stretch, 0, Options(text=True), search, cutter):
                    if e[0] == "lines":
                        x = e[3]
                        yield batch(len(x), rec_type=pa.repeat("line", len(x)), line_no=pa.array(x.numbers), byte_offset=pa.array(x.offsets), line=x.lines)
            if cutter.offset < p.stop:
                yield said("SHRANK", "the file got shorter while it was read")
        except (ReadError, OSError) as e:
            yield said(getattr(e, "code", "READ_FAILED"), str(e))
        yield batch(1, rec_type=pa.array(["size"]), n_lines=pa.array([cutter.number - 1]))


class FollowSource(DataSource):
    @classmethod
    def name(cls):
        return "follow"

    def schema(self):
        return APPENDED

    def streamReader(self, schema):
        return FollowReader(dict(self.options))


def _numbered(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of one file with their line numbers in it, and a verdict on all of the file so far."""
    before, matched, partial = state.get if state.exists else (0, False, False)
    n, restart = 0, False
    for rows in parts:
        restart |= bool(rows["restart"].any())
        n += int(rows["n_lines"].fillna(0).sum())
        shown = rows[rows["rec_type"] != "size"]
        is_line = shown["rec_type"] == "line"
        matched, partial = matched or bool(is_line.any()), partial or bool((~is_line).any())
        yield pd.DataFrame({
            "rec_type": shown["rec_type"], "archive": shown["archive"], "line_no": (shown["line_no"] + (0 if restart else before)).astype("Int64"), "byte_offset": shown["byte_offset"].astype("Int64"),
            "line": shown["line"], "code": shown["code"], "message": shown["message"], "matched": None, "partial": None, "exit_code": pd.array([None] * len(shown), "Int32"),
        })
    state.update((n + (0 if restart else before), matched, partial))
    verdict = {"rec_type": "verdict", "archive": key[0], "line_no": pd.NA, "byte_offset": pd.NA, "line": None, "code": None, "message": None, "matched": matched, "partial": partial}
    yield pd.DataFrame([verdict | {"exit_code": 2 if partial else 0 if matched else 1}]).astype({"line_no": "Int64", "byte_offset": "Int64"})


def follow(spark: SparkSession, folder: str, match: Match | None = None) -> DataFrame:
    """Lines appended to the files below ``folder``, those that match if ``match`` is given, as rows of ``FOLLOWED``.

    Every batch ends a file's rows with a verdict: whether anything in it
    matched so far, whether anything of it could not be read, and the exit code.
    """
    spark.dataSource.register(FollowSource)
    reader = spark.readStream.format("follow").option("path", os.path.abspath(folder))
    if match is not None:
        wanted = Wanted(**{k: v for k, v in asdict(match).items()}, what="lines")
        reader = reader.option("wanted", json.dumps(wanted.written()))
    rows = reader.load()
    return rows.groupBy("archive").applyInPandasWithState(_numbered, FOLLOWED, "n long, matched boolean, partial boolean", "append", GroupStateTimeout.NoTimeout)

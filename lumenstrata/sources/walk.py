"""One input as a sequence of events: its members, their lines, diagnostics, and the proof that it was read.

Events are tuples: ("member", index, name, format, codec), ("lines", index,
first line number, ``Lines``), ("binary", index, offset of what makes the member
binary), ("size", index, lines, bytes), ("diag", index or None, severity, code,
message) ("hits", index, lines, matches) where matches
are only counted, and ("end", members seen, members searched, what the end leaves
unverified).  A damaged input never raises; what was read before the
damage stands.
"""

from __future__ import annotations

import re
from codecs import getincrementaldecoder
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.escapes import truncate_name
from ..functions.globs import Globs
from . import codecs, zips
from .matching import Selection, Wanted
from .sniff import CODECS, SNIFF_LENGTH, sniff
from .streams import CHUNK, ReadError, Stream, file_chunks
from .tar import Tar

#: Byte order marks.
MARKS = (("utf-8", b"\xef\xbb\xbf"), ("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"))
LINE_MOST, DIAGNOSTICS_MOST, FIRST_FILL = 16 << 20, 100, 64 << 10
BATCH_BYTES = 1 << 20


@dataclass(frozen=True)
class Options:
    """How inputs are walked."""

    globs: tuple[str, ...] = ()
    text: bool = False
    crlf: bool = False
    lines: bool = True
    #: Rules of ``globs`` judge members; a plain input is judged by its own names.
    names: tuple[str, ...] = field(default=())
    #: Lines without it need not be given, where the caller shows none of them; lines of binary members are all given.
    literal: bytes = b""
    #: What of the lines is wanted; None: all of them, unsearched.
    wanted: Wanted | None = None
    #: Lines that a window reaches to either side.
    around: int = 0
    #: Lines are given unsearched where the caller can search those of many members at once.
    later: bool = False

    def left(self) -> Selection | None:
        """The search that is left to the caller."""
        w = self.wanted
        return Selection(w) if self.later and w and w.what in ("lines", "whole") and w.limit is None else None


class Lines(NamedTuple):
    """Consecutive lines of a member, or with a literal those of them that hold it, as columns."""

    numbers: np.ndarray
    offsets: np.ndarray
    lines: pa.BinaryArray
    ends: list[bytes]
    muted: list[bool]
    hits: np.ndarray | None = None
    spans: pa.ListArray | None = None

    def taken(self, at: np.ndarray) -> Lines:
        """The lines at the given places."""
        places = at.tolist()
        return Lines(self.numbers[at], self.offsets[at], self.lines.take(pa.array(at)), [self.ends[k] for k in places], [self.muted[k] for k in places])

    def told(self, hits: np.ndarray, spans: pa.ListArray | None) -> Lines:
        return Lines(self.numbers, self.offsets, self.lines, self.ends, self.muted, hits, spans)

    def __iter__(self):
        return zip(self.offsets.tolist(), self.lines.to_pylist(), self.ends, self.muted)

    def __len__(self) -> int:
        return len(self.numbers)


def _binary(data: bytes, edges: np.ndarray) -> pa.BinaryArray:
    return pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])


class _Cutter:
    """Cuts a member's bytes into lines.  Unless ``text``, a NUL ends a line and mutes what it makes binary.

    A NUL within the first fill mutes the whole member, a later one the lines
    from its own on.
    """

    def __init__(self, o: Options):
        self.o, self.number, self.offset, self.rest, self.muted, self.binary = o, 1, 0, b"", False, None

    def first(self, data: bytes) -> None:
        at = -1 if self.o.text else data.find(b"\0", 0, FIRST_FILL)
        if at >= 0:
            self.muted, self.binary = True, at

    def cut(self, data: bytes, last: bool) -> Lines | None:
        data = self.rest + data
        end = len(data) if last else max(data.rfind(b"\n"), -1 if self.o.text else data.rfind(b"\0")) + 1
        self.rest, data = data[end:], data[:end]
        if len(self.rest) > LINE_MOST:
            raise ReadError("SEARCH_FAILED", "a line is longer than 16 MiB")
        if not data:
            return None
        return self._plain(data) if self.o.text or b"\0" not in data else self._with_nuls(data)

    def _plain(self, data: bytes) -> Lines:
        """Lines between line feeds only."""
        if self.o.literal and not self.o.crlf and len(data) <= LINE_MOST:
            return self._few(data)
        feeds = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        open_end = not data.endswith(b"\n")
        stops = np.append(feeds, len(data)) if open_end else feeds  # where each line's text ends
        starts = np.concatenate([[0], feeds[: len(stops) - 1] + 1])
        if len(stops) and (stops - starts).max() > LINE_MOST:
            raise ReadError("SEARCH_FAILED", "a line is longer than 16 MiB")
        numbers, offsets = self.number + np.arange(len(stops)), self.offset + starts
        lines = _binary(data.replace(b"\n", b""), np.concatenate([[0], np.cumsum(stops - starts)]))
        ends = [b"\n"] * len(feeds) + [b""] * open_end
        self.number, self.offset = self.number + len(stops), self.offset + len(data)
        if self.o.crlf:
            ended = pc.and_(pc.ends_with(lines, b"\r"), pa.array([e == b"\n" for e in ends]))
            lines = pc.if_else(ended, pc.binary_slice(lines, 0, -1), lines)
            ends = [b"\r\n" if x else e for x, e in zip(ended.to_pylist(), ends)]
        if self.o.literal:
            pick = _holding(data, self.o.literal, stops)
            numbers, offsets, lines, ends = numbers[pick], offsets[pick], lines.take(pa.array(pick)), [ends[k] for k in pick.tolist()]
        return Lines(numbers, offsets, lines, ends, [self.muted] * len(numbers))

    def _few(self, data: bytes) -> Lines:
        """Of at most so many bytes as a line may have, the lines that hold the literal; the others are only counted."""
        literal, numbers, offsets, lines, ends = self.o.literal, [], [], [], []
        number, start = self.number, 0  # of the line that begins there
        at = data.find(literal)
        while at >= 0:
            number += data.count(b"\n", start, at)
            start = data.rfind(b"\n", start, at) + 1 or start
            stop = data.find(b"\n", at)
            numbers.append(number)
            offsets.append(self.offset + start)
            lines.append(data[start:stop] if stop >= 0 else data[start:])
            ends.append(b"\n" if stop >= 0 else b"")
            at = data.find(literal, stop) if stop >= 0 else -1
        self.number += data.count(b"\n") + (not data.endswith(b"\n"))
        self.offset += len(data)
        return Lines(np.array(numbers, np.int64), np.array(offsets, np.int64), pa.array(lines, pa.binary()), ends, [self.muted] * len(lines))

    def _with_nuls(self, data: bytes) -> Lines:
        """NULs end lines too; the first one mutes."""
        raw = np.frombuffer(data, np.uint8)
        stops = np.flatnonzero((raw == 10) | (raw == 0))
        nul = raw[stops] == 0
        ends = [b"\0" if x else b"\n" for x in nul.tolist()]
        if not len(stops) or stops[-1] < len(data) - 1:
            stops, nul = np.append(stops, len(data)), np.append(nul, False)
            ends.append(b"")
        starts = np.concatenate([[0], stops[:-1] + 1])
        if (stops - starts).max() > LINE_MOST:
            raise ReadError("SEARCH_FAILED", "a line is longer than 16 MiB")
        if self.binary is None and nul.any():
            self.binary = self.offset + int(stops[nul.argmax()])
        muted = np.full(len(stops), True) if self.muted else np.cumsum(nul) > 0
        self.muted = bool(muted[-1])
        numbers, offsets = self.number + np.arange(len(stops)), self.offset + starts
        lines = _binary(raw[(raw != 10) & (raw != 0)].tobytes(), np.concatenate([[0], np.cumsum(stops - starts)]))
        self.number, self.offset = self.number + len(stops), self.offset + len(data)
        if self.o.crlf:
            ended = pc.and_(pc.ends_with(lines, b"\r"), pa.array([e == b"\n" for e in ends]))
            lines = pc.if_else(ended, pc.binary_slice(lines, 0, -1), lines)
            ends = [b"\r\n" if x else e for x, e in zip(ended.to_pylist(), ends)]
        return Lines(numbers, offsets, lines, ends, muted.tolist())


def _holding(data: bytes, literal: bytes, stops: np.ndarray) -> np.ndarray:
    """Indexes of the lines, by their ends, that hold a literal."""
    out, at = [], data.find(literal)
    while at >= 0:
        k = int(np.searchsorted(stops, at))
        out.append(k)
        at = data.find(literal, int(stops[k]))
    return np.array(out, np.int64)


def _decoded(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes behind a UTF-8 mark; UTF-16 with a mark as UTF-8."""
    head = b""
    for chunk in chunks:
        head += chunk
        if len(head) >= 3:
            break
    kind = next((k for k, mark in MARKS if head.startswith(mark)), None)
    if kind == "utf-8":
        yield head[3:]
    elif kind:
        decoder = getincrementaldecoder(kind)("replace")
        yield decoder.decode(head[2:]).encode()
        for chunk in chunks:
            yield decoder.decode(chunk).encode()
        yield decoder.decode(b"", True).encode()
    else:
        yield head
    yield from chunks


def lines_of(chunks: Iterator[bytes], index: int, o: Options, search: Selection | None = None, cutter: _Cutter | None = None) -> Iterator[tuple]:
    """A member's lines in blocks, or what is wanted of them, then where it turned out binary and how much it was.

    ``cutter`` goes on inside a member, where no mark can stand.
    """
    if search:
        search.member()
        if search.done:
            return
    left = o.left() is not None
    first = cutter is None or not cutter.offset
    chunks = _decoded(iter(chunks)) if cutter is None else iter(chunks)
    cutter, parts, held, fill = cutter or _Cutter(o), [], 0, FIRST_FILL

    def cut(last: bool):
        nonlocal first
        data = b"".join(parts)
        if first:
            cutter.first(data)
            first = False
        found = cutter.cut(data, last)
        if found and search:
            found = None if not len(found) else found if left else search.take(found)
        if found:
            yield "lines", index, int(found.numbers[0]), found

    try:
        for chunk in chunks:
            parts.append(chunk)
            held += len(chunk)
            if held >= fill:
                if held + len(cutter.rest) <= LINE_MOST and not first and not any(b"\n" in p or b"\0" in p for p in parts):
                    continue  # a long line is put together once
                yield from cut(False)
                parts, held, fill = [], 0, BATCH_BYTES
                if search and search.done:
                    break
        else:
            yield from cut(True)
    finally:  # what was found before a damage counts
        counts = list(search.counted(index)) if search else []
        if counts:
            yield from counts
    if cutter.binary is not None:
        yield "binary", index, cutter.binary
    yield "size", index, cutter.number - 1, cutter.offset


class _Diagnostics:
    """At most a hundred of either severity, and how many there were besides."""

    def __init__(self):
        self.n = {"error": 0, "note": 0}

    def __call__(self, severity: str, code: str, message: str, index=None) -> Iterator[tuple]:
        self.n[severity] += 1
        if self.n[severity] <= DIAGNOSTICS_MOST:
            yield "diag", index, severity, code, message

    def rest(self) -> Iterator[tuple]:
        for severity, n in self.n.items():
            if n > DIAGNOSTICS_MOST:
                yield "diag", None, severity, "CAPPED_ERRORS" if severity == "error" else "CAPPED_NOTES", f"and {n - DIAGNOSTICS_MOST} more"


def _member(index: int, name: str, s: Stream, o: Options, diag: _Diagnostics, outer: str, search: Selection | None) -> Iterator[tuple]:
    """One member: at most one level of compression is taken off.  Returns whether it was read whole."""
    told = False
    codec, whole, inner = "", True, s
    try:
        head = s.peek(SNIFF_LENGTH)
        kind = sniff(head)
        if kind in CODECS:
            codec = kind
            inner = Stream(codecs.decode(kind, s))
            kind = sniff(inner.peek(SNIFF_LENGTH))
        yield "member", index, name, outer, codec
        told = True
        where = truncate_name(name) + ": " if name else ""
        if kind in CODECS and codec:
            yield from diag("error", "STILL_COMPRESSED", f"{where}still compressed after one level", index)
            whole = False
        elif kind.startswith("unreadable:"):
            yield from diag("error", "UNREADABLE_FORMAT", f"{where}a format that is not read: {kind.split(':')[1]}", index)
            whole = False
        else:
            if name and kind in ("zip", "tar"):
                yield from diag("note", "NESTED_ZIP" if kind == "zip" else "NESTED_TAR", f"{where}an archive inside an archive is searched as one binary", index)
            if o.lines:
                yield from lines_of(iter(inner), index, o, search)
        for _ in inner:  # to the checksum, whatever was searched
            pass
        if codec:
            for _ in s:
                pass
    except ReadError as e:
        if not told:
            yield "member", index, name, outer, codec
        code = e.code if e.code not in ("READ_FAILED", "SEARCH_FAILED") or not name else "MEMBER_FAILED"
        yield from diag("error", code, f"{truncate_name(name)}: {e}" if name else str(e), index)
        whole = False
        if e.code.startswith("TAR_"):
            raise
    return whole


def walk(f, size: int | None, o: Options, stream: bool = False, run: tuple[int, int, int] | None = None) -> Iterator[tuple]:
    """All events of one open binary file; ``stream``: it can't be sought.

    ``run`` (number, first, stop) walks these entries of a zip only.  The first
    run has the audit of the whole file; the others end with ("part", members
    seen, members searched) in place of ("end", ...).
    """
    globs = Globs(list(o.globs)) if o.globs else None
    diag = _Diagnostics()
    search = Selection(o.wanted) if o.wanted else None
    seen = read = 0
    unverified = None
    try:
        s = Stream(file_chunks(f))
        head = s.peek(SNIFF_LENGTH)
        kind = sniff(head)
        if kind == "plain" and size and not stream and zips.ends_as_zip(f, size):
            kind = "zip"
        elif kind == "plain" and not stream:
            f.seek(0)
            s = Stream(file_chunks(f))
        if kind == "zip":
            if stream:
                raise ReadError("ZIP_ON_PIPE", "a zip is read from its end, which a pipe does not have yet")
            z, failed = zips.Zip(f, size), 0
            for k, info in enumerate(z.members()):
                if run and not run[1] <= k < run[2]:
                    continue
                seen += 1
                if globs and not globs.match(info.filename):
                    continue
                whole = yield from _member(k, info.filename, Stream(_zip_chunks(z, info)), o, diag, "zip", search)
                read += whole
                failed = 0 if whole else failed + 1
                if failed >= zips.GAVE_UP:
                    yield from diag("error", "ZIP_GAVE_UP", "a thousand entries in a row could not be read")
                    break
            for e in z.audit() if not run or not run[0] else ():
                yield from diag("error", e.code, str(e))
        else:
            if kind.startswith("unreadable:"):
                raise ReadError("UNREADABLE_FORMAT", f"a format that is not read: {kind.split(':')[1]}")
            outer, body = kind, s
            if kind in CODECS:
                body = Stream(codecs.decode(kind, s))
                head = body.peek(SNIFF_LENGTH)
            if kind == "tar" or (kind == "plain" or kind in CODECS) and _is_tar(body):
                tar = Tar(body)
                for k, name in enumerate(tar):
                    seen += 1
                    if globs and not globs.match(name):
                        continue
                    whole = yield from _member(k, name, Stream(tar.content()), o, diag, "tar" if kind == "tar" else f"tar.{kind}", search)
                    read += whole
            else:
                inner = sniff(head) if kind in CODECS else "plain"
                seen = 1
                names = o.names
                if globs and names and not any(globs.match(n) for n in names):
                    seen = 0
                elif inner in CODECS:
                    yield "member", 0, "", outer, ""
                    yield from diag("error", "STILL_COMPRESSED", "still compressed after one level", 0)
                elif inner.startswith("unreadable:"):
                    raise ReadError("UNREADABLE_FORMAT", f"a format that is not read: {inner.split(':')[1]}")
                else:
                    yield "member", 0, "", outer, ""
                    if o.lines:
                        yield from lines_of(iter(body), 0, o, search)
                    read = 1
                if seen or kind in CODECS:
                    for _ in body:
                        pass
                if kind == "plain" and size is not None and seen and o.lines and body.offset < size:
                    yield from diag("error", "SHRANK", "the file got shorter while it was read", 0)
            unverified = "the format can't tell a whole stream from a cut one" if getattr(s, "unverified", False) else None
    except ReadError as e:
        yield from diag("error", e.code, str(e))
    except OSError as e:
        yield from diag("error", "OPEN_FAILED" if not seen else "READ_FAILED", str(e))
    yield from diag.rest()
    if run and run[0]:
        yield "part", seen, read
    else:
        yield "end", seen, read, unverified


def entry_runs(f, size: int, run_bytes: int) -> list[int] | None:
    """The first entries of runs of a zip that hold about so many packed bytes each, and the number of entries; None if it is no zip, or one run."""
    head = f.read(SNIFF_LENGTH)
    if sniff(head) != "zip" and not (sniff(head) == "plain" and zips.ends_as_zip(f, size)):
        return None
    try:
        packed = np.cumsum([info.compress_size for info in zips.Zip(f, size).members()])
    except ReadError:
        return None
    run = packed // run_bytes if len(packed) else packed
    firsts = np.flatnonzero(np.diff(run, prepend=-1)).tolist()
    return [*firsts, len(packed)] if len(firsts) > 1 else None


def splittable(f, size: int) -> bool:
    """Whether an input is lines from its first byte to its last, so that ranges of it can be read apart."""
    s = Stream(file_chunks(f))
    head = s.peek(SNIFF_LENGTH)
    return sniff(head) == "plain" and not any(head.startswith(mark) for _, mark in MARKS) and not zips.ends_as_zip(f, size) and not _is_tar(_reread(f))


def _reread(f) -> Stream:
    f.seek(0)
    return Stream(file_chunks(f))


def _between(f, start: int, stop: int) -> Iterator[bytes]:
    """The bytes from ``start`` to the end of the line that holds the byte before ``stop``."""
    f.seek(start)
    while start < stop - 1 and (chunk := f.read(min(CHUNK, stop - 1 - start))):
        start += len(chunk)
        yield chunk
    while chunk := f.read(CHUNK):
        end = chunk.find(b"\n") + 1
        yield chunk[:end] if end else chunk
        if end:
            return


def _beside(f, at: int, n: int, o: Options, search: Selection, before: bool, number: int) -> Lines | None:
    """The ``n`` lines before or behind a place where a line begins."""
    data, step = b"", CHUNK
    while data.count(b"\n") <= n:
        if before:
            start = max(0, at - step)
            f.seek(start)
            data = f.read(at - start)
            if not start:
                break
        else:
            f.seek(at)
            data = f.read(step)
            if len(data) < step:
                break
        if step > 2 * LINE_MOST and data.count(b"\n") <= 1:
            break  # lines of that length end the search anyway
        step *= 2
    if before and len(data) < at:
        data = data[data.find(b"\n") + 1 :]
    cutter = _Cutter(o)
    cutter.number, cutter.offset = number, at - len(data) if before else at
    found = cutter.cut(data, True)
    if not found:
        return None
    pick = np.arange(max(0, len(found) - n), len(found)) if before else np.arange(min(n, len(found)))
    found = found.taken(pick)
    if before:
        found = Lines(number - len(pick) + np.arange(len(pick)), *found[1:])
    return found if o.left() else search.take(found)


def walk_range(f, part: int, start: int, stop: int, size: int, o: Options) -> Iterator[tuple]:
    """One range of a plain input: the lines that begin in it, numbered from one, and its part in the input's figures.

    Where windows are asked for, the lines around the range are given as
    ("beside", index, ``Lines``).  ("range", part, lines, bytes, offset of a NUL, failed) comes last.
    """
    search, cutter = Selection(o.wanted), _Cutter(o)
    globs = Globs(list(o.globs)) if o.globs else None
    if globs and o.names and not any(globs.match(n) for n in o.names):
        if not part:
            yield "end", 0, 0, None
        return
    around = o.around if o.wanted.what == "whole" else 0
    n_bytes, failed = 0, False
    if not part:
        yield "member", 0, "", "plain", ""
    try:
        at = start
        if start:
            f.seek(start - 1)
            at = start - 1
            while at < stop - 1 and (chunk := f.read(min(CHUNK, stop - 1 - at))):
                feed = chunk.find(b"\n")
                at += feed + 1 if feed >= 0 else len(chunk)
                if feed >= 0:
                    break
            else:
                at = stop
        if at < stop:
            if around and at:
                found = _beside(f, at, around, o, search, True, 1)
                if found:
                    yield "beside", 0, found
            cutter.offset = at
            for e in lines_of(_between(f, at, stop), 0, o, search, cutter):
                if e[0] != "size":
                    yield e
            n_bytes = cutter.offset - at
            if around and not search.done:
                found = _beside(f, cutter.offset, around, o, search, False, cutter.number)
                if found:
                    yield "beside", 0, found
        now = f.seek(0, 2)
        if start <= now < stop and now < size:
            yield "diag", 0, "error", "SHRANK", "the file got shorter while it was read"
    except ReadError as e:
        failed = True
        yield "diag", None, "error", e.code, str(e)
    except OSError as e:
        failed = True
        yield "diag", None, "error", "READ_FAILED", str(e)
    yield "range", part, cutter.number - 1, n_bytes, cutter.binary, failed
    if not part:
        yield "end", 1, 1, None


def _zip_chunks(z: zips.Zip, info) -> Iterator[bytes]:
    yield from z.content(info)


def _is_tar(body: Stream) -> bool:
    """A tar, possibly behind up to a mebibyte of zero blocks."""
    size = 512
    while True:
        head = body.peek(size)
        zeros = len(head) - len(head.lstrip(b"\0"))
        start = zeros // 512 * 512
        if start > 1 << 20:
            return False
        if len(head) >= start + 512:
            return sniff(head[start : start + 512]) == "tar"
        if len(head) < size:
            return False  # no whole block is left
        size *= 2


def read_all(f, size: int | None = None, o: Options | None = None, stream: bool = False) -> list[tuple]:
    """All events in a list, for small inputs."""
    return list(walk(f, size, o or Options(), stream))


__all__ = ["CHUNK", "Options", "entry_runs", "lines_of", "read_all", "splittable", "walk", "walk_range"]

"""What a run prints, from its DataFrames in order."""

from __future__ import annotations

import base64
import json
import re
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.escapes import escape_bytes, escape_json, one_line
from .plans.search import MEMBER, Run

#: Colours of path, line number and match.
PATH, NUMBER, MATCH, RESET = b"\x1b[0m\x1b[35m", b"\x1b[0m\x1b[32m", b"\x1b[0m\x1b[1m\x1b[31m", b"\x1b[0m"


def _name(text: str, raw: bool) -> bytes:
    if not raw:
        text = text.replace("\r", "\\x0d").replace("\n", "\\x0a")
    return text.encode("utf-8", "surrogateescape")


def output(run: Run, escape: bool = False, raw_names: bool = False, color: bool = False) -> Iterator[bytes]:
    """Chunks of standard output in the run's mode, each as soon as its input is read and those before it are told; an empty chunk where the next may take a while."""
    s = run.spec
    clean = escape_bytes if escape else lambda b: b
    if s.mode == "quiet":
        return
    name = lambda r: clean(_name(_display(r, s.separator), raw_names))
    if s.mode == "list":
        for r in _told(run):
            if r is None:
                yield b""
            elif r["rec_type"] == "member":
                yield name(r) + b"\n"
    elif s.mode in ("files", "count"):
        yield from _counts(run, name)
    elif s.mode == "json":
        yield from _json(run, escape)
    else:
        yield from _lines(run, clean, name, color)


def _display(r: dict, separator: str) -> str:
    return r["archive"] + separator + r["member"] if r["member"] else r["archive"]


def _key(r: dict) -> tuple:
    return r["item_index"], r["member_index"]


def _told(run: Run) -> Iterator[dict | None]:
    """The run's rows, None after each input; the ranges of an input are put together as they come."""
    item, base, muted, gone, last = None, 0, False, False, None
    for batch in _by_part(run):
        if batch is None:
            yield None
            continue
        rows, end = batch
        first = True
        if rows and rows[0]["item_index"] != item:
            item, base, muted, gone, last = rows[0]["item_index"], 0, False, False, None
        for r in rows:
            if r["part"] is not None:
                if gone and r["rec_type"] not in ("member", "end") or r["rec_type"] == "binary" and muted:
                    continue
                if r["rec_type"] == "line":
                    r["line_no"] += base
                    r["muted"] |= muted
                    if first and last is not None and (run.spec.lines_before or run.spec.lines_after):
                        r["group_break"] = r["line_no"] - last > 1
                    first, last = False, r["line_no"]
            run.told_errors += r["rec_type"] == "diag" and r["severity"] == "error"
            yield r
        if end is not None:
            base, muted, gone = base + end["line_no"], muted or end["n"] is not None, gone or bool(end["muted"])


def _by_part(run: Run) -> Iterator[tuple[list[dict], dict | None] | None]:
    """Batches of rows, with the figures of a range in the last one of it; None after each segment that ends an input."""
    figures, part = None, None
    for rows in run.rows():
        if not rows:
            if figures is not None:
                yield [], figures
            yield None
            figures = None
            continue
        for r in rows:
            if r["rec_type"] == "range":
                figures = r
        yield [r for r in rows if r["rec_type"] != "range"], None


def _counts(run: Run, name) -> Iterator[bytes]:
    """A row a member with a match; the ranges of a plain input are one member."""
    s, held = run.spec, None
    for r in _told(run):
        if r is None:
            if held and held[3]:
                yield held[1] + (b":%d\n" % held[2] if s.mode == "count" else b"\n")
                held = None
            yield b""
        if r is None or r["kind"] != "match":
            continue
        n = r["n"] if s.only_matching and not s.invert else r["n_lines"]
        if held and held[0] == _key(r):
            held[2] += n
            continue
        if held:
            yield held[1] + (b":%d\n" % held[2] if s.mode == "count" else b"\n")
        held = [_key(r), name(r), n, r["part"] is None]
    if held:
        yield held[1] + (b":%d\n" % held[2] if s.mode == "count" else b"\n")


def standard(run: Run) -> DataFrame:
    """Standard output as rows (item_index, member_index, line_no, text, group_break), names on one line, without colours or escapes."""
    mark = F.when(F.col("kind") == "match", ":").otherwise("-")
    number = F.concat(F.col("line_no").cast("string"), mark) if run.spec.line_numbers else F.lit("")
    text = F.concat(one_line(F.col("display")), mark, number, F.col("line").cast("string"))
    return run.hits().filter("not muted").select(*MEMBER, "line_no", text.alias("text"), "group_break")


def _lines(run: Run, clean, name, color: bool) -> Iterator[bytes]:
    s = run.spec
    only = s.only_matching and not s.invert
    context = s.lines_before or s.lines_after
    previous, printed = None, False
    paint = (lambda b, c: c + b + RESET) if color else (lambda b, c: b)
    eol = b"\r\n" if s.crlf else b"\n"
    offsets: dict[tuple, int] = {}  # where members turned binary, until they are behind us
    hidden = None  # the member whose hits are not shown

    def notice() -> Iterator[bytes]:
        nonlocal hidden
        if hidden is not None:
            yield name(hidden) + b': binary file matches (found "\\0" byte around offset %d)\n' % offsets.pop(_key(hidden), 0)
            hidden = None

    for r in _told(run):
        if r is None:
            if hidden is not None and hidden["part"] is None:
                yield from notice()
            yield b""
            continue
        if r["rec_type"] == "binary":
            offsets.setdefault(_key(r), r["byte_offset"])
        if r["rec_type"] != "line":
            continue
        key = _key(r)
        if hidden is not None and _key(hidden) != key:
            yield from notice()
        if r["muted"]:
            hidden = r if r["kind"] == "match" else hidden
            continue
        if only and r["kind"] != "match":
            continue
        if context and (previous is not None and previous != key and printed or r["group_break"]):
            yield b"--" + eol
        previous, printed = key, True
        mark = b":" if r["kind"] == "match" else b"-"
        head = paint(name(r), PATH) + mark + (paint(b"%d" % r["line_no"], NUMBER) + mark if s.line_numbers else b"")
        ending = r["eol"] if r["eol"] and b"\n" in r["eol"] else b"\n"
        line, found = r["line"], [(a, z) for a, z in _spans(r) if a < z]
        if only:
            bodies = [paint(clean(line[a:z]), MATCH) for a, z in found]
        elif color and r["kind"] == "match" and found:
            edges = [0, *(x for span in found for x in span), len(line)]
            parts = [clean(line[a:z]) for a, z in zip(edges, edges[1:])]
            bodies = [b"".join(paint(x, MATCH) if k % 2 else x for k, x in enumerate(parts))]
        else:
            bodies = [clean(line)]
        for body in bodies:
            yield head + body + ending
            if s.spaced:
                yield ending
    yield from notice()


def _spans(r: dict) -> list[tuple[int, int]]:
    """Start and end of the matches in a row's line."""
    flat = r["spans"] or []
    return list(zip(flat[::2], flat[1::2]))


def _text(b: bytes) -> dict:
    try:
        return {"text": b.decode()}
    except UnicodeDecodeError:
        return {"bytes": base64.b64encode(b).decode()}


def _json(run: Run, escape: bool) -> Iterator[bytes]:
    """JSON lines: begin, match and context, end of every member with a match, then the summary."""
    s = run.spec

    def dump(x: dict) -> bytes:
        out = ((escape_json if escape else str)(json.dumps(x, ensure_ascii=False, separators=(",", ":"))) + "\n").encode("utf-8", "surrogateescape")
        total["bytes_printed"] += len(out)
        return out

    key, stats, total, began = None, None, {"bytes_printed": 0}, time.monotonic()
    offsets: dict[tuple, int] = {}

    def end():
        return dump({"type": "end", "data": {"path": _text(stats["path"]), "binary_offset": offsets.pop(key, None), "stats": {"matched_lines": stats["lines"], "matches": stats["matches"]}}})

    for r in _told(run):
        if r is None:
            yield b""
        elif r["rec_type"] == "binary":
            offsets.setdefault(_key(r), r["byte_offset"])
        if r is None or r["rec_type"] != "line":
            continue
        own, path = _key(r), _display(r, s.separator).encode("utf-8", "surrogateescape")
        if own != key:
            if stats:
                yield end()
            key, stats = own, {"path": path, "lines": 0, "matches": 0}
            yield dump({"type": "begin", "data": {"path": _text(path)}})
        line = r["line"]
        subs = [{"match": _text(line[a:z]), "start": a, "end": z} for a, z in _spans(r)] if r["kind"] == "match" else []
        stats["lines"] += r["kind"] == "match"
        stats["matches"] += len(subs)
        data = {"path": _text(path), "lines": _text(line + (r["eol"] or b"")), "line_number": r["line_no"], "absolute_offset": r["byte_offset"], "submatches": subs}
        yield dump({"type": r["kind"], "data": data})
    if stats:
        yield end()
    if s.max_count != 0:
        seconds = time.monotonic() - began
        elapsed = {"secs": int(seconds), "nanos": int(seconds % 1 * 1e9), "human": f"{seconds:.6f}s"}
        yield dump({"type": "summary", "data": {"elapsed_total": elapsed, "stats": run.verdict()["stats"] | dict(total) | {"elapsed": elapsed}}})


def one_line_message(text: str) -> str:
    return re.sub("[\r\n]", lambda m: "\\x0d" if m[0] == "\r" else "\\x0a", text)

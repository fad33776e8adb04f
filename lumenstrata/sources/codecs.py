"""Decompression of whole streams: every frame, every checksum, nothing silently short.

Concatenated streams are one; zero bytes behind a stream are padding; anything
else there must be another stream.  Each decoder is a generator of chunks that
raises ``ReadError`` where its input is damaged or ends too soon.
"""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Iterator

from . import lz4, lzw
from .sniff import LZ4_FRAME, LZ4_LEGACY, ZSTD, is_skippable
from .streams import CHUNK, ReadError, Stream

LIMIT = 1 << 20


def _padding(s: Stream) -> bool:
    """Skips zeros; True at the end of the input."""
    while True:
        head = s.peek(CHUNK)
        if not head:
            return True
        rest = head.lstrip(b"\0")
        s.read(len(head) - len(rest))
        if rest:
            return False


def _streams(s: Stream, make, step, name: str) -> Iterator[bytes]:
    first = True
    while not (_padding(s) if not first else False):
        d, first, data = make(), False, b""
        while not d.eof:
            if not data and not getattr(d, "needs_input", True):
                pass
            elif not data:
                data = s.chunk()
                if not data:
                    raise ReadError("READ_FAILED", f"{name}: the stream ends too soon")
            try:
                out, data = step(d, data)
            except (zlib.error, OSError, lzma.LZMAError, EOFError) as e:
                raise ReadError("READ_FAILED", f"{name}: {e}") from None
            if out:
                yield out
        s._buffer, s._at = d.unused_data + data + s._buffer[s._at :], 0


def _gzip_step(d, data):
    out = d.decompress(data, LIMIT)
    return out, b"" if d.eof else d.unconsumed_tail


def _plain_step(d, data):
    return d.decompress(data, LIMIT), b""


def gzip(s: Stream) -> Iterator[bytes]:
    return _streams(s, lambda: zlib.decompressobj(31), _gzip_step, "gzip")


def bzip2(s: Stream) -> Iterator[bytes]:
    return _streams(s, bz2.BZ2Decompressor, _plain_step, "bzip2")


def xz(s: Stream) -> Iterator[bytes]:
    return _streams(s, lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ), _plain_step, "xz")


def skip_frame(s: Stream) -> None:
    """Past one skippable frame."""
    head = s.read(8)
    left = int.from_bytes(head[4:8], "little")
    while left and len(head) == 8:
        got = s.read(min(left, CHUNK))
        if not got:
            break
        left -= len(got)
    if left or len(head) < 8:
        raise ReadError("SKIPPABLE_CUT", "the input ends inside a skippable frame")


def zstd(s: Stream) -> Iterator[bytes]:
    import zstandard

    first = True
    while first or not _padding(s):
        head = s.peek(4)
        if is_skippable(head):
            skip_frame(s)
            if first and s.peek(4) in (LZ4_FRAME, LZ4_LEGACY):  # only now can the two formats be told apart
                yield from lz4.decode(s)
                return
            first = first and bool(s.peek(1))
            continue
        first = False
        if head != ZSTD:
            raise ReadError("READ_FAILED", "zstd: bytes that are no frame")
        d = zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj()
        while not d.eof:
            data = s.read(8 << 10)
            if not data:
                raise ReadError("READ_FAILED", "zstd: the stream ends too soon")
            try:
                out = d.decompress(data)
            except zstandard.ZstdError as e:
                raise ReadError("READ_FAILED", f"zstd: {e}") from None
            if out:
                yield out
        s._buffer, s._at = d.unused_data + s._buffer[s._at :], 0


DECODERS = {"gzip": gzip, "bzip2": bzip2, "xz": xz, "zstd": zstd, "lz4": lz4.decode, "compress": lzw.decode}


def decode(codec: str, s: Stream) -> Iterator[bytes]:
    return DECODERS[codec](s)

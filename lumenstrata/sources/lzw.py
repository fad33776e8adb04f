"""The ``.Z`` format: LZW with codes of 9 to 16 bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .streams import ReadError, Stream

CLEAR = 256
#: Groups of eight codes that are taken apart at once.
GROUPS = 1024


def decode(s: Stream) -> Iterator[bytes]:
    head = s.read(3)
    if len(head) < 3:
        raise ReadError("READ_FAILED", "compress: the header is cut short")
    most, block = head[2] & 31, head[2] >> 7
    if not 9 <= most <= 16 or head[2] & 0x60:
        raise ReadError("READ_FAILED", "compress: unknown parameters")
    s.unverified = True  # nothing in the format tells a whole stream from a cut one
    base = [bytes([i]) for i in range(256)] + [b""] * block
    table, width, previous, out, size, full = list(base), 9, None, [], 0, 1 << most
    while True:
        # the table gets an entry a code but for the first, so what is left of a width is known
        left = (1 << width) - len(table) + (previous is None)
        groups = min(GROUPS, -(-left // 8)) if width < most else GROUPS
        data = s.peek(groups * width)
        every = _codes(data, width)
        if not len(every):
            s.read(len(data))
            break
        clear = np.flatnonzero(every == CLEAR) if block else ()
        stop = min(left if width < most else len(every), len(every), int(clear[0]) if len(clear) else len(every))
        cleared = len(clear) > 0 and stop == clear[0]
        s.read(min(len(data), -(-(stop + cleared) // 8) * width if cleared or stop < len(every) else len(data)))  # what a change of width leaves of eight codes is filling
        codes = every[:stop].tolist()
        n = len(out)
        previous = _entries(codes, table, full, previous, out)
        size += sum(map(len, out[n:]))
        if cleared:
            table, width, previous = list(base), 9, None
        elif len(table) >= 1 << width and width < most:
            width += 1
        if size >= 1 << 18:
            yield b"".join(out)
            out, size = [], 0
    yield b"".join(out)


def _codes(data: bytes, width: int) -> np.ndarray:
    n = len(data) * 8 // width
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(np.pad(bits, ((0, 0), (0, 16 - width))), bitorder="little").view("<u2")


def _entries(codes: list[int], table: list[bytes], full: int, previous: bytes | None, out: list[bytes]) -> bytes | None:
    """Appends what the codes stand for to ``out``, and to the table what they add to it; returns the last of it."""
    put, grow, at = out.append, table.append, 0
    if previous is None and codes:
        if codes[0] >= len(table):
            raise ReadError("READ_FAILED", "compress: a code before its entry")
        previous, at = table[codes[0]], 1
        put(previous)
    stop = at + full - len(table)
    for code in codes[at:stop]:
        if code < len(table):
            entry = table[code]
        elif code == len(table):
            entry = previous + previous[:1]
        else:
            raise ReadError("READ_FAILED", "compress: a code before its entry")
        grow(previous + entry[:1])
        put(entry)
        previous = entry
    if len(codes) > stop:  # the table is full
        out.extend(map(table.__getitem__, codes[stop:]))
        previous = out[-1]
    return previous


def encode(data: bytes, most: int = 16) -> bytes:
    """A ``.Z`` stream of ``data``; the table is not cleared once full."""
    out, at = [b"\x1f\x9d" + bytes([0x80 | most])], 0
    codes = np.array(_words(data, 1 << most), np.uint16)
    for width in range(9, most + 1):
        own = codes[at : at + (1 << width - 1) if width < most else None]  # the decoder's table grows one code later
        at += len(own)
        bits = np.unpackbits(own.astype("<u2").view(np.uint8), bitorder="little").reshape(len(own), 16)[:, :width]
        out.append(np.packbits(bits, bitorder="little").tobytes())
    return b"".join(out)


def _words(data: bytes, full: int) -> list[int]:
    """The codes of the longest words that the table has, which gets each with the byte behind it."""
    leaf: dict[int, int] = {}
    table = [leaf] * (CLEAR + 1)  # what each word's next bytes make of it
    out: list[int] = []
    put, free, bytes_ = out.append, CLEAR + 1, iter(data)
    word = next(bytes_, None)
    if word is None:
        return out
    for c in bytes_:
        longer = table[word].get(c)
        if longer is not None:
            word = longer
            continue
        put(word)
        if free < full:
            if table[word] is leaf:
                table[word] = {c: free}
            else:
                table[word][c] = free
            table.append(leaf)
            free += 1
        word = c
    put(word)
    return out

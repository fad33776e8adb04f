"""Deflate64: deflate with a window of 64 KiB, two more distance codes and a long length code."""

from __future__ import annotations

from collections.abc import Iterator

from .streams import ReadError

WINDOW = 1 << 16
#: The order in which lengths of the code length code are stored.
ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)
#: Lengths and distances as (least, extra bits): a code's extra bits grow by one every four, or two, codes; the last length code holds sixteen bits.
LENGTHS = [(3 + k, 0) for k in range(8)] + [(3 + ((4 + k % 4) << (k // 4 - 1)), k // 4 - 1) for k in range(8, 28)] + [(3, 16)]
DISTANCES = [(1 + k, 0) for k in range(4)] + [(1 + ((2 + k % 2) << (k // 2 - 1)), k // 2 - 1) for k in range(4, 32)]


class _Bits:
    """Bits of a stream of chunks, the lowest of each byte first."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.value, self.count = chunks, 0, 0

    def need(self, n: int) -> None:
        while self.count < n:
            chunk = next(self.chunks, None)
            if chunk is None:
                raise ReadError("ZIP_ENTRY", "the entry ends too soon")
            self.value |= int.from_bytes(chunk, "little") << self.count
            self.count += 8 * len(chunk)

    def take(self, n: int) -> int:
        self.need(n)
        out = self.value & ((1 << n) - 1)
        self.value >>= n
        self.count -= n
        return out


class _Code:
    """A prefix code by the lengths of its symbols; symbols are found by the next bits, as many as the longest has."""

    def __init__(self, lengths: list[int]):
        self.longest = max(lengths, default=0)
        if not self.longest:
            self.table: list[tuple[int, int] | None] = [None]
            return
        self.table = [None] * (1 << self.longest)
        code = 0
        for size in range(1, self.longest + 1):
            for symbol, own in enumerate(lengths):
                if own == size:
                    if code >> size:
                        raise ReadError("ZIP_ENTRY", "a code has too many symbols")
                    turned = int(f"{code:0{size}b}"[::-1], 2)  # codes stand with their highest bit first
                    for k in range(turned, len(self.table), 1 << size):
                        self.table[k] = (symbol, size)
                    code += 1
            code <<= 1

    def read(self, bits: _Bits) -> int:
        if bits.count < self.longest:
            try:
                bits.need(self.longest)
            except ReadError:
                pass  # the last symbol may be shorter than the longest one
        found = self.table[bits.value & ((1 << self.longest) - 1)]
        if found is None or found[1] > bits.count:
            raise ReadError("ZIP_ENTRY", "no such symbol")
        bits.value >>= found[1]
        bits.count -= found[1]
        return found[0]


def _dynamic(bits: _Bits) -> tuple[_Code, _Code]:
    n_lengths, n_distances, n_codes = 257 + bits.take(5), 1 + bits.take(5), 4 + bits.take(4)
    own = [0] * 19
    for k in ORDER[:n_codes]:
        own[k] = bits.take(3)
    code, lengths = _Code(own), []
    while len(lengths) < n_lengths + n_distances:
        symbol = code.read(bits)
        if symbol < 16:
            lengths.append(symbol)
        elif symbol == 16:
            if not lengths:
                raise ReadError("ZIP_ENTRY", "a repetition of nothing")
            lengths += lengths[-1:] * (3 + bits.take(2))
        else:
            lengths += [0] * (3 + bits.take(3) if symbol == 17 else 11 + bits.take(7))
    if len(lengths) > n_lengths + n_distances:
        raise ReadError("ZIP_ENTRY", "too many code lengths")
    return _Code(lengths[:n_lengths]), _Code(lengths[n_lengths:])


def inflate64(chunks: Iterator[bytes], piece: int = 256) -> Iterator[bytes]:
    """The bytes of a Deflate64 stream; memory of a window and a block of output."""
    small = (c[k : k + piece] for c in chunks for k in range(0, len(c), piece))  # long integers are slow to shift
    bits, out, given = _Bits(small), bytearray(), 0
    fixed = _Code([8] * 144 + [9] * 112 + [7] * 24 + [8] * 8), _Code([5] * 32)
    last = False
    while not last:
        last, kind = bool(bits.take(1)), bits.take(2)
        if kind == 3:
            raise ReadError("ZIP_ENTRY", "no such kind of block")
        if kind == 0:
            bits.take(bits.count % 8)
            size, other = bits.take(16), bits.take(16)
            if size ^ other != 0xFFFF:
                raise ReadError("ZIP_ENTRY", "a stored block with another length")
            for _ in range(size):
                out.append(bits.take(8))
        else:
            literals, distances = fixed if kind == 1 else _dynamic(bits)
            while (symbol := literals.read(bits)) != 256:
                if symbol < 256:
                    out.append(symbol)
                else:
                    if symbol > 285:
                        raise ReadError("ZIP_ENTRY", "no such length")
                    least, extra = LENGTHS[symbol - 257]
                    length = least + bits.take(extra)
                    least, extra = DISTANCES[distances.read(bits)]
                    distance = least + bits.take(extra)
                    if distance > len(out):
                        raise ReadError("ZIP_ENTRY", "a copy from before the start")
                    start = len(out) - distance
                    copied = out[start : start + min(length, distance)]
                    out += (copied * (length // len(copied) + 1))[:length]
                if len(out) > 4 * WINDOW:
                    yield bytes(out[given:-WINDOW])
                    del out[:-WINDOW]
                    given = 0
        if len(out) > 4 * WINDOW:
            yield bytes(out[given:-WINDOW])
            del out[:-WINDOW]
            given = 0
    yield bytes(out[given:])


__all__ = ["inflate64"]

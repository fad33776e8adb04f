"""LZ4 frames and legacy blocks, followed block by block so that a cut or trailing junk never passes."""

from __future__ import annotations

from collections.abc import Iterator

from .sniff import LZ4_FRAME, LZ4_LEGACY, is_skippable
from .streams import ReadError, Stream

#: A legacy block holds at most 8 MiB, which compresses to at most that and a 255th more.
LEGACY_MOST = (8 << 20) + (8 << 20) // 255 + 16


class _Frame:
    """A file-like view of exactly one frame of a stream."""

    def __init__(self, s: Stream):
        self.s, self.queue, self.state, self.closed = s, b"", "header", False

    def _take(self, n: int) -> bytes:
        got = self.s.read(n)
        if len(got) < n:
            raise ReadError("LZ4_CUT", "lz4: the input ends inside a frame")
        return got

    def _more(self) -> bytes:
        if self.state == "header":
            head = self._take(6)
            flags = head[4]
            head += self._take(8 * (flags >> 3 & 1) + 4 * (flags & 1) + 1)
            self.block_sum, self.content_sum, self.state = flags >> 4 & 1, flags >> 2 & 1, "blocks"
            return head
        size = self._take(4)
        n = int.from_bytes(size, "little") & 0x7FFFFFFF
        if size == bytes(4):
            self.state = "end"
            return size + self._take(4 * self.content_sum)
        if n > 8 << 20:
            raise ReadError("READ_FAILED", "lz4: a block larger than any block size")
        return size + self._take(n + 4 * self.block_sum)

    def read(self, n: int = -1) -> bytes:
        while self.state != "end" and (n < 0 or len(self.queue) < n):
            self.queue += self._more()
        if n < 0:
            n = len(self.queue)
        out, self.queue = self.queue[:n], self.queue[n:]
        return out

    def readable(self):
        return True

    def close(self):
        self.closed = True


def raw_size(block: bytes) -> int:
    """Output bytes of a raw block, by its tokens."""
    i, out, n = 0, 0, len(block)
    try:
        while True:
            token = block[i]
            i += 1
            lit = token >> 4
            if lit == 15:
                while block[i] == 255:
                    lit += 255
                    i += 1
                lit += block[i]
                i += 1
            out, i = out + lit, i + lit
            if i == n:
                return out
            if i > n:
                raise IndexError
            i += 2
            match = (token & 15) + 4
            if token & 15 == 15:
                while block[i] == 255:
                    match += 255
                    i += 1
                match += block[i]
                i += 1
            out += match
    except IndexError:
        raise ReadError("READ_FAILED", "lz4: a damaged block") from None


def decode(s: Stream) -> Iterator[bytes]:
    """All frames of a stream; skippable ones may stand before and between."""
    import pyarrow as pa

    from .codecs import skip_frame

    while True:
        head = s.peek(4)
        if not head:
            return
        if is_skippable(head):
            skip_frame(s)
        elif head == LZ4_FRAME:
            frame = _Frame(s)
            try:
                with pa.CompressedInputStream(pa.PythonFile(frame, "r"), "lz4") as f:
                    while chunk := f.read(1 << 18):
                        yield chunk
                frame.read()
            except OSError as e:
                raise ReadError("READ_FAILED", f"lz4: {e}") from None
        elif head == LZ4_LEGACY:
            s.read(4)
            codec = pa.Codec("lz4_raw")
            while True:
                size = s.peek(4)
                if not size or size in (LZ4_FRAME, LZ4_LEGACY) or is_skippable(size):
                    break
                n = int.from_bytes(size, "little")
                if len(size) < 4:
                    raise ReadError("LZ4_CUT", "lz4: the input ends inside a block's length")
                if n > LEGACY_MOST:
                    raise ReadError("LZ4_JUNK", "lz4: bytes that are no frame after the last one")
                s.read(4)
                block = s.read(n)
                if len(block) < n:
                    raise ReadError("LZ4_CUT", "lz4: the input ends inside a block")
                want = raw_size(block)
                try:
                    yield codec.decompress(block, want).to_pybytes() if want else b""
                except OSError as e:
                    raise ReadError("READ_FAILED", f"lz4: {e}") from None
            s.unverified = not s.peek(1)  # a legacy frame has no end mark
        else:
            raise ReadError("LZ4_JUNK", "lz4: bytes that are no frame after the last one")

"""Buffered byte streams over generators of chunks, and the errors that reading raises."""

from __future__ import annotations

from collections.abc import Iterator

CHUNK = 64 << 10


class ReadError(Exception):
    """Something was not read; ``code`` is its place in the catalogue of diagnostics."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class Stream:
    """Reads, peeks and pushes back over an iterator of byte strings."""

    def __init__(self, chunks: Iterator[bytes]):
        self._chunks, self._buffer, self._at, self.offset = iter(chunks), b"", 0, 0

    def _fill(self, n: int) -> None:
        parts, have = [self._buffer[self._at :]], len(self._buffer) - self._at
        while have < n:
            chunk = next(self._chunks, None)
            if chunk is None:
                break
            parts.append(chunk)
            have += len(chunk)
        self._buffer, self._at = b"".join(parts), 0

    def peek(self, n: int) -> bytes:
        """The next ``n`` bytes, fewer only at the end."""
        if len(self._buffer) - self._at < n:
            self._fill(n)
        return self._buffer[self._at : self._at + n]

    def read(self, n: int) -> bytes:
        out = self.peek(n)
        self._at += len(out)
        self.offset += len(out)
        return out

    def chunk(self) -> bytes:
        """Whatever is at hand, at least a byte unless at the end."""
        if self._at == len(self._buffer):
            self._buffer, self._at = b"", 0
            for chunk in self._chunks:
                if chunk:
                    self._buffer = chunk
                    break
        out = self._buffer[self._at : self._at + CHUNK]
        self._at += len(out)
        self.offset += len(out)
        return out

    def __iter__(self) -> Iterator[bytes]:
        while chunk := self.chunk():
            yield chunk


def file_chunks(f, size: int = CHUNK) -> Iterator[bytes]:
    while chunk := f.read(size):
        yield chunk

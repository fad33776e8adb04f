"""Files of a store by their URIs, read in ranges through a bounded cache.

Stores that Arrow knows (``file``, ``s3``, ``gs``, ``abfs``, ``hdfs``) are opened by the
task that walks the input, which then needs a few blocks of memory whatever the
size.  A zip is read from its tail on; what lies between its entries is not fetched.
"""

from __future__ import annotations

import io
import re
from collections import OrderedDict
from functools import lru_cache

from pyarrow import fs

BLOCK, BLOCKS = 1 << 20, 8


@lru_cache(maxsize=64)
def _store(root: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(root)[0]


def _located(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI and the path in it; Hadoop's names of a scheme are taken for Arrow's."""
    uri = re.sub(r"^s3[an]:", "s3:", uri)
    uri = re.sub(r"^abfss:", "abfs:", uri)
    scheme, _, rest = uri.partition(":")
    path = "/" + rest.lstrip("/") if scheme == "file" else rest.lstrip("/")
    if scheme == "file":
        return _store("file:///"), path
    host, _, below = path.partition("/")
    store = _store(f"{scheme}://{host}/")
    return store, "/" + below if scheme == "hdfs" else path


class Ranged(io.RawIOBase):
    """A seekable file over fetched blocks, the last few of which are kept; ``fetched`` counts their bytes."""

    def __init__(self, uri: str):
        store, path = _located(uri)
        self._file = store.open_input_file(path)
        self.size, self._at, self.fetched = self._file.size(), 0, 0
        self._blocks: OrderedDict[int, bytes] = OrderedDict()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self._at = max(0, offset + (0, self._at, self.size)[whence])
        return self._at

    def tell(self) -> int:
        return self._at

    def _block(self, k: int) -> bytes:
        if k not in self._blocks:
            if len(self._blocks) >= BLOCKS:
                self._blocks.popitem(last=False)
            self._blocks[k] = self._file.read_at(min(BLOCK, self.size - k * BLOCK), k * BLOCK)
            self.fetched += len(self._blocks[k])
        self._blocks.move_to_end(k)
        return self._blocks[k]

    def readinto(self, buffer) -> int:
        if self._at >= self.size:
            return 0
        k, inside = divmod(self._at, BLOCK)
        part = self._block(k)[inside : inside + len(buffer)]
        buffer[: len(part)] = part
        self._at += len(part)
        return len(part)

    def close(self) -> None:
        if not self.closed:
            self._file.close()
        super().close()


def reachable(uri: str) -> bool:
    """Whether Arrow opens the store that holds a file."""
    try:
        store, path = _located(uri)
        return store.get_file_info(path).is_file
    except Exception:  # not built in, no credentials, unknown scheme: Spark's own reader remains
        return False


def created(uri: str):
    """A new file of a store, to be written."""
    store, path = _located(uri)
    return store.open_output_stream(path)


def opened(path: str):
    """A local path or a URI as an open binary file."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path):
        return io.BufferedReader(Ranged(path), 64 << 10)
    return open(path, "rb")


__all__ = ["Ranged", "created", "opened", "reachable"]

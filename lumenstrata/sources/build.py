"""Archives from members, in every format that the readers read but the unreadable ones."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile

from . import lzw


def tar(members, **options) -> bytes:
    """A tar of (name, bytes) members."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", **options) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def zip_(members, method: int = zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def legacy_lz4(data: bytes, step: int = 1 << 20) -> bytes:
    """Blocks behind the legacy magic, without an end mark."""
    import pyarrow as pa

    codec, out = pa.Codec("lz4_raw"), b"\x02\x21\x4c\x18"
    for i in range(0, len(data), step):
        block = codec.compress(data[i : i + step], asbytes=True)
        out += len(block).to_bytes(4, "little") + block
    return out


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.compress(data)


def _lz4(data: bytes) -> bytes:
    import pyarrow as pa

    return pa.compress(data, codec="lz4", asbytes=True)


CODECS = {"gz": gzip.compress, "bz2": bz2.compress, "xz": lzma.compress, "zst": _zstd, "lz4": _lz4, "Z": lzw.encode, "lz4l": legacy_lz4}


def archive(members, kind: str) -> bytes:
    """``tar``, ``zip`` or ``tar.<codec>``."""
    if kind == "zip":
        return zip_(members)
    t = tar(members)
    return CODECS[kind.removeprefix("tar.")](t) if kind != "tar" else t

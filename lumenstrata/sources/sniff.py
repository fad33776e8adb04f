"""The format of a stream by its first bytes, never by its name."""

from __future__ import annotations

import stat
import struct
from collections.abc import Callable

from .tar import is_tar_header

SNIFF_LENGTH = 512
CODECS = ("gzip", "compress", "zstd", "lz4", "xz", "bzip2")
#: First bytes by format.
ZSTD, LZ4_FRAME, LZ4_LEGACY = b"\x28\xb5\x2f\xfd", b"\x04\x22\x4d\x18", b"\x02\x21\x4c\x18"
MAGICS = {
    "gzip": (b"\x1f\x8b",), "compress": (b"\x1f\x9d",), "zip": (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08"), "zstd": (ZSTD,), "lz4": (LZ4_FRAME, LZ4_LEGACY), "xz": (b"\xfd7zXZ\x00",),
    "unreadable:lzip": (b"LZIP\x00", b"LZIP\x01"), "unreadable:7z": (b"7z\xbc\xaf\x27\x1c",), "unreadable:rar": (b"Rar!\x1a\x07",), "unreadable:lzop": (b"\x89LZO\x00\r\n\x1a\n",),
}
#: What follows the level digit of a bzip2 stream, a block or the end.
BZIP2_MARKS = (b"\x31\x41\x59\x26\x53\x59", b"\x17\x72\x45\x38\x50\x90")
#: Magic of skippable frames, whose last four bits are free.
SKIPPABLE = 0x184D2A50
#: Text forms of cpio: magic, digits of a number, bytes of a header.
CPIO_TEXT = {b"070707": (b"01234567", 76), b"070701": (b"0123456789abcdefABCDEF", 110), b"070702": (b"0123456789abcdefABCDEF", 110)}
#: File types that a cpio entry can have.
FILE_TYPES = {stat.S_IFIFO, stat.S_IFCHR, stat.S_IFDIR, stat.S_IFBLK, stat.S_IFREG, stat.S_IFLNK, stat.S_IFSOCK}
#: Dictionary sizes that encoders of the bare LZMA form write: powers of two from 64 KiB, and those and a half.
LZMA_DICTIONARIES = {x for n in range(16, 32) for x in (1 << n, 3 << n >> 1)}


def is_skippable(head: bytes) -> bool:
    return len(head) >= 4 and struct.unpack_from("<I", head)[0] & ~0xF == SKIPPABLE


def _magic(kind: str) -> Callable[[bytes], str | None]:
    return lambda head: kind if head.startswith(MAGICS[kind]) else None


def _skippable(head: bytes) -> str | None:
    """Skippable frames belong to zstd and lz4; what stands behind them tells which, as far as it can be seen."""
    if not is_skippable(head):
        return None
    while is_skippable(head) and len(head) >= 8:
        head = head[8 + struct.unpack_from("<I", head, 4)[0] :]
    return _magic("lz4")(head) or "zstd"


def _bzip2(head: bytes) -> str | None:
    return "bzip2" if head[:3] == b"BZh" and b"1" <= head[3:4] <= b"9" and head[4:].startswith(BZIP2_MARKS) else None


def _tar(head: bytes) -> str | None:
    return "tar" if is_tar_header(head) else None


def _cpio(head: bytes) -> str | None:
    """Text forms are all digits up to the name; the binary form is thirteen words in either order, then the name."""
    digits, length = CPIO_TEXT.get(head[:6], (b"", 0))
    if length and len(head) >= length and not head[:length].strip(digits):
        return "unreadable:cpio"
    for order in "<>":
        if len(head) < 26 or struct.unpack_from(f"{order}H", head)[0] != 0o070707:
            continue
        _, _, _, mode, *_, n_name, _, _ = struct.unpack_from(f"{order}13H", head)
        name = head[26 : 26 + n_name]
        if stat.S_IFMT(mode) in FILE_TYPES and n_name and name.find(b"\0") == n_name - 1:
            return "unreadable:cpio"
    return None


def _lzma(head: bytes) -> str | None:
    """The bare form: usual properties, dictionary size, size (or all ones), and the range coder's first byte, a zero."""
    if len(head) < 14:
        return None
    properties, dictionary, size, coder = struct.unpack_from("<BIQB", head)
    usual = properties == 0x5D and dictionary in LZMA_DICTIONARIES and coder == 0
    return "unreadable:lzma" if usual and (size == 2**64 - 1 or size < 2**40) else None


#: In the order in which they are tried.
CHECKS = (
    *map(_magic, ("gzip", "compress", "zip", "zstd", "lz4")), _skippable, _magic("xz"), _bzip2, _tar,
    *map(_magic, ("unreadable:lzip", "unreadable:7z", "unreadable:rar", "unreadable:lzop")), _cpio, _lzma,
)


def sniff(head: bytes) -> str:
    """gzip, compress, zip, zstd, lz4, xz, bzip2, tar, unreadable:<kind> or plain."""
    return next((kind for check in CHECKS if (kind := check(head))), "plain")

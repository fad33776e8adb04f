import gzip
import io
import json
import os
import sys

import pytest
from fixtures import archives, tar, zip_

from lumenstrata import cli
from lumenstrata.plans.search import search
from lumenstrata.plans.spec import Usage, parse
from lumenstrata.sources import archive
from lumenstrata.sources.resolve import resolve

LOG = b"a\nNEEDLE one\nb\nc\nneedle two\nd\n"


@pytest.fixture
def run(spark, capsysbinary, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)

    def go(*args):
        code = cli.main(list(args), spark)
        got = capsysbinary.readouterr()
        return code, got.out.decode("utf-8", "surrogateescape"), got.err.decode()

    return go


def put(path, data: bytes):
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_modes(run):
    put("x.tgz", gzip.compress(tar([("a.log", LOG), ("b.log", b"none\n")])))
    assert run("NEEDLE", "x.tgz") == (0, "x.tgz:a.log:2:NEEDLE one\n", "")
    assert run("-i", "-N", "needle", "x.tgz")[1] == "x.tgz:a.log:NEEDLE one\nx.tgz:a.log:needle two\n"
    assert run("-ic", "needle", "x.tgz")[1] == "x.tgz:a.log:2\n"
    assert run("-il", "needle", "x.tgz")[1] == "x.tgz:a.log\n"
    assert run("-q", "needle", "x.tgz")[:2] == (0, "")
    assert run("absent", "x.tgz")[:2] == (1, "")
    assert run("-io", "needle", "x.tgz")[1] == "x.tgz:a.log:2:NEEDLE\nx.tgz:a.log:5:needle\n"
    assert run("-A1", "-B1", "-i", "needle", "x.tgz")[1] == "x.tgz:a.log-1-a\nx.tgz:a.log:2:NEEDLE one\nx.tgz:a.log-3-b\nx.tgz:a.log-4-c\nx.tgz:a.log:5:needle two\nx.tgz:a.log-6-d\n"
    assert run("-i", "-A1", "-m1", "needle", "x.tgz")[1] == "x.tgz:a.log:2:NEEDLE one\nx.tgz:a.log-3-b\n"
    assert run("-m0", "needle", "x.tgz")[:2] == (1, "")
    assert run("-T", "x.tgz") == (0, "x.tgz:a.log\nx.tgz:b.log\n", "")
    assert run("--archive-sep", "!", "-l", "NEEDLE", "x.tgz")[1] == "x.tgz!a.log\n"
    assert run("--spaced", "NEEDLE", "x.tgz")[1] == "x.tgz:a.log:2:NEEDLE one\n\n"


def test_separators_between_members(run):
    put("x.zip", zip_([("a", b"NEEDLE\nx\ny\nNEEDLE\n"), ("b", b"NEEDLE\n")]))
    assert run("-A1", "NEEDLE", "x.zip")[1] == "x.zip:a:1:NEEDLE\nx.zip:a-2-x\n--\nx.zip:a:4:NEEDLE\n--\nx.zip:b:1:NEEDLE\n"


@pytest.mark.parametrize("kind", ["tar", "zip", "tar.gz", "tar.zst", "tar.lz4", "tar.Z"])
def test_verdicts_by_format(run, kind):
    put("x", archives([("a.log", LOG)])[kind])
    assert run("NEEDLE", "x")[:2] == (0, "x:a.log:2:NEEDLE one\n")
    assert run("absent", "x")[0] == 1


def test_partial(run):
    whole = gzip.compress(tar([("a.log", LOG), ("b.log", os.urandom(5000))]))
    put("cut.tgz", whole[: len(whole) // 2])
    put("ok.log", LOG)
    code, out, err = run("NEEDLE", "cut.tgz", "ok.log")
    assert code == 2 and out == "cut.tgz:a.log:2:NEEDLE one\nok.log:2:NEEDLE one\n" and "cut.tgz" in err
    assert run("NEEDLE", "missing")[0] == 2
    os.mkdir("empty")
    assert run("NEEDLE", "empty")[0] == 2
    assert run("-m0", "NEEDLE", "cut.tgz")[0] == 2
    assert run("(", "ok.log")[0] == 2
    put("e.tar", bytes(10240))
    assert run("NEEDLE", "e.tar")[0] in (1, 0)


def test_globs(run):
    put("d/x.tgz", gzip.compress(tar([("logs/a.log", LOG), ("logs/b.txt", LOG)])))
    put("d/y.log", LOG)
    assert run("-g", "*.txt", "-l", "NEEDLE", "d/x.tgz")[1] == "d/x.tgz:logs/b.txt\n"
    assert run("-g", "*.txt", "-g", "!*b*", "-l", "NEEDLE", "d/x.tgz")[0] == 2
    assert run("--archive-glob", "*.tgz", "-l", "NEEDLE", "d")[1] == "d/x.tgz:logs/a.log\nd/x.tgz:logs/b.txt\n"
    assert run("--archive-glob", "*.nope", "-l", "NEEDLE", "d")[0] == 2
    assert run("-g", "*.log", "-l", "NEEDLE", "d")[1] == "d/x.tgz:logs/a.log\nd/y.log\n"


def test_binary_notice(run):
    put("b", b"NEEDLE\nbin\0ary\n")
    assert run("NEEDLE", "b") == (0, 'b: binary file matches (found "\\0" byte around offset 10)\n', "")
    assert run("-a", "NEEDLE", "b")[1] == "b:1:NEEDLE\n"
    assert run("-c", "NEEDLE", "b")[1] == "b:1\n"


def test_runs_of_zeros_are_no_long_line(run):
    put("b", b"NEEDLE\n" + bytes(17 << 20) + b"NEEDLE\n")
    code, out, err = run("-c", "NEEDLE", "b")
    assert (code, out, err) == (0, "b:2\n", "")
    assert run("absent", "b")[0] == 1


def test_json(run):
    put("x.zip", zip_([("a", "é NEEDLE NEEDLE\nx\n".encode()), ("b", b"\xff NEEDLE\n")]))
    code, out, _ = run("--json", "NEEDLE", "x.zip")
    rows = [json.loads(x) for x in out.splitlines()]
    assert code == 0 and [r["type"] for r in rows] == ["begin", "match", "end", "begin", "match", "end", "summary"]
    assert rows[1]["data"]["submatches"] == [{"match": {"text": "NEEDLE"}, "start": 3, "end": 9}, {"match": {"text": "NEEDLE"}, "start": 10, "end": 16}]
    assert rows[1]["data"]["path"] == {"text": "x.zip:a"} and rows[1]["data"]["absolute_offset"] == 0 and "bytes" in rows[4]["data"]["lines"]
    assert rows[-1]["data"]["stats"]["searches"] == 2 and rows[-1]["data"]["stats"]["matches"] == 3


def test_spans_are_those_of_the_bytes(run):
    """Submatches and matched parts as the engine found them, whatever stands around them."""
    put("x.log", b"other the end\naab a\nGET /NEEDLE?q=\xff\xfe\n\xc3\xa9 the\xc3\xa9 the\n")

    def subs(*args):
        rows = [json.loads(x) for x in run("--json", *args, "x.log")[1].splitlines()]
        return {r["data"]["line_number"]: [(m["start"], m["end"]) for m in r["data"]["submatches"]] for r in rows if r["type"] == "match"}

    assert subs("-w", "the") == {1: [(6, 9)], 4: [(9, 12)]}
    assert subs("a$") == {2: [(4, 5)]}
    assert subs("^|b") == {1: [(0, 0)], 2: [(0, 0), (2, 3)], 3: [(0, 0)], 4: [(0, 0)]}
    assert subs("NEEDLE.*") == {3: [(5, 14)]}
    raw(run, ["-o", "-N", "NEEDLE.{3}", "x.log"], b"x.log:NEEDLE?q=\n")
    raw(run, ["-o", "-N", "[^ ]+EEDLE(?s:.)*", "x.log"], b"x.log:/NEEDLE?q=\n")
    raw(run, ["-o", "-N", "(a+)+$", "x.log"], b"x.log:a\n")


def raw(run, args, want):
    assert run(*args)[1].encode("utf-8", "surrogateescape") == want


def test_matches_are_painted(run):
    put("x.log", b"a the b the\n")
    assert run("--color", "always", "-N", "the", "x.log")[1] == "\x1b[0m\x1b[35mx.log\x1b[0m:a \x1b[0m\x1b[1m\x1b[31mthe\x1b[0m b \x1b[0m\x1b[1m\x1b[31mthe\x1b[0m\n"
    assert run("--color", "always", "-o", "-N", "th", "x.log")[1] == "\x1b[0m\x1b[35mx.log\x1b[0m:\x1b[0m\x1b[1m\x1b[31mth\x1b[0m\n" * 2
    assert "\x1b" not in run("the", "x.log")[1]


def test_notes_stand_beside_matches(run):
    put("x.tar", tar([("in.zip", zip_([("a", b"x\n")])), ("b.log", LOG)]))
    code, out, err = run("NEEDLE", "x.tar")
    assert code == 0 and "x.tar:b.log:2:NEEDLE one" in out and "archive inside an archive" in err


def test_a_tar_behind_zeros(run):
    put("x.tar", bytes(512 * 2048) + tar([("a.log", LOG)]))
    assert run("NEEDLE", "x.tar")[:2] == (0, "x.tar:a.log:2:NEEDLE one\n")
    put("y.tar", bytes(512 * 2049) + tar([("a.log", LOG)]))
    assert "y.tar: binary file matches" in run("NEEDLE", "y.tar")[1]
    put("z.tar", bytes(700) + tar([("a.log", LOG)]))
    assert "binary file matches" in run("NEEDLE", "z.tar")[1]


def test_where_a_member_turns_binary_in_json(run):
    put("x.log", b"NEEDLE\n" + b"filler\n" * 20000 + b"\0 NEEDLE\n")
    ends = [json.loads(x)["data"] for x in run("--json", "NEEDLE", "x.log")[1].splitlines() if '"type":"end"' in x]
    assert [e["binary_offset"] for e in ends] == [7 + 7 * 20000]
    put("y.log", b"NEEDLE\n")
    ends = [json.loads(x)["data"] for x in run("--json", "NEEDLE", "y.log")[1].splitlines() if '"type":"end"' in x]
    assert [e["binary_offset"] for e in ends] == [None]


def test_answers_that_are_known_early(spark, tmp_path):
    """-l and -q give one row a member or input and stop matching there; damage behind it is still found."""
    whole = gzip.compress(tar([("a.log", b"NEEDLE\n" * 400_000), ("b.log", LOG), ("c.log", b"x\n")]))
    put(str(tmp_path / "x.tgz"), whole)
    for flag, members in (("-l", [0, 1]), ("-q", [0]), ("-c", [0, 1])):
        r = search(spark, parse([flag, "NEEDLE", str(tmp_path / "x.tgz")]))
        rows = r.table.filter("kind = 'match'").select("rec_type", "member_index", "n_lines").collect()
        assert sorted(x["member_index"] for x in rows) == members and {x["rec_type"] for x in rows} == {"hits"}
        assert [x["n_lines"] for x in sorted(rows, key=lambda x: x["member_index"])][0] == (400_000 if flag == "-c" else 1)
        assert r.verdict()["exit_code"] == 0
    put(str(tmp_path / "y.tgz"), whole[:-12])
    for flag in ("-l", "-q", "-c"):
        assert search(spark, parse([flag, "NEEDLE", str(tmp_path / "y.tgz")])).verdict()["exit_code"] == 2


def test_names_and_escapes(run):
    put("x.tar", tar([("new\nline\r", b"NEEDLE \x1b[1m\n")]))
    assert run("NEEDLE", "x.tar")[1] == "x.tar:new\\x0aline\\x0d:1:NEEDLE \x1b[1m\n"
    assert run("--escape", "always", "NEEDLE", "x.tar")[1] == "x.tar:new\\x0aline\\x0d:1:NEEDLE \\x1b[1m\n"
    assert run("--escape", "never", "-l", "NEEDLE", "x.tar")[1] == "x.tar:new\nline\r\n"


def test_stdin(run, monkeypatch):
    monkeypatch.setattr(sys, "stdin", type("S", (), {"buffer": io.BytesIO(gzip.compress(LOG))})())
    assert run("NEEDLE", "-")[:2] == (0, "<stdin>:2:NEEDLE one\n")


def test_standard_input_goes_where_tasks_see_it(run, spark, monkeypatch):
    from lumenstrata.plans.scratch import scratch_root

    monkeypatch.setattr(sys, "stdin", type("S", (), {"buffer": io.BytesIO(LOG)})())
    r = search(spark, parse(["NEEDLE", "-"]))
    assert r.resolved.items[0].path.startswith(scratch_root(spark).removeprefix("file://")) and r.hits().count() == 1
    path = r.resolved.items[0].path
    r.close()
    assert not os.path.exists(path)


def test_a_lost_task_is_no_success(run, monkeypatch):
    put("a.log", LOG)
    put("b.log", LOG)
    from lumenstrata.plans import segments

    def fails(self, df):
        from pyspark.errors import PySparkException

        self.error = PySparkException("a task failed four times\nand more")

    monkeypatch.setattr(segments.Segments, "_write", fails)
    code, out, err = run("NEEDLE", "a.log", "b.log")
    assert code == 2 and "WORKER_DIED" in err and "and more" not in err


def test_help_and_usage(run):
    assert run("--help")[0] == run("--examples")[0] == run("-V")[0] == 0
    for bad in (["-T", "-c", "x"], ["--spaced", "-c", "p", "x"], ["p"], [], ["--nope", "p", "x"], ["-m", "x", "p", "x"], ["--archive-sep", "ab", "p", "x"], ["--color", "x", "p", "f"]):
        with pytest.raises(Usage):
            parse(bad)
    assert parse(["-qlc", "--json", "p", "x"]).mode == "quiet" and parse(["-C2", "-A1", "p", "x"]).lines_before == 2
    assert parse(["--inflate", "auto", "--inflate-budget", "1M", "p", "x"]).warnings


def test_resolution(tmp_path):
    d = str(tmp_path / "d")
    put(d + "/b", b"x")
    put(d + "/a/.hidden", b"x")
    os.symlink(d, d + "/a/loop")
    os.link(d + "/b", d + "/c")
    os.symlink(d + "/none", d + "/broken")
    r = resolve([d + "/c", d, d + "/gone"])
    assert [i.path for i in r.items] == [d + "/c", d + "/a/.hidden"] and r.items[0].aliases == [d + "/b"]
    assert sorted(c for c, _ in r.errors) == ["PATH_MISSING", "WALK_ERROR", "WALK_ERROR"]


def test_all_readers_agree(spark, tmp_path, monkeypatch):
    put(str(tmp_path / "x.tgz"), gzip.compress(tar([("a.log", LOG)])))
    put(str(tmp_path / "y.zip"), zip_([("a.log", LOG)]))
    cols = ["rec_type", "member_index", "member", "line_no", "byte_offset", "line"]
    rows = lambda df: sorted(map(repr, df.select(cols).collect()))
    a, _ = archive.scan(spark, [str(tmp_path)])
    b, _ = archive.scan(spark, [f"file://{tmp_path}"])
    assert "binaryFile" not in b._jdf.queryExecution().toString() and rows(a) == rows(b)
    monkeypatch.setattr(archive, "reachable", lambda path: False)
    c, _ = archive.scan(spark, [f"file://{tmp_path}"])
    assert rows(a) == rows(c)
    out = archive.outcomes(a).filter("archive like '%x.tgz'").first()
    assert out["walked"] and out["members_seen"] == 1 and out["n_errors"] == 0
    assert spark.read.format("archive").load(str(tmp_path / "x.tgz")).filter("rec_type = 'line'").count() == 6


def test_ranged_files(tmp_path, monkeypatch):
    from lumenstrata.sources import ranged

    monkeypatch.setattr(ranged, "BLOCK", 1000)
    body = os.urandom(50_500)
    put(str(tmp_path / "a b"), body)
    f = ranged.opened(f"file://{tmp_path}/a b")
    assert f.read() == body and f.seek(-10, 2) == 50_490 and f.read(4) == body[50_490:50_494] and f.seek(999) == 999 and f.read(3) == body[999:1002]
    assert len(f.raw._blocks) <= ranged.BLOCKS
    monkeypatch.setattr(ranged, "BLOCK", 4096)
    entries = [(f"m{i}", os.urandom(20_000)) for i in range(200)]
    put(str(tmp_path / "z.zip"), zip_(entries))
    import zipfile

    g = ranged.opened(f"file:{tmp_path}/z.zip")
    with zipfile.ZipFile(g) as z:
        assert z.read("m77") == entries[77][1]
    assert g.raw.fetched < os.path.getsize(tmp_path / "z.zip") / 10
    assert ranged.reachable(f"file://{tmp_path}/z.zip") and not ranged.reachable(f"file://{tmp_path}/none") and not ranged.reachable("nosuch://x/y")


def test_a_large_file_of_a_store_takes_little_memory(tmp_path):
    """Three gibibytes behind a URI, most of them a hole, through the walker in a process of its own."""
    import subprocess

    path = tmp_path / "big.tar"
    head = tar([("a.log", LOG)])[:1024]
    import tarfile

    info = tarfile.TarInfo("hole.bin")
    info.size = 3 << 30
    with open(path, "wb") as f:
        f.write(head + info.tobuf(tarfile.USTAR_FORMAT))
        f.seek(len(head) + 512 + info.size)
        f.write(tar([("z.log", LOG)]))
    code = f"""
import resource
from lumenstrata.sources.ranged import opened
from lumenstrata.sources.walk import Options, walk
from lumenstrata.sources.matching import Wanted
f = opened("file://{path}")
n = [e[2] for e in walk(f, f.raw.size, Options(("*.log",), wanted=Wanted(("NEEDLE",), what="count"))) if e[0] in ("hits", "diag", "end")]
assert n == [1, 1, 2], n
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 500_000
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300)


def test_matches_of_the_first_lines(run):
    put("x.log", b"a a\na a a\nb\na\n")
    assert run("-c", "-o", "-m", "1", "a", "x.log")[1] == "x.log:2\n"
    assert run("-c", "-o", "-m", "2", "a", "x.log")[1] == "x.log:5\n"
    assert run("-c", "-o", "a", "x.log")[1] == "x.log:6\n" and run("-c", "-m", "2", "a", "x.log")[1] == "x.log:2\n"


def test_unverified_ends_are_noted(run):
    put("x.Z", archives([("a.log", LOG)])["tar.Z"])
    code, out, err = run("absent", "x.Z")
    assert (code, out) == (1, "") and "x.Z: the format can't tell" in err
    assert run("NEEDLE", "x.Z")[2] == ""
    put("y.gz", gzip.compress(b"x\n"))
    assert run("absent", "y.gz") == (1, "", "")


def test_byte_order_marks(run):
    put("a.log", b"\xef\xbb\xbfNEEDLE one\n")
    put("b.log", "x\nNEEDLE two\n".encode("utf-16"))
    assert run("^NEEDLE", "a.log", "b.log")[1] == "a.log:1:NEEDLE one\nb.log:2:NEEDLE two\n"


def test_lost_output(run, monkeypatch):
    put("a.log", LOG)
    monkeypatch.setattr(sys, "stdout", None)
    assert run("NEEDLE", "a.log")[0] == 2

    class Full(io.RawIOBase):
        def writable(self):
            return True

        def write(self, b):
            raise OSError(28, "No space left on device")

    monkeypatch.setattr(sys, "stdout", io.TextIOWrapper(io.BufferedWriter(Full())))
    code, _, err = run("NEEDLE", "a.log")
    assert code == 2 and "WRITE_FAILED" in err


def test_json_summary_has_all_figures(run):
    put("x.tgz", gzip.compress(tar([("a.log", LOG), ("b.log", b"none\n")])))
    events = [json.loads(x) for x in run("--json", "NEEDLE", "x.tgz")[1].splitlines()]
    stats = events[-1]["data"]["stats"]
    assert (stats["searches"], stats["searches_with_match"], stats["matched_lines"], stats["matches"], stats["bytes_searched"]) == (2, 1, 1, 1, len(LOG) + 5)
    assert stats["bytes_printed"] > 0 and "elapsed" in stats and "elapsed_total" in events[-1]["data"]


def test_an_input_is_opened_once_a_run(run, tmp_path):
    """Whatever is shown and told: a pipe that is written once is enough."""
    import threading

    os.mkfifo("pipe")
    data = gzip.compress(tar([("a.log", LOG * 50), ("b.log", b"none\n")]))

    def feed():
        with open("pipe", "wb") as f:
            f.write(data)

    for args, lines in ((["-B1", "NEEDLE"], 149), (["--json", "NEEDLE"], 53), (["-c", "NEEDLE"], 1)):
        t = threading.Thread(target=feed)
        t.start()
        code, out, err = run(*args, "pipe")
        t.join()
        assert (code, err, len(out.splitlines())) == (0, "", lines)


def test_paths_with_a_scheme(run, tmp_path):
    put("d/x.tgz", gzip.compress(tar([("a.log", LOG)])))
    put("d/cut.tgz", gzip.compress(tar([("a.log", LOG)]))[:-9])
    code, out, err = run("NEEDLE", f"file://{tmp_path}/d/x.tgz")
    assert code == 0 and out == f"file://{tmp_path}/d/x.tgz:a.log:2:NEEDLE one\n"
    code, out, err = run("-c", "NEEDLE", f"file://{tmp_path}/d")
    assert code == 2 and len(out.splitlines()) == 2 and "cut.tgz" in err
    assert run("NEEDLE", "--archive-glob", "x*", f"file://{tmp_path}/d")[0] == 0
    assert run("NEEDLE", f"file://{tmp_path}/none")[0] == 2


def test_context_of_lines_in_many_batches(spark, tmp_path):
    """Windows over the edges of Arrow batches, limits, and lines that a literal lets the reader leave out."""
    import random

    from lumenstrata.plans.search import search

    rng = random.Random(4)
    lines = [rng.choice(["x", "y NEEDLE", "z"] + ["filler"] * 9) for _ in range(40000)]
    put(str(tmp_path / "a.log"), "\n".join(lines).encode())
    for before, after, limit, invert in ((0, 0, None, False), (3, 2, None, False), (2, 0, 7, False), (0, 4, 1, False), (0, 0, 5, False), (1, 1, 3, True)):
        args = [*(["-B", str(before)] if before else []), *(["-A", str(after)] if after else []), *(["-m", str(limit)] if limit else []), *(["-v"] if invert else [])]
        got = {r["line_no"]: (r["kind"], r["group_break"]) for r in search(spark, parse([*args, "NEEDLE", str(tmp_path / "a.log")])).hits().collect()}
        hit = [("NEEDLE" in x) != invert for x in lines]
        kept = [k for k, h in enumerate(hit) if h][:limit]
        shown = sorted({j for k in kept for j in range(max(0, k - before), min(len(lines), k + after + 1))})
        want = {j + 1: ("match" if hit[j] else "context", bool((before or after) and i and j - shown[i - 1] > 1)) for i, j in enumerate(shown)}
        assert got == want, (before, after, limit, invert)

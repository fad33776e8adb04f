"""Growing files as a stream."""

import os

import pytest

from lumenstrata.operators.lines import Match
from lumenstrata.streaming.follow import follow, whole_lines


@pytest.fixture
def started(spark, tmp_path):
    queries = []

    def start(match=None):
        out = follow(spark, str(tmp_path / "logs"), match)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="100 milliseconds").start()
        queries.append(q)
        return q

    yield start
    for q in queries:
        q.stop()


def rows(spark, tmp_path, kind):
    df = spark.read.parquet(str(tmp_path / "out")).filter(f"rec_type = '{kind}'")
    return sorted((os.path.basename(r["archive"]), r["line_no"], bytes(r["line"])) if kind == "line" else (os.path.basename(r["archive"]), r["code"], r["exit_code"]) for r in df.collect())


def append(path, data):
    with open(path, "ab") as f:
        f.write(data)


def test_appended_lines_come_once(spark, tmp_path, started):
    os.mkdir(tmp_path / "logs")
    a, b = tmp_path / "logs" / "a.log", tmp_path / "logs" / "b.log"
    append(a, b"NEEDLE 1\nx\nhalf NEE")
    append(b, b"x\n")
    q = started(Match.of("NEEDLE"))
    q.processAllAvailable()
    assert rows(spark, tmp_path, "line") == [("a.log", 1, b"NEEDLE 1")]
    assert rows(spark, tmp_path, "verdict") == [("a.log", None, 0), ("b.log", None, 1)]
    append(a, b"DLE\nNEEDLE 4\n")
    q.processAllAvailable()
    want = [("a.log", 1, b"NEEDLE 1"), ("a.log", 3, b"half NEEDLE"), ("a.log", 4, b"NEEDLE 4")]
    assert rows(spark, tmp_path, "line") == want
    q.stop()
    append(a, b"\n" * 5 + b"NEEDLE 10\n")
    append(b, b"NEEDLE\n")
    q = started(Match.of("NEEDLE"))  # goes on where it stopped
    q.processAllAvailable()
    assert rows(spark, tmp_path, "line") == [*want, ("a.log", 10, b"NEEDLE 10"), ("b.log", 2, b"NEEDLE")]
    with open(b, "wb") as f:
        f.write(b"N\n")
    q.processAllAvailable()
    append(b, b"NEEDLE new\n")
    q.processAllAvailable()
    assert rows(spark, tmp_path, "diag") == [("b.log", "SHRANK", None)]
    assert rows(spark, tmp_path, "line")[-1] == ("b.log", 2, b"NEEDLE new")
    assert rows(spark, tmp_path, "verdict")[-1] == ("b.log", None, 2)


def test_all_lines_of_several_files(spark, tmp_path, started):
    os.mkdir(tmp_path / "logs")
    q, want = started(), []
    for turn in range(3):
        for k in range(5):
            append(tmp_path / "logs" / f"{k}.log", b"".join(b"%d %d\n" % (k, turn * 300 + i) for i in range(300)))
        q.processAllAvailable()
    want = [(f"{k}.log", i + 1, b"%d %d" % (k, i)) for k in range(5) for i in range(900)]
    assert rows(spark, tmp_path, "line") == sorted(want)


def test_where_whole_lines_end(tmp_path):
    for body, want in ((b"", 0), (b"abc", 0), (b"a\nb", 2), (b"a\n", 2), (b"\n" + b"x" * 200_000, 1)):
        (tmp_path / "f").write_bytes(body)
        assert whole_lines(str(tmp_path / "f"), len(body)) == want

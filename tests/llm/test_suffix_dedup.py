"""Removal of earlier byte strings against plain window sets."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from lumenstrata.llm import queries, suffix_dedup

SF = "/root/testdata/sf0.001"


def plain(rows, window=50):
    earliest: dict = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        if i is not None:
            for p in range(len(b) - window + 1):
                g = b[p : p + window]
                earliest[g] = min(i, earliest.get(g, i))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1) if i is not None else ():
            if earliest[b[p : p + window]] < i:
                gone[p : p + window] = b"\x01" * window
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_all_documents(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = found(queries.op12_suffix_dedup(spark, SF))
    assert got == plain(rows) and any(r[2] for r in got)


def odd_rows():
    rng = random.Random(9)
    line = lambda n: "".join(rng.choice("abcdefgh é日") for _ in range(n))
    passage, copy, long = line(200), line(300), line(40000)
    rows = [(5, None), (6, ""), (7, "x" * 49), (8, "x" * 50), (9, "x" * 51), (10, "y" * 400), (11, "y" * 120 + "z" + "y" * 70), (None, copy), (None, passage), (-3, copy[:100])]
    rows += [(20 + i, copy) for i in range(12)]  # exact copies
    rows += [(40 + i, line(rng.randrange(0, 90)) + passage + line(rng.randrange(0, 90))) for i in range(25)]  # one passage between other texts
    rows += [(70 + i, copy[: 10 * i] + "#" + copy[10 * i :]) for i in range(25)]  # near copies
    rows += [(100, passage * 4), (100, passage * 4), (100, "another " + passage), (101, passage * 3)]  # an id several times
    rows += [(200, long), (201, "start " + long + " end"), (202, long[:20000] + long[20001:]), (203, " ab" * 5000), (204, " ab" * 5000 + "."), (205, "\x00" * 60), (206, "\x00" * 60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("window, gram, part", [(50, 20, 4096), (50, 20, 2), (9, 4, 3), (5, 5, 100)])
def test_odd_rows(spark, monkeypatch, window, gram, part):
    if part == 2:  # cross every boundary of blocks, slices and sorted batches
        monkeypatch.setattr(suffix_dedup, "BLOCK", 97)
        monkeypatch.setattr(suffix_dedup, "SLICE", 400)
        monkeypatch.setattr(suffix_dedup, "SORTED", 300)
    rows = odd_rows()
    if window < 50:
        rows = [(i, t and t[:600]) for i, t in rows]
    df = spark.createDataFrame([(i, t, 1.0, "clash", 2) for i, t in rows], "doc_id long, text string, n_bytes double, whole string, row int").repartition(3)
    assert found(suffix_dedup.remove_earlier_bytes(df, window=window, gram=gram, part=part)) == plain(rows, window)


def test_no_rows(spark):
    assert suffix_dedup.remove_earlier_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert suffix_dedup.remove_earlier_bytes(spark.createDataFrame([(1, "short")], "doc_id int, text string")).collect()[0]["n_removed"] == 0


@pytest.mark.parametrize("window", [3, 8, 9, 20, 50])
def test_bucket_pointers_sort_every_window(window):
    rng = random.Random(window)
    texts = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(window, 3 * window))) for _ in range(60)] + [b"ab" * window] * 2 + [b"\xff" * (2 * window)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = b"".join(texts)
    order, group = suffix_dedup.sort_windows(np.frombuffer(data, np.uint8), first, window)
    starts = [int(f) + p for f, t in zip(first, texts) for p in range(len(t) - window + 1)]
    assert sorted(order.tolist()) == starts
    cut = [data[p : p + window] for p in order.tolist()]
    assert cut == sorted(cut)
    assert group.tolist() == [k for k in range(len(cut)) if not k or cut[k] != cut[k - 1]]


def test_every_window_has_one_anchor_and_equal_windows_the_same(monkeypatch):
    rng = random.Random(3)
    base = [bytes(rng.choice(b"abc") for _ in range(rng.choice([0, 10, 49, 50, 51, 300]))) for _ in range(60)]
    texts = base + [x[:200] + b"q" + x[100:] for x in base]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = b"".join(texts)
    for block in (1 << 18, 64):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        start, count, anchor = suffix_dedup.anchors(np.frombuffer(data, np.uint8), first)
        covered = [int(s) + k for s, n in zip(start, count) for k in range(n)]
        assert covered == [int(f) + p for f, t in zip(first, texts) for p in range(len(t) - 49)]
        by: dict = {}
        for s, n, a in zip(start.tolist(), count.tolist(), anchor.tolist()):
            for p in range(s, s + n):
                assert by.setdefault(data[p : p + 50], a) == a

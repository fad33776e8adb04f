"""Lines around hits, found in the reader over many members at once."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lumenstrata.plans.search import search
from lumenstrata.plans.select import shown_lines
from lumenstrata.plans.spec import parse
from lumenstrata.sources.walk import Options, _Cutter


def rows_of(members, before, after, limit):
    """Brute force: (input, member, line, kind, break) of the lines that are shown."""
    out = []
    for (item, member), hits in members:
        at = [k for k, h in enumerate(hits) if h][:limit]
        show = [k for k in range(len(hits)) if any(a - before <= k <= a + after for a in at)]
        for last, k in zip([None, *show], show):
            out.append((item, member, k + 1, "match" if hits[k] else "context", bool(before or after) and last is not None and k - last > 1))
    return out


@pytest.mark.parametrize("before, after, limit", [(0, 0, None), (2, 1, None), (1, 0, None), (0, 3, 1), (3, 3, 2), (50, 0, None), (0, 50, 1)])
def test_windows_over_batches_of_any_size(before, after, limit):
    rng = random.Random(before * 10 + after)
    members = [((k // 4, k % 4), [rng.random() < 0.2 for _ in range(rng.choice((0, 1, 3, 8, 40)))]) for k in range(60)]
    lines = [(item, member, n + 1, h) for (item, member), hits in members for n, h in enumerate(hits)]
    for size in (1, 2, 7, 33, len(lines)):
        batches = []
        for a in range(0, len(lines), size):
            part = lines[a : a + size]
            cut = rng.randrange(len(part) + 1)  # where a row stands that is no line
            i, m, n, h = (list(c) for c in zip(*part))
            own = i[max(cut - 1, 0)]
            for column, value in ((i, own), (m, None), (n, None), (h, None)):
                column.insert(cut, value)
            kinds = ["line"] * len(i)
            kinds[cut] = "diag"
            batches.append(pa.RecordBatch.from_pydict({"rec_type": kinds, "item_index": pa.array(i, pa.int64()), "part": pa.nulls(len(i), pa.int64()), "member_index": pa.array(m, pa.int64()), "line_no": pa.array(n, pa.int64()), "hit": pa.array(h, pa.bool_())}))
        found = [r for b in shown_lines(iter(batches), "hit", before, after, limit) for r in b.to_pylist()]
        told = [tuple(r[c] for c in ("item_index", "member_index", "line_no", "kind", "group_break")) for r in found if r["rec_type"] == "line"]
        assert told == rows_of(members, before, after, limit)
        assert sum(r["rec_type"] == "diag" for r in found) == len(batches)


def test_lines_out_of_windows_never_leave_the_reader(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"".join(b"line %d\n" % k for k in range(5000)))
    run = search(spark, parse(["-C", "1", "line 777$", str(tmp_path)]))
    assert "MapInArrow" not in run.selected()._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["line_no"] for r in run.scanned.filter("rec_type = 'line'").collect()) == [777, 778, 779]


@pytest.mark.parametrize("data", [b"", b"\n", b"needle", b"needle\n", b"a\nneedle needle\n\nb\nxneedle", b"needle\nneedle\n", b"\n\nneedle\n\n", b"a\nb"])
def test_lines_with_a_literal(data):
    few, all_ = _Cutter(Options(literal=b"needle")), _Cutter(Options())
    for k, part in enumerate((data, data + b"\n", data)):
        a, b = few.cut(part, k == 2), all_.cut(part, k == 2)
        want = [] if b is None else [(n, *x) for n, x in zip(b.numbers.tolist(), b) if b"needle" in x[1]]
        assert ([] if a is None else [(n, *x) for n, x in zip(a.numbers.tolist(), a)]) == want
        assert (few.number, few.offset, few.rest) == (all_.number, all_.offset, all_.rest)
    assert isinstance(a, type(None)) or a.numbers.dtype == np.int64

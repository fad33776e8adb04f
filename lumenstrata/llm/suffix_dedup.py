"""Removal of byte strings that also start in an earlier document, by suffix sorting with bucket pointers.

A window is ``WINDOW`` consecutive bytes of one document; it goes if the same
bytes start in a document with a smaller id.  Three steps make the suffixes
that have to be sorted few and the groups to sort small, without losing any:

* Documents alike as a whole are settled by their digest, the smallest id first.
* Every window is filed under its anchor, the smallest hash of the ``GRAM``
  bytes strings inside it; equal windows have equal anchors, and neighbours
  share theirs.  Anchors of a single document have no repeated window.
* The windows under a repeated anchor travel as one segment of text (at most
  2 * WINDOW bytes for all of them), to a task that holds this anchor.

There the suffixes of the distinct segments are sorted by bucket-pointer
refinement: positions are dealt into buckets by their first eight bytes, and a
bucket with several members is sorted again on the buckets of the positions
further on, whose pointers have been refined themselves, until buckets agree in
a whole window.  The smallest id of a bucket keeps its window.

An anchor with many documents (``PART``) is dealt over several tasks; what each
of them keeps meets again by a 128-bit digest of the window.

Defined results: a null text is empty; texts shorter than a window lose
nothing; rows without an id neither lose bytes nor take any; documents of the
same id do not count against each other, nor does a document against itself;
extra columns are not read.  Ids must be whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_table, map_text, materialize, mix, rolled, slices

WINDOW, GRAM, BUCKET = 50, 20, 8
#: Documents of one anchor that one task sorts together.
PART = 4096
#: Windows hashed at a time, bytes of texts in one step, bytes of segments sorted at a time (more if one anchor has more).
BLOCK, SLICE, SORTED = 1 << 18, 1 << 20, 2 << 20
#: A random value for every byte.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def anchors(data: np.ndarray, first: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share an anchor: (first window's start, number of windows, anchor).  ``first`` has each text's first byte, and the number of all."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
    ends = first[1:] - window  # the last window of each text
    spread, low = window - gram + 1, np.uint64((1 << 20) - 1)
    for s in range(0, max(0, len(data) - window + 1), BLOCK):
        own = data[s : s + BLOCK + window - 1]
        h = rolled(BYTE[own], gram)
        place = np.arange(len(h), dtype=np.uint64)
        best, step = (h & ~low) | place, 1  # the smallest upper bits, then the leftmost
        while 2 * step <= spread:
            best = np.minimum(best[: len(best) - step], best[step:])
            step *= 2
        if step < spread:
            best = np.minimum(best[: len(best) - (spread - step)], best[spread - step :])
        at = (best & low).astype(np.int64)
        new = np.flatnonzero(np.diff(at, prepend=-1))
        start, count = new + s, np.diff(np.append(new, len(at)))
        out.append((start, count, h[at[new]].view(np.int64)))
    start, count, anchor = map(np.concatenate, zip(*out))
    if len(first) == 2:
        return start, count, anchor
    # windows over a text's edge are in runs of their own or at a run's ends: cut them off
    owner = np.searchsorted(first, start, "right") - 1
    stop = np.minimum(start + count, ends[owner] + 1)
    inside = stop > start
    later = np.flatnonzero(start + count > first[owner + 1])  # a run that goes on into the next texts
    if len(later):
        more = [(first[k], min(e, ends[k] + 1), a) for i in later.tolist() for e, a in [(int(start[i] + count[i]), anchor[i])] for k in range(owner[i] + 1, int(np.searchsorted(first, e))) if ends[k] >= first[k]]
        if more:
            x, y, z = map(np.array, zip(*more))
            start, stop, anchor, inside = (np.concatenate(p) for p in ((start, x), (stop, y), (anchor, z), (inside, np.ones(len(x), bool))))
            order = np.argsort(start, kind="stable")
            start, stop, anchor, inside = start[order], stop[order], anchor[order], inside[order]
    return start[inside], (stop - start)[inside], anchor[inside]


def sort_windows(data: np.ndarray, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all windows of several texts in the order of their bytes, and where in it each group of equal ones begins."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(data))  # bytes to the text's end
    width = min(BUCKET, window)
    size = max(0, len(data) - width + 1)
    gram = np.zeros(size, np.uint64)
    for k in range(width):
        gram = (gram << np.uint64(8)) | data[k : size + k]
    order = np.flatnonzero(left[:size] >= width)
    order = order[np.argsort(gram[order], kind="stable")]
    new = np.ones(len(order), bool)
    new[1:] = gram[order[1:]] != gram[order[:-1]]
    pointer = np.full(len(data), -1, np.int64)
    pointer[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    depth = width
    while depth < window:
        step = min(depth, window - depth)
        order = order[left[order] >= depth + step]
        own = pointer[order]
        new = np.ones(len(order), bool)
        new[1:] = own[1:] != own[:-1]
        single = new & np.append(new[1:], True)
        part, bucket = order[~single], own[~single]  # buckets of one need no sorting
        onward = pointer[part + step]
        ranks = np.lexsort((onward, bucket))
        part, onward = part[ranks], onward[ranks]
        differs = np.ones(len(part), bool)
        differs[1:] = (bucket[1:] != bucket[:-1]) | (onward[1:] != onward[:-1])
        head = np.ones(len(part), bool)
        head[1:] = bucket[1:] != bucket[:-1]
        place = np.arange(len(part))
        pointer[part] = bucket + np.maximum.accumulate(np.where(differs, place, 0)) - np.maximum.accumulate(np.where(head, place, 0))
        order[~single] = part
        depth += step
    own = pointer[order]
    return order, np.flatnonzero(np.diff(own, prepend=-1))


def sketch(docs: DataFrame, doc_id: str, text: str, window: int, gram: int) -> DataFrame:
    """(id, t, n_bytes, whole, kept, anchors): digests of the text and its distinct anchors."""

    def make():
        def each(texts, _):
            import xxhash

            own = [x or b"" for x in texts]
            first = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            start, _, anchor = anchors(np.frombuffer(b"".join(own), np.uint8), first, window, gram)
            owner = np.searchsorted(first, start, "right") - 1
            order = np.lexsort((anchor, owner))
            owner, anchor = owner[order], anchor[order]
            new = np.ones(len(order), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (anchor[1:] != anchor[:-1])
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(own)))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(anchor[new]))
            return [[len(x) for x in own], [xxhash.xxh3_128_digest(x) for x in own], [hashlib.sha256(x).hexdigest() for x in own], lists]

        return each

    fields = [("n_bytes", T.LongType()), ("whole", T.BinaryType()), ("kept", T.StringType()), ("anchors", T.ArrayType(T.LongType()))]
    return map_text(_own(docs, doc_id, text), fields, "text", make, SLICE).drop("text")


def _own(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text).cast("string")).alias("t"), F.col(text).cast("string").alias("text"))


def _segments(window: int, gram: int):
    """(anchor, part, id, row, at, segment): the text under all windows of a repeated anchor, and the first one's starts; segments alike in a document go once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, ids, texts, listed = (batch.column(k) for k in range(4))
            for a, b in slices(np.array([len(x.as_buffer()) for x in texts]), SLICE):
                own = [x.as_buffer().to_pybytes() for x in texts.slice(a, b - a)]
                data, first = b"".join(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])
                start, count, anchor = anchors(np.frombuffer(data, np.uint8), first, window, gram)
                edge = np.searchsorted(start, first)
                parts = np.zeros(len(start), np.int64)
                for k in range(b - a):
                    known = listed[a + k].values
                    g, n = (known.field(j).to_numpy(zero_copy_only=False) for j in (0, 1))
                    order = np.argsort(g)
                    g, n, mine = g[order], n[order], anchor[edge[k] : edge[k + 1]]
                    at = np.minimum(np.searchsorted(g, mine), len(g) - 1)
                    parts[edge[k] : edge[k + 1]] = np.where(g[at] == mine, n[at], 0)
                pick = np.flatnonzero(parts)
                start, count, anchor, parts = start[pick], count[pick], anchor[pick], parts[pick]
                owner = np.searchsorted(first, start, "right") - 1
                rows, own_ids = row.to_numpy()[a:b][owner], ids.to_numpy()[a:b][owner]
                part = np.where(parts > 1, (mix(rows.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64), -1)  # -1: the anchor's only part
                order = np.lexsort((anchor, owner))
                again = np.zeros(len(order), bool)
                again[1:] = (owner[order[1:]] == owner[order[:-1]]) & (anchor[order[1:]] == anchor[order[:-1]])
                several = np.flatnonzero(again | np.append(again[1:], False))  # in that order: anchors at several places of a document
                alike, known = np.arange(len(start)), {}
                for i in order[several].tolist():
                    alike[i] = known.setdefault((int(owner[i]), data[start[i] : start[i] + count[i] + window - 1]), i)
                order = np.argsort(alike, kind="stable")
                one = np.flatnonzero(np.diff(alike[order], prepend=-1))
                lists, at = np.append(one, len(order)), (start - first[owner])[order].astype(np.int64)
                one = order[one]
                for s in range(0, len(one), 1 << 14):
                    e = one[s : s + (1 << 14)]
                    cut = [data[x:y] for x, y in zip(start[e].tolist(), (start[e] + count[e] + window - 1).tolist())]
                    ends = lists[s : s + len(e) + 1]
                    places = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(at[ends[0] : ends[-1]]))
                    columns = (anchor[e], part[e].astype(np.int32), own_ids[e], rows[e])
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), places, pa.array(cut, pa.binary())], names=["anchor", "part", "id", "row", "at", "segment"])

    return run


SEGMENTS = "anchor long, part int, id long, row long, at array<long>, segment binary"
#: Window starts from ``start`` to ``stop`` (exclusive) of a row; with a digest it is a window that is the first of its part.
FOUND = "row long, start long, stop long, id long, high long, low long"


def _sorted_parts(window: int):
    """What is repeated within each part of an anchor's segments; and, of an anchor with several parts, what is not."""

    def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        known: dict[bytes, int] = {}
        segment = np.array([known.setdefault(x, len(known)) for x in t.column("segment").to_pylist()], np.int64)
        ids, rows, part = (t.column(n).to_numpy() for n in ("id", "row", "part"))
        listed = t.column("at").combine_chunks()
        sizes, at = listed.value_lengths().to_numpy(), listed.flatten().to_numpy()
        smallest = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(smallest, segment, ids)
        texts = list(known)
        first = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        data = b"".join(texts)
        order, group = sort_windows(np.frombuffer(data, np.uint8), first, window)
        size = np.diff(np.append(group, len(order)))
        earliest = np.full(len(data), -1, np.int64)  # by window start: the smallest id that has it
        earliest[order] = np.repeat(np.minimum.reduceat(smallest[np.searchsorted(first, order, "right") - 1], group), size)
        # every window of every place
        segment, ids, rows, part = (np.repeat(x, sizes) for x in (segment, ids, rows, part))
        n = np.diff(first)[segment] - window + 1
        own = np.repeat(np.arange(len(rows)), n)
        within = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        best = earliest[first[segment][own] + within]
        gone = best < ids[own]
        edge = np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1
        edge |= gone & (within == 0)
        last = gone & np.append((~gone[1:]) | (within[1:] == 0), True)
        a, z = np.flatnonzero(edge), np.flatnonzero(last)
        none = np.zeros(len(a), bool)
        absent = pa.array(np.zeros(len(a), np.int64), mask=~none)
        yield pa.RecordBatch.from_arrays([pa.array(rows[own[a]]), pa.array(at[own[a]] + within[a]), pa.array(at[own[a]] + within[z] + 1), absent, absent, absent], names=["row", "start", "stop", "id", "high", "low"])
        open_ = np.flatnonzero(~gone & (part[own] >= 0))
        if len(open_):
            import xxhash

            where = first[segment][own[open_]] + within[open_]
            places, back = np.unique(where, return_inverse=True)
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[p : p + window]) for p in places.tolist()), ">i8").reshape(-1, 2).astype(np.int64)[back]
            o = own[open_]
            for s in range(0, len(o), 1 << 16):
                e = slice(s, s + (1 << 16))
                begin = at[o[e]] + within[open_[e]]
                columns = (rows[o[e]], begin, begin + 1, ids[o[e]], digest[e, 0], digest[e, 1])
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["row", "start", "stop", "id", "high", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, before = 0, None
        for batch in batches:
            if not len(batch):
                continue
            keys = [batch.column(k).to_numpy() for k in (0, 1)]
            turns = np.flatnonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0)) + 1
            cut = int(turns[-1]) if len(turns) else 0 if before is not None and before != (keys[0][0], keys[1][0]) else None
            before = (keys[0][-1], keys[1][-1])
            if size > SORTED and cut is not None:
                yield from found([*held, batch.slice(0, cut)])
                held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.nbytes
        if held:
            yield from found(held)

    return run


def _cutter(window: int):
    def make():
        def each(texts, batch):
            n_removed, n_spans, sums = [], [], []
            for text, ranges in zip(texts, batch.column(batch.schema.get_field_index("ranges"))):
                start, stop = (ranges.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                order = np.argsort(start, kind="stable")
                start, reach = start[order], np.maximum.accumulate(stop[order] + window - 1)
                new = np.ones(len(start), bool)
                new[1:] = start[1:] > reach[:-1]
                a, z = start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]
                kept = hashlib.sha256()
                for p, q in zip([0, *z.tolist()], [*a.tolist(), len(text)]):
                    kept.update(text[p:q])
                n_removed.append(int((z - a).sum()))
                n_spans.append(len(a))
                sums.append(kept.hexdigest())
            return [n_removed, n_spans, sums]

        return each

    return make


def remove_earlier_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, part: int = PART) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    raw = materialize(sketch(docs, doc_id, text, window, gram).withColumn("row", F.monotonically_increasing_id()), "sketch")  # numbers stand in the table
    rows = materialize(raw.drop("anchors", "t"), "rows")
    long_ = rows.filter((F.col("n_bytes") >= window) & F.col("id").isNotNull())
    first = long_.groupBy("whole").agg(F.min(F.struct("id", "row")).alias("first")).select("whole", "first.id", "first.row")
    first = materialize(first, "first")
    distinct = materialize(raw.join(first.select("row"), "row", "left_semi").select("row", "id", "t", "anchors"), "distinct")
    drop_table(raw)
    counts = distinct.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = materialize(counts.select("anchor", F.ceil(F.col("n") / part).cast("int").alias("parts")), "repeated")
    hits = distinct.select("row", F.explode("anchors").alias("anchor")).join(repeated, "anchor").groupBy("row").agg(F.collect_list(F.struct("anchor", "parts")).alias("known"))
    dirty = materialize(hits.join(distinct.select("row", "id", "t"), "row"), "dirty")
    drop_table(distinct)
    drop_table(repeated)
    texts = _own(docs, doc_id, text).filter("id is not null").filter(F.octet_length("text") >= window)
    matched = materialize(dirty.join(texts, ["id", "t"]).select("row", "id", "text", "known"), "texts")  # rows alike in both come as often
    drop_table(dirty)
    segments = matched.mapInArrow(_segments(window, gram), SEGMENTS).repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    found = materialize(segments.mapInArrow(_sorted_parts(window), FOUND), "found")
    open_ = found.filter("high is not null")
    met = open_.groupBy("high", "low").agg(F.min("id").alias("earliest"), F.max("id").alias("latest")).filter("earliest < latest").drop("latest")
    ranges = found.filter("high is null").select("row", "start", "stop").unionByName(open_.join(met, ["high", "low"]).filter("id > earliest").select("row", "start", "stop"))
    listed = ranges.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    cut = map_text(matched.select("row", "text").join(listed, "row"), [("n_removed", T.LongType()), ("n_spans", T.LongType()), ("left", T.StringType())], "text", _cutter(window), SLICE)
    cut = materialize(cut.select(F.col("row").alias("first_row"), "n_removed", "n_spans", "left").dropDuplicates(["first_row"]), "cut")
    drop_table(matched)
    drop_table(found)
    out = rows.join(first.withColumnRenamed("row", "first_row"), ["whole", "id"], "left").join(cut, "first_row", "left")
    copy = (F.col("n_bytes") >= window) & F.col("id").isNotNull() & F.col("first_row").isNull()
    return out.select(
        F.col("id").alias("doc_id"), "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("left", "kept")).alias("kept_sha256"),
    )

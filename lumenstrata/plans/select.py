"""The lines of a scan that a search shows, found while the lines stream by.

A member's lines, or those in a range of a plain input, arrive together and in order, so limits and context windows
need neither a shuffle nor more memory than a window.  Those of all members in a batch are found at once; only of the
last one something is remembered for the next batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class _Member:
    """What is to be remembered from one batch of a member's lines to the next."""

    def __init__(self, key: tuple):
        self.key, self.hits, self.open_to, self.last = key, 0, None, None
        self.waiting: pa.RecordBatch | None = None  # lines that a hit to come may show as its context


def shown_lines(batches: Iterator[pa.RecordBatch], hit: str, before: int, after: int, limit: int | None) -> Iterator[pa.RecordBatch]:
    """``batches`` without the lines that are not shown, and with ``kind`` (match, context) and ``group_break``.

    ``hit`` names a column that is true for hits, and is dropped.  With
    ``limit`` only the first so many hits of a member count; further ones inside
    the last one's window are of kind match.  Rows that are no lines stay.
    """
    member: _Member | None = None

    def shown(batch: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal member
        column = lambda name, null: pc.fill_null(batch.column(name), null).to_numpy(zero_copy_only=False)
        own = np.flatnonzero(pc.equal(batch.column("rec_type"), "line").to_numpy(zero_copy_only=False))
        keys = [column(n, -1)[own] for n in ("item_index", "part", "member_index")]
        fresh = np.ones(len(own), bool)
        if len(own) and member is not None and member.key != tuple(int(k[0]) for k in keys):
            member = None
        if len(own) and member is not None and member.waiting is not None and member.waiting.num_rows:
            n = member.waiting.num_rows
            batch = pa.Table.from_batches([member.waiting, batch]).combine_chunks().to_batches()[0]
            member.waiting = None
            own = np.concatenate([np.arange(n), own + n])
            keys = [np.concatenate([np.repeat(k[:1], n), k]) for k in keys]
            fresh = np.arange(len(own)) >= n  # the others were looked at before
        keep, kinds, breaks = np.ones(batch.num_rows, bool), np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
        if len(own):
            number, hits = column("line_no", 0)[own].astype(np.int64), column(hit, False)[own].astype(bool)
            begins = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
            whose = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(own))))
            first = whose == 0
            opens = hits & fresh
            rank = np.cumsum(opens)
            rank -= (rank - opens)[begins][whose]
            if member is not None:
                rank[first] += member.hits
            if limit is not None:
                opens &= rank <= limit
            # places of lines such that no window reaches from one member into another
            reach = int(number.max() - number.min())
            back, on = min(before, reach), min(after, reach)
            place = number - number.min() + whose * (reach + back + on + 1)
            at = place[opens]
            edge = np.zeros(len(own) + 1, np.int64)
            np.add.at(edge, np.searchsorted(place, at - back), 1)
            np.add.at(edge, np.searchsorted(place, at + on, "right"), -1)
            show = np.cumsum(edge[:-1]) > 0
            if member is not None and member.open_to is not None:
                show |= first & fresh & (number <= member.open_to)
            last = begins[-1]
            now = member if member is not None and len(begins) == 1 else _Member(tuple(int(k[-1]) for k in keys))
            now.hits += int(opens[last:].sum())
            if opens[last:].any():
                now.open_to = int(number[last:][opens[last:]][-1]) + after
            if before and (limit is None or now.hits < limit):
                now.waiting = batch.take(pa.array(own[last:][(number[last:] > number[-1] - before) & ~show[last:]]))
            else:
                now.waiting = None
            if "beside" in batch.schema.names:
                show &= ~column("beside", False)[own].astype(bool)
            told = np.flatnonzero(show)
            previous = np.concatenate([[-1], told[:-1]]) if len(told) else told
            follows = (previous >= 0) & (whose[previous] == whose[told])
            since = np.where(follows, number[previous], number[told])
            if member is not None and member.last is not None and len(told) and first[told[0]]:
                since[0] = member.last
            if len(told) and whose[told[-1]] == whose[-1]:
                now.last = int(number[told[-1]])
            member = now
            keep[own] = show
            kinds[own], breaks[own[told]] = np.where(hits, "match", "context"), (number[told] - since > 1) & bool(before or after)
        picked = pa.array(np.flatnonzero(keep))
        names = [n for n in batch.schema.names if n != hit]
        out = batch.take(picked)
        more = [pa.array(kinds[keep], pa.string()), pa.array(breaks[keep], pa.bool_())]
        return pa.RecordBatch.from_arrays([*(out.column(n) for n in names), *more], names=[*names, "kind", "group_break"])

    for batch in batches:
        out = shown(batch)
        if out.num_rows:
            yield out

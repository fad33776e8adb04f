"""Benchmark decontamination by Wu-Manber search over words.

The symbols are words, the test strings are the windows of the benchmark
items.  A block is a pair of adjacent words: the shift table gives how far the
search may jump when a block ends at the current word, the buckets behind a
shift of zero (by suffix block, then by prefix block) give the few test
strings that a direct comparison then confirms.

Benchmark items are searched in blocks of ``BLOCK_BYTES`` of item text (a single
longer item is a block of its own): one narrow map over the documents has them
in packed form and compiles one after the other for each slice of documents.  A
map takes ``MAP_BYTES`` of items at most, a larger benchmark takes several, so
neither the driver nor a closure holds more.

Defined results: null and empty texts have no words and are never hit; items
without words are never found; items that share an id are one item; a null
item id counts as the id ``""``; repeated documents are judged row by row.
"""

from __future__ import annotations

import json
import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_text, slices

WINDOW = 10
BLOCK_BYTES, MAP_BYTES = 512 << 10, 64 << 20
#: Lower-cases A-Z and turns every byte that can't be in a word into a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class WuManber:
    """Finds all occurrences of word sequences of one length ``m``."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[int]], m: int):
        self.m, self.block = m, min(2, m)
        self.far = m - self.block + 1
        self.known = {w for p in patterns for w in p}
        self.shift: dict = {}
        self.buckets: dict = {}
        for p, ids in patterns.items():
            for end in range(self.block - 1, m):
                key = p[end - self.block + 1 : end + 1]
                self.shift[key] = min(self.shift.get(key, self.far), m - 1 - end)
            self.buckets.setdefault(p[m - self.block :], {}).setdefault(p[: self.block], []).append((list(p), ids))

    def find(self, words: list[bytes]) -> list[tuple[int, set[int]]]:
        """(start, items) of every occurrence, by start."""
        m, block, far, known, shift, out = self.m, self.block, self.far, self.known, self.shift.get, []
        i, n = m - 1, len(words)
        while i < n:
            if words[i] not in known:  # no test string has this word: all positions that cover it are impossible
                i += m
                continue
            suffix = tuple(words[i - block + 1 : i + 1])
            step = shift(suffix, far)
            if step:
                i += step
                continue
            start = i - m + 1
            for pattern, ids in self.buckets[suffix].get(tuple(words[start : start + block]), ()):
                if words[start : i + 1] == pattern:
                    out.append((start, ids))
            i += 1
        return out


def compile_items(items: list[tuple[str, str | None]], window: int = WINDOW) -> list[WuManber]:
    """One searcher for each window length that occurs; ids in a searcher are indexes into ``items``."""
    by_length: dict[int, dict] = {}
    for k, (_, text) in enumerate(items):
        words = words_of(text.encode() if text is not None else None)
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            by_length.setdefault(m, {}).setdefault(tuple(words[i : i + m]), set()).add(k)
    return [WuManber(p, m) for m, p in sorted(by_length.items())]


def search(words: list[bytes], searchers: list[WuManber]) -> tuple[list[int], set[int]]:
    """Covered word ranges, merged, as [start, end, start, end, ...], and the items found."""
    found, ids = [], set()
    for s in searchers:
        for start, items in s.find(words):
            found.append((start, start + s.m))
            ids |= items
    return merge_ranges(found), ids


def merge_ranges(ranges: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def find_contamination(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, map_bytes: int = MAP_BYTES
) -> DataFrame:
    """Add ``n_words``, ``hit_ranges`` (word ranges, end exclusive, flattened), ``item_ids`` and ``contaminated`` to every document."""
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).cast("string").alias("t")).filter(F.col("t").isNotNull())
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    maps = max(1, math.ceil(total / map_bytes))
    n_words, ranges, ids, flag = fresh(docs.columns, "n_words", "hit_ranges", "item_ids", "contaminated")
    out = docs
    for k in range(maps):
        part = items if maps == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(maps)) == k)
        blocks = packed(sorted((r["i"], r["t"]) for r in part.distinct().collect()), block_bytes)  # the bound: map_bytes, or one item
        names = fresh(out.columns, "n", "r", "i") if k else (n_words, ranges, ids)
        fields = [(names[0], T.LongType()), (names[1], T.ArrayType(T.IntegerType())), (names[2], T.ArrayType(T.StringType()))]
        out = map_text(out, fields, text, _searcher(blocks, window, (ranges, ids) if k else None))
        if k:
            out = out.drop(n_words, ranges, ids).withColumnsRenamed(dict(zip(names, (n_words, ranges, ids))))
    return out.withColumn(flag, F.size(ranges) > 0)


def packed(rows: list[tuple[str, str]], block_bytes: int) -> list[bytes]:
    """The items in blocks of bounded size, each packed."""
    sizes = np.array([len(t.encode()) for _, t in rows])
    return [zlib.compress(json.dumps(rows[a:b]).encode()) for a, b in slices(sizes, block_bytes)]


def _searcher(blocks: list[bytes], window: int, so_far: tuple[str, str] | None):
    def make():
        def opened(data: bytes) -> tuple[list[WuManber], list[str]]:
            rows = json.loads(zlib.decompress(data))
            return compile_items(rows, window), [i for i, _ in rows]

        only = opened(blocks[0]) if len(blocks) == 1 else None

        def each(texts, batch):
            words = [words_of(t) for t in texts]
            before = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in so_far] if so_far else [[None] * len(texts)] * 2
            hits, names = [x or [] for x in before[0]], [set(x or ()) for x in before[1]]
            for data in blocks:
                searchers, own = only or opened(data)
                for k, w in enumerate(words):
                    hit, found = search(w, searchers)
                    if hit:
                        hits[k] = merge_ranges([*zip(hit[::2], hit[1::2]), *zip(hits[k][::2], hits[k][1::2])])
                        names[k].update(own[i] for i in found)
            return [list(map(len, words)), hits, list(map(sorted, names))]

        return each

    return make

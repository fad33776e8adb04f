"""Substring deduplication over a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words.  Each window is represented in the
index by its minimizer, the smallest hash of the grams inside it: equal windows
have equal minimizers, and neighbouring windows share theirs, so the index is a
small multiple of a seventh of the words.  Every batch of documents becomes one
immutable run, sorted by fingerprint; an arriving batch is merge-joined with the
runs before it to find the fingerprints that repeat, and runs that have become
many are compacted into one sorted run first.  Only windows under a repeated
fingerprint are then verified, by two independent 64-bit hashes of their words,
against the first document that has them, of the call or of the calls before
it.  An index that is kept holds its documents' texts beside the runs for that.

Defined results: null texts and texts shorter than a window lose nothing; rows
are ordered by id (null first), then by a hash of the text, and of rows alike
in both the later ones repeat the first; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MIX_B, drop_table, hashed_words, map_text, materialize, release, rolled, scratch_path, slices

WINDOW, GRAM = 20, 8
#: Ingested batches, and runs from which they are compacted.
BATCHES, FAN_IN = 3, 2
NULL_ID = -(1 << 63)
#: Rows of one Arrow batch of windows.
ROWS = 1 << 17
FOUND = "h long, v long, ord long, pos int"


def split_words(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts, one after the other, and where each text's begin."""
    words: list[bytes] = []
    first = [0]
    for text in texts:
        if text:
            words += text.split()
        first.append(len(words))
    return words, np.array(first, np.int64)


def minimizers(h: np.ndarray, first: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of several texts' word hashes: its start, and the place and hash of its leftmost smallest gram."""
    n = np.maximum(np.diff(first) - window + 1, 0)
    starts = np.repeat(first[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    if not len(starts):
        return starts, starts, np.empty(0, np.uint64)
    value = rolled(h, gram)
    place = np.arange(len(value))
    spread, step = window - gram + 1, 1

    def halves(by: int):
        left, right = value[: len(value) - by], value[by:]
        better = left <= right
        return np.where(better, left, right), np.where(better, place[: len(place) - by], place[by:])

    while 2 * step <= spread:
        value, place = halves(step)
        step *= 2
    if step < spread:
        value, place = halves(spread - step)
    return starts, place[starts], value[starts]


def sketch(docs: DataFrame, doc_id: str, text: str, window: int, gram: int) -> DataFrame:
    """(id, t, n_words, whole, kept, grams): digests of the whole word sequence and the document's fingerprints, those at several places twice."""

    def make():
        def each(texts, _):
            import xxhash

            h, first = hashed_words(texts)
            joined = [b" ".join(x.split()) if x else b"" for x in texts]
            starts, at, g = minimizers(h, first, window, gram)
            new = np.flatnonzero(np.diff(at, prepend=-1))  # places never decrease along a text's windows
            g, owner = g[new], np.searchsorted(first, at[new], "right") - 1
            order = np.lexsort((g, owner))
            g, owner = g[order], owner[order]
            same = np.zeros(len(g), bool)
            same[1:] = (g[1:] == g[:-1]) & (owner[1:] == owner[:-1])
            third = same.copy()
            third[1:] &= same[:-1]
            g, owner = g[~third], owner[~third]
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
            grams = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(g.view(np.int64)))
            return [np.diff(first).tolist(), [xxhash.xxh3_128_digest(x) for x in joined], [hashlib.sha256(x).hexdigest() for x in joined], grams]

        return each

    fields = [("n_words", T.LongType()), ("whole", T.BinaryType()), ("kept", T.StringType()), ("grams", T.ArrayType(T.LongType()))]
    return map_text(_own(docs, doc_id, text), fields, "text", make).drop("text")


def _own(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text).cast("string")).alias("t"), F.col(text).cast("string").alias("text"))


class FingerprintIndex:
    """Sorted immutable runs of (fingerprint, number of places), and the documents behind them, below one shared folder."""

    def __init__(self, spark: SparkSession, path: str, fan_in: int = FAN_IN):
        self.spark, self.path, self.fan_in, self.runs = spark, path.rstrip("/"), fan_in, []
        self.kept, self.next = [], 0  # tables of kept documents, the order number of the next call's first one

    schema = "g long, n long"

    def _write(self, counts: DataFrame) -> str:
        path = f"{self.path}/run-{len(self.runs):06d}-{uuid.uuid4().hex}"
        counts.sortWithinPartitions("g").write.option("compression", "zstd").parquet(path)
        return path

    def add(self, sketches: DataFrame) -> None:
        """One more run from the fingerprints of a batch; the runs before it are compacted first where they are as many as the fan-in."""
        drop_table(self.ingest(sketches))

    def ingest(self, sketches: DataFrame) -> DataFrame:
        """As ``add``; (g, old): the batch's fingerprints that stand at another place too, ``old`` if one of an earlier batch."""
        if len(self.runs) >= self.fan_in:
            self.compact()
        counts = sketches.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        path = self._write(counts)
        run = self.read(path)
        history = self.merged().withColumnRenamed("n", "m")
        met = run.join(history.hint("merge"), "g", "left") if self.runs else run.withColumn("m", F.lit(None).cast("long"))
        flagged = materialize(met.filter("n > 1 or m is not null").select("g", F.col("m").isNotNull().alias("old")), "flagged")
        self.runs.append(path)
        release(self.spark)
        return flagged

    def keep(self, docs: DataFrame) -> None:
        """Keep (ord, grams, text) of a call's distinct documents, against which later calls are verified."""
        path = f"{self.path}/docs-{len(self.kept):06d}-{uuid.uuid4().hex}"
        docs.select("ord", "grams", "text").write.option("compression", "zstd").parquet(path)
        self.kept.append(path)

    def documents(self) -> DataFrame | None:
        schema = "ord long, grams array<long>, text string"
        return self.spark.read.schema(schema).parquet(*self.kept) if self.kept else None

    def read(self, run: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(run)

    def merged(self) -> DataFrame:
        """All runs as one: a chain of sort-merge joins over sorted runs."""
        out = None
        for run in self.runs:
            part = self.read(run)
            if out is None:
                out = part
            else:
                out = out.join(part.hint("merge").withColumnRenamed("n", "m"), "g", "full").select("g", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return out if out is not None else self.spark.createDataFrame([], self.schema)

    def compact(self) -> None:
        old, new = self.runs, self._write(self.merged())
        self.runs = [new]
        for run in old:
            drop_table(self.read(run))
        release(self.spark)

    def repeated(self) -> DataFrame:
        """Fingerprints at two places or more."""
        return self.merged().filter("n > 1").select("g")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, index: FingerprintIndex | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row.

    A word is removed if a window over it starts earlier with the same words in
    a document before it or in its own.  ``index`` keeps runs and documents for
    later calls; the documents of earlier calls with it come before all of ``docs``.
    """
    spark = docs.sparkSession
    raw = materialize(sketch(docs, doc_id, text, window, gram), "sketch")
    # range partitions in ascending order and rows sorted inside: the generated number follows (id, t)
    order = [F.coalesce("id", F.lit(NULL_ID)), F.col("t")]
    start = index.next if index else 0
    number = (F.monotonically_increasing_id() + F.lit(start)).alias("ord")
    sketches = materialize(raw.repartitionByRange(max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))), *order).sortWithinPartitions(*order).select("*", number), "ordered")
    drop_table(raw)
    long_ = sketches.filter(F.col("n_words") >= window)
    first = materialize(long_.groupBy("whole").agg(F.min("ord").alias("first")).select("first"), "first")
    distinct = materialize(long_.join(first, F.col("ord") == F.col("first"), "left_semi").select("ord", "id", "t", "grams"), "distinct")
    texts = _own(docs, doc_id, text).filter("text is not null").select(F.coalesce("id", F.lit(NULL_ID)).alias("id_"), "t", "text")
    runs = index or FingerprintIndex(spark, scratch_path(spark, "runs"))
    earlier = runs.documents()
    cuts = distinct.approxQuantile("ord", [k / batches for k in range(1, batches)], 0.05) if batches > 1 else []
    cuts = sorted({int(c) for c in cuts})
    flagged = None
    for a, b in zip([start - 1, *cuts], [*cuts, None]):
        part = distinct.filter(F.col("ord") > a)
        met = runs.ingest(part if b is None else part.filter(F.col("ord") <= b))
        flagged = met if flagged is None else flagged.unionByName(met)
    flagged = materialize(flagged.groupBy("g").agg(F.bool_or("old").alias("old")), "repeated")
    # the documents of the call that hold a repeated fingerprint, and those of the calls before that share one with them
    dirty = materialize(_under(distinct, flagged, "ord", "id", "t"), "dirty")
    matched = materialize(dirty.withColumn("id_", F.coalesce("id", F.lit(NULL_ID))).drop("id").join(texts, ["id_", "t"]).select("ord", "text", "gs"), "texts")  # rows alike in id and text come as often
    drop_table(dirty)
    found = every = matched.mapInArrow(_windows(window, gram), FOUND)
    if earlier is not None:
        before = _under(earlier, flagged.filter("old"), "ord").join(earlier.select("ord", "text"), "ord").select("ord", "text", "gs")
        every = every.unionByName(before.mapInArrow(_windows(window, gram), FOUND))
    firsts = every.groupBy("h", "v").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).filter((F.col("first") < F.col("last")) & (F.col("last") >= start))
    firsts = materialize(firsts.drop("last"), "firsts")
    drop_table(flagged)
    later = found.join(firsts, ["h", "v"]).filter("ord > first").groupBy("ord").agg(F.collect_list("pos").alias("starts"))
    later = materialize(later, "later")
    drop_table(firsts)
    cut = matched.select("ord", "text").join(later, "ord", "left")
    cut = map_text(cut, [("n_removed", T.LongType()), ("left", T.StringType())], "text", _cutter(window)).select("ord", "n_removed", "left")
    cut = materialize(cut.dropDuplicates(["ord"]), "cut")
    drop_table(matched)
    drop_table(later)
    if index:
        kept = distinct.withColumn("id_", F.coalesce("id", F.lit(NULL_ID))).drop("id").join(texts, ["id_", "t"])
        index.keep(kept.dropDuplicates(["ord"]))
        last = sketches.agg(F.max("ord")).first()[0]
        index.next = start if last is None else last + 1
        if len(index.runs) > 1:
            index.compact()
    drop_table(distinct)
    out = sketches.drop("grams", "whole", "t").join(first.withColumn("is_first", F.lit(True)), F.col("ord") == F.col("first"), "left").join(cut, "ord", "left")
    copy = (F.col("n_words") >= window) & F.col("is_first").isNull()
    return out.select(
        F.col("id").alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("left", "kept")).alias("kept_sha256"),
    )


def _under(docs: DataFrame, flagged: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of the documents that hold flagged fingerprints, with those as ``gs``."""
    hits = docs.select(*columns, F.explode(F.array_distinct("grams")).alias("g")).join(flagged.select("g"), "g")
    return hits.groupBy(*columns).agg(F.collect_list("g").alias("gs"))


def _hashes(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of every window."""
    return rolled(h, window), rolled((h ^ (h >> np.uint64(29))) * MIX_B, window)


def _windows(window: int, gram: int):
    """Rows of the windows under a repeated fingerprint, once a document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(np.array([len(x.as_buffer()) for x in texts])):
                ords, own, gs = (c.slice(a, b - a) for c in batch.columns)
                h, first = hashed_words([x.as_buffer().to_pybytes() for x in own])
                starts, at, g = minimizers(h, first, window, gram)
                edge = np.searchsorted(starts, first)
                flagged = gs.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                end = np.concatenate([[0], np.cumsum([len(x) for x in gs])])
                new = np.flatnonzero(np.diff(at, prepend=-1))
                turn = np.searchsorted(new, edge)
                hit = np.concatenate([np.empty(0, bool), *(np.isin(g[new[turn[k] : turn[k + 1]]], flagged[end[k] : end[k + 1]]) for k in range(b - a))])
                pick = np.repeat(hit, np.diff(np.append(new, len(starts))))
                starts = starts[pick]
                x, v = _hashes(h, window) if len(starts) else (np.empty(0, np.uint64),) * 2
                owner = np.searchsorted(first, starts, "right") - 1
                order, new = _grouped(x[starts], owner)
                starts, owner = starts[order[new]], owner[order[new]]
                columns = (x[starts].view(np.int64), v[starts].view(np.int64), ords.to_numpy()[owner], (starts - first[owner]).astype(np.int32))
                for k in range(0, max(1, len(starts)), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c[k : k + ROWS]) for c in columns], names=["h", "v", "ord", "pos"])

    return run


def _grouped(x: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal windows of one document stand together, the first first, and where each group begins in it."""
    order = np.lexsort((x, owner))
    new = np.ones(len(x), bool)
    new[1:] = (x[order][1:] != x[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    return order, new


def _cutter(window: int):
    def make():
        def each(texts, batch):
            words, first = split_words(texts)
            h, _ = hashed_words(texts)
            n = np.maximum(np.diff(first) - window + 1, 0)
            own = np.repeat(np.arange(len(texts)), n)
            starts = np.repeat(first[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            x = rolled(h, window)[starts] if len(starts) else np.empty(0, np.uint64)
            order, new = _grouped(x, own)
            group = np.empty(len(x), np.int64)
            group[order] = np.cumsum(new) - 1
            gone = np.ones(len(x), bool)
            gone[order[new]] = False  # the first of equal windows stays, unless it stands in an earlier document
            others = batch.column(batch.schema.get_field_index("starts"))
            offset = np.cumsum(n) - n  # a text's windows stand one after the other
            listed = [at.values.to_numpy(zero_copy_only=False) + offset[k] for k, at in enumerate(others) if at.is_valid]
            if listed:
                repeated = np.zeros(int(new.sum()), bool)
                repeated[group[np.concatenate(listed).astype(np.int64)]] = True
                gone |= repeated[group]
            at = starts[gone]
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
            keep = np.cumsum(edge[:-1]) == 0
            left = np.concatenate([[0], np.cumsum(keep)])[first]
            still = np.flatnonzero(keep).tolist()
            sums = [hashlib.sha256(b" ".join([words[k] for k in still[a:b]])).hexdigest() for a, b in zip(left[:-1].tolist(), left[1:].tolist())]
            return [(np.diff(first) - np.diff(left)).tolist(), sums]

        return each

    return make

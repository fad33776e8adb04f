"""Shared plumbing of the training-data operators: scratch tables, Arrow maps, word hashing."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import scratch_path

#: Bytes of text handed to one step of a Python operator; an Arrow batch above it is processed in slices.
SLICE_BYTES = 8 << 20
#: Bytes of a join's side that may be broadcast.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by five; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def materialize(df: DataFrame, tag: str, **options) -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder, with the writer's ``options``, and read it back.

    The result has no lineage, survives lost executors, and lets Spark drop the
    shuffle files behind it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    schema = df.schema
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def small_side(df: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written table as the side of a join: broadcast if its rows, by their count, take at most ``most`` bytes; else both sides are shuffled."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def drop_table(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner drop the shuffle files of finished plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return the free memory of a Python worker to the system; Spark keeps idle workers for the stages that follow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, at least one row each."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def map_text(
    df: DataFrame, fields: list[tuple[str, T.DataType]], text: str, make: Callable[[], Callable[[list[bytes | None], pa.RecordBatch], list]], limit: int = SLICE_BYTES
) -> DataFrame:
    """Add columns computed from the whole text of each row.

    ``make()`` runs once per task and returns a function from a list of UTF-8
    texts (None for null) and their batch to one Python or Arrow column per
    field; it gets slices of at most ``limit`` bytes of text, or single longer
    texts.  Its attribute ``done``, if it has one, is called after the task's
    last batch.  All columns of ``df`` are kept.
    """
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t, True) for n, t in fields)])
    arrow = [_arrow_type(t) for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
            ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
            for a, b in slices(np.diff(ends), limit):
                part = batch.slice(a, b - a)
                out = each(column.slice(a, b - a).to_pylist(), part)
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(out, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *(n for n, _ in fields)])
        getattr(each, "done", int)()
        del each
        give_back()

    return df.mapInArrow(run, schema)


def _arrow_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow_type(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in t.fields])
    return {
        T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.FloatType: pa.float32(),
        T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary(),
    }[type(t)]


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names like ``names`` that clash with none of ``taken`` (compared without case)."""
    have, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


#: Fixed odd multipliers of the 64-bit mixing function and of the polynomial over words.
MIX_A, MIX_B, POLY = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words, the same in every process; a bounded memo saves repeated words."""

    def __init__(self, seed: int = 0, keep: int = 1 << 19):
        import xxhash

        self.seed, self.keep, self.memo, self.hash = seed, keep, {}, xxhash.xxh3_64_intdigest

    def __call__(self, words: list[bytes]) -> np.ndarray:
        memo, h, seed = self.memo, self.hash, self.seed
        if len(memo) > self.keep:
            memo.clear()
        try:
            return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in set(words).difference(memo):
                memo[w] = h(w, seed)
            return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


#: Masks that keep the first so many bytes of eight; words beyond ``LONG_WORD`` bytes are hashed one by one.
FIRST_BYTES, LONG_WORD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64), 64


def hashed_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (between ASCII white space) of all texts, the same in every process, and where each text's begin.

    Eight bytes of all words are taken at a time; of words up to eight bytes those of one length never collide.
    """
    data = b" ".join([b"", *(t or b"" for t in texts), b" " * 8])
    raw = np.frombuffer(data, np.uint8)
    white = (raw == 32) | (raw - np.uint8(9) < 5)
    edges = np.flatnonzero(white[1:] != white[:-1]) + 1
    starts, size = edges[0::2], edges[1::2] - edges[0::2]
    first = np.searchsorted(starts, np.cumsum([1, *(len(t or b"") + 1 for t in texts)]))
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = mix(size.astype(np.uint64) * POLY ^ eight[starts] & FIRST_BYTES[np.minimum(size, 8)])
    rows, at = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(rows):
        left = size[rows] - at
        h[rows] = mix(h[rows] ^ eight[starts[rows] + at] & FIRST_BYTES[np.minimum(left, 8)])
        rows, at = rows[left > 8], at + 8
    long_ = np.flatnonzero(size > LONG_WORD)
    if len(long_):
        import xxhash

        h[long_] = [xxhash.xxh3_64_intdigest(data[a : a + n]) for a, n in zip(starts[long_].tolist(), size[long_].tolist())]
    return h, first.astype(np.int64)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of a sequence of word hashes; empty if it is shorter."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = h[:n].copy()
    for i in range(1, k):
        acc *= POLY
        acc += h[i : i + n]
    return mix(acc)


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """As ``windows``, put together from windows of half the length."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)

    def joined(left, n_left, right, n_right):
        m = len(h) - n_left - n_right + 1
        return left[:m] * POLY ** np.uint64(n_right) + right[n_left : n_left + m]

    out, size, bit = h, 1, k.bit_length() - 1
    while bit:
        bit -= 1
        out, size = joined(out, size, out, size), 2 * size
        if k >> bit & 1:
            out, size = joined(out, size, h, 1), size + 1
    return mix(out)

"""Lloyd's centroid clustering by filtering kd-trees, in whole numbers.

The vectors become integers once, and every task builds kd-trees over blocks of
its own vectors: a node holds the count, the componentwise integer sum and the
bounding box of its vectors.  A block's tree is cut into subtrees of bounded
size, each a row of a written table, so a round is one narrow map over that
table.  It carries a set of candidate centroids down each tree: a candidate
that is farther than another from every place of a node's box is pruned, a node
left with one candidate is assigned whole by its count and sum, and leaves with
several are resolved vector by vector.  A task returns a row a centroid, and
the new centroids, k rows, are all that reaches the driver.

All arithmetic is exact: in floating point while every intermediate value is a
whole number below 2^53, else in 64-bit integers.

Defined results: vectors that are null, of another length, or hold a null or a
non-finite component are not kept, nor are those with a component of
``LARGEST`` steps or more, whose squared distances would not fit in a long;
repeated rows count as often as they stand; rows without an id are clustered
but never start a centroid, and of equal ids the one with the smaller components starts
first; with fewer kept vectors than ``k`` there are as many centroids as
vectors with an id; no such vector gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

CENTROIDS, ROUNDS, SEED, DIMENSIONS, SCALE = 8, 10, 3, 64, 1024
#: Vectors that a task splits at a time, of one subtree (a row), and of a leaf.
BLOCK, SUBTREE, LEAF = 1 << 14, 1 << 10, 32
LARGEST = 1 << 27
#: Components up to here have squared distances over 64 components below 2^53.
EXACT_FLOAT = 1 << 22


def kept_vectors(vectors: DataFrame, vec_id: str, embedding: str, dimensions: int, scale: int) -> DataFrame:
    """(id, v): the usable vectors in steps of 1 / ``scale``."""
    e = F.col(embedding)

    def usable(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * scale) < LARGEST)

    kept = vectors.filter((F.size(e) == dimensions) & F.forall(e, usable))
    return kept.select(F.col(vec_id).alias("id"), F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors whose hashed ids come first, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = kept.filter("id is not null").select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def split_block(x: np.ndarray, smallest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Halve the vectors at the median of their widest component until parts have at most ``smallest``; the order, and the bounds of the parts of each level."""
    order, levels = np.arange(len(x)), [np.array([0, len(x)])]
    while (np.diff(levels[-1]) > smallest).any():
        bounds = levels[-1]
        middles = (bounds[:-1] + bounds[1:]) // 2
        for a, m, b in zip(bounds[:-1].tolist(), middles.tolist(), bounds[1:].tolist()):
            part = x[order[a:b]]
            widest = int(np.argmax(part.max(0) - part.min(0)))
            order[a:b] = order[a:b][np.argpartition(part[:, widest], m - a)]
        levels.append(np.sort(np.concatenate([bounds, middles])))
    return order, levels


class Tree:
    """Nodes by level: the bounds of their vectors, counts, sums and boxes."""

    def __init__(self, x: np.ndarray, levels: list[np.ndarray], sums: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.x, self.levels, self.sums, self.low, self.high = x, levels, sums, low, high
        self.at = np.concatenate([[0], np.cumsum([len(b) - 1 for b in levels])])  # each level's first node

    @classmethod
    def of(cls, x: np.ndarray, levels: list[np.ndarray]) -> Tree:
        """From vectors in the order of the tree: leaves first, parents from their two children."""
        starts = levels[-1][:-1]
        level = [(np.add.reduceat(x, starts), np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts))]
        for _ in levels[1:]:
            s, a, b = level[0]
            level.insert(0, (s[::2] + s[1::2], np.minimum(a[::2], a[1::2]), np.maximum(b[::2], b[1::2])))
        return cls(x, levels, *(np.concatenate(parts) for parts in zip(*level)))

    def filtered(self, centroids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray | int, np.ndarray]]:
        """(from, to, labels, sum or sums): parts that cover the tree; a whole node has one label and its sum, a leaf a label a vector."""
        top = max(int(np.abs(self.low[0]).max()), int(np.abs(self.high[0]).max()), int(np.abs(centroids).max()))
        kind = np.float64 if top <= EXACT_FLOAT else np.int64
        c, far = centroids.astype(kind), np.finfo(np.float64).max if kind is np.float64 else np.iinfo(np.int64).max
        square = (c * c).sum(1)
        nodes, alive = np.zeros(1, np.int64), np.ones((1, len(c)), bool)
        for depth, bounds in enumerate(self.levels):
            low, high = (side[self.at[depth] + nodes].astype(kind) for side in (self.low, self.high))
            middle = low + high  # twice the middle, so compared with twice the centroids: |m - 2c|^2 = |m|^2 + 4 (|c|^2 - m c)
            best = np.where(alive, square - middle @ c.T, far).argmin(1)
            toward = c[None] - c[best][:, None]
            reach = np.einsum("nd,nkd->nk", high, np.maximum(toward, 0)) + np.einsum("nd,nkd->nk", low, np.minimum(toward, 0))
            alive &= square[None] - square[best][:, None] - 2 * reach <= 0  # else farther than the best one at the nearest corner, so everywhere
            single = alive.sum(1) == 1
            for n, label in zip(nodes[single].tolist(), alive[single].argmax(1).tolist()):
                yield int(bounds[n]), int(bounds[n + 1]), label, self.sums[self.at[depth] + n]
            nodes, alive = nodes[~single], alive[~single]
            if depth + 1 < len(self.levels):
                nodes, alive = np.repeat(2 * nodes, 2) + np.tile([0, 1], len(nodes)), np.repeat(alive, 2, axis=0)
        for n, mask in zip(nodes.tolist(), alive):
            a, b, own = int(bounds[n]), int(bounds[n + 1]), np.flatnonzero(mask)
            yield a, b, own[(square[own] - 2 * (self.x[a:b].astype(kind) @ c[own].T)).argmin(1)], self.x[a:b]  # the smaller number on ties


def levels_of(n: int, leaf: int) -> list[np.ndarray]:
    """The bounds that ``split_block`` gives for n vectors."""
    levels = [np.array([0, n])]
    while (np.diff(levels[-1]) > leaf).any():
        levels.append(np.sort(np.concatenate([levels[-1], (levels[-1][:-1] + levels[-1][1:]) // 2])))
    return levels


def build_trees(kept: DataFrame, dimensions: int) -> DataFrame:
    """One row a subtree: ids, vectors in the order of the tree, and its nodes' sums and boxes as packed arrays."""
    id_type = kept.schema["id"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), *(T.StructField(n, T.BinaryType()) for n in ("points", "sums", "low", "high"))])

    def rows(ids: pa.Array, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        order, levels = split_block(x, SUBTREE)
        packed = []
        for a, b in zip(levels[-1][:-1].tolist(), levels[-1][1:].tolist()):
            inner, own = split_block(x[order[a:b]], LEAF)
            order[a:b] = order[a:b][inner]
            tree = Tree.of(x[order[a:b]], own)
            packed.append([part.astype(kind).tobytes() for part, kind in ((tree.x, np.int32), (tree.sums, np.int64), (tree.low, np.int32), (tree.high, np.int32))])
        columns = [pa.ListArray.from_arrays(pa.array(levels[-1], pa.int32()), ids.take(pa.array(order)))]
        columns += [pa.array(c, pa.binary()) for c in zip(*packed)]
        yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def block():
            t = pa.Table.from_batches(held).combine_chunks()
            x = t.column("v").chunk(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)
            return rows(t.column("id").chunk(0), x)

        for batch in batches:
            while len(batch):
                part = batch.slice(0, BLOCK - n)
                held.append(part)
                n, batch = n + len(part), batch.slice(len(part))
                if n == BLOCK:
                    yield from block()
                    held, n = [], 0
        if n:
            yield from block()

    return kept.mapInArrow(run, schema)


def _trees(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for i in range(len(batch)):
            ids = batch.column(0)[i].values
            x, sums, low, high = (
                np.frombuffer(batch.column(k)[i].as_buffer(), kind).reshape(-1, dimensions) for k, kind in ((1, np.int32), (2, np.int64), (3, np.int32), (4, np.int32))
            )
            yield ids, Tree(x, levels_of(len(x), LEAF), sums, low, high)


def next_centroids(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: whole nodes and leaves are summed by centroid in the tasks, then over the tasks."""
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for _, tree in _trees(batches, dimensions):
            for a, b, label, what in tree.filtered(centroids):
                if isinstance(label, int):
                    counts[label] += b - a
                    sums[label] += what
                else:
                    counts += np.bincount(label, minlength=k)
                    np.add.at(sums, label, what)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[own]), pa.array(sums[own].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = trees.mapInArrow(run, "cluster long, n long, sums array<long>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s"))
    out = centroids.copy()
    for r in each.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # k * dimensions rows at most
        out[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    return out


def assign(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    dimensions = centroids.shape[1]
    schema = T.StructType([T.StructField("id", trees.schema["ids"].dataType.elementType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _trees(batches, dimensions):
            labels = np.empty(len(tree.x), np.int32)
            for a, b, label, _ in tree.filtered(centroids):
                labels[a:b] = label
            apart = tree.x - centroids[labels]
            yield pa.RecordBatch.from_arrays([ids, pa.array(labels), pa.array((apart * apart).sum(1))], names=schema.fieldNames())

    return trees.mapInArrow(run, schema)


def cluster_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance, cluster_inertia, inertia) of every kept vector, and the final centroids in steps of 1 / ``scale``."""
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, vec_id, embedding, dimensions, scale)
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        schema = T.StructType([kept.schema["id"], *(T.StructField(n, t) for n, t in (("cluster", T.IntegerType()), ("distance", T.LongType()), ("cluster_inertia", T.LongType()), ("inertia", T.LongType())))])
        return spark.createDataFrame([], schema), centroids
    trees = materialize(build_trees(kept, dimensions), "trees")
    for _ in range(rounds):
        moved = next_centroids(trees, centroids)
        if (moved == centroids).all():
            break  # every further round gives the same
        centroids = moved
    assigned = materialize(assign(trees, centroids), "assigned")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = dict(assigned.groupBy("cluster").agg(total.cast("long")).collect())  # at most one row a centroid
    by_cluster = F.array(*(F.lit(inertia.get(c, 0)) for c in range(len(centroids)))).cast("array<long>")
    return assigned.withColumns({"cluster_inertia": F.get(by_cluster, F.col("cluster")), "inertia": F.lit(sum(inertia.values())).cast("long")}), centroids


def centroid_digests(centroids: np.ndarray) -> list[str]:
    """The sha256 of each centroid's components as decimal integers, joined by commas."""
    return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

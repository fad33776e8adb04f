"""Centroid clustering against plain Lloyd rounds in Python's whole numbers."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from lumenstrata.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance string"


def plain(rows, k=8, rounds=10, seed=3, dimensions=64):
    kept = [
        (i, [math.floor(1024 * float(x)) for x in e]) for i, e in rows
        if e is not None and len(e) == dimensions and all(x is not None and math.isfinite(x) for x in e)
    ]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in order[:k]]
    if not c:
        return [], []
    apart = lambda v, q: sum((a - b) ** 2 for a, b in zip(v, q))
    near = lambda v: min((apart(v, q), j) for j, q in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], c


def check(df, rows, **how):
    want, c = plain(rows, **how)
    found, final = centroids.cluster_vectors(df, **how)
    got = found.collect()
    key = lambda r: (r[0] is None, r)
    assert sorted(((r["id"], r["cluster"], r["distance"]) for r in got), key=key) == sorted(want, key=key)
    assert final.tolist() == c
    for r in got:
        assert r["cluster_inertia"] == sum(d for _, j, d in want if j == r["cluster"]) and r["inertia"] == sum(d for _, _, d in want)


def test_the_given_vectors(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall()
    want, c = plain(rows)
    digests = [hashlib.sha256(",".join(map(str, q)).encode()).hexdigest() for q in c]
    got = {r["vec_id"]: r for r in queries.op11_centroid_clustering(spark, sf).collect()}
    assert {i: (r["cluster"], r["distance"], r["centroid_sha256"]) for i, r in got.items()} == {i: (j, d, digests[j]) for i, j, d in want}


def odd_rows():
    rng = random.Random(4)
    point = lambda: [rng.choice([-1.0, 0.0, 0.25, 1e-9, -1e-9]) for _ in range(64)]
    hot, rows = point(), []
    rows += [(i, hot) for i in range(100)]  # a third of the rows alike
    rows += [(100 + i, point()) for i in range(120)]
    rows += [(7, point()), (7, point()), (None, point()), (None, hot), (300, None), (301, []), (302, [0.5] * 63), (303, [0.5] * 65)]
    rows += [(304, [None] + [0.5] * 63), (305, [float("nan")] + [0.5] * 63), (306, [float("inf")] * 64), (307, [-float("inf")] + [0.5] * 63), (308, [99999.0] * 64)]
    return rows


def test_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    check(df.repartition(3), rows)
    assert centroids.cluster_vectors(df.filter("vec_id > 299 and vec_id < 308"))[0].count() == 0
    assert centroids.cluster_vectors(df.filter("vec_id is null"))[0].count() == 0  # no id, no start
    huge = spark.createDataFrame([(1, [1e30] * 64, "", "")], SCHEMA)
    assert centroids.cluster_vectors(huge)[0].count() == 0


@pytest.mark.parametrize("k, count", [(8, 3), (1, 40), (20, 400)])
def test_other_sizes(spark, k, count):
    rng = random.Random(k)
    rows = [(i, [rng.gauss(3 * (i % 5), 1) for _ in range(4)]) for i in range(count)]
    check(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(2), [(i, np.float32(v).tolist()) for i, v in rows], k=k, dimensions=4)


@pytest.mark.parametrize("spread", [40, 30000000])
def test_filtering_prunes_and_is_exact(spread):
    """Close groups are assigned as whole nodes; every part's labels are those of plain distances, ties to the smaller number."""
    rng = np.random.default_rng(5)
    middles = rng.integers(-spread, spread, (4, 6))
    x = (middles[rng.integers(0, 4, 3000)] + rng.integers(-3, 4, (3000, 6))).astype(np.int64)
    order, levels = centroids.split_block(x, 16)
    assert all((a == b).all() for a, b in zip(levels, centroids.levels_of(len(x), 16)))
    tree = centroids.Tree.of(x[order], levels)
    c = np.concatenate([middles, middles[:1], middles[1:2] + 1])
    labels, whole = np.full(len(x), -1), 0
    for a, b, label, what in tree.filtered(c):
        labels[a:b] = label
        if isinstance(label, int):
            whole += b - a
            assert (what == tree.x[a:b].sum(0)).all()
    want = ((tree.x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(2).argmin(1)
    assert (labels == want).all()
    assert whole > 500

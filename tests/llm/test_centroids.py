import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperledger.llm import centroids as c

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, clusters=40, rounds=5, size=64):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    centers = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), k) for k, m in enumerate(centers))

    for _ in range(rounds):
        members = [[] for _ in centers]
        for _, v in kept:
            members[near(v)[1]].append(v)
        centers = [[sum(x) // len(m) for x in zip(*m)] if m else old for m, old in zip(members, centers)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {k: sum(d for _, n, d in found if n == k) for _, k, _ in found}
    return sorted([(i, k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, centers[k])).encode()).hexdigest()) for i, k, d in found], key=repr)


def result(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def vectors(n, size, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(k, [float(x) for x in np.float32(rng.normal(0, spread, size))]) for k in range(n)]


@pytest.mark.parametrize("clusters,n", [(7, 120), (40, 25), (1, 10)])
def test_clusters_equal_brute_force(spark, clusters, n):
    rows = vectors(n, 6, n)
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(4)
    assert result(c.cluster(df, clusters, 5, 6)) == brute(rows, clusters, 5, 6)


def test_odd_vectors(spark):
    rows = vectors(40, 4, 1)
    same = rows[3][1]
    odd = [(100, None), (101, []), (102, [1.0] * 5), (103, [1.0, None, 0.0, 2.0]), (104, [float("nan")] * 4), (105, [float("inf"), 0.0, 0.0, 0.0]),
           (None, same), (None, rows[5][1]), (3, same), (200, same), (201, [0.0] * 4), (202, [-0.0] * 4), (203, [1e-9, -1e-9, 0.5, -0.5])]
    df = spark.createDataFrame([(*r, None) for r in rows + odd], SCHEMA).withColumns({n: F.lit("clash") for n in ["cluster", "distance", "digest", "n", "sums", "deal"]})
    assert result(c.cluster(df, 5, 5, 4)) == brute(rows + odd, 5, 5, 4)


def test_large_numbers_are_reckoned_in_full(spark):
    rows = vectors(30, 3, 2) + [(50 + k, [float(np.float32(3e6 * (k - 2))), 1.0, -2.0]) for k in range(6)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    assert result(c.cluster(df, 6, 3, 3)) == brute(rows, 6, 3, 3)
    huge = [*rows, (90, [3e38, -3e38, 0.0])]
    found = {r["vec_id"]: r for r in c.cluster(spark.createDataFrame([(*r, 0) for r in huge], SCHEMA), 2, 1, 3).collect()}
    assert len(found) == 37 and found[90]["inertia"] <= c.LARGEST


def test_nothing_gives_nothing(spark):
    assert c.cluster(spark.createDataFrame([], SCHEMA)).collect() == []
    assert c.cluster(spark.createDataFrame([(1, [1.0], 0)], SCHEMA)).collect() == []


@pytest.mark.parametrize("kind", [np.int64, object])
def test_walks_find_the_nearest_and_the_smallest_of_equals(kind):
    rng = np.random.default_rng(4)
    for size, k in [(1, 5), (2, 9), (8, 40), (64, 40)]:
        centers = rng.integers(-4, 5, (k, size))
        centers[k // 2] = centers[0]
        x = rng.integers(-6, 7, (300, size))
        number, distance = c.Lists([tuple(map(int, row)) for row in centers]).nearest(x.astype(kind))
        exact = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2)
        assert (number == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()


def test_walks_end_early_where_clusters_are_apart():
    """The walk measures few centroids of many when the vector is near one of them."""
    rng = np.random.default_rng(5)
    centers = rng.integers(-10_000, 10_000, (40, 4))
    lists, measured = c.Lists([tuple(map(int, row)) for row in centers]), []
    rows = lists.rows

    class Counting:
        shape, dtype = rows.shape, rows.dtype

        def __getitem__(self, what):
            measured.append(len(what))
            return rows[what]

    lists.rows = Counting()
    number, _ = lists.nearest(centers[rng.integers(0, 40, 200)] + 3)
    assert sum(measured) < 200 * 20

"""Exact integer k-means whose assignments come from the threshold algorithm."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperledger.llm.common import written

SIZE, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Components of this size and more are reckoned as Python's integers, since sums of their squares could leave 64 bits.
WIDE = 1 << 26
#: Vectors that a task walks at a time.
BLOCK = 1024
LARGEST = (1 << 63) - 1


def scaled(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)`` as integers: 64-bit ones, or Python's where a number is large."""
    floors = np.floor(values.astype(np.float64) * scale)
    if floors.size == 0 or np.abs(floors).max() < WIDE:
        return floors.astype(np.int64)
    return np.array([[int(x) for x in row] for row in floors], dtype=object)


class Lists:
    """The centroids' components as one sorted list for each dimension."""

    def __init__(self, centroids: list[tuple[int, ...]]):
        wide = any(abs(x) >= WIDE for row in centroids for x in row)
        self.rows = np.array(centroids, dtype=object if wide else np.int64)
        self.ids = np.argsort(self.rows, axis=0, kind="stable").T  # dimension, rank
        self.values = np.take_along_axis(self.rows.T, self.ids, axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each vector's nearest centroid, of equals the smallest number.

        The lists are walked outward from the vector's value in each
        dimension, one entry of each list a step. A centroid is measured
        exactly when it is met first. One that hasn't been met lies beyond the
        frontier in every dimension, so its distance is at least the sum of the
        frontiers' squares; when that exceeds the best, the walk ends.
        """
        k, size = self.rows.shape
        rows = self.rows.astype(object) if x.dtype == object else self.rows
        values, big = (self.values.astype(object), None) if x.dtype == object or self.rows.dtype == object else (self.values, np.iinfo(np.int64).max)
        n, dims = len(x), np.arange(size)
        best = np.full(n, big, dtype=object if big is None else np.int64)
        number = np.full(n, k)
        met = np.zeros((n, k), bool)
        left = np.stack([np.searchsorted(values[d], x[:, d]) for d in dims], axis=1) - 1  # last one below the value
        right = left + 1
        alive = np.arange(n)
        while len(alive):
            here, l, r = x[alive], left[alive], right[alive]
            below = here - values[dims, np.maximum(l, 0)]
            above = values[dims, np.minimum(r, k - 1)] - here
            down = (l >= 0) & ((r >= k) | (below <= above))
            gap = np.where(down, below, above)
            seen = self.ids[dims, np.where(down, l, np.minimum(r, k - 1))]
            left[alive], right[alive] = l - down, r + ~down
            fresh = np.zeros((len(alive), k), bool)
            fresh[np.arange(len(alive))[:, None], seen] = True
            fresh &= ~met[alive]
            met[alive] |= fresh
            who, what = np.nonzero(fresh)
            if len(who):
                off = here[who] - rows[what]
                distance = (off * off).sum(axis=1)
                for_rows = np.lexsort((what, distance, who)) if big is not None else np.array(sorted(range(len(who)), key=lambda i: (who[i], distance[i], what[i])))
                first = for_rows[np.r_[True, who[for_rows][1:] != who[for_rows][:-1]]]
                at, near, which = alive[who[first]], distance[first], what[first]
                old = best[at]
                better = np.array([o is None or d < o or (d == o and w < m) for d, o, w, m in zip(near, old, which, number[at])]) if big is None else (near < old) | ((near == old) & (which < number[at]))
                best[at[better]], number[at[better]] = near[better], which[better]
            frontier = (gap * gap).sum(axis=1)
            alive = alive[~((frontier > best[alive]) | met[alive].all(axis=1))]
        return number, best


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, np.ndarray]]:
    for batch in batches:
        for k in range(0, len(batch), BLOCK):
            part = batch.iloc[k : k + BLOCK]
            yield part["vec_id"], np.array(part["embedding"].tolist(), dtype=np.float64)


def kept_vectors(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """``vec_id, embedding`` (doubles) of the vectors with ``size`` components, none of them null or not finite."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where((F.size("embedding") == size) & finite)


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, seed: int = SEED, scale: int = SCALE) -> list[tuple[int, ...]]:
    """The vectors whose ids hash lowest, in ascending order of the hash; those with a null id come last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    picked = kept.select(digest.alias("digest"), "embedding").orderBy(F.asc_nulls_last("digest"), "embedding").limit(clusters).collect()
    return [tuple(int(x) for x in row) for row in scaled(np.array([r["embedding"] for r in picked]).reshape(len(picked), -1), scale)] if picked else []


def moved(kept: DataFrame, centroids: list[tuple[int, ...]], scale: int = SCALE) -> list[tuple[int, ...]]:
    """The floor of the mean of each centroid's vectors; an empty one stays.

    A task adds up its vectors first: it sends a row of sums for each centroid, and these
    are added in two steps, so that no task gets more than the rows of about a root of all tasks.
    """
    size = len(centroids[0])

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists, sums, counts = Lists(centroids), [[0] * size for _ in centroids], [0] * len(centroids)
        for _, values in _blocks(batches):
            x = scaled(values, scale)
            number, _ = lists.nearest(x)
            for c in np.unique(number):
                part = x[number == c]
                counts[c] += len(part)
                sums[c] = [a + int(b) for a, b in zip(sums[c], part.sum(axis=0))]
        rows = [(c, n, [str(a) for a in s]) for c, (n, s) in enumerate(zip(counts, sums)) if n]
        if rows:
            yield pd.DataFrame(rows, columns=["cluster", "n", "sums"])

    def add(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        sums = [0] * size
        for row in parts["sums"]:
            sums = [a + int(b) for a, b in zip(sums, row)]
        return pd.DataFrame([(key[0], int(parts["n"].sum()), [str(a) for a in sums])], columns=["cluster", "n", "sums"])

    schema = "cluster int, n long, sums array<string>"
    parts = kept.mapInPandas(total, schema).withColumn("deal", F.pmod(F.spark_partition_id(), F.lit(64)))
    first = parts.groupBy("cluster", "deal").applyInPandas(lambda key, p: add(key, p), schema)
    out = list(centroids)
    for row in first.groupBy("cluster").applyInPandas(lambda key, p: add(key, p), schema).collect():  # a row a centroid
        out[row["cluster"]] = tuple(int(s) // row["n"] for s in row["sums"])
    return out


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``, a row for each vector that is kept.

    Components become ``floor(scale * x)``. Vectors of another length (a null
    one too), or with a null or a number that isn't finite, are left out. With fewer than ``clusters``
    vectors each is a centroid. Repeated rows count each; of vectors whose ids
    hash alike the smaller one comes first, and null ids come last. A distance
    that 64 bits can't hold counts as 2^63 - 1, and so does a sum. An empty table gives no row; other columns are ignored.
    """
    kept = written(kept_vectors(vectors, size))
    centroids = first_centroids(kept, clusters, seed, scale)
    if not centroids:
        return kept.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(kept, centroids, scale)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists = Lists(centroids)
        for ids, values in _blocks(batches):
            number, distance = lists.nearest(scaled(values, scale))
            near = [min(int(d), LARGEST) for d in distance] if distance.dtype == object else distance
            yield pd.DataFrame({"vec_id": ids.astype("Int64").to_numpy(), "cluster": number.astype(np.int32), "distance": np.array(near, np.int64)}).astype({"vec_id": "Int64"})

    found = written(kept.mapInPandas(assign, "vec_id long, cluster int, distance long"))
    by = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"))
    sums = {r["cluster"]: int(r["sum"]) for r in by.collect()}  # a row a centroid
    inertias = F.array(*[F.lit(min(sums.get(c, 0), LARGEST)).cast("long") for c in range(len(centroids))])
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        F.get(inertias, F.col("cluster")).alias("cluster_inertia"),
        F.lit(min(sum(sums.values()), LARGEST)).cast("long").alias("inertia"),
        F.get(F.array(*map(F.lit, digests)), F.col("cluster")).alias("centroid_sha256"),
    )

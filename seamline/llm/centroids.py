"""Clusters around centroids over whole numbers, each vector's centroid found by an equal-average equal-variance search.

A component x becomes floor(64 x). Centroids are kept in order of the sum of their components. With sums S and deviations
V = sqrt(|x|^2 - S^2 / dim), a squared distance is at least (S_x - S_c)^2 / dim, and at least that plus (V_x - V_c)^2. A vector looks
outward from its own sum, to both sides: once the first bound exceeds the best distance so far, everything farther out on that
side does too and the side is closed; a centroid whose second bound exceeds it is skipped; what is left is worked out exactly, in
64-bit integers. Bounds have slack for rounding, so they only save work, and equal distances go to the smaller number.

The vectors are stored once as integers. Each round is one pass over them that doesn't move them: a task adds up its vectors by
cluster and only these sums, k rows of dim numbers a task, are shuffled (by cluster and component). The driver holds the k
centroids, k x dim numbers whatever the data, and so does every task.

Cases: a vector that is null, has not exactly `dim` components, or has one that is null or not finite takes no part, and neither does one
with a component of 2^21 or more, whose squared distance might not fit 64 bits. A row without an id takes part but is never a
starting centroid. Repeated rows are vectors of their own; where ids repeat, starting centroids go in order of hash, then of the
vector. Fewer vectors than k give fewer centroids, an empty table an empty result. A cluster that loses all its vectors keeps its centroid
and may win some later. Other columns, whatever their names, are left out.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.session import written

DIMENSIONS = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
#: 64 squares of a difference of two integers below 2^27 stay below 2^62.
MOST = 1 << 27
SLACK = 1e-7


def whole_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", dim: int = DIMENSIONS) -> DataFrame:
    """id, numbers (integers), total (their sum) and power (sum of their squares) of the vectors that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: F.coalesce((x * SCALE >= -MOST) & (x * SCALE < MOST), F.lit(False)))
    whole = rows.filter((F.size("vector") == dim) & sound).select("id", F.transform("vector", lambda x: F.floor(x * SCALE).cast("int")).alias("numbers"))
    added = lambda f: F.aggregate("numbers", F.lit(0).cast("long"), lambda acc, x: acc + f(x.cast("long")))
    return whole.select("id", "numbers", added(lambda x: x).alias("total"), added(lambda x: x * x).alias("power"))


class Search:
    """Nearest of a few centroids (k x dim integers), for many vectors at once."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, self.dim = centroids.astype(np.int64), centroids.shape[1]
        totals = self.centroids.sum(axis=1)
        self.order = np.argsort(totals, kind="stable")
        powers = (self.centroids**2).sum(axis=1)
        self.totals, self.powers, self.spread = totals[self.order], powers[self.order], self._spread(totals, powers)[self.order]

    def _spread(self, totals, powers):
        return np.sqrt(np.maximum(powers - totals.astype(float) ** 2 / self.dim, 0))

    def nearest(self, vectors: np.ndarray, totals: np.ndarray, powers: np.ndarray):
        """(number, squared distance) of each vector's nearest centroid, and how many distances were worked out."""
        spread, n, k = self._spread(totals, powers), len(vectors), len(self.order)
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        high = np.searchsorted(self.totals, totals)
        low, done, active = high - 1, 0, np.arange(n)
        gap = lambda rows, place, there: np.where(there, np.abs(totals[rows] - self.totals[place]).astype(float), np.inf)
        while len(active):
            lo, hi = low[active], high[active]
            below, above = gap(active, np.maximum(lo, 0), lo >= 0), gap(active, np.minimum(hi, k - 1), hi < k)
            down = below <= above
            near, place = np.minimum(below, above), np.where(down, lo, hi)
            by_mean = near**2 / self.dim
            limit = best[active] * (1 + SLACK)
            on = by_mean <= limit  # the nearer side is the last to be closed; beyond every centroid the gap is infinite
            active, place, down, by_mean, limit = active[on], place[on], down[on], by_mean[on], limit[on]
            low[active[down]] -= 1
            high[active[~down]] += 1
            slight = by_mean + (spread[active] - self.spread[place]) ** 2 - SLACK * (powers[active] + self.powers[place] + 1.0)
            kept = slight <= limit
            rows, found = active[kept], self.order[place[kept]]
            distance = ((vectors[rows] - self.centroids[found]) ** 2).sum(axis=1)
            done += len(rows)
            better = (distance < best[rows]) | ((distance == best[rows]) & (found < number[rows]))
            best[rows[better]], number[rows[better]] = distance[better], found[better]
        return number, best, done


def _matrix(batch, dim):
    return batch.column("numbers").flatten().to_numpy().reshape(-1, dim).astype(np.int64), batch.column("total").to_numpy(), batch.column("power").to_numpy()


def _sums(centroids):
    def add_up(batches):
        search, (k, dim) = Search(centroids), centroids.shape
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            vectors, totals, powers = _matrix(batch, dim)
            number, _, _ = search.nearest(vectors, totals, powers)
            np.add.at(sums, number, vectors)
            counts += np.bincount(number, minlength=k)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return add_up


def _assigned(centroids):
    def assign(batches):
        search = Search(centroids)
        for batch in batches:
            number, distance, _ = search.nearest(*_matrix(batch, centroids.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(number.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return assign


def starting_order() -> list[Column]:
    """The order in which vectors become centroids."""
    return [F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256).asc(), F.col("numbers").asc()]


def _moved(stored: DataFrame, centroids: np.ndarray) -> np.ndarray:
    parts = stored.select("numbers", "total", "power").mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
    totals = parts.select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    new = centroids.copy()
    for row in totals.collect():  # at most k x dim rows
        new[row["cluster"], row["at"]] = row["s"] // row["n"]
    return new


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, key: str = "vec_id", column: str = "embedding", dim: int = DIMENSIONS) -> tuple[DataFrame, np.ndarray]:
    """Per vector: its id (named `key`), cluster and squared distance, stored; and the final centroids."""
    stored = written(whole_vectors(vectors, key, column, dim), "whole-vectors")
    first = stored.filter("id IS NOT NULL").orderBy(*starting_order()).limit(k).select("numbers").collect()
    centroids = np.array([r["numbers"] for r in first], np.int64).reshape(-1, dim)
    if not len(centroids):  # only rows without an id, or none
        return stored.select(F.col("id").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), centroids
    for _ in range(rounds):
        centroids = _moved(stored, centroids)
    named = stored.select("id", "numbers", "total", "power").mapInArrow(_assigned(centroids), "id long, cluster int, distance long")
    return written(named.withColumnRenamed("id", key), "clusters"), centroids


def with_inertia(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Per vector: its id, cluster and distance, the inertia of its cluster and of all, and the hash of its centroid."""
    rows, centroids = clustered(vectors, key=key, column=column)
    spent = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("s")).collect()}
    told = [(c, s, sum(spent.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in spent.items()]
    totals = rows.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(totals), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

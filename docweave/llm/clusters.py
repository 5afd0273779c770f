"""Centroid clustering with exponion search.

Every vector keeps its centroid, an upper bound on the distance to it and a lower bound
on the distance to any other. A vector whose upper bound is below its lower one, or below
half the distance from its centroid to the nearest other, stays without a look at any
centroid. Otherwise the upper bound is made exact, and if that does not settle it, only
centroids inside a ball around the current one are compared: with u the distance to it
and s its distance to the nearest other centroid, a centroid as near as the nearest or
the second nearest lies within 2u + s. For each centroid the others are listed by
distance, so the ball is a prefix of a list, found by bisection. The radius is inclusive
and bounds are widened by more than rounding can take from them, so ties are all seen.

Components are integers and all comparisons between centroids use exact squared
distances. A round writes its vectors with their bounds, sums components by centroid
(map-side first, so a centroid that holds a third of the vectors is one row a task) and
moves the centroids; only these, ``k`` times the width, come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm._shared import Shipped, Tables, map_arrow

#: Components beyond this are held at it, so that squared distances stay in a long.
MOST = 1 << 26
#: Share by which bounds are widened.
SLACK = 1e-9
_STATE = "vec_id long, v array<long>, cluster int, upper double, lower double, distance long"


def usable(vector: str, width: int) -> Column:
    """Of exactly ``width`` components, none null or non-finite."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce(F.size(vector) == width, F.lit(False)) & ~F.exists(F.col(vector), bad)


def integers(vector: str, scale: float) -> Column:
    """floor(scale * x) of each component, held within ``MOST``."""
    at = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-float(MOST))), F.lit(float(MOST)))).cast("long")
    return F.transform(vector, at)


class Exponion:
    """Centroids with their distance lists, and how far they moved since the last round."""

    def __init__(self, centroids: np.ndarray, moved: np.ndarray) -> None:
        self.c, self.moved = centroids, moved
        k = len(centroids)
        apart = np.sqrt(((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2).astype(np.float64))
        np.fill_diagonal(apart, -1.0)  # a centroid heads its own list
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.maximum(np.take_along_axis(apart, self.order, axis=1), 0.0)
        self.near = self.apart[:, 1] if k > 1 else np.full(k, np.inf)
        others = np.where(np.eye(k, dtype=bool), -np.inf, np.broadcast_to(moved, (k, k))) if k else np.zeros((0, 0))
        self.drift = np.maximum(others.max(axis=1, initial=0.0), 0.0)

    def squared(self, x: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Exact squared distances of the rows to the centroids ``j``."""
        d = x - self.c[j]
        return np.einsum("ij,ij->i", d, d)

    def assign(self, x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, upper, lower) of the rows after the centroids moved."""
        a, upper, lower = a.copy(), upper + self.moved[a] * (1 + SLACK), (lower - self.drift[a] * (1 + SLACK))
        open_ = np.flatnonzero(upper >= np.maximum(lower, self.near[a] / 2 * (1 - SLACK)))
        if len(open_):
            upper[open_] = np.sqrt(self.squared(x[open_], a[open_]).astype(np.float64)) * (1 + SLACK) + SLACK
            open_ = open_[upper[open_] >= np.maximum(lower[open_], self.near[a[open_]] / 2 * (1 - SLACK))]
        for own in np.unique(a[open_]):
            self._scan(x, open_[a[open_] == own], int(own), a, upper, lower)
        return a, upper, lower

    def _scan(self, x: np.ndarray, rows: np.ndarray, own: int, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Compares the rows, all of centroid ``own``, with the centroids in their balls."""
        if len(self.c) == 1:
            return
        radius = (2 * upper[rows] + self.near[own]) * (1 + SLACK)
        reach = np.searchsorted(self.apart[own], radius, side="right")
        rows, reach = rows[np.argsort(-reach, kind="stable")], -np.sort(-reach)
        first, at = self.squared(x[rows], np.full(len(rows), own)), np.full(len(rows), own)
        second = np.full(len(rows), np.iinfo(np.int64).max)
        for r in range(1, len(self.c)):
            n = int(np.searchsorted(-reach, -r, side="left"))  # rows whose ball holds more than r
            if not n:
                break
            j = int(self.order[own, r])
            d = self.squared(x[rows[:n]], np.full(n, j))
            better = (d < first[:n]) | ((d == first[:n]) & (j < at[:n]))
            second[:n] = np.where(better, first[:n], np.minimum(second[:n], d))
            first[:n], at[:n] = np.where(better, d, first[:n]), np.where(better, j, at[:n])
        a[rows] = at
        upper[rows] = np.sqrt(first.astype(np.float64)) * (1 + SLACK) + SLACK
        lower[rows] = np.sqrt(second.astype(np.float64)) * (1 - SLACK) - SLACK


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), width)


def _assigned(state: DataFrame, centroids: np.ndarray, moved: np.ndarray, width: int, last: bool) -> DataFrame:
    shipped = Shipped(state.sparkSession, (centroids, moved))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Exponion(*shipped.get())
        for batch in batches:
            x = _matrix(batch.column(1), width)
            a, upper, lower = search.assign(x, *(batch.column(i).to_numpy() for i in (2, 3, 4)))
            d = search.squared(x, a) if last else np.zeros(len(a), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(d)], ["vec_id", "v", "cluster", "upper", "lower", "distance"])

    return map_arrow(state, run, _STATE)


def _floor_mean(sums: list, n: int) -> list[int]:
    return [int(s) // n for s in sums]


def k_means(vectors: DataFrame, *, k: int = 16, rounds: int = 3, width: int = 64, scale: float = 64.0, seed: str = "1:", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each
    vector of exactly ``width`` components, none null or non-finite.

    Components count as floor(scale * x), held within +-2**26. Centroids 0, 1, ... start as
    the ``k`` vectors (all, if fewer) with the smallest hex SHA-256 of ``seed`` and the id;
    of one id that comes twice the smaller vector first, vectors without id last. Each of
    ``rounds`` rounds assigns every vector to the nearest centroid, of ties the smaller
    number, and replaces every centroid that has vectors by the floor of their mean; at
    last they are assigned once more. ``distance`` is squared; the inertias sum it over the
    cluster and over all, held at the end of the range of long. Repeated rows count as
    often as they stand; no vectors give no rows. Other columns are not read."""
    spark = vectors.sparkSession
    tables = Tables(spark, "k-means")
    kept = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(usable("v", width)).select("vec_id", integers("v", scale).alias("v"))
    bounds = [F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).cast("long").alias("distance")]
    state = tables.keep(kept.select("vec_id", "v", *bounds), "round-0")
    hashed = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    seeds = state.orderBy(hashed.asc_nulls_last(), "v").limit(k).select("v").collect()
    empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not seeds:
        return spark.createDataFrame([], empty)
    centroids = np.array([r["v"] for r in seeds], dtype=np.int64).reshape(len(seeds), width)
    moved = np.zeros(len(centroids))
    for turn in range(rounds):
        state = tables.keep(_assigned(state, centroids, moved, width, False), f"round-{turn + 1}")
        tables.drop(f"round-{turn}")
        sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(width))).collect()
        new = centroids.copy()
        for r in sums:
            new[r["cluster"]] = _floor_mean([r[f"s{i}"] for i in range(width)], r["n"])
        moved = np.sqrt(((new - centroids) ** 2).sum(axis=1).astype(np.float64))
        centroids = new
    found = tables.keep(_assigned(state, centroids, moved, width, True).select("vec_id", "cluster", "distance"), "found")
    tables.drop(f"round-{rounds}")
    most = (1 << 63) - 1
    inertia = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    total = min(most, sum(inertia.values()))
    named = [(j, min(most, d), total, hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, d in sorted(inertia.items())]
    about = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

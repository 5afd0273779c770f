"""Exact top-k by inner product with MaxScore.

A query term is a dimension together with the sign of the query's component. A
vector stands in a term's postings if its component has that sign, so it adds
more than zero; other components add nothing or less. A term's bound in a shard is
the most that any vector there adds. Terms in order of their bounds split into
non-essential ones, whose bounds together cannot beat the k-th score so far, and
essential ones: a vector in no essential posting is out. Essential postings are
traversed, then the other terms are probed, in falling order of bounds, for the
vectors that still can compete. Shards yield k rows a query; a window merges them.

Queries travel as broadcast blocks of bounded size; each block reads the
candidates once. Scores are integers; sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.llm._shared import Shipped, Tables, map_arrow

#: Query components (8 bytes each) in a broadcast block.
BLOCK_CELLS = 1 << 20
#: Candidates in a shard's postings.
SHARD_ROWS = 4096
#: Terms probed between two tests of what still competes.
PROBE = 8
_FIELDS = ["query_id", "vec_id", "score"]
_LONG = (1 << 63) - 1
_FAR = np.finfo(np.float64).max


def usable(vector: str) -> Column:
    """Neither null nor with a null or non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(F.col(vector), bad)


def scaled(column: pa.Array, scale: float) -> np.ndarray:
    """Rows of floor(scale * x) as integers held in float64; short rows end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(np.asarray(column.flatten().cast(pa.float64())) * scale), -_FAR, _FAR)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


class Shard:
    """The postings of one run of candidates, sorted by id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], np.ascontiguousarray(x[order].T)
        self.high, self.low = self.x.max(axis=1, initial=0), self.x.min(axis=1, initial=0)
        self.most = np.abs(self.x).max(initial=0)

    def best(self, own: int, q: np.ndarray, k: int, floor: tuple | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, none of which is worse than ``floor``, the
        (score, id) of the k-th found before."""
        with np.errstate(over="ignore"):
            large = self.most * np.abs(q).max(initial=0) * len(q) >= 2.0**53
        if large:
            return self._large(own, q, k)
        bound = np.where(q > 0, q * self.high, q * self.low)
        terms = np.argsort(-bound, kind="stable")
        beyond = np.concatenate([np.cumsum(bound[terms][::-1])[::-1], [0.0]])
        least = floor[0] if floor else -np.inf
        essential = int(np.count_nonzero(beyond[:-1] >= max(least, 0.0))) if least > 0 else len(terms)
        rows = np.flatnonzero(self.ids != own)
        score = np.zeros(len(rows))
        if least > 0:
            posted = np.zeros(len(self.ids), dtype=bool)
            for t in terms[:essential]:
                posted |= self.x[t] > 0 if q[t] > 0 else self.x[t] < 0
            rows = rows[posted[rows]]
            score = score[: len(rows)]
        at = 0
        while at < len(terms) and len(rows):
            step = terms[at : at + PROBE]
            score = score + q[step] @ self.x[np.ix_(step, rows)] if len(rows) < len(self.ids) // 2 else score + (q[step] @ self.x[step])[rows]
            at += len(step)
            live = score + beyond[min(at, len(terms))] >= least
            rows, score = rows[live], score[live]
        if len(rows) > k:
            cut = np.partition(score, len(score) - k)[len(score) - k]
            top = score >= cut
            rows, score = rows[top], score[top]
            order = np.lexsort((self.ids[rows], -score))[:k]
            rows, score = rows[order], score[order]
        return self.ids[rows], score.astype(np.int64)

    def _large(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        exact = [int(v) for v in q]
        found = [(min(_LONG, max(-_LONG - 1, sum(a * int(b) for a, b in zip(exact, self.x[:, i], strict=True)))), int(v)) for i, v in enumerate(self.ids) if v != own]
        found = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
        return np.array([v for _, v in found], dtype=np.int64), np.array([s for s, _ in found], dtype=np.int64)


def _merge(held: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    ids, scores = np.concatenate([held[0], new[0]]), np.concatenate([held[1], new[1]])
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def top_k(vectors: DataFrame, *, queries: Column | None = None, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its ``k`` highest scores, or
    all if fewer, ties to the smaller id.

    ``queries`` selects query rows, by default those whose id is divisible by 100;
    candidates are all rows but those with the query's id. Each component counts as
    floor(scale * x), one beyond the range of double as the largest double. Rows without id, and vectors that are null or hold a null or
    non-finite component, take no part; shorter vectors count as ending in zeros.
    A candidate id that comes twice is ranked twice, a repeated query row once. A
    score beyond the range of long is held at its end. Other columns are not read.
    """
    spark = vectors.sparkSession
    tables = Tables(spark, "top-k")
    good = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(F.col("vec_id").isNotNull() & usable("v"))
    asked = vectors.where(queries if queries is not None else F.col(vec_id) % 100 == 0)
    asked = asked.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(F.col("vec_id").isNotNull() & usable("v")).dropDuplicates(["vec_id"])

    def block(ids: list[int], rows: list) -> DataFrame:
        shipped = Shipped(spark, (np.array(ids, dtype=np.int64), scaled(pa.array(rows, type=pa.list_(pa.float64())), scale)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, q = shipped.get()
            none = np.zeros(0, np.int64)
            best = [(none, none)] * len(own)
            for batch in batches:
                x = scaled(batch.column(1), scale)
                width = max(x.shape[1], q.shape[1])
                x, wide = _widened(x, width), _widened(q, width)
                for at in range(0, len(x), SHARD_ROWS):
                    shard = Shard(batch.column(0).to_numpy()[at : at + SHARD_ROWS], x[at : at + SHARD_ROWS])
                    for i, (one, row) in enumerate(zip(own, wide, strict=True)):
                        floor = (best[i][1][-1], best[i][0][-1]) if len(best[i][0]) == k else None
                        best[i] = _merge(best[i], shard.best(one, row, k, floor), k)
            sizes = [len(i) for i, _ in best]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, sizes)), pa.array(np.concatenate([none, *(i for i, _ in best)])), pa.array(np.concatenate([none, *(s for _, s in best)]))], _FIELDS)

        return map_arrow(good, run, "query_id long, vec_id long, score long")

    ids: list[int] = []
    rows: list = []
    cells = turn = 0
    for one, v in asked.toLocalIterator():
        ids.append(one)
        rows.append(v)
        cells += max(1, len(v))
        if cells >= BLOCK_CELLS:
            tables.keep(block(ids, rows), "found", "append")
            ids, rows, cells, turn = [], [], 0, turn + 1
    last = block(ids, rows)
    if turn:
        last = tables.keep(last, "found", "append")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return last.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

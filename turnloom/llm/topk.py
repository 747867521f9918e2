"""Exact top-k by inner product over an impact-ordered index, read score-at-a-time.

A shard of vectors is indexed by postings (vector, impact), one for each component that isn't zero. A posting's quantised
impact is its level, two to a factor of two of |impact|; the postings of one level and one dimension are a segment, and
segments are laid down by descending level. Reading a segment adds impact times query component to the accumulators of
its vectors. What a vector's unread postings can still add is at most |query| * |unread part of the vector|
(Cauchy-Schwarz, from the squares that the levels read so far have left of it). So a vector whose accumulator plus that
bound lies below the k-th best score known is out, with proof; the others may be members. Reading stops when scoring
those exactly costs less than the segments left, and they are scored from the forward vectors in whole numbers. If no
bound parts them, all segments are read, and the accumulators are the exact scores.

The index is built once, shard by shard, and written to the shared folder. Queries come in batches of bounded size, which
every task of the index gets; a task reads its shards one after the other, and the k-th best scores of those behind it
are thresholds for the next. Only k rows a query and task are shuffled.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import written

#: Sums of products of whole numbers below these are exact in single and double precision.
_EXACT32, _EXACT64 = 1 << 24, 1 << 53
#: Queries read together.
_TOGETHER = 64


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of every component. Null ids, null vectors and those with null or non-finite components go."""
    ok = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
        .filter(ok)
        .withColumn("v", F.transform("v", lambda x: F.floor(x * scale)))
    )


def matrix(vs: list) -> np.ndarray:
    """Shorter vectors count as padded with zeros."""
    out = np.zeros((len(vs), max((len(v) for v in vs), default=0)), dtype=np.int64)
    for i, v in enumerate(vs):
        out[i, : len(v)] = v
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    """The values in the smallest whole-number type that holds them."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


class ImpactIndex:
    """The postings of one shard, and its vectors for exact scores.

    segments holds (level, dimension, first posting) in reading order, rows and impacts the postings; unread holds, for
    each level in reading order, every vector's length once that level has been read.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, _narrow(vectors)
        rows, dims = np.nonzero(vectors)
        impacts = vectors[rows, dims]
        level = np.floor(2 * np.log2(np.abs(impacts.astype(np.float64)))).astype(np.int64)
        order = np.lexsort((rows, dims, -level))
        rows, dims, impacts, level = rows[order], dims[order], impacts[order], level[order]
        new = np.append(True, (np.diff(level) != 0) | (np.diff(dims) != 0)) if len(rows) else np.zeros(0, dtype=bool)
        first = np.flatnonzero(new)
        self.rows, self.impacts = rows.astype(np.uint32), _narrow(impacts)
        self.segments = np.stack([level[first], dims[first], first], axis=1)
        left = (vectors.astype(np.float64) ** 2).sum(axis=1)
        self.unread = []
        for n in np.unique(level)[::-1]:
            at = level == n
            left = np.maximum(left - np.bincount(rows[at], weights=impacts[at].astype(np.float64) ** 2, minlength=len(vectors)), 0)
            self.unread.append(np.sqrt(left).astype(np.float32))
        self.read = 0  # postings, over all searches and counted for each query

    def dump(self) -> bytes:
        return pickle.dumps(self.__dict__)

    @classmethod
    def load(cls, blob: bytes) -> ImpactIndex:
        index = cls.__new__(cls)
        index.__dict__ = pickle.loads(blob)
        return index

    def _exact(self, queries: np.ndarray) -> type:
        most = max(queries.shape[1], 1) * float(np.abs(queries).max(initial=0)) * float(np.abs(self.vectors.astype(np.float64)).max(initial=0))
        return np.float32 if most < _EXACT32 else np.float64 if most < _EXACT64 else object

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple:
        """(query row, vector row, score) of every query's k best, itself left out; ties go to the smaller id. floors are
        scores that a query's k-th best reaches at least; vectors below them may be left out."""
        width = max(queries.shape[1], self.vectors.shape[1])
        queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
        floors = np.full(len(queries), -np.inf) if floors is None else floors
        found = []
        for at in range(0, len(queries), _TOGETHER):
            part = slice(at, at + _TOGETHER)
            rows, cols, scores = self._search(queries[part], query_ids[part], k, floors[part])
            found.append((rows + at, cols, scores))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 3

    def _search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, floors: np.ndarray) -> tuple:
        n, kind = len(self.ids), self._exact(queries)
        own = self.ids[:, None] == query_ids[None, :]
        if kind is object:
            return self._rescored(queries, ~own, k)
        q, norm = queries.astype(kind), np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        acc = np.zeros((n, len(q)), dtype=kind)
        ends = [*self.segments[1:, 2].tolist(), len(self.rows)]
        levels = self.segments[:, 0]
        told, passed = np.isfinite(floors).all(), 0
        for s, (_, dim, first) in enumerate(self.segments.tolist()):
            rows = self.rows[first : ends[s]]
            acc[rows] += self.impacts[first : ends[s], None].astype(kind) * q[None, :, dim]
            self.read += len(rows) * len(q)
            left = len(self.rows) - ends[s]
            if not left or levels[s + 1] == levels[s]:
                continue  # look for members between levels only
            slack = norm[None, :] * self.unread[passed][:, None].astype(np.float64) * (1 + 1e-6)
            passed += 1
            if 2 * left > len(self.rows):
                continue  # bounds this early don't part anything
            if n > k + 1 and not told:  # without a threshold from before, the k-th best lower bound is one
                low = np.where(own, -np.inf, acc - slack)
                floors = np.maximum(floors, np.partition(low, n - k, axis=0)[n - k])
            alive = (acc + slack >= floors[None, :]) & ~own
            if np.count_nonzero(alive) * self.vectors.shape[1] <= left * len(q):
                return self._rescored(queries, alive, k)
        return self._best(*np.nonzero(~own & (acc >= floors[None, :])), acc, k)

    def _rescored(self, queries: np.ndarray, members: np.ndarray, k: int) -> tuple:
        """Exact scores of the possible members, some at a time."""
        cols, rows = np.nonzero(members)
        kind = object if self._exact(queries) is object else np.int64
        step = max(1, (1 << 22) // max(1, self.vectors.shape[1]))
        parts = [(self.vectors[cols[a : a + step]].astype(kind) * queries[rows[a : a + step]].astype(kind)).sum(axis=1) for a in range(0, len(cols), step)]
        return self._chosen(rows, cols, np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64), k)

    def _best(self, cols: np.ndarray, rows: np.ndarray, acc: np.ndarray, k: int) -> tuple:
        scores = acc[cols, rows]
        if len(self.ids) > k:  # only those that reach a query's k-th best need sorting
            most = np.full(acc.shape, -np.inf)
            most[cols, rows] = scores
            keep = scores >= np.partition(most, len(self.ids) - k, axis=0)[len(self.ids) - k][rows]
            cols, rows, scores = cols[keep], rows[keep], scores[keep]
        return self._chosen(rows, cols, scores.astype(np.int64), k)

    def _chosen(self, rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, k: int) -> tuple:
        rows, at = _k_best(rows, self.ids[cols], scores, k)
        return rows, cols[at], scores[at]


def _k_best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of each row's k highest scores, ties to the smaller id."""
    order = np.lexsort((ids, -scores, rows))
    rows = rows[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], order[keep]


def index_of(vectors: DataFrame, shard_rows: int) -> DataFrame:
    """One row a shard of at most shard_rows of (id, v), as they come: its index. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vs = [], []

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([ImpactIndex(np.array(ids, dtype=np.int64), matrix(vs)).dump()], pa.binary())], names=["shard"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i), vs.append(v)
                if len(ids) == shard_rows:
                    yield shard()
                    ids, vs = [], []
        if ids:
            yield shard()

    return vectors.mapInArrow(run, "shard binary")


def _found(index: DataFrame, queries: np.ndarray, query_ids: np.ndarray, k: int) -> DataFrame:
    """(query_id, at, vec_id, score): k rows a query, told by its place, and task."""
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast((_narrow(queries), query_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, query_ids = sent.value
        queries = queries.astype(np.int64)
        rows, ids, scores = (np.zeros(0, dtype=np.int64) for _ in range(3))
        floors = np.full(len(queries), -np.inf)
        for b in batches:
            for blob in b.column(0):
                shard = ImpactIndex.load(blob.as_py())
                r, c, s = shard.search(queries, query_ids, k, floors)
                rows, ids, scores = np.concatenate([rows, r]), np.concatenate([ids, shard.ids[c]]), np.concatenate([scores, s])
                rows, at = _k_best(rows, ids, scores, k)
                ids, scores = ids[at], scores[at]
                full = np.flatnonzero(np.bincount(rows, minlength=len(queries)) == k)
                floors[full] = scores[np.searchsorted(rows, full, side="right") - 1].astype(np.float64)
        cols = [pa.array(query_ids[rows], pa.int64()), pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores.astype(np.int64), pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["query_id", "at", "vec_id", "score"])

    return index.mapInArrow(run, "query_id long, at long, vec_id long, score long")


def exact_top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64,
    shard_rows: int = 16_384, batch_rows: int = 32_768,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller id.

    Every query meets every shard, in batches of about batch_rows queries, dealt by row number, that pass through the
    driver; vectors never do. Vectors that are null or hold null or non-finite components take no part; fewer than k
    others give fewer rows; empty tables give an empty one; repeated ids are rows of their own, and none of a query's
    id is among its results, of which a repeated query has one set; shorter vectors count as padded with zeros; scores
    beyond 64 bits are an error.
    """
    q = written(quantised(queries, id_col, vec_col, scale).dropDuplicates(["id", "v"]), "queries")
    index = written(index_of(quantised(vectors, id_col, vec_col, scale), shard_rows), "index")
    batches = max(1, math.ceil(q.count() / batch_rows))
    dealt = q.withColumn("batch", F.pmod(F.xxhash64("id", "v"), F.lit(batches)))
    best = Window.partitionBy("query_id", "at").orderBy(F.desc("score"), "vec_id")
    found = None
    for b in range(batches):
        asked = dealt.filter(F.col("batch") == b).select("id", "v").toArrow()
        part = _found(index, matrix(asked["v"].to_pylist()), asked["id"].to_numpy().astype(np.int64), k)
        part = part.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        part = written(part, "found") if batches > 1 else part
        found = part if found is None else found.unionByName(part)
    return found

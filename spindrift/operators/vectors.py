"""Exact nearest neighbours of a stated query set, in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Query vectors in one broadcast; more queries mean more passes, not larger ones.
BLOCK = 32_768
#: Distances that are held at once.
CELLS = 4_000_000
#: Vectors that are compared with a tile of queries at once.
COLUMNS = 1024
SCALE = 1_000_000
#: A distance that none reaches.
FAR = np.iinfo(np.int64).max


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def semantic_similarity(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2; a vector of length zero counts as orthogonal."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.5).otherwise((dot(a, b) / norms + 1) / 2)


def _distances(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        d = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * q @ v.T
        return np.maximum(d, 0)
    n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
    return 1 - np.divide(q @ v.T, n, out=np.zeros_like(n), where=n > 0)


def _top(d: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least distances (whole numbers) of each row, in order; of equal ones the least rank first."""
    n = d.shape[1]
    if n and d.max(initial=0) >= (1 << 62) // n:
        return np.lexsort((np.broadcast_to(rank, d.shape), d), axis=1)[:, :k]
    key = d * n + rank
    if n > k:
        best = np.argpartition(key, k - 1, axis=1)[:, :k]
        return np.take_along_axis(best, np.argsort(np.take_along_axis(key, best, 1), axis=1), 1)
    return np.argsort(key, axis=1)


class _Sought:
    """Queries in tiles against the vectors of one task, a block at a time: per query the k least distances so far.

    No vector beyond the k-th of them can be among the nearest, so but for a first block only what a product of single precision, with room
    for its error, puts within it is measured. Where that is much, as among copies, and in the first block, all of the block is.
    """

    def __init__(self, q: np.ndarray, k: int, metric: str):
        self.q, self.k, self.metric = q, k, metric
        self.norm = np.linalg.norm(q, axis=1)
        self.least = np.full((len(q), k), FAR)  # in millionths

    def _narrow(self, x: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] > 0) if self.metric == "cosine" else x

    def measured(self, i: np.ndarray, v: np.ndarray, norm: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = [np.zeros(0)]
        step = max(1, CELLS // max(1, v.shape[1]))
        for a in range(0, len(i), step):
            x, y = i[a : a + step], j[a : a + step]
            product = np.einsum("ij,ij->i", self.q[x], v[y])
            if self.metric == "l2":
                out.append(np.maximum(self.norm[x] ** 2 + norm[y] ** 2 - 2 * product, 0))
            else:
                n = self.norm[x] * norm[y]
                out.append(1 - np.divide(product, n, out=np.zeros_like(n), where=n > 0))
        return np.round(np.concatenate(out) * SCALE).astype(np.int64)

    def found(self, v: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query, vector and distance of what may be among the nearest, k a query at most; of equal distances the least rank first."""
        norm = np.linalg.norm(v, axis=1)
        most = max(self.norm.max(initial=0), norm.max(initial=0))
        kind = np.float32 if most < 1e15 else np.float64
        l2 = self.metric == "l2"
        spare = (v.shape[1] + 16) * float(np.finfo(np.float32).eps) * (4 * most * most if l2 else 2) + 1 / SCALE
        right = self._narrow(v, norm)
        right = (np.column_stack([2 * right, -norm * norm]) if l2 else right).astype(kind)
        wide = max(1, min(COLUMNS, len(v)))
        tall = max(1, CELLS // (2 * wide))
        for a in range(0, len(self.q), tall):
            left = self._narrow(self.q[a : a + tall], self.norm[a : a + tall])
            left = (np.column_stack([left, np.ones(len(left))]) if l2 else left).astype(kind)
            base = self.norm[a : a + tall] ** 2 if l2 else np.ones(len(left))
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for b in range(0, len(v), wide):
                limit = self.least[a : a + tall].max(axis=1)
                near = np.zeros(0, np.int64)
                if limit.min() < FAR:
                    least = (base - (limit.astype(float) + 1) / SCALE - spare).astype(kind)
                    near = np.flatnonzero(~(left @ right[b : b + wide].T < least[:, None]))
                    if not len(near):
                        continue
                w = min(wide, len(v) - b)
                if limit.min() >= FAR or len(near) * 16 > len(left) * w:
                    d = np.round(_distances(self.q[a : a + tall], v[b : b + wide], self.metric) * SCALE).astype(np.int64)
                    best = _top(d, rank[b : b + wide], self.k)
                    i, j = np.repeat(np.arange(len(d)), best.shape[1]), best.ravel()
                    micros = d[i, j]
                else:
                    i, j = np.divmod(near, w)
                    micros = self.measured(a + i, v, norm, b + j)
                held.append(self._first(i, b + j, micros, rank, limit))
                self._told(a, *held[-1])
            if held:
                limit = self.least[a : a + tall].max(axis=1)
                i, j, micros = self._first(*(np.concatenate(x) for x in zip(*held, strict=True)), rank, limit)
                yield a + i, j, micros

    def _first(self, i: np.ndarray, j: np.ndarray, micros: np.ndarray, rank: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        within = np.flatnonzero(micros <= limit[i])
        i, j, micros = i[within], j[within], micros[within]
        order = np.lexsort((rank[j], micros, i))
        i, j, micros = i[order], j[order], micros[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < self.k
        return i[keep], j[keep], micros[keep]

    def _told(self, a: int, i: np.ndarray, j: np.ndarray, micros: np.ndarray) -> None:
        rows, first, count = np.unique(i, return_index=True, return_counts=True)
        new = np.full((len(rows), self.k), FAR)
        new[np.repeat(np.arange(len(rows)), count), np.arange(len(i)) - np.repeat(first, count)] = micros
        both = np.concatenate([self.least[a + rows], new], axis=1)
        self.least[a + rows] = np.partition(both, self.k - 1, axis=1)[:, : self.k]


def _nearest(held, k: int, metric: str, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = held.value
        asked, sought = pa.array(ids, kind), _Sought(q, k, metric)
        for b in batches:
            if not b.num_rows:
                continue
            other = b.column("id")
            rank = pc.rank(other, tiebreaker="first").to_numpy().astype(np.int64) - 1
            v = np.asarray(b.column("vector").flatten(), float).reshape(b.num_rows, -1)
            for i, j, micros in sought.found(v, rank):
                yield pa.RecordBatch.from_pydict({"query_id": asked.take(pa.array(i)), "id": other.take(pa.array(j)), "micros": pa.array(micros)})

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """query_id, rank (1 is nearest), id, distance (rounded to 6 places) of the k nearest vectors of each query.

    Both take (id, vector) with ids of any type; rows without an id or a vector take no part. Each block of queries is one pass over the vectors: a task keeps
    the k least distances of each query so far, and of an Arrow batch only rows within them go on to the final ranking, k a query at most. Ties go to the smaller id.
    """
    spark, ids, block, passes = queries.sparkSession, [], [], []
    kinds = [queries.schema["id"].dataType, vectors.schema["id"].dataType]
    schema = f"query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, micros long"
    whole = vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).where("id IS NOT NULL AND size(vector) > 0")

    def flush():
        held = spark.sparkContext.broadcast((list(ids), np.array(block, float)))
        passes.append(whole.mapInArrow(_nearest(held, k, metric, to_arrow_type(kinds[0])), schema))
        ids.clear()
        block.clear()

    for r in queries.select("id", "vector").where("id IS NOT NULL AND size(vector) > 0").orderBy("id").toLocalIterator():
        ids.append(r[0])
        block.append(r[1])
        if len(ids) == BLOCK:
            flush()
    if ids:
        flush()
    if not passes:
        return spark.createDataFrame([], f"query_id {kinds[0].simpleString()}, rank int, id {kinds[1].simpleString()}, distance double")
    order = Window.partitionBy("query_id").orderBy("micros", "id")
    ranked = reduce(DataFrame.unionAll, passes).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", (F.col("micros") / SCALE).alias("distance"))

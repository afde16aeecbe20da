"""Exact top-k search by inner product with a KD-tree for each shard.

Components become integers, ``floor(scale * x)``, and scores are exact integers. Vectors are dealt into shards of about
``SHARD_ROWS`` rows. In a shard's tree every node splits at the median of its widest dimension and keeps a tight bounding
box. A box bounds the inner product with a query: each dimension adds the larger of the products with the box's two sides.
Traversal is best first: nodes leave a heap by descending bound, and it ends when the best bound left is below the score of
the k-th vector found. Equal bounds are still visited, since ties go to the smaller id.

Queries first search one shard each. The k-th score found there is a lower limit of the final one, so it is sent along when
they search all other shards, in blocks of ``QUERY_ROWS`` queries against one shard. Only vectors at or above the limit come
back.

Cases: vectors that are null, empty, or hold null or non-finite components take no part, neither as query nor candidate;
queries meet only vectors of their own length; rows that share the query's id are its own and no candidates, other
repeated rows are candidates each; rows with a null id take no part; scores outside 64 bits are cut to its limits; an empty
table gives no row. Only the named columns are read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logtriage.llm.common import stored

SHARD_ROWS = 8192
QUERY_ROWS = 2048
LEAF = 128
FOUND = "query_id bigint, vec_id bigint, score bigint"


class KdTree:
    """Median splits and tight boxes over the rows of ``points`` (float64 holding integers)."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> None:
        order = np.arange(len(points))
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[tuple[int, int]] = []
        low, high, todo = [], [], [(0, len(points), -1)]
        while todo:
            a, b, parent = todo.pop()
            own = points[order[a:b]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            node = len(self.rows)
            self.rows.append((a, b))
            self.children.append(None)
            if parent >= 0:
                self.children[parent] = (*(self.children[parent] or ()), node)
            spread = high[-1] - low[-1]
            if b - a > leaf and spread.max() > 0:
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, spread.argmax()], middle)]
                todo += [(a, a + middle, node), (a + middle, b, node)]
        self.low, self.high = np.array(low), np.array(high)
        self.points, self.ids = points[order], ids[order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For every query and node, the most that a vector in the node's box can score."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bound: np.ndarray, own_id: int, k: int, limit: float) -> list[tuple[int, int]]:
        """The ``k`` best (score, id) at or above ``limit``, best first."""
        scores, ids = np.zeros(0), np.zeros(0, dtype=np.int64)
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= limit:
            node = heapq.heappop(heap)[1]
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(heap, (-bound[child], child))
                continue
            a, b = self.rows[node]
            found = self.points[a:b] @ query
            good = (found >= limit) & (self.ids[a:b] != own_id)
            if good.any():
                scores, ids = np.append(scores, found[good]), np.append(ids, self.ids[a:b][good])
                best = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[best], ids[best]
                if len(best) == k:
                    limit = scores[-1]
        return [(int(s), int(i)) for s, i in zip(scores, ids, strict=True)]


def search_shard(
    points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, limits: np.ndarray, k: int
) -> list[tuple[int, int, int]]:
    """(query id, id, score) of each query's best in one shard."""
    most = float(np.abs(points.astype(float)).max()) * float(np.abs(queries.astype(float)).max()) * points.shape[1]
    rows = []
    if most < 2**53:  # exact in double precision
        tree = KdTree(points.astype(float), ids)
        bounds = tree.bounds(queries.astype(float))
        for query, own, bound, limit in zip(queries.astype(float), query_ids.tolist(), bounds, limits, strict=True):
            rows += [(own, i, s) for s, i in tree.search(query, bound, own, k, limit)]
        return rows
    top, low = (1 << 63) - 1, -(1 << 63)  # components too large for doubles: Python's integers
    for query, own in zip(queries.astype(object), query_ids.tolist(), strict=True):
        scores = [(min(max(int(s), low), top), i) for s, i in zip(points.astype(object) @ query, ids.tolist(), strict=True)]
        best = heapq.nsmallest(k, (x for x in scores if x[1] != own), key=lambda x: (-x[0], x[1]))
        rows += [(own, i, s) for s, i in best]
    return rows


def integral(vectors: DataFrame, key: str, column: str, scale: int) -> DataFrame:
    """``vec_id``, ``v`` (integer components), ``size`` of the vectors that take part."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    v = F.transform(column, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    found = vectors.where(F.col(key).isNotNull() & (F.size(column) > 0) & finite)
    return found.select(F.col(key).cast("bigint").alias("vec_id"), v.alias("v"), F.size(column).alias("size"))


def _matrix(rows: pa.Table, name: str) -> np.ndarray:
    column = rows.column(name).combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def _searched(shards: DataFrame, queries: DataFrame, keys: list[str], k: int) -> DataFrame:
    def search(own: pa.Table, asked: pa.Table) -> pa.Table:
        rows = []
        if own.num_rows and asked.num_rows:
            ids, query_ids = own.column("vec_id").to_numpy(), asked.column("q_vec_id").to_numpy()
            limits = asked.column("q_least").to_numpy().astype(float)
            rows = search_shard(_matrix(own, "v"), ids, _matrix(asked, "q_v"), query_ids, limits, k)
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.table([pa.array(list(c), pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    asked_of = queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns))
    return shards.groupBy(*keys).cogroup(asked_of.groupBy(*(f"q_{c}" for c in keys))).applyInArrow(search, FOUND)


def top_k(
    vectors: DataFrame, asked: Column, k: int = 10, scale: int = 1024, key: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` best of all rows for every row that ``asked`` (over
    ``vec_id``) selects."""
    plain = integral(vectors, key, column, scale)
    shards = max(1, math.ceil(plain.count() / SHARD_ROWS))
    dealt = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    placed = stored(plain.withColumn("shard", dealt), "vectors")
    queries = placed.where(asked).withColumn("least", F.lit(-math.inf))
    keys = ["size", "shard"]
    home = stored(_searched(placed, queries, keys, k), "home")
    limit = home.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
    limit = limit.where(F.col("n") >= k).select("query_id", F.col("kth").cast("double").alias("kth"))
    blocks = max(1, math.ceil(queries.count() / QUERY_ROWS))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    sent = queries.join(limit, F.col("vec_id") == F.col("query_id"), "left").select(
        "vec_id", "v", "size", block.alias("block"), F.coalesce("kth", F.lit(-math.inf)).alias("least"),
        F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("shard"))).alias("shard"),
    )
    met = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rest = _searched(met, sent, [*keys, "block"], k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    found = home.unionByName(rest).select("query_id", rank, "vec_id", "score")
    return found.where(F.col("rank") <= k)

"""Operator 5: exact top-k inner products by one KD-tree a shard.

Vectors are quantised to integers and dealt to shards by hash. Each shard builds a KD-tree: median splits of
the widest dimension, a tight bounding box at every node. A query walks a tree best first: nodes by the upper
bound of its product with the box, until no bound reaches the query's kth score so far. The kth score
propagates: a first step asks one shard a query, and the other shards start from the score found there, so that they
enter only boxes that can still improve it.

Queries are a stated part of the rows; nothing is broadcast. A shard's points come first in its task, its queries stream
past them in blocks of at most ``BLOCK``, so that a task holds one shard and one block, whatever the number of queries.
Scores are exact: products are summed in float64 while they stay below 2**53, else in Python
integers (clipped to 64 bits in the result).

Null vectors and vectors with a null or non-finite component take no part, nor do rows without an id; vectors of a
different length than the query don't meet it. Rows are told apart by a key of their own: of repeated ids each row is a query and a
candidate by itself, whatever its vector, and a query finds every row but itself; its answers stand under the shared id, one list a row.
Equal scores go to the smaller id. Long vectors are searched as any. An empty table gives an empty result; further columns, of any name, are ignored.
"""

from __future__ import annotations

import decimal
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import tasks, written

#: Queries that meet a shard together, vectors in a shard (about) and in a leaf.
BLOCK, SHARD, LEAF = 256, 16_384, 64


class Tree:
    """Nodes of a KD-tree over the rows of ``points``: boxes, children (-1: a leaf) and row ranges of ``order``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points, self.order = points, np.arange(len(points))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int]] = []
        stack = [(0, len(points), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            rows = points[self.order[a:b]]
            low, high = rows.min(axis=0), rows.max(axis=0)
            me = len(self.spans)
            self.low.append(low)
            self.high.append(high)
            self.spans.append((a, b))
            self.children.append((-1, -1))
            if parent >= 0:
                pair = list(self.children[parent])
                pair[side] = me
                self.children[parent] = tuple(pair)
            wide = int((high - low).argmax())
            if b - a > leaf and high[wide] > low[wide]:
                half = (a + b) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(rows[:, wide], half - a)]
                stack += [(half, b, me, 1), (a, half, me, 0)]
        self.low, self.high = np.stack(self.low), np.stack(self.high)
        self.sorted = points[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest product of each query with a point of each box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def search(tree: Tree, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, query_rows: np.ndarray, floors: list[float], k: int) -> list[list[tuple[float, int]]]:
    """Of each query its (score, id) in this tree that are at least its floor, without its own row, the k best (ties: smaller ids)."""
    out = []
    bounds = tree.bounds(queries)
    sorted_ids, sorted_rows = ids[tree.order], rows[tree.order]
    for q, own, floor, bound in zip(queries, query_rows, floors, bounds, strict=True):
        best: list[tuple[float, int]] = []  # heap of (score, -id): its first is the kth
        nodes = [(-bound[0], 0)]
        while nodes:
            most, node = heapq.heappop(nodes)
            if -most < floor or (len(best) == k and -most < best[0][0]):
                break
            left, right = tree.children[node]
            if left >= 0:
                heapq.heappush(nodes, (-bound[left], left))
                heapq.heappush(nodes, (-bound[right], right))
                continue
            a, b = tree.spans[node]
            scores = tree.sorted[a:b] @ q
            least = max(floor, best[0][0]) if len(best) == k else floor
            for i in np.flatnonzero((scores >= least) & (sorted_rows[a:b] != own)).tolist():
                item = (scores[i], -int(sorted_ids[a + i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        out.append([(s, -i) for s, i in best])
    return out


def quantised(column: pa.Array, scale: float) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).reshape(len(column), -1)


def _large(points: np.ndarray) -> bool:
    """Whether sums of products could pass 2**53."""
    return bool(points.size) and float(np.abs(points).max()) ** 2 * points.shape[1] >= 2**53


def _integers(points: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in points], object)


class Shard:
    """The points of one shard and length; its trees, of float64 and of Python integers, are made when first asked."""

    def __init__(self, batches: list[pa.RecordBatch], scale: float) -> None:
        self.ids = np.concatenate([b.column("id").to_numpy(zero_copy_only=False) for b in batches])
        self.rows = np.concatenate([b.column("row").to_numpy(zero_copy_only=False) for b in batches])
        self.points = np.concatenate([quantised(b.column("embedding"), scale) for b in batches])
        self.large = _large(self.points)
        self.trees: dict[bool, Tree] = {}

    def best(self, asked: pa.RecordBatch, k: int, scale: float) -> pa.RecordBatch:
        wanted = quantised(asked.column("embedding"), scale)
        large = self.large or _large(wanted)
        if large not in self.trees:
            self.trees[large] = Tree(_integers(self.points) if large else self.points)
        number = int if large else float
        floors = [-np.inf if x is None else number(x) for x in asked.column("floor").to_pylist()]
        keys = asked.column("row").to_numpy(zero_copy_only=False)
        found = search(self.trees[large], self.ids, self.rows, _integers(wanted) if large else wanted, keys, floors, k)
        names = zip(keys.tolist(), asked.column("id").to_pylist(), strict=True)
        rows = [(*name, i, decimal.Decimal(int(s))) for name, best in zip(names, found, strict=True) for s, i in best]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.decimal128(38, 0))], ["query_row", "query_id", "vec_id", "score"])


def answers(batches: Iterator[pa.RecordBatch], k: int, scale: float, block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """``query_row, query_id, vec_id, score`` from rows ``shard, dims, asks, id, row, embedding, floor`` in the order of the first three."""
    key, points, shard = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("shard", "dims", "asks")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            if start == stop:
                continue
            if tuple(keys[:2, start]) != key:
                key, points, shard = tuple(keys[:2, start]), [], None
            if not keys[2, start]:
                points.append(batch.slice(start, stop - start))
                continue
            if points:
                shard, points = Shard(points, scale), []
            if shard is not None:
                for at in range(start, stop, block):
                    yield shard.best(batch.slice(at, min(block, stop - at)), k, scale)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, shard: int = SHARD) -> DataFrame:
    """``vectors(vec_id, embedding)`` to ``query_id, rank, vec_id, score``; queries are the rows with vec_id divisible by ``every``."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    usable = usable.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dims"))
    shards = max(1, -(-usable.count() // shard))
    usable = usable.withColumn("row", F.monotonically_increasing_id())  # written with the row, so that it stays the same
    dealt = written(usable.withColumn("shard", F.pmod(F.xxhash64("id", "row"), F.lit(shards)).cast("int")), "vectors")
    queries = dealt.where(F.col("id") % every == 0)
    queries = queries.withColumn("home", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).cast("int"))
    order = ["shard", "dims", "asks"]
    points = dealt.select("shard", "dims", F.lit(0).alias("asks"), "id", "row", "embedding", F.lit(None).cast("decimal(38,0)").alias("floor"))

    def ask(asked: DataFrame) -> DataFrame:
        asked = asked.select(F.col("to").alias("shard"), "dims", F.lit(1).alias("asks"), "id", "row", "embedding", "floor")
        rows = points.union(asked).repartition(max(shards, tasks(vectors.sparkSession)), "shard").sortWithinPartitions(*order)
        return rows.mapInArrow(lambda batches: answers(batches, k, scale), "query_row long, query_id long, vec_id long, score decimal(38,0)")

    first = written(ask(queries.withColumn("to", F.col("home")).withColumn("floor", F.lit(None).cast("decimal(38,0)"))), "first")
    floors = first.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    second = ask(queries.join(floors, "row", "left").withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("to <> home"))
    # A query has at most k rows of each shard; the ranks are those of its k best.
    merged = first.union(second).groupBy("query_row", "query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    ranked = merged.select("query_id", F.posexplode("best").alias("at", "b"))
    limit = 2**63 - 1
    score = F.least(F.greatest(-F.col("b.s"), F.lit(-limit - 1).cast("decimal(38,0)")), F.lit(limit).cast("decimal(38,0)")).cast("long")
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), score.alias("score"))

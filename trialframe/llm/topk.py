"""Exact top-k inner products: a ball tree for each shard, searched by branch and bound.

Vectors become integer vectors, are written once and dealt to shards of about ``SHARD_ROWS`` rows. A task streams one
shard's vectors, builds a ball tree over them (centre, radius, both children) and then streams queries past it. For a
query the nodes wait in a heap ordered by their upper bound q.c + |q| r; the search ends when the best bound is below
the query's current kth score, so nothing that could still be among the k best, ties included, is left out.

The kth score is shared between shards in two rounds. In the first a query goes to its home shard alone and learns a
score that k rows reach at least. In the second it goes to all the other shards with that bar, which cuts their trees
from the root on. What a shard returns is at most k rows a query; a window's row number picks from them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialframe.llm.workers import bound_batches, trim
from trialframe.scratch import discard, materialize

SHARD_ROWS = 8192
LEAF_ROWS = 64
#: Shuffle partitions for each shard, so that few shards meet in one task.
SPREAD = 4
#: Queries whose bounds to all nodes of a tree are taken at a time.
QUERY_BLOCK = 256
#: Products of integers up to here are exact in double precision, sums included.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(row, vec_id, x): floor(scale * component), in double precision, of every vector without null or non-finite components.

    ``row`` tells rows apart, whatever their ids. Null vectors, and those with a component whose product with ``scale``
    is not finite, are left out.
    """
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda c: c * F.lit(scale))
    narrow = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return narrow.where(F.col("x").isNotNull() & finite)


class BallTree:
    """Balls over the rows of ``x`` (integers in float64, or Python integers in an object array where those are too large)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray):
        order = np.arange(len(x))
        self.centers: list[np.ndarray] = []
        self.radii: list[float] = []
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        wide = x.astype(np.float64)
        todo = [(self._ball(wide, order, 0, len(x)), 0, len(x))]
        while todo:
            node, low, high = todo.pop()
            if high - low <= LEAF_ROWS or self.radii[node] == 0:
                continue
            own = wide[order[low:high]]
            far = own[int(np.argmax(((own - self.centers[node]) ** 2).sum(axis=1)))]
            other = own[int(np.argmax(((own - far) ** 2).sum(axis=1)))]
            middle = (low + high) // 2
            order[low:high] = order[low:high][np.argpartition(own @ (other - far), middle - low)]
            left, right = self._ball(wide, order, low, middle), self._ball(wide, order, middle, high)
            self.children[node] = (left, right)
            todo += [(left, low, middle), (right, middle, high)]
        self.ids, self.rows, self.x = ids[order], rows[order], x[order]
        self.largest = float(np.abs(wide).max(initial=0.0))
        self.c, self.r = np.stack(self.centers), np.array(self.radii)
        self.c_norm = np.sqrt((self.c**2).sum(axis=1))

    def _ball(self, x: np.ndarray, order: np.ndarray, low: int, high: int) -> int:
        own = x[order[low:high]]
        # a mean by scaled rows: the sum of very large components stays finite
        center = (own / len(own)).sum(axis=0)
        self.centers.append(center)
        self.radii.append(float(np.sqrt(((own - center) ** 2).sum(axis=1).max())))
        self.spans.append((low, high))
        self.children.append(None)
        return len(self.radii) - 1

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of queries (rows) with anything in each node, rounding included."""
        wide = q.astype(np.float64)
        norm = np.sqrt((wide**2).sum(axis=1))[:, None]
        top = wide @ self.c.T + norm * self.r
        top = top + 1e-9 * norm * (self.c_norm + self.r) + 1e-6
        return np.where(np.isnan(top), np.inf, top)

    def search(self, row: int, q: np.ndarray, bounds: np.ndarray, k: int, bar: int | None) -> list[tuple[int, int, int]]:
        """The k best (score, (-id, -row), position) of one query among rows that reach ``bar``; its own row is left out."""
        best: list[tuple[int, tuple[int, int], int]] = []  # a heap: the worst kept comes first
        heap = [(-bounds[0], 0)]
        while heap:
            top, node = heapq.heappop(heap)
            least = best[0][0] if len(best) == k else bar
            least = None if least is not None and least <= -LONG else least
            if least is not None and -top < least:
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    if least is None or bounds[child] >= least:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            low, high = self.spans[node]
            scores = self.x[low:high] @ q
            near = range(high - low) if least is None else np.flatnonzero(scores >= least)
            for at in near:
                here = low + int(at)
                if self.rows[here] == row:
                    continue
                entry = (max(-LONG, min(LONG, int(scores[at]))), (-int(self.ids[here]), -int(self.rows[here])), here)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return best


#: Stands for an id that is null: behind all others.
NO_ID = LONG


def _matrix(part: pa.RecordBatch) -> np.ndarray:
    dims = part.column("dims")[0].as_py()
    return np.floor(part.column("x").flatten().to_numpy(zero_copy_only=False)).reshape(part.num_rows, dims)


def _exact(x: np.ndarray, largest: float) -> np.ndarray:
    """float64 where all products of integers up to ``largest`` are exact, else Python integers."""
    if largest * largest * max(1, x.shape[1]) < EXACT:
        return x
    return np.array([[int(v) for v in r] for r in x.tolist()], dtype=object).reshape(x.shape)


def _search(k: int):
    """Streams (shard, ask, row, vec_id, bar, x): each shard's vectors, of one number of components, before its queries."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, held = None, None, []

        def planted() -> BallTree:
            ids, rows = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            x = np.concatenate([h[2] for h in held])
            held.clear()
            return BallTree(ids, rows, _exact(x, float(np.abs(x).max(initial=0.0))))

        def answers(part: pa.RecordBatch) -> pa.RecordBatch:
            n = part.num_rows
            q = _matrix(part)
            rows, ids = part.column("row").to_pylist(), part.column("vec_id").to_pylist()
            bars = part.column("bar").to_pylist()
            largest = max(tree.largest, float(np.abs(q).max(initial=0.0)))
            exact = _exact(q, largest)
            if exact.dtype == object and tree.x.dtype != object:
                tree.x = _exact(tree.x, largest)
            elif tree.x.dtype == object and exact.dtype != object:
                exact = np.array([[int(v) for v in r] for r in q.tolist()], dtype=object).reshape(q.shape)
            out: list[list] = [[], [], [], [], []]
            for start in range(0, n, QUERY_BLOCK):
                bounds = tree.bounds(q[start : start + QUERY_BLOCK])
                for i in range(start, min(n, start + QUERY_BLOCK)):
                    for score, (_, other), here in tree.search(rows[i], exact[i], bounds[i - start], k, bars[i]):
                        found = int(tree.ids[here])
                        for column, v in zip(out, (rows[i], ids[i], None if found == NO_ID else found, -other, score), strict=True):
                            column.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query", "query_id", "vec_id", "row", "score"])

        for batch in batches:
            shards, asks = batch.column("shard").to_numpy(), batch.column("ask").to_numpy()
            sizes = batch.column("dims").to_numpy()
            starts = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1]) | (sizes[1:] != sizes[:-1])])
            for low, high in zip(starts, np.r_[starts[1:], len(shards)], strict=True):
                part = batch.slice(int(low), int(high - low))
                if (shards[low], sizes[low]) != key:
                    key, tree = (shards[low], sizes[low]), None
                    held.clear()
                if asks[low] == 0:
                    ids = part.column("vec_id").fill_null(NO_ID).to_numpy()
                    held.append((ids, part.column("row").to_numpy(), _matrix(part)))
                    continue
                if held:
                    tree = planted()
                if tree is not None:
                    yield answers(part)
            trim()

    return scan


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the k other rows of the highest inner products.

    Components are floor(scale * x) as integers. Equal scores go by ascending id, nulls last; among rows of one id by an
    order that is the same in every run over the same files. Fewer rows than k others give all of them.

    Vectors that are null or hold null or non-finite components take no part; vectors of unlike lengths are not compared.
    A null id is no query but may be found. Rows with one id are rows of their own, each a query; a row is left out of
    its own results only. Scores beyond a long count as the largest or smallest one. Empty vectors score 0. An empty
    table gives no rows; further columns are ignored, whatever their names.
    """
    table = integers(vectors, id_col, vector_col, scale)
    table = materialize(table.withColumn("dims", F.size("x")), "vectors")
    shards = max(1, -(-table.count() // shard_rows))
    home = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    indexed = table.select(home.alias("shard"), "dims", F.lit(0).alias("ask"), "row", "vec_id", F.lit(None).cast("long").alias("bar"), "x")
    queries = table.where(F.col("vec_id") % every == 0)
    bound_batches(vectors.sparkSession)

    def searched(asked: DataFrame) -> DataFrame:
        dealt = indexed.unionByName(asked).repartition(SPREAD * shards, "shard").sortWithinPartitions("shard", "dims", "ask", "row")
        return dealt.mapInArrow(_search(k), "query long, query_id long, vec_id long, row long, score long")

    first = materialize(searched(queries.select(home.alias("shard"), "dims", F.lit(1).alias("ask"), "row", "vec_id", F.lit(None).cast("long").alias("bar"), "x")), "home")
    hits = first
    if shards > 1:
        bars = first.groupBy(F.col("query").alias("row")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bar"))
        others = F.explode(F.expr(f"filter(sequence(0, {shards - 1}), s -> s <> home)")).alias("shard")
        again = queries.withColumn("home", home).join(bars, "row", "left").select(others, "dims", F.lit(1).alias("ask"), "row", "vec_id", "bar", "x")
        hits = first.unionByName(searched(again))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = materialize(ranked.select("query_id", "rank", "vec_id", "score"), "top-k")
    discard(first, table)
    return out

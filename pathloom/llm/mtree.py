"""Exact highest inner products by best-first search in M-trees.

Vectors are dealt to shards of a bounded number of rows; a shard is one M-tree. One more coordinate makes all vectors of
a shard equally long, so the nearest in Euclidean distance has the highest inner product. Queries go to every shard in
blocks; each search returns its ``k`` best of the shard, and the best of all shards are merged.
"""

from __future__ import annotations

import heapq
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.scale import cut_lineage

PAGE = 48
SHARD_ROWS = 16384
QUERY_BLOCK = 2048


class MTree:
    """A metric tree over the rows of ``points``. A page holds at most ``page`` entries. A leaf entry is a point; a
    routing entry has a centre, a covering radius and a child page. Every entry keeps its distance to the centre above."""

    def __init__(self, points: np.ndarray, page: int = PAGE):
        self.points, self.page = points, page
        rows = np.arange(len(points))
        self.root = self._page(rows, self._centre(rows)) if len(points) else None

    def _centre(self, rows: np.ndarray) -> np.ndarray:
        return self.points[rows].mean(axis=0)

    def _page(self, rows: np.ndarray, centre: np.ndarray) -> tuple:
        """(is leaf, distances of the entries to the centre, rows or centres, radii, child pages)."""
        if len(rows) <= self.page:
            return True, np.linalg.norm(self.points[rows] - centre, axis=1), rows, None, None
        parts = self._split(rows)
        centres = np.array([self._centre(part) for part in parts])
        radii = np.array([np.linalg.norm(self.points[p] - c, axis=1).max() for p, c in zip(parts, centres)])
        children = [self._page(p, c) for p, c in zip(parts, centres)]
        return False, np.linalg.norm(centres - centre, axis=1), centres, radii, children

    def _split(self, rows: np.ndarray) -> list[np.ndarray]:
        """At most ``page`` parts of near points: the widest part is halved at the median of its distance to a far point."""
        most = min(self.page, -(-len(rows) // self.page) * 2)
        heap, order = [(-len(rows), 0, rows)], count(1)
        while len(heap) < most and -heap[0][0] > max(2, self.page // 2):
            part = heapq.heappop(heap)[2]
            x = self.points[part]
            far = x[np.argmax(((x - x[0]) ** 2).sum(axis=1))]
            other = x[np.argmax(((x - far) ** 2).sum(axis=1))]
            side = np.argsort(x @ (far - other), kind="stable")
            half = len(part) // 2
            for piece in (part[side[:half]], part[side[half:]]):
                heapq.heappush(heap, (-len(piece), next(order), piece))
        return [piece for _, _, piece in heap]

    def search(self, query: np.ndarray, offer, slack: float) -> None:
        """Hand rows to ``offer(rows)`` by pages, nearest page first, until no page can hold a point nearer than the
        distance that ``offer`` returned last. ``slack`` covers rounding."""
        if self.root is None:
            return
        reach, order = np.inf, count()
        heap = [(0.0, next(order), self.root, None)]
        while heap:
            least, _, (leaf, to_parent, entries, radii, children), at = heapq.heappop(heap)
            if least > reach + slack:
                return
            # The triangle inequality with the stored distances rules entries out before theirs is computed.
            bound = np.zeros(len(to_parent)) if at is None else np.abs(at - to_parent)
            bound = bound if leaf else bound - radii
            open_ = np.flatnonzero(bound <= reach + slack)
            if leaf:
                reach = offer(entries[open_], reach)
                continue
            distance = np.linalg.norm(entries[open_] - query, axis=1)
            for i, d in zip(open_, distance):
                nearest = max(0.0, d - radii[i], least)
                if nearest <= reach + slack:
                    heapq.heappush(heap, (nearest, next(order), children[i], d))


def _search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` highest inner products of each query within the shard, ties to the smaller id, its own rows left out."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[order], vectors[order]
    new = np.append(True, (vectors[1:] != vectors[:-1]).any(axis=1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ids))
    distinct = vectors[first]  # equal vectors are one point; their ids follow in order
    exact = distinct.astype(np.float64)
    square = (exact**2).sum(axis=1)
    longest = square.max()
    points = np.column_stack([exact, np.sqrt(longest - square)])
    tree = MTree(points)
    out: list[tuple[int, int, int]] = []
    for query_id, query in zip(query_ids, queries):
        best: list[tuple[int, int]] = []  # heap of (score, -id), the worst first
        q = query.astype(np.float64)
        length = float(q @ q)

        def offer(rows: np.ndarray, reach: float) -> float:
            scores = distinct[rows] @ query
            for i in np.argsort(-scores, kind="stable"):
                score = int(scores[i])
                if len(best) == k and score < best[0][0]:
                    break
                taken = 0
                for one in ids[first[rows[i]]:last[rows[i]]]:
                    if one == query_id:
                        continue
                    entry = (score, -int(one))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                    else:
                        break
                    taken += 1
                    if taken == k:
                        break
            return np.sqrt(max(0.0, length + longest - 2 * best[0][0])) if len(best) == k else np.inf

        tree.search(np.append(q, 0.0), offer, 1e-6 * (np.sqrt(length + longest) + 1))
        out += [(int(query_id), -i, s) for s, i in best]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")


def top_k_inner_products(vectors: DataFrame, k: int = 10, *, every: int = 100, scale: int = 1024,
                         shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """For each row of ``vectors (vec_id, embedding)`` whose id is divisible by ``every`` the ``k`` rows of another id with the
    highest inner product of the vectors ``floor(scale * x)``; ties to the smaller id.

    Rows whose vector is null or holds null, NaN or infinite components, and rows without id, take no part. Vectors of unequal length are
    compared as if the shorter one went on with zeros; an empty vector scores 0. Of rows that repeat an id and a vector one
    counts. A vector whose product with itself is beyond 64 bits after scaling is an error, since the score is a long. Returns ``query_id, rank, vec_id, score``.
    """
    x = F.col("embedding").cast("array<double>")
    usable = x.isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(
        x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long"))
    points = vectors.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("point"))
    points = cut_lineage(points)
    squared = F.aggregate("point", F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double"))
    rows, width, largest = points.agg(F.count(F.lit(1)), F.max(F.size("point")), F.max(squared)).first()
    # No product of two vectors, nor a part of its sum, is beyond the largest square; a little is left for rounding.
    if (largest or 0.0) > 2**63 * (1 - 1e-9):
        raise ValueError("a component is too large for exact scores")
    width = max(width or 0, 1)
    padded = F.slice(F.concat("point", F.array_repeat(F.lit(0).cast("long"), width)), 1, width)
    points = points.select("vec_id", padded.alias("point"))
    shards = max(1, -(-rows // shard_rows))
    blocks = max(1, -(-rows // every // query_block))
    order = F.xxhash64("vec_id")
    sharded = points.select(F.pmod(order, F.lit(shards)).alias("shard"), "vec_id", "point", F.lit(False).alias("asks"))
    asking = points.filter(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64(order, F.lit(1)), F.lit(blocks)))
    # A shard meets each block of queries in a task of its own; both are bounded.
    each_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    each_shard = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    met = sharded.withColumn("block", F.lit(0).cast("long")) if blocks == 1 else sharded.select("*", each_block.alias("block"))
    asked = asking.select(each_shard.alias("shard"), "vec_id", "point", F.lit(True).alias("asks"), "block")

    def search(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        matrix = np.array(table["point"].tolist(), np.int64).reshape(-1, width)
        ids, asks = table["vec_id"].to_numpy(np.int64), table["asks"].to_numpy(bool)
        if asks.all() or not asks.any():
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        own = np.unique(np.column_stack([ids[~asks], matrix[~asks]]), axis=0)
        ask = np.unique(np.column_stack([ids[asks], matrix[asks]]), axis=0)
        return _search_shard(own[:, 0], own[:, 1:], ask[:, 0], ask[:, 1:], k)

    found = met.unionByName(asked).groupBy("shard", "block").applyInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Nearest vectors by inner product, with a vantage-point tree per shard.

Adding the coordinate ``sqrt(M^2 - |x|^2)`` to every vector and 0 to every query, ``M`` being the greatest norm,
turns the largest inner product into the smallest Euclidean distance, for which the triangle inequality
holds. Vectors are dealt over shards by hash and every shard builds a tree: a node splits its vectors at
the median distance from a vantage point, down to leaves that are compared as one matrix product.

A branch is left out for a query if the triangle inequality says that it holds nothing nearer than
the k-th hit so far. That bound is relaxed by a factor: the k-th distance is divided by it, so a factor of one
is the exact search and larger ones prune more. Hits carry exact scores of the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from docquarry.session import materialize

_SLACK = 1e-9


@dataclass(frozen=True)
class Search:
    """``k`` hits per query; a shard has about ``shard_rows`` vectors, a block ``block_rows`` queries."""

    k: int = 20
    factor: float = 1.0
    leaf_rows: int = 256
    shard_rows: int = 1 << 13
    block_rows: int = 1 << 10
    seed: int = 7


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``v`` (doubles) of vectors that are not NULL, empty or zero and have finite components only.

    Vectors of another length than most are kept; those of different lengths never meet.
    """
    values = F.col(vector).cast("array<double>")
    good = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0)
    return df.where(F.col(key).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(key).cast("long").alias("id"), values.alias("v"))


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, summed in one fixed order so that copies score alike."""
    return (queries * vectors).sum(axis=1)


class Tree:
    """A vantage-point tree over points; each distinct point holds its smallest ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top_norm: float, search: Search):
        self.search = search
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        fresh = np.ones(len(ids), dtype=bool)
        fresh[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        first = np.flatnonzero(fresh)
        # Copies score alike and smaller ids win: no more than k + 1 of them can matter, one being the query.
        keep = np.arange(len(ids)) - np.repeat(first, np.diff([*first, len(ids)])) <= search.k
        self.ids, self.vectors = ids[keep], vectors[keep]
        rest = np.maximum(top_norm**2 - (self.vectors**2).sum(axis=1), 0)
        self.points = np.concatenate([self.vectors, np.sqrt(rest)[:, None]], axis=1)
        self.squares = (self.points**2).sum(axis=1)
        self.scale = max(top_norm, 1e-300)
        self.random = np.random.default_rng(search.seed)
        self.root = self._build(np.arange(len(self.ids)))

    def _build(self, rows: np.ndarray) -> tuple:
        """A leaf (rows,) or a node (vantage point, (near low, near high), near, (far low, far high), far)."""
        if len(rows) <= self.search.leaf_rows:
            return (rows,)
        center = self.points[rows[self.random.integers(len(rows))]]
        d = np.sqrt(np.maximum(((self.points[rows] - center) ** 2).sum(axis=1), 0))
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        near, far = order[:half], order[half:]
        return (center, (d[near[0]], d[near[-1]]), self._build(rows[near]), (d[far[0]], d[far[-1]]), self._build(rows[far]))

    def nearest(self, q_ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, score) of up to k hits for each query, itself left out."""
        n, k = len(queries), self.search.k
        self._q = np.concatenate([queries, np.zeros((n, 1))], axis=1)
        self._q_ids, self._q_squares, self._queries = q_ids, (queries**2).sum(axis=1), queries
        self._best = np.full((n, k), -np.inf)
        self._hit = np.full((n, k), np.iinfo(np.int64).max)
        self._home(self.root, np.arange(n))
        self._visit(self.root, np.arange(n))
        found = np.isfinite(self._best)
        return np.nonzero(found)[0], self._hit[found], self._best[found]

    def _reach(self, rows: np.ndarray) -> np.ndarray:
        """Distance of the k-th hit, divided by the relaxing factor."""
        low = self._best[rows, -1]
        squared = self._q_squares[rows] + self.scale**2 - 2 * low
        return np.sqrt(np.maximum(squared, 0)) / self.search.factor + _SLACK * self.scale

    def _home(self, node: tuple, rows: np.ndarray) -> None:
        """Take every query to one leaf first, so that pruning starts from a good bound."""
        if len(node) == 1:
            self._compare(node[0], rows)
        elif len(rows):
            center, near_span, near, far_span, far = node
            d = np.sqrt(np.maximum(((self._q[rows] - center) ** 2).sum(axis=1), 0))
            left = d <= (near_span[1] + far_span[0]) / 2
            self._home(near, rows[left])
            self._home(far, rows[~left])

    def _visit(self, node: tuple, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if len(node) == 1:
            self._compare(node[0], rows)
            return
        center, *sides = node
        d = np.sqrt(np.maximum(((self._q[rows] - center) ** 2).sum(axis=1), 0))
        for (low, high), child in zip(sides[::2], sides[1::2]):
            least = np.maximum(np.maximum(low - d, d - high), 0)
            self._visit(child, rows[least <= self._reach(rows)])

    def _compare(self, leaf: np.ndarray, rows: np.ndarray) -> None:
        """Merge the vectors of a leaf into the hits of the queries."""
        if not len(rows) or not len(leaf):
            return
        k = self.search.k
        rough = self._queries[rows] @ self.vectors[leaf].T
        near = rough >= self._best[rows, -1][:, None] - _SLACK * self.scale * (1 + np.sqrt(self._q_squares[rows]))[:, None]
        i, j = np.nonzero(near & (self._q_ids[rows][:, None] != self.ids[leaf][None, :]))
        if not len(i):
            return
        touched, at = np.unique(i, return_inverse=True)
        exact = scores(self._queries[rows[i]], self.vectors[leaf[j]])
        own = rows[touched]
        # A leaf may be seen twice, so hits that are there already are dropped.
        query = np.concatenate([at, np.repeat(np.arange(len(own)), k)])
        ids = np.concatenate([self.ids[leaf[j]], self._hit[own].ravel()])
        values = np.concatenate([exact, self._best[own].ravel()])
        order = np.lexsort((ids, -values, query))
        query, ids, values = query[order], ids[order], values[order]
        same = np.zeros(len(ids), dtype=bool)
        same[1:] = (query[1:] == query[:-1]) & (ids[1:] == ids[:-1]) & np.isfinite(values[1:])
        query, ids, values = query[~same], ids[~same], values[~same]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < k
        best, hit = np.full((len(own), k), -np.inf), np.full((len(own), k), np.iinfo(np.int64).max)
        best[query[keep], place[keep]], hit[query[keep], place[keep]] = values[keep], ids[keep]
        self._best[own], self._hit[own] = best, hit


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def nearest(queries: DataFrame, vectors: DataFrame, search: Search = Search()) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k nearest of ``vectors`` for each query.

    Both have the columns of :func:`usable`. Equal scores are ordered by the smaller id; a vector with the
    query's id is no hit. Rows that repeat an id and vector count once. A query has fewer hits if there are
    fewer vectors of its length. Shards and blocks of queries are bounded, whatever the tables hold.
    """
    vectors, queries = materialize(vectors.distinct()), materialize(queries.distinct())
    size = F.size("v").alias("size")
    norms = vectors.groupBy(size).agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm"))
    shards, blocks = max(1, ceil(vectors.count() / search.shard_rows)), max(1, ceil(queries.count() / search.block_rows))
    # One number per length of vector.
    top = {r["size"]: r["norm"] for r in norms.collect()}

    def dealt(df: DataFrame, own: str, parts: int, other: str, times: int) -> DataFrame:
        # Both numbers have one type on both sides: groups of different types would not meet.
        return df.select("*", size, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias(other))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        tree = Tree(right["id"].to_numpy(), _matrix(right["v"]), top[int(right["size"].iloc[0])], search)
        q_ids = left["id"].to_numpy()
        row, hit, score = tree.nearest(q_ids, _matrix(left["v"]))
        return pd.DataFrame({"query_id": q_ids[row], "vec_id": hit, "score": score})

    on = ["size", "shard", "block"]
    local = (dealt(queries, "block", blocks, "shard", shards).groupBy(*on)
             .cogroup(dealt(vectors, "shard", shards, "block", blocks).groupBy(*on))
             .applyInPandas(compare, "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= search.k).select("query_id", "rank", "vec_id", "score")

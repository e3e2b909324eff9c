"""Nearest neighbours by cosine with vantage-point trees, one for each shard of the vectors.

On unit vectors the Euclidean distance orders like the cosine and obeys the triangle inequality: with a vantage point at
distance d from a query and the node's points split at radius m, the other side holds nothing nearer than |d - m|. That
side is skipped when factor * |d - m| exceeds the query's k-th distance so far; factor 1 is exact, more skips more.
Leaves are compared in blocks; scores are then worked out again on the original vectors, row by row in double precision,
so equal vectors get equal scores wherever they lie, and ties go to the smaller id.

Rows go to the nearest of some of the rows themselves, the pivots (those of the smallest hashes of their ids, one for each
shard's worth of rows, so their number grows with the root of the rows). A pivot's rows are dealt to shards by a hash of
the id, as many as hold them all, so copies of one vector, however many, spread; a shard knows the least and the greatest
distance of its rows from the pivot. Each query looks into its own shard first. What it finds there bounds its k-th
distance, and it goes only to those other shards that can hold anything nearer (again factor times the difference), in
about as many blocks as it takes for `block` queries each; a task holds one shard and one block. Vectors that are
null, zero or hold null or non-finite components take no part;
repeated rows of an id count once; with fewer candidates than k all are returned; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samelode.llm.common import small_batches, stored

LEAF = 256
#: Rounding of squared distances; equal vectors differ by less. Distances near 0 are off by up to its root.
SLACK = 1e-12


class Tree:
    """A vantage-point tree over the rows of `unit`, held as nested tuples."""

    def __init__(self, unit: np.ndarray, leaf: int = LEAF, seed: int = 11):
        self.unit, self.leaf, self.rng = unit, leaf, np.random.default_rng(seed)
        self.root = self._build(np.arange(len(unit)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        point = self.unit[rows[self.rng.integers(len(rows))]]
        d = np.sqrt(np.maximum(0, 2 - 2 * (self.unit[rows] @ point)))
        middle = float(np.median(d))
        near = d < middle
        if not near.any() or near.all():  # too many points at one distance: halve them anywhere
            half = len(rows) // 2
            return point, 0.0, np.inf, self._build(rows[:half]), self._build(rows[half:])
        return point, float(d[near].max()), float(d[~near].min()), self._build(rows[near]), self._build(rows[~near])

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, factor: float, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(squared distances, rows) of the k nearest rows of each unit query, without rows whose id is the query's; padded with infinity and -1. Rows are returned with spare places for ties.
        bound: squared distances beyond which a query wants nothing."""
        keep, limit = k + 3, np.full(len(queries), np.inf) if bound is None else bound
        best, at = np.full((len(queries), keep), np.inf), np.full((len(queries), keep), -1)

        def leaf(rows: np.ndarray, q: np.ndarray) -> None:
            d = 2 - 2 * (queries[q] @ self.unit[rows].T)
            d[own[q][:, None] == ids[rows][None, :]] = np.inf
            # nearest first, ties (to rounding) to the smaller id
            alld = np.concatenate([best[q], d], axis=1)
            allr = np.concatenate([at[q], np.broadcast_to(rows, d.shape)], axis=1)
            key = np.where(allr >= 0, ids[allr], np.iinfo(np.int64).max)
            order = self._top(alld, key, keep)
            best[q], at[q] = np.take_along_axis(alld, order, 1), np.take_along_axis(allr, order, 1)

        def reach(q: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(0, np.minimum(best[q, k - 1], limit[q])) + SLACK) + np.sqrt(SLACK)

        def visit(node, q: np.ndarray) -> None:
            if not len(q):
                return
            if isinstance(node, np.ndarray):
                leaf(node, q)
                return
            point, inner, outer, low, high = node
            d = np.sqrt(np.maximum(0, 2 - 2 * (queries[q] @ point)))
            if not np.isfinite(outer):
                visit(low, q)
                visit(high, q)
                return
            first = d <= (inner + outer) / 2
            visit(low, q[first])
            visit(high, q[~first])
            late, gap = q[first], outer - d[first]
            visit(high, late[factor * gap <= reach(late)])
            late, gap = q[~first], d[~first] - inner
            visit(low, late[factor * gap <= reach(late)])

        if len(queries) and len(self.unit):
            visit(self.root, np.arange(len(queries)))
        at[~np.isfinite(best)] = -1
        return best, at

    @staticmethod
    def _top(d: np.ndarray, key: np.ndarray, keep: int) -> np.ndarray:
        return np.lexsort((key, np.round(d, 12)), axis=1)[:, :keep]


def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a and b in double precision, each row alone."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def usable(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, in double precision, an id once."""
    v = F.transform(F.col(col), lambda x: x.cast("double"))
    good: Column = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(F.coalesce(good, F.lit(False))).groupBy("vec_id").agg(F.min("v").alias("v"))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def sharded(rows: DataFrame, shard_rows: int, total: int) -> tuple[DataFrame, np.ndarray, np.ndarray, int]:
    """(rows (vec_id, v, cell, sub), unit pivots, shards as (cell, sub, least, greatest distance, rows), rows of a shard at most, about)."""
    per = max(shard_rows, 16 * int(np.sqrt(total)))
    cells = max(1, -(-total // per))
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(cells).collect()
    dims = len(picked[0]["v"]) if picked else 0
    pivots = _unit(np.array([r["v"] for r in picked], np.float64)) if picked else np.zeros((0, dims))

    def cell(batches):
        for b in batches:
            d = _distance(_unit(np.stack(b["v"].to_numpy())), pivots)
            yield pd.DataFrame({"vec_id": b["vec_id"], "v": b["v"], "cell": d.argmin(axis=1).astype(np.int32), "far": d.min(axis=1)})

    placed = stored(rows.mapInPandas(cell, "vec_id long, v array<double>, cell int, far double"), "cells")
    sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a pivot
    subs = np.array([max(1, -(-sizes.get(c, 0) // (2 * per))) for c in range(cells)])
    parts = F.element_at(F.array(*[F.lit(int(x)) for x in subs]), F.col("cell") + 1) if len(set(subs.tolist())) > 1 else F.lit(int(subs[0]))
    placed = placed.withColumn("sub", F.pmod(F.xxhash64(F.lit(2), "vec_id"), parts).cast("int"))
    rings = placed.groupBy("cell", "sub").agg(F.min("far").alias("lo"), F.max("far").alias("hi"), F.count("*").alias("n")).orderBy("cell", "sub").collect()
    return placed, pivots, np.array([(r["cell"], r["sub"], r["lo"], r["hi"], r["n"]) for r in rings], np.float64).reshape(-1, 5), per


def nearest(vectors: DataFrame, query: Column, k: int = 5, factor: float = 1.0, shard_rows: int = 8192, block: int = 65_536, leaf: int = LEAF) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each row for which `query` (on vec_id) holds."""
    small_batches(vectors.sparkSession, 4000)
    rows = stored(usable(vectors), "vectors")
    placed, pivots, shards, _ = sharded(rows, shard_rows, rows.count())
    parts = max(1, -(-rows.filter(query).count() // block))
    reach = lambda kth: np.sqrt(np.maximum(0, kth) + SLACK) + np.sqrt(SLACK)

    def search(points: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        """What the queries (vec_id, v, kth) find in a shard, and how far the k-th of it is."""
        if not len(points) or not len(ask):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "kth": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64", "kth": "float64"})
        ids, own = points["vec_id"].to_numpy(np.int64), np.stack(points["v"].to_numpy())
        q, v = ask["vec_id"].to_numpy(np.int64), np.stack(ask["v"].to_numpy())
        best, at = Tree(_unit(own), leaf).search(_unit(v), q, ids, k, factor, ask["kth"].to_numpy(np.float64))
        i, j = np.nonzero(at >= 0)
        r = at[i, j]
        return pd.DataFrame({"query_id": q[i], "vec_id": ids[r], "score": score(v[i], own[r]), "kth": best[i, k - 1]})

    found = "query_id long, vec_id long, score double, kth double"
    asked = placed.filter(query).withColumn("kth", F.lit(float("inf")))
    near = stored(placed.groupBy("cell", "sub").cogroup(asked.groupBy("cell", "sub")).applyInPandas(search, found), "own-shards")

    def route(batches):
        """The other shards that may hold something nearer than a query has."""
        for b in batches:
            d = _distance(_unit(np.stack(b["v"].to_numpy())), pivots)[:, shards[:, 0].astype(int)]
            gap = np.maximum(d - shards[:, 3], shards[:, 2] - d)
            own = (b["cell"].to_numpy()[:, None] == shards[:, 0]) & (b["sub"].to_numpy()[:, None] == shards[:, 1])
            i, j = np.nonzero((factor * gap <= reach(b["kth"].to_numpy(np.float64))[:, None]) & ~own)
            yield pd.DataFrame({"vec_id": b["vec_id"].to_numpy()[i], "v": b["v"].to_numpy()[i], "kth": b["kth"].to_numpy()[i], "cell": shards[j, 0].astype(np.int32), "sub": shards[j, 1].astype(np.int32)})

    kth = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("kth").alias("kth"))
    there = asked.drop("kth").join(kth, "vec_id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("inf"))))
    ask = there.select("vec_id", "v", "cell", "sub", "kth").mapInPandas(route, "vec_id long, v array<double>, kth double, cell int, sub int").withColumn("part", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(parts)).cast("int"))
    held = placed.select("cell", "sub", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "vec_id", "v")
    far = held.groupBy("cell", "sub", "part").cogroup(ask.groupBy("cell", "sub", "part")).applyInPandas(search, found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    every = near.unionByName(far).select("query_id", "vec_id", "score")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Approximate nearest neighbours by collision-counting hashing.

Every hash is one random projection. An index block keeps its vectors' projections as sorted arrays,
one per hash. A query opens a window around its own projection in each array; a vector that lies in
at least ``THRESHOLD`` of the windows is verified, that is measured exactly. Windows grow by virtual
rehashing (the half-width times ``GROWTH`` per round; the arrays stay as they are, and only what is
newly covered is counted).

A query ends in a block when a vector as near as its k-th best so far would have been verified: the
share of windows it falls into, p = erf(width / distance / sqrt 2), less ``SURE`` standard errors,
reaches the threshold. Nothing else ends it: with fewer vectors than k, windows grow until they hold all.

Equal vectors are one entry with their k + 1 smallest ids, so copies do not crowd a block. Blocks
of vectors meet blocks of queries in tasks of bounded size; each task returns at most k + 1 rows a
query, and only these are merged.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.common import checkpoint, partitions_for

HASHES, THRESHOLD, GROWTH, SURE = 64, 40, 1.25, 1.0
#: Vectors and queries of one task.
VECTORS, QUERIES = 8192, 2048


@functools.lru_cache(maxsize=4)
def directions(dim: int, hashes: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, hashes))


def inside(width: float, distance: float) -> float:
    """Probability that a projection at this distance falls into a window of this half-width."""
    return 1.0 if distance <= 0 else math.erf(width / distance / math.sqrt(2))


class Block:
    """Sorted projections of one block of vectors."""

    def __init__(self, vectors: np.ndarray, hashes: int = HASHES, seed: int = 11):
        self.vectors, self.dirs = vectors, directions(vectors.shape[1], hashes, seed)
        place = vectors @ self.dirs
        self.order = np.argsort(place, axis=0, kind="stable").astype(np.int32).T.copy()
        self.sorted = np.take_along_axis(place, self.order.T, axis=0).T.copy()
        self.spread = float(place.std()) or 1.0

    def search(self, query: np.ndarray, k: int, threshold: int = THRESHOLD, growth: float = GROWTH,
               sure: float = SURE) -> tuple[np.ndarray, np.ndarray]:
        """Positions and exact distances of all verified vectors (at least k, or the whole block)."""
        n, m = len(self.vectors), len(self.sorted)
        at = query @ self.dirs
        count = np.zeros(n, np.int32)
        seen = np.zeros(n, bool)
        lo = [int(np.searchsorted(s, p)) for s, p in zip(self.sorted, at)]
        hi = list(lo)
        width, found, dist, best = self.spread / 2, [], [], np.empty(0)
        while True:
            new = []
            for j in range(m):
                a, b = self.sorted[j].searchsorted((at[j] - width, at[j] + width))
                new += [self.order[j, a:lo[j]], self.order[j, hi[j]:b]]
                lo[j], hi[j] = min(int(a), lo[j]), max(int(b), hi[j])
            count += np.bincount(np.concatenate(new), minlength=n).astype(np.int32)
            fresh = np.flatnonzero((count >= threshold) & ~seen)
            if len(fresh):
                seen[fresh] = True
                d = np.sqrt(((self.vectors[fresh] - query) ** 2).sum(axis=1))
                found.append(fresh)
                dist.append(d)
                best = np.sort(np.concatenate((best, d)))[:k]
            if len(best) == k:
                p = inside(width, float(best[-1]))
                if m * p - sure * math.sqrt(m * p * (1 - p)) >= threshold:
                    break
            if sum(map(len, found)) == n:
                break
            width *= growth
        return np.concatenate(found), np.concatenate(dist)


def _usable(vec: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)


def _search_task(k: int, hashes: int, threshold: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data, asked = pdf[~pdf["query"]], pdf[pdf["query"]]
        out: tuple[list, list, list] = ([], [], [])
        if len(data) and len(asked):
            block = Block(np.stack(data["vec"].to_numpy()).astype(np.float64), hashes, seed)
            ids = data["ids"].tolist()
            for entry, vec in zip(asked["entry"], asked["vec"]):
                at, dist = block.search(np.asarray(vec, np.float64), min(k + 1, len(data)), threshold)
                near = at[np.lexsort((at, dist))]
                near_dist = np.sort(dist)
                cut = near_dist[min(k, len(near_dist) - 1)]  # ties at the end are settled by id
                rows = sorted((float(d), int(i)) for a, d in zip(near, near_dist) if d <= cut for i in ids[a])[:k + 1]
                out[0].extend([entry] * len(rows))
                out[1].extend(i for _, i in rows)
                out[2].extend(d for d, _ in rows)
        return pd.DataFrame({"entry": np.array(out[0], np.int64), "vec_id": np.array(out[1], np.int64),
                             "score": np.array(out[2], np.float64)})
    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
            hashes: int = HASHES, threshold: int = THRESHOLD, seed: int = 11) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of every row that ``is_query`` marks.

    Candidates are all rows but those with the query's own id; score is the Euclidean distance in
    double precision; ties go to the smaller id. Vectors that are null, empty, zero or hold null or
    non-finite components take no part, neither do rows without an id; vectors meet those of their own
    dimension only. Repeated rows of one id count once per distinct vector (queries: the smallest
    vector). With fewer than k candidates all are returned; an empty table gives no rows.
    """
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double") + F.lit(0.0))  # one zero
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = rows.filter(F.col("id").isNotNull() & _usable(F.col("vec")))
    # Of equal vectors the k + 1 smallest ids can occur in a result; the ranking is limited before the shuffle.
    low = Window.partitionBy("vec").orderBy("id")
    few = rows.select("vec", "id").withColumn("r", F.dense_rank().over(low)).filter(F.col("r") <= k + 1)
    entries = checkpoint(few.groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.min("id").alias("entry"))
                         .withColumn("entry", F.xxhash64("entry", "vec")))
    asked = rows.filter("query").groupBy("id").agg(F.min("vec").alias("vec"))
    asked = checkpoint(asked.join(entries.select("vec", "entry"), "vec").select("id", "entry"))
    wanted = asked.select("entry").distinct()
    n, q = entries.count(), wanted.count()
    nb, nq = partitions_for(n, VECTORS), partitions_for(q, QUERIES)
    block = F.pmod(F.xxhash64("entry", F.lit(1)), F.lit(nb)).cast("int")
    group = F.pmod(F.xxhash64("entry", F.lit(2)), F.lit(nq)).cast("int")
    data = entries.select(block.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("g"),
                          F.size("vec").alias("dim"), F.lit(False).alias("query"), "entry", "vec", "ids")
    ask = entries.join(wanted, "entry", "left_semi").select(
        F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("b"), group.alias("g"),
        F.size("vec").alias("dim"), F.lit(True).alias("query"), "entry", "vec", F.array().cast("array<bigint>").alias("ids"))
    found = data.union(ask).groupBy("b", "g", "dim").applyInPandas(
        _search_task(k, hashes, threshold, seed), "entry long, vec_id long, score double")
    best = Window.partitionBy("entry").orderBy("score", "vec_id")
    merged = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    ranked = asked.join(merged, "entry").filter(F.col("vec_id") != F.col("id"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("score", "vec_id"))
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        F.col("id").alias("query_id"), "rank", "vec_id", "score")

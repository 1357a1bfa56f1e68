"""Hard-negative mining over rotated one-bit codes.

A vector of integers is rotated by a random orthogonal matrix and kept as the signs of its
coordinates, with its length and its *alignment*: the cosine between the vector and its code, read as
a vector of equal coordinates. For a query the cosine to a code is a popcount over the bit planes of the
rounded query, known up to the rounding error. With the angles a (vector to code) and b (query to
code) the Cauchy-Schwarz inequality for what lies off the code says

    cos a cos b - sin a sin b  <=  cosine of vector and query  <=  cos a cos b + sin a sin b,

an interval that always holds. The vectors that look best by their estimates are scored first; those whose
interval then cannot meet what is asked for (the best so many, scores in a window) are dropped, and
every other one is scored in integers, so results are exact.

An index row holds one block of vectors. The vectors move once, into their blocks; batches of queries are sent to
every block, and only the best few rows per block and query come back.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.common import checkpoint, partitions_for

#: Expected vectors of a block and queries of a batch, bit planes of a rounded query, vectors scored first per row asked for.
VECTORS, QUERIES, PLANES, FIRST = 4096, 256, 6, 4
#: Slack on every interval, relative to the product of lengths, for rounding in floating point.
SLACK = 1e-9
#: Scores are longs: squared lengths stay below this, so every inner product fits.
MOST_SQUARE = float(1 << 62)


@functools.lru_cache(maxsize=4)
def rotation(dim: int, seed: int) -> np.ndarray:
    if not dim:
        return np.zeros((0, 0))
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _width(dim: int) -> int:
    return max(64, -(-dim // 64) * 64)


@dataclass
class Codes:
    """One-bit codes of a block, as 64-bit words, with lengths and angles to the code."""

    words: np.ndarray
    length: np.ndarray
    angle: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray, seed: int) -> Codes:
        n, dim = vectors.shape
        turned = vectors.astype(np.float64) @ rotation(dim, seed)
        bits = np.zeros((n, _width(dim)), np.uint8)
        bits[:, :dim] = turned > 0
        length = np.sqrt((turned * turned).sum(axis=1))
        cos = np.abs(turned).sum(axis=1) / np.maximum(length, 1e-300) / np.sqrt(max(1, dim))
        return cls(np.packbits(bits, axis=1, bitorder="little").view("<u8"), length, np.arccos(np.clip(cos, -1, 1)))


def score_bounds(codes: Codes, query: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Estimate of the inner product of every coded vector with the query, and an interval that holds it."""
    dim = len(query)
    turned = query.astype(np.float64) @ rotation(dim, seed) if dim else np.zeros(0)
    norm = float(np.sqrt((turned * turned).sum()))
    if norm == 0:
        return (np.zeros(len(codes.length)),) * 3
    unit = turned / norm
    low, step = unit.min(), (unit.max() - unit.min()) / ((1 << PLANES) - 1) or 1.0
    steps = np.rint((unit - low) / step).astype(np.int64)
    rounded = low + step * steps
    error = np.abs(unit - rounded).sum() / np.sqrt(dim)
    bits = np.zeros((PLANES + 1, _width(dim)), np.uint8)
    bits[:PLANES, :dim] = steps >> np.arange(PLANES)[:, None] & 1
    bits[PLANES, :dim] = 1
    planes = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    ones = [np.bitwise_count(codes.words & p).sum(axis=1, dtype=np.int64) for p in planes]
    above = low * ones[PLANES] + step * sum(o << k for k, o in enumerate(ones[:PLANES]))
    cos = (2 * above - rounded.sum()) / np.sqrt(dim)
    near, far = np.arccos(np.clip(cos + error, -1, 1)), np.arccos(np.clip(cos - error, -1, 1))
    least = np.maximum(np.maximum(codes.angle - far, near - codes.angle), 0)
    most = np.minimum(codes.angle + far, np.pi)
    size = codes.length * norm
    slack = SLACK * size + SLACK
    return size * cos / np.maximum(np.cos(codes.angle), 1e-9), size * np.cos(most) - slack, size * np.cos(least) + slack


def integer_scores(vectors: np.ndarray, query: np.ndarray, size: float) -> np.ndarray:
    """Exact inner products; in doubles where ``size``, the product of lengths, proves every partial sum exact."""
    if size < float(1 << 52):
        return (vectors.astype(np.float64, copy=False) @ query.astype(np.float64)).astype(np.int64)
    return (vectors.astype(np.int64, copy=False) * query.astype(np.int64)).sum(axis=1)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search(vectors: np.ndarray, codes: Codes, ids: np.ndarray, allowed: np.ndarray, query: np.ndarray, k: int,
           windows: Sequence[tuple[int, int]], seed: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For every window (least and greatest score, inclusive) ids and scores of the k best allowed vectors,
    ties to smaller ids; and how many vectors were scored."""
    guess, low, high = score_bounds(codes, query, seed)
    norm = float(np.sqrt((query.astype(np.float64) ** 2).sum()))

    def exact(at: np.ndarray) -> np.ndarray:
        return integer_scores(vectors[at], query, float(codes.length[at].max(initial=0)) * norm)

    wanted = np.zeros(len(ids), bool)
    for a, b in windows:
        able = np.flatnonzero(allowed & (high >= a) & (low <= b))
        fit = able[guess[able] <= b]
        first = fit[np.argpartition(-guess[fit], FIRST * k)[:FIRST * k]] if len(fit) > FIRST * k else fit
        sure = exact(first)
        sure = sure[(sure >= a) & (sure <= b)]
        floor = np.partition(sure, -k)[-k] if len(sure) >= k else a  # so many are at least as good
        wanted[able[high[able] >= floor]] = True
    at = np.flatnonzero(wanted)
    scores = exact(at)
    out = []
    for a, b in windows:
        fit = np.flatnonzero((scores >= a) & (scores <= b))
        best = fit[_best(ids[at[fit]], scores[fit], k)]
        out.append((ids[at[best]], scores[best]))
    return out, len(at)


def rows_of(vectors: DataFrame, is_anchor: Column, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``(id, label, vec, dim, anchor)`` of the rows that take part, vectors as integers ``floor(256 x)``; equal rows once."""
    finite = ~F.exists(vec_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("given"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    square = F.aggregate("given", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x.cast("double")) * 256 + 1, F.lit(2.0)))
    whole = F.transform("given", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    rows = rows.filter(square < MOST_SQUARE).select("id", "label", "anchor", whole.alias("vec"))
    return rows.groupBy("id", "label", "vec").agg(F.max("anchor").alias("anchor")).withColumn("dim", F.size("vec"))


def _packed(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per key with ids, labels and vectors as bytes."""
    names = [k for k in keys if k != "dim"]
    types = ", ".join(f"{k} int" for k in names)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[-1].as_py()
        ids, labels = (table.column(c).to_numpy() for c in ("id", "label"))
        vecs = table.column("vec").combine_chunks().flatten().to_numpy().reshape(len(ids), dim)
        order = np.lexsort((labels, ids))
        vecs = vecs[order]
        small = np.abs(vecs).max(initial=0)
        kind = "<i2" if small < 1 << 15 else "<i4" if small < 1 << 31 else "<i8"
        return pa.table({**{k: pa.array([v.as_py()], pa.int32()) for k, v in zip(keys, key)}, "n": pa.array([len(ids)], pa.int32()),
                         "kind": [kind], "ids": pa.array([ids[order].tobytes()], pa.binary()),
                         "labels": pa.array([labels[order].tobytes()], pa.binary()), "vecs": pa.array([vecs.astype(kind).tobytes()], pa.binary())})
    return rows.groupBy(*keys).applyInArrow(run, f"{types}, dim int, n int, kind string, ids binary, labels binary, vecs binary")


def _read(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, dim = row[prefix + "n"], row["dim"]
    return (np.frombuffer(row[prefix + "ids"], "<i8"), np.frombuffer(row[prefix + "labels"], "<i8"),
            np.frombuffer(row[prefix + "vecs"], row[prefix + "kind"]).reshape(n, dim))


def _coded(blocks: DataFrame, seed: int) -> DataFrame:
    """Index rows: the packed block and its codes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [Codes.of(_read(r)[2], seed) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array([getattr(c, f).tobytes() for c in codes], pa.binary()) for f in ("words", "length", "angle")]],
                [*batch.schema.names, "words", "length", "angle"])
    names = "b int, dim int, n int, kind string, ids binary, labels binary, vecs binary, words binary, length binary, angle binary"
    return blocks.mapInArrow(run, names)


def _pairs(index: DataFrame, batches: DataFrame, blocks: int) -> DataFrame:
    """Every batch meets every block of its dimension: the batches are copied, the blocks stay."""
    asked = batches.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "dim", "g",
                           *[F.col(c).alias(f"q_{c}") for c in batches.columns if c not in ("dim", "g")])
    return index.repartition(2 * blocks, "b", "dim").join(asked.repartition(2 * blocks, "b", "dim"), ["b", "dim"])


def _searched(pairs: DataFrame, k: int, seed: int, shares: tuple[int, int] | None) -> DataFrame:
    """``(g, dim, q, w, id, score)``: the best k rows of query q of batch g in its window w. Without ``shares`` rows of the
    query's label and another id, in one window without limits; else rows of other labels, per positive w of
    the batch in the window of these percentages of its score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, vecs = _read(row)
                codes = Codes(np.frombuffer(row["words"], "<u8").reshape(row["n"], -1), np.frombuffer(row["length"]), np.frombuffer(row["angle"]))
                vecs = vecs.astype(np.float64 if codes.length.max() < 1 << 26 else np.int64)  # once for all queries
                windows: dict[int, list[tuple[int, int, int]]] = {}
                for x in row.get("q_windows", ()):
                    windows.setdefault(x["q"], []).append((x["w"], -(-shares[0] * x["score"] // 100), shares[1] * x["score"] // 100))
                out: list[tuple] = []
                for q, (own, label, vec) in enumerate(zip(*_read(row, "q_"))):
                    if shares is None:
                        allowed, asked = (labels == label) & (ids != own), [(0, -(1 << 62), 1 << 62)]
                    else:
                        allowed, asked = labels != label, windows.get(q, [])
                    found, _ = search(vecs, codes, ids, allowed, vec, k, [x[1:] for x in asked], seed)
                    out += [(q, x[0], i, v) for x, (near, scores) in zip(asked, found) for i, v in zip(near.tolist(), scores.tolist())]
                cols = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[c]] * len(out), pa.int32()) for c in ("g", "dim")]
                    + [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))],
                    ["g", "dim", "q", "w", "id", "score"])
    return pairs.mapInArrow(run, "g int, dim int, q int, w int, id long, score long")


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
         id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", seed: int = 12) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Scores are integer inner products of ``floor(256 x)``. The positives of an anchor are its best rows of its label
    with another id, its negatives for one positive the best rows of other labels whose score lies between
    ``least`` and ``most`` percent of the positive's. Higher scores come first, ties by smaller id.

    Rows without an id, label or vector take no part, nor vectors with null or non-finite components or so long that
    inner products could leave the range of longs. Zero and empty vectors take part. Vectors meet those of
    their own dimension only. Equal rows count once; rows of one id that differ are rows of their own, and each
    that ``is_anchor`` marks is an anchor. Fewer rows than asked for give all; no rows give no rows. Columns
    other than the three named are ignored.
    """
    rows = checkpoint(rows_of(vectors, is_anchor, id_col, vec_col, label_col))
    asked = rows.filter("anchor")
    nb, nq = partitions_for(rows.count(), VECTORS), partitions_for(asked.count(), QUERIES)
    hashed = F.xxhash64("id", "label", "vec")
    index = checkpoint(_coded(_packed(rows.withColumn("b", F.pmod(hashed, F.lit(nb)).cast("int")), "b", "dim"), seed))
    batches = checkpoint(_packed(asked.withColumn("g", F.pmod(hashed, F.lit(nq)).cast("int")), "g", "dim"))

    def merged(found: DataFrame, k: int) -> DataFrame:
        best = Window.partitionBy("g", "dim", "q", "w").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    near = checkpoint(merged(_searched(_pairs(index, batches, nb), positives, seed, None), positives))
    windows = near.groupBy("g", "dim").agg(F.collect_list(F.struct("q", F.col("rank").alias("w"), "score")).alias("windows"))
    far = merged(_searched(_pairs(index, batches.join(windows, ["g", "dim"]), nb), negatives, seed, (least, most)), negatives)
    at = near.select("g", "dim", "q", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(at, ["g", "dim", "q", "w"]).join(_ids(batches), ["g", "dim", "q"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _ids(batches: DataFrame) -> DataFrame:
    """``(g, dim, q, anchor_id)`` of the queries of every batch."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for g, dim, ids in pdf.itertuples(index=False):
                found = np.frombuffer(ids, "<i8")
                yield pd.DataFrame({"g": g, "dim": dim, "q": np.arange(len(found)), "anchor_id": found})
    return batches.select("g", "dim", "ids").mapInPandas(run, "g int, dim int, q int, anchor_id long")

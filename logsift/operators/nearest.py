"""Annotated snippets nearest to new ones: exact (O68, O74) and by a stored index.

Rows lie in cells (all in one, the neighbourhoods of pivots, or the lists of the index). Queries meet the rows of a
cell in tasks of bounded size, whatever the cell holds; each keeps only what may be among the k best of a query,
so pairs are never materialised. The ranking of these few is by distances in the JVM, ties by id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift import constants as C

# Corpus rows and queries of one comparison (bounds its memory), and numbers of an array held at once.
CORPUS_BLOCK, QUERY_BLOCK, PAIRS_AT_ONCE = 16_384, 4_096, 1 << 20
# Pairs of one task, each query counted as meeting so many rows more, and tasks of a lookup.
TASK_PAIRS, QUERY_COST, MOST_TASKS = 1 << 24, 4_096, 16_384
# Pivots of a dimension; dimensions beyond the commonest so many are compared without pivots.
MOST_PIVOTS, PIVOT_DIMENSIONS = 64, 16
# Lists of an index, values of all their centres together, and code words of a piece.
MOST_LISTS, CENTRE_VALUES, CODE_WORDS = 4_096, 1 << 22, 256


def l2(a, b):
    """Column expression: Euclidean distance of two equal-length float arrays."""
    sq = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0).cast("double"),
                     lambda acc, v: acc + v)
    return F.sqrt(sq)


def _check_k(k: int, max_k: int | None) -> None:
    """``1 <= k <= max_k`` (the configured number of annotations a lookup may return)."""
    if k < 1 or (max_k is not None and k > max_k):
        raise ValueError(f"k must be between 1 and {max_k}")


def _vectors(df: DataFrame, key: str, vec: str, name: str) -> DataFrame:
    """``(name, v, dim)`` of the rows whose vector has only finite components."""
    bad = F.exists(F.col("v"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(key).cast("bigint").alias(name), F.col(vec).alias("v")).filter(
        F.col("v").isNotNull() & ~bad).withColumn("dim", F.size("v"))


def nearest_one(query_vec: list[float], corpus: DataFrame, k: int = C.NEAREST_DEFAULT_K,
                id_col: str = "id", vec_col: str = "text_embedding", max_k: int | None = C.NEAREST_MAX_K) -> DataFrame:
    """Single query: L2 ascending, id as tie-breaker (TakeOrderedAndProject)."""
    _check_k(k, max_k)
    q = F.array(*[F.lit(float(x)) for x in query_vec])
    return corpus.withColumn("distance", l2(F.col(vec_col), q)).orderBy("distance", id_col).limit(k)


# --- Queries meet the rows of their cells ----------------------------------------------------------------------

def _sizes(asked: DataFrame, rows: DataFrame, cell: list[str]) -> DataFrame:
    """Queries and rows of every cell that has both; one row per cell, of which there is a bounded number."""
    return asked.groupBy(*cell).agg(F.count(F.lit(1)).alias("nq")).join(
        rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("nr")), cell)


def _meet(asked: DataFrame, rows: DataFrame, cell: list[str], sizes: DataFrame, kernel, schema: str) -> DataFrame:
    """``kernel(key, queries, rows)`` over the cells; a cell with many queries (``qid``) or rows (``cid``) is dealt to
    several groups by hashes of their ids. Cells without a query are not shuffled. The number of tasks follows the
    pairs, at most one a group: their input is small beside their work and results."""
    sizes = sizes.select(*cell, "nq", "nr")
    known = sizes.collect()  # one row a cell
    groups = sum(-(-r["nq"] // QUERY_BLOCK) * -(-r["nr"] // CORPUS_BLOCK) for r in known)
    pairs = sum(r["nq"] * (r["nr"] + QUERY_COST) for r in known)
    tasks = max(1, min(MOST_TASKS, groups, -(-pairs // TASK_PAIRS)))
    parts = F.broadcast(asked.sparkSession.createDataFrame(known, sizes.schema).select(
        *cell, F.ceil(F.col("nq") / QUERY_BLOCK).alias("na"), F.ceil(F.col("nr") / CORPUS_BLOCK).alias("nb")))
    a = asked.join(parts, cell).withColumn("a", F.pmod(F.xxhash64("qid"), F.col("na"))).withColumn(
        "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))).drop("na", "nb")
    b = rows.join(parts, cell).withColumn("b", F.pmod(F.xxhash64("cid"), F.col("nb"))).withColumn(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("na") - 1))).drop("na", "nb")
    key = [*cell, "a", "b"]
    return a.repartition(tasks, *key).groupBy(*key).cogroup(b.repartition(tasks, *key).groupBy(*key)).applyInPandas(kernel, schema)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _slices(rows: int, width: int) -> Iterator[slice]:
    """Runs of rows whose arrays of ``width`` numbers a row stay within ``PAIRS_AT_ONCE`` numbers."""
    step = max(1, PAIRS_AT_ONCE // max(1, width))
    return (slice(at, at + step) for at in range(0, rows, step))


def _near(ids: np.ndarray, qm: np.ndarray, cids: np.ndarray, cm: np.ndarray, k: int,
          limit: np.ndarray | None = None) -> pd.DataFrame:
    """``(qid, cid, kth)``: rows of a block that may be among the k nearest of a query (and not beyond its squared
    ``limit``); kth is at least the squared distance of the k-th, infinite where the block has fewer."""
    out = []
    same = np.unique(cm, axis=0, return_inverse=True)[1].reshape(-1)
    size = (cm * cm).sum(axis=1)
    kth = min(k, len(cm)) - 1
    for at in _slices(len(ids), len(cm)):
        part = qm[at]
        own = (part * part).sum(axis=1)
        d2 = own[:, None] + size[None, :] - 2.0 * part @ cm.T
        # Rounding of these sums stays far below 1e-11 of the squared lengths: all that may be among
        # the k nearest is kept.
        slack = 1e-11 * (own + size.max())
        reach = np.partition(d2, kth, axis=1)[:, kth] + slack
        most = reach if limit is None else np.minimum(reach, limit[at] + slack)
        i, j = np.nonzero(d2 <= most[:, None])
        # Equal vectors tie exactly, so of each only the k smallest ids can be ranked.
        order = np.lexsort((cids[j], same[j], i))
        i, j = i[order], j[order]
        group = i.astype(np.int64) * len(cm) + same[j]
        near = np.arange(len(i)) - np.searchsorted(group, group) < k
        out.append(pd.DataFrame({"qid": ids[at][i[near]], "cid": cids[j[near]],
                                 "kth": (reach + slack)[i[near]] if kth == k - 1 else np.inf}))
    return pd.concat(out) if out else _nothing()


def _nothing() -> pd.DataFrame:
    return pd.DataFrame({"qid": np.empty(0, np.int64), "cid": np.empty(0, np.int64), "kth": np.empty(0)})


NEAR = "qid bigint, cid bigint, kth double"


def _near_kernel(k: int):
    def kernel(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(rows):
            return _nothing()
        return _near(asked["qid"].to_numpy(np.int64), _matrix(asked["v"]), rows["cid"].to_numpy(np.int64),
                     _matrix(rows["v"]), k, asked["limit"].to_numpy(np.float64))
    return kernel


def _ranked(found: DataFrame, q: DataFrame, c: DataFrame, k: int, qid: str, cid: str) -> DataFrame:
    """The k nearest of the found pairs, by exact distances."""
    cand = found.join(c.select("cid", F.col("v").alias("cv")), "cid").join(q.select("qid", F.col("v").alias("qv")), "qid") \
        .withColumn("distance", l2(F.col("cv"), F.col("qv")))
    w = Window.partitionBy("qid").orderBy("distance", "cid")
    ranked = cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select(F.col("qid").alias(qid), F.col("cid").alias(cid), "distance", "rank")


# --- O68 exact lookup ---------------------------------------------------------------------------------------------

def nearest_snippets(queries: DataFrame, corpus: DataFrame, k: int = C.NEAREST_DEFAULT_K,
                     qid: str = "query_id", cid: str = "id", vec_col: str = "text_embedding",
                     qvec_col: str | None = None, text_col: str | None = None,
                     max_k: int | None = C.NEAREST_MAX_K, pivots: int | None = None) -> DataFrame:
    """Exact top-k corpus rows per query: ``(query_id, id, distance, rank)``.

    Queries with a blank ``text_col`` give no rows; vectors that are null or hold null or non-finite components take
    no part, and vectors meet those of their own dimension. No side passes through the driver.

    With ``pivots`` (by default one per block of 16,384 rows, at most 64) rows lie in the cell of their nearest pivot,
    and a cell is known by its least and largest distance to every pivot. A query is compared with its own cell
    first; by the triangle inequality it then skips the cells that cannot hold a row as near as its k-th so far.
    The result is the same; ``pivot_share`` tells how many pairs are skipped.
    """
    _check_k(k, max_k)
    q = _vectors(queries.filter(F.trim(F.col(text_col)) != "") if text_col else queries, qid, qvec_col or vec_col, "qid")
    c = _vectors(corpus, cid, vec_col, "cid")
    number = pivots or min(MOST_PIVOTS, -(-c.count() // CORPUS_BLOCK))
    if number > 1:
        found = _pivoted(q, c, k, number)[0]
    else:
        asked = q.withColumn("limit", F.lit(float("inf")))
        found = _meet(asked, c, ["dim"], _sizes(asked, c, ["dim"]), _near_kernel(k), NEAR)
    return _ranked(found, q, c, k, qid, cid)


def pivot_share(queries: DataFrame, corpus: DataFrame, k: int = C.NEAREST_DEFAULT_K, qid: str = "query_id",
                cid: str = "id", vec_col: str = "text_embedding", pivots: int = MOST_PIVOTS) -> DataFrame:
    """One row ``(pairs, compared, skipped_share)`` of the exact lookup with so many pivots."""
    q, c = _vectors(queries, qid, vec_col, "qid"), _vectors(corpus, cid, vec_col, "cid")
    return _one_row(_pairs(_sizes(q, c, ["dim"]), "pairs"), _pairs(_pivoted(q, c, k, pivots)[1], "compared")) \
        .withColumn("skipped_share", F.when(F.col("pairs") > 0, 1 - F.col("compared") / F.col("pairs")))


def _pairs(sizes: DataFrame, name: str) -> DataFrame:
    return sizes.agg(F.coalesce(F.sum(F.col("nq") * F.col("nr")), F.lit(0)).cast("bigint").alias(name))


def _one_row(*frames: DataFrame) -> DataFrame:
    """The numbers of several one-row tables in one row."""
    names = [n for df in frames for n in df.columns]
    long = [df.unpivot([], df.columns, "what", "n") for df in frames]
    return reduce(DataFrame.union, long).agg(*[F.max(F.when(F.col("what") == n, F.col("n"))).alias(n) for n in names])


def _pivoted(q: DataFrame, c: DataFrame, k: int, number: int, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(qid, cid)`` that hold the k nearest, and the queries and rows of each cell that met."""
    from logsift.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(q.sparkSession)
    number = min(number, MOST_PIVOTS)
    pivot = _pivots(c, number, seed)

    def far(v: pd.Series, dim: int) -> np.ndarray:
        """Distances to the pivots of the dimension; one of zero to none where it has no pivots."""
        m, p = _matrix(v), pivot.get(dim)
        if p is None:
            return np.zeros((len(m), 1))
        return np.sqrt(((m[:, None, :] - p[None, :, :]) ** 2).sum(axis=2)) if m.size * len(p) <= PAIRS_AT_ONCE else \
            np.stack([np.sqrt(((m - x) ** 2).sum(axis=1)) for x in p], axis=1)

    def placed(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim", sort=False):
                yield part.assign(cell=far(part["v"], dim).argmin(axis=1).astype(np.int32))

    def spans(batches):
        """Least and largest distance to every pivot, per cell: one row per cell and task."""
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for dim, part in pdf.groupby("dim", sort=False):
                d = far(part["v"], dim)
                own = d.argmin(axis=1)
                for cell in np.unique(own):
                    lo, hi = d[own == cell].min(axis=0), d[own == cell].max(axis=0)
                    if (dim, cell) in held:
                        lo, hi = np.minimum(lo, held[dim, cell][0]), np.maximum(hi, held[dim, cell][1])
                    held[dim, cell] = lo, hi
        if held:
            yield pd.DataFrame([(dim, cell, lo, hi) for (dim, cell), (lo, hi) in held.items()],
                               columns=["dim", "cell", "lo", "hi"])

    cells = c.mapInPandas(placed, T.StructType([*c.schema.fields, T.StructField("cell", T.IntegerType())]))
    at = c.mapInPandas(spans, "dim int, cell int, lo array<double>, hi array<double>").select(
        "dim", "cell", F.posexplode(F.arrays_zip("lo", "hi")).alias("pos", "z"))
    bound: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
    known = at.filter(F.col("dim").isin(list(pivot))) if pivot else at.limit(0)
    for r in known.groupBy("dim", "cell", "pos").agg(F.min("z.lo").alias("lo"), F.max("z.hi").alias("hi")).collect():
        bound.setdefault(r["dim"], {}).setdefault(r["cell"], {})[r["pos"]] = (r["lo"], r["hi"])  # at most 16 x 64 x 64
    table = {dim: (np.array(sorted(by)), np.array([[by[x][p] for p in sorted(by[x])] for x in sorted(by)]))
             for dim, by in bound.items()}

    def asks(first: bool):
        def run(batches):
            for pdf in batches:
                for dim, part in pdf.groupby("dim", sort=False):
                    names, span = table.get(dim, (np.zeros(1, np.int64), np.array([[[0.0, np.inf]]])))
                    d = far(part["v"], dim)
                    if first:
                        yield part.assign(cells=list(names[d[:, names].argmin(axis=1)][:, None].astype(np.int32)))
                    else:
                        yield part.assign(cells=_others(d, names, span, part["limit"].to_numpy(np.float64)))
        return run

    # A query is one row with its cells; the JVM copies its vector to each of them.
    asked_schema = "qid bigint, v array<double>, dim int, limit double, cells array<int>"
    plain = q.select("qid", F.col("v").cast("array<double>").alias("v"), "dim", F.lit(float("inf")).alias("limit"))
    each = ["qid", "v", "dim", "limit", F.explode("cells").alias("cell")]
    own = plain.mapInPandas(asks(True), asked_schema).select(*each)
    sizes = _sizes(own, cells, ["dim", "cell"])
    near = _meet(own, cells, ["dim", "cell"], sizes, _near_kernel(k), NEAR).checkpoint()
    reach = near.groupBy("qid").agg(F.min("kth").alias("limit"))
    others = plain.drop("limit").join(reach, "qid", "left").select(
        "qid", "v", "dim", F.coalesce("limit", F.lit(float("inf"))).alias("limit")).mapInPandas(asks(False), asked_schema).checkpoint().select(*each)
    more = _sizes(others, cells, ["dim", "cell"])
    found = near.union(_meet(others, cells, ["dim", "cell"], more, _near_kernel(k), NEAR)).select("qid", "cid")
    return found, sizes.union(more)


def _others(d: np.ndarray, names: np.ndarray, span: np.ndarray, limit: np.ndarray) -> list[np.ndarray]:
    """Per query the cells, its own left out, that may hold a row within its squared limit."""
    out, reach, slack = [], np.sqrt(np.maximum(limit, 0.0)), 1e-9 * d.max(initial=0.0)
    for at in _slices(len(d), span.shape[0] * span.shape[1]):
        part = d[at]
        own = names[part[:, names].argmin(axis=1)]
        # A row of the cell is at least this far by its distance to each pivot.
        least = np.maximum(span[None, :, :, 0] - part[:, None, :], part[:, None, :] - span[None, :, :, 1]).max(axis=2)
        met = (least * (1 - 1e-9) - slack <= reach[at][:, None]) & (names[None, :] != own[:, None])
        out += [names[m].astype(np.int32) for m in met]
    return out


def _pivots(c: DataFrame, number: int, seed: int) -> dict[int, np.ndarray]:
    """For the commonest dimensions ``number`` rows each, chosen by a hash of the id."""
    dims = [r["dim"] for r in c.filter("dim > 0").groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(PIVOT_DIMENSIONS).collect()]
    w = Window.partitionBy("dim").orderBy(F.xxhash64(F.lit(seed), "cid"), "cid")
    rows = c.filter(F.col("dim").isin(dims)).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= number).collect() if dims else []
    return {dim: np.array([r["v"] for r in sorted(rows, key=lambda r: r["n"]) if r["dim"] == dim], dtype=np.float64)
            for dim in dims}


# --- O69 stored index -----------------------------------------------------------------------------------------------

INDEX = {"centres": "list int, v array<double>", "codebook": "piece int, code int, v array<double>",
         "depths": "depth int"}


def _squares(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances but for the length of the row: enough to order the centres."""
    return (centre * centre).sum(axis=1)[None, :] - 2.0 * rows @ centre.T


def _closest(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    return np.concatenate([_squares(rows[at], centre).argmin(axis=1) for at in _slices(len(rows), len(centre))])


def _code_words(rows: np.ndarray, seed: int) -> np.ndarray:
    """At most 256 code words of the rows, by k-means."""
    rows = np.unique(rows, axis=0)
    word = rows[np.random.default_rng(seed).permutation(len(rows))[:CODE_WORDS]]
    for _ in range(8):
        own = _closest(rows, word)
        held = np.bincount(own, minlength=len(word))
        total = np.zeros_like(word)
        np.add.at(total, own, rows)
        word = np.where(held[:, None] > 0, total / np.maximum(held, 1)[:, None], word)
    return word


def _pieces(dim: int, pieces: int) -> list[slice]:
    edges = np.linspace(0, dim, min(pieces, dim) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def build_index(corpus: DataFrame, root: str, cid: str = "id", vec_col: str = "text_embedding", lists: int | None = None,
                pieces: int | None = None, sample: int = 65_536, asked: int = 256, k: int = 10, seed: int = 7) -> None:
    """Writes an inverted file with product-quantised residuals below ``root``, to be searched any number of times.

    * ``centres``: of the lists (by default the square root of the number of rows, at most 4,096), by Spark's k-means
      over at most about ``sample`` rows, chosen by a hash of their id;
    * ``codebook``: 256 code words for each of the ``pieces`` (by default one per four components) a residual is cut
      into, each piece fitted by a task of its own on the same sample;
    * ``rows``: every row, partitioned by its list, with its vector and its residual's code (a byte a piece); rows
      are dealt out by ranges of (list, id), so a list that holds a third of them is written by several tasks;
    * ``depths``: for the k nearest of ``asked`` sample rows, found exactly, which of the nearest lists holds them:
      from these a search knows how many lists it needs for a recall.

    All vectors have one dimension; null ones and those with null or non-finite components are left out. Only centres
    and code words (bounded by parameters) pass through the driver. Writing again replaces the index.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    spark = corpus.sparkSession
    c = _vectors(corpus, cid, vec_col, "cid")
    n, least, most = c.agg(F.count(F.lit(1)), F.min("dim"), F.max("dim")).first()
    if n and (least != most or not least):
        raise ValueError("all vectors of an index have one dimension, of at least one component")
    if not n:
        c.drop("dim").withColumn("code", F.lit(b"")).withColumn("list", F.lit(0)).limit(0).write.mode("overwrite").parquet(f"{root}/rows")
        for name, schema in INDEX.items():
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/{name}")
        return
    dim = most
    picked = c.filter(F.pmod(F.xxhash64(F.lit(seed), "cid"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / n))).select("cid", "v")
    picked = picked.unionByName(c.orderBy("cid").limit(1).select("cid", "v"))
    number = max(2, min(lists or int(n ** 0.5), MOST_LISTS, CENTRE_VALUES // dim))
    fitted = KMeans(k=number, initMode="random", maxIter=8, seed=seed, featuresCol="f").fit(
        picked.select(array_to_vector(F.col("v").cast("array<double>")).alias("f")))
    centre = np.array(fitted.clusterCenters(), dtype=np.float64)
    cuts = _pieces(dim, pieces or -(-dim // 4))

    def residuals(batches):
        for pdf in batches:
            rows = _matrix(pdf["v"])
            rest = rows - centre[_closest(rows, centre)]
            for piece, cut in enumerate(cuts):
                yield pd.DataFrame({"piece": np.int32(piece), "v": list(rest[:, cut])})

    def words(pdf: pd.DataFrame) -> pd.DataFrame:
        """k-means over one piece of the sample's residuals."""
        word = _code_words(_matrix(pdf["v"]), seed)
        return pd.DataFrame({"piece": pdf["piece"].iloc[0], "code": np.arange(len(word), dtype=np.int32), "v": list(word)})

    book_table = picked.mapInPandas(residuals, "piece int, v array<double>").groupBy("piece").applyInPandas(words, INDEX["codebook"])
    book_table.write.mode("overwrite").parquet(f"{root}/codebook")
    spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(centre)], INDEX["centres"]) \
        .write.mode("overwrite").parquet(f"{root}/centres")
    book = _codebook(spark, root)

    def coded(batches):
        for pdf in batches:
            rows = _matrix(pdf["v"])
            own = _closest(rows, centre)
            rest = rows - centre[own]
            code = np.stack([_closest(rest[:, cut], book[p]) for p, cut in enumerate(cuts)], axis=1)
            yield pdf.assign(code=[x.tobytes() for x in code.astype(np.uint8)], list=own.astype(np.int32))

    vec = c.schema["v"].dataType.simpleString()
    c.select("cid", "v").mapInPandas(coded, f"cid bigint, v {vec}, code binary, list int") \
        .repartitionByRange("list", "cid").sortWithinPartitions("list", "cid") \
        .write.mode("overwrite").partitionBy("list").parquet(f"{root}/rows")

    @F.pandas_udf("int")
    def depth(v: pd.Series, own: pd.Series) -> pd.Series:
        d = _squares(_matrix(v), centre)
        return pd.Series((d < d[np.arange(len(d)), own.to_numpy()][:, None]).sum(axis=1).astype(np.int32) + 1)

    stored = spark.read.parquet(f"{root}/rows")
    trial = c.orderBy(F.xxhash64(F.lit(seed), "cid"), "cid").limit(asked).select(F.col("cid").alias("qid"), "v")
    truth = nearest_snippets(trial, c, k + 1, "qid", "cid", "v", max_k=None).filter("qid <> cid")
    truth.join(stored.select("cid", "list"), "cid").join(trial, "qid").select(depth("v", "list").alias("depth")) \
        .coalesce(1).write.mode("overwrite").parquet(f"{root}/depths")  # at most asked x k numbers


def _codebook(spark: SparkSession, root: str) -> list[np.ndarray]:
    rows = spark.read.schema(INDEX["codebook"]).parquet(f"{root}/codebook").collect()  # 256 x dimension values
    return [np.array([r["v"] for r in sorted((r for r in rows if r["piece"] == p), key=lambda r: r["code"])])
            for p in sorted({r["piece"] for r in rows})]


def search_index(queries: DataFrame, root: str, k: int = C.NEAREST_DEFAULT_K, qid: str = "query_id", cid: str = "id",
                 vec_col: str = "text_embedding", probes: int | None = None, recall: float = 0.95, refine: int = 10) -> DataFrame:
    """Approximate top-k of the rows of a stored index: ``(query_id, id, distance, rank)``.

    A query reads its ``probes`` nearest lists only (by default as many as held this share of the nearest when the
    index was built), estimates distances from the codes, and ranks the ``refine * k`` best estimates by their vectors.
    A query whose lists hold fewer than k rows is answered exactly, so each gets k rows where there are as many.
    """
    return _searched(queries, root, k, qid, cid, vec_col, probes, recall, refine)[0]


def _searched(queries, root, k, qid, cid, vec_col, probes, recall, refine) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The result, queries and rows of each list that met, and the rows of the index."""
    from logsift.session import ensure_checkpoint_dir
    spark = queries.sparkSession
    ensure_checkpoint_dir(spark)
    rows = spark.read.parquet(f"{root}/rows")
    read = spark.read.schema(INDEX["centres"]).parquet(f"{root}/centres").orderBy("list").collect()
    if not read:
        none = spark.createDataFrame([], "list int, nq bigint, nr bigint")
        return spark.createDataFrame([], f"{qid} bigint, {cid} bigint, distance double, rank int"), none, rows
    centre, book = np.array([r["v"] for r in read]), _codebook(spark, root)
    cuts = _pieces(centre.shape[1], len(book))
    if probes is None:
        deep = sorted(r["depth"] for r in spark.read.schema(INDEX["depths"]).parquet(f"{root}/depths").collect())
        probes = deep[min(len(deep), int(np.ceil(recall * len(deep)))) - 1] if deep else len(centre)
    take, keep = min(probes, len(centre)), refine * k
    q = _vectors(queries, qid, vec_col, "qid").filter(F.col("dim") == centre.shape[1])

    @F.pandas_udf("array<int>")
    def nearest_lists(v: pd.Series) -> pd.Series:
        m = _matrix(v)
        return pd.Series([x for at in _slices(len(m), len(centre))
                          for x in np.argpartition(_squares(m[at], centre), take - 1, axis=1)[:, :take].astype(np.int32)])

    asked = q.select("qid", "v", nearest_lists("v").alias("lists")).checkpoint()
    probed = asked.select("qid", F.explode("lists").alias("list"))
    wanted = [r["list"] for r in probed.select("list").distinct().collect()]  # at most as many as lists
    here = rows.filter(F.col("list").isin(wanted))  # prunes folders

    def kernel(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"qid": np.empty(0, np.int64), "cid": np.empty(0, np.int64), "told": np.empty(0), "list": np.empty(0, np.int32)})]
        if len(asking) and len(held):
            held = held.sort_values("list")
            code = np.frombuffer(b"".join(held["code"]), np.uint8).reshape(len(held), -1)
            cids, ids, lists = held["cid"].to_numpy(np.int64), asking["qid"].to_numpy(np.int64), held["list"].to_numpy(np.int32)
            names, first, own = np.unique(lists, return_index=True, return_inverse=True)
            runs = [slice(a, b) for a, b in zip(first, [*first[1:], len(lists)])]
            v, probes, last = _matrix(asking["v"]), asking["lists"].to_numpy(), min(keep, len(held)) - 1
            for at in _slices(len(ids), max(len(held), CODE_WORDS * max(cut.stop - cut.start for cut in cuts))):
                part, reads = v[at], np.stack([np.isin(names, x) for x in probes[at]])
                told = np.full((len(part), len(held)), np.inf)
                for n, run in enumerate(runs):
                    who = np.flatnonzero(reads[:, n])
                    rest, sums = part[who] - centre[names[n]], np.zeros((len(who), run.stop - run.start))
                    for p, cut in enumerate(cuts):
                        d = ((rest[:, None, cut] - book[p][None]) ** 2).sum(axis=2)
                        sums += d[:, code[run, p]]
                    told[who, run] = sums
                i, j = np.nonzero((told <= np.partition(told, last, axis=1)[:, last:last + 1]) & reads[:, own.reshape(-1)])
                order = np.lexsort((cids[j], told[i, j], i))
                i, j = i[order], j[order]
                best = np.arange(len(i)) - np.searchsorted(i, i) < keep
                i, j = i[best], j[best]
                out.append(pd.DataFrame({"qid": ids[at][i], "cid": cids[j], "told": told[i, j], "list": lists[j]}))
        return pd.concat(out)

    met = _sizes(probed, here, ["list"]).collect()  # at most as many as lists
    sizes = spark.createDataFrame(met, "list int, nq bigint, nr bigint")
    # A query meets a shelf of lists at once, so it brings its vector and leaves with its best estimates once a shelf.
    shelves = list(enumerate(_shelves(sorted((r["list"], r["nr"]) for r in met))))
    placed = spark.createDataFrame([(name, shelf) for shelf, names in shelves for name in names], "list int, shelf int")
    codes = here.select("cid", "code", "list").join(F.broadcast(placed), "list")
    asking = asked.crossJoin(F.broadcast(spark.createDataFrame(shelves, "shelf int, holds array<int>"))).select(
        "qid", "v", "shelf", F.array_intersect("lists", "holds").alias("lists")).filter(F.size("lists") > 0)
    told = _meet(asking, codes, ["shelf"], _sizes(asking, codes, ["shelf"]), kernel, "qid bigint, cid bigint, told double, list int")
    w = Window.partitionBy("qid").orderBy("told", "cid")
    best = told.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= keep).select("qid", "cid", "list")
    cand = best.join(here.select("cid", "list", F.col("v").alias("cv")), ["list", "cid"]).join(q.select("qid", "v"), "qid") \
        .withColumn("distance", l2(F.col("cv"), F.col("v")))
    w = Window.partitionBy("qid").orderBy("distance", "cid")
    top = cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        F.col("qid").alias(qid), F.col("cid").alias(cid), "distance", "rank")
    held = sizes.select("list", "nr")
    enough = probed.join(F.broadcast(held), "list").groupBy("qid").agg(F.sum("nr").alias("nr")).filter(
        F.col("nr") >= k).select("qid")
    few = q.join(enough, "qid", "left_anti")
    exact = nearest_snippets(few, rows, k, "qid", "cid", "v", max_k=None).select(
        F.col("qid").alias(qid), F.col("cid").alias(cid), "distance", "rank")
    whole = top.join(enough.select(F.col("qid").alias(qid)), qid, "left_semi").unionByName(exact)
    return whole, sizes, rows


def _shelves(sizes: list[tuple[int, int]]) -> list[list[int]]:
    """Lists, given with their numbers of rows, by shelves of at most ``CORPUS_BLOCK`` rows; a larger list has its own."""
    out, rows = [], CORPUS_BLOCK
    for name, n in sizes:
        if rows + n > CORPUS_BLOCK:
            out.append([])
            rows = 0
        out[-1].append(name)
        rows += n
    return out


def _scratch(spark: SparkSession) -> str:
    from logsift.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark)}/vector-index-{uuid.uuid4().hex}"


def nearest_snippets_approx(queries: DataFrame, corpus: DataFrame, k: int = C.NEAREST_DEFAULT_K,
                            qid: str = "query_id", cid: str = "id", vec_col: str = "text_embedding",
                            centres: int | None = None, probes: int | None = None, recall: float = 0.95, sample: int = 65_536,
                            seed: int = 7) -> DataFrame:
    """``build_index`` and ``search_index`` in one go. The index lies below the checkpoint folder, whose owner clears
    it as he does checkpoints; whoever asks more than once builds an index and keeps it."""
    root = _scratch(queries.sparkSession)
    build_index(corpus, root, cid, vec_col, centres, sample=sample, seed=seed)
    return search_index(queries, root, k, qid, cid, vec_col, probes, recall)


def index_quality(queries: DataFrame, root: str, k: int = C.NEAREST_DEFAULT_K, qid: str = "query_id", cid: str = "id",
                  vec_col: str = "text_embedding", probes: int | None = None, recall: float = 0.95, refine: int = 10) -> DataFrame:
    """One row ``(wanted, found, recall, candidate_share)`` of ``search_index`` with these settings.

    recall: share of the exact result that it finds; candidate_share: pairs whose distance it estimates, of all."""
    found, sizes, rows = _searched(queries, root, k, qid, cid, vec_col, probes, recall, refine)
    exact = nearest_snippets(queries, rows.withColumnRenamed("cid", "__cid"), k, qid, "__cid", "v", vec_col, max_k=None)
    hit = exact.withColumnRenamed("__cid", cid).join(found.select(qid, cid, F.lit(1).alias("hit")), [qid, cid], "left")
    told = _one_row(hit.agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found")),
                    _vectors(queries, qid, vec_col, "qid").agg(F.count(F.lit(1)).alias("nq")),
                    rows.agg(F.count(F.lit(1)).alias("nr")),
                    _pairs(sizes, "met"))
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    return told.select("wanted", "found", share(F.col("found"), F.col("wanted")).alias("recall"),
                       share(F.col("met"), F.col("nq") * F.col("nr")).alias("candidate_share"))


def probe_quality(queries: DataFrame, corpus: DataFrame, k: int = C.NEAREST_DEFAULT_K, qid: str = "query_id", cid: str = "id",
                  vec_col: str = "text_embedding", centres: int | None = None, probes: int | None = None, recall: float = 0.95,
                  sample: int = 65_536, seed: int = 7) -> DataFrame:
    """``index_quality`` of an index built for these queries."""
    root = _scratch(queries.sparkSession)
    build_index(corpus, root, cid, vec_col, centres, sample=sample, seed=seed)
    return index_quality(queries, root, k, qid, cid, vec_col, probes, recall)

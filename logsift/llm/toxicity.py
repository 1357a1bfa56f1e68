"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other training texts are unlabelled, a mixture in which
the share ``prior`` is toxic. A linear classifier is fitted in numpy by minimising the corrected risk

    prior * mean(loss(f(P), +1)) + max(0, mean(loss(f(U), -1)) - prior * mean(loss(f(P), -1)))

with the sigmoid loss. Where the second term falls below zero, its gradient is followed upwards
instead, so the fit cannot profit from driving the unlabelled risk negative.

Features are hashed: the words of a text in lower case and their first four and five letters, each
counted once per text. The features that differ most between positives and unlabelled texts are
selected (a bounded number); a text is scored over those it holds, whatever its length.

Fitting uses bounded samples (``MOST_POSITIVE`` and ``MOST_UNLABELLED`` rows, chosen by a hash of
the id). The class prior and the scores cover all rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from logsift.llm.common import bounded_batches, checkpoint, text_or_empty

#: Expected rows of the training samples, number of hash cells and of selected features.
MOST_POSITIVE, MOST_UNLABELLED, CELLS, MOST_FEATURES = 8_000, 24_000, 1 << 20, 2_048
#: A feature is selected when its share among positives exceeds that among unlabelled texts by this many
#: errors, and that many distinct positives hold it. The count does not grow with the number of positives,
#: so the words of a language or subject with few of them are learned, too. It was chosen by cross-validation
#: between the two thirds that are learned from: 2, 3, 4, 5, 6, 8 made 62, 61, 63, 71, 80, 123 errors in 2,636 texts;
#: of those within one standard error (8) of the fewest, the one that selects the fewest features.
LEAST_Z, LEAST_TEXTS = 4.0, 4
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")


#: Words whose cells a worker remembers.
SEEN = 100_000


def _cells(word: str) -> tuple[int, ...]:
    """Hash cells of a word: itself and its first four and five letters."""
    forms = {"w" + word} | {f"{n}" + word[:n] for n in (4, 5) if len(word) >= n}
    return tuple(sorted(zlib.crc32(f.encode("utf-8", "surrogatepass")) % CELLS for f in forms))


def _words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(text: str) -> np.ndarray:
    """Distinct feature cells of a whole text, ascending."""
    found = {cell for word in _words(text) for cell in _cells(word)}
    return np.sort(np.fromiter(found, np.int64, len(found)))


@dataclass(frozen=True)
class Model:
    """Weights of the selected feature cells (ascending) and the bias."""

    cells: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scorer(self):
        """Function from a text to its score in (0, 1). Of each word only the selected cells are
        remembered (mostly none), for a bounded number of words."""
        weight = dict(zip(self.cells.tolist(), self.weights.tolist()))
        seen: dict[str, tuple[int, ...]] = {}

        def score(text: str) -> float:
            found: set[int] = set()
            for word in _words(text):
                cells = seen.get(word)
                if cells is None:
                    if len(seen) >= SEEN:
                        seen.clear()
                    cells = tuple(c for c in _cells(word) if c in weight)
                    if len(word) <= 64:
                        seen[word] = cells
                found.update(cells)
            z = math.fsum(weight[c] for c in found) + self.bias
            return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, z))))
        return score


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float, float]:
    """(positive part, corrected negative part, non-negative risk) under the sigmoid loss."""
    pos = prior * float(_sigmoid(-zp).mean())
    neg = float(_sigmoid(zu).mean()) - prior * float(_sigmoid(zp).mean())
    return pos, neg, pos + max(0.0, neg)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 1000, rate: float = 0.1,
        l2: float = 1e-5, beta: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias over features given as row-wise indices (0 to the largest index)."""
    n = max([int(x.max()) + 1 for x in positive + unlabelled if len(x)], default=0)
    rp, cp = _flat(positive)
    ru, cu = _flat(unlabelled)
    theta, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    theta[n] = -1.0

    def scores(rows, cols, count):
        return np.bincount(rows, theta[cols], count) + theta[n]

    def back(rows, cols, g):
        return np.append(np.bincount(cols, g[rows], n), g.sum())

    for t in range(1, rounds + 1):
        zp, zu = scores(rp, cp, len(positive)), scores(ru, cu, len(unlabelled))
        sp, su = _sigmoid(zp), _sigmoid(zu)
        slope_p, slope_u = sp * (1 - sp) / max(1, len(positive)), su * (1 - su) / max(1, len(unlabelled))
        _, neg, _ = risk(zp, zu, prior) if len(positive) and len(unlabelled) else (0, 0.0, 0)
        grad_pos = back(rp, cp, -prior * slope_p)
        grad_neg = back(ru, cu, slope_u) - back(rp, cp, prior * slope_p)
        grad = grad_pos + grad_neg if neg >= -beta else -grad_neg
        grad[:n] += l2 * theta[:n]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return theta[:n], float(theta[n])


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in rows], np.int64)
    return np.repeat(np.arange(len(rows)), size), np.concatenate(rows).astype(np.int64) if len(rows) else np.empty(0, np.int64)


def held_out(id_col: str | Column) -> Column:
    """CRC-32 of the id as text modulo 3 is 1 (null ids: not held out, and never learned from)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(df: DataFrame, id_col: str, rows: int, seed: int) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of the id (all, if there are fewer)."""
    n = df.count()
    if n <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 40)) < int((1 << 40) * (rows / n)))


def _presence(rows: DataFrame, text: str) -> DataFrame:
    """(positive, cells) per distinct sampled text: copies of one text are no further evidence."""
    rows = rows.withColumn("same", F.xxhash64("text")).dropDuplicates(["positive", "same"])

    @F.pandas_udf("array<int>")
    def cells(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([features(t).astype(np.int32) for t in s])

    return rows.select("positive", cells(text_or_empty(text)).alias("cells"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", toxic: str = "toxic",
          prior: float | None = None, seed: int = 7) -> Model:
    """Fit on the rows that are not held out. ``prior`` defaults to the share among labelled rows.

    Labels that contradict each other or repeat an id count once, toxic first; null ids and labels
    are ignored; positives without a document are ignored. Without positives or documents the model
    has no features and scores every text at the prior.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(toxic).isNotNull() & ~held_out(id_col)) \
        .groupBy(F.col(id_col).alias("__id")).agg(F.max(toxic).alias("__toxic"))
    n, hits = known.agg(F.count("*"), F.coalesce(F.sum((F.col("__toxic") > 0).cast("long")), F.lit(0))).first()
    prior = min(0.9, max(1e-4, prior if prior is not None else (hits / n if n else 0.01)))
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("text")).filter(F.col("__id").isNotNull() & ~held_out("__id"))
    # The sampled positive ids are bounded by MOST_POSITIVE, so their table may be broadcast.
    chosen = _sample(known.filter("__toxic > 0").select("__id"), "__id", MOST_POSITIVE, seed)
    positive = base.join(F.broadcast(chosen), "__id", "left_semi").withColumn("positive", F.lit(True))
    unlabelled = _sample(base, "__id", MOST_UNLABELLED, seed + 1).withColumn("positive", F.lit(False))
    seen = checkpoint(_presence(positive.union(unlabelled), "text"))
    counts = seen.select("positive", F.explode("cells").alias("cell")).groupBy("cell").agg(
        F.sum(F.col("positive").cast("int")).alias("p"), F.sum((~F.col("positive")).cast("int")).alias("u"))
    total = {r.positive: r["count"] for r in seen.groupBy("positive").count().collect()}
    np_, nu = total.get(True, 0), total.get(False, 0)
    if not np_ or not nu:
        return Model(np.empty(0, np.int64), np.empty(0), math.log(prior / (1 - prior)), prior)
    a, b = F.col("p") / np_, F.col("u") / nu
    z = (a - b) / F.sqrt(((F.col("p") + F.col("u") + 1) / (np_ + nu)) * (1.0 / np_ + 1.0 / nu))
    picked = counts.withColumn("z", z).filter((F.col("z") >= LEAST_Z) & (F.col("p") >= LEAST_TEXTS)).orderBy(F.desc("z"), "cell").limit(MOST_FEATURES)
    cells = np.sort(np.array([r.cell for r in picked.select("cell").collect()], np.int64))
    keep = F.array_intersect("cells", F.array(*[F.lit(int(c)) for c in cells])) if len(cells) else F.array().cast("array<int>")
    rows = seen.select("positive", F.array_sort(keep).alias("cells")).toArrow()  # bounded: samples times selected features
    flags = rows["positive"].to_pylist()
    index = [np.searchsorted(cells, np.array(x, np.int64)) for x in rows["cells"].to_pylist()]
    index = list(zip(flags, index))
    weights, bias = fit([x for p, x in index if p], [x for p, x in index if not p], prior)
    return Model(cells, np.append(weights, np.zeros(len(cells) - len(weights))), bias, prior)


def with_score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` plus a score in [0, 1], higher where toxic is likelier. Null and empty texts are scored
    as texts without features; rows are independent and other columns pass through."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(DoubleType())
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score_one = model.scorer()
        for s in parts:
            yield pd.Series([score_one(t) for t in s], dtype="float64")

    return docs.withColumn(out, score(text_or_empty(text)))

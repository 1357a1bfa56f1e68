"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target of words: the total is shared by weight, a source stops at ``cap`` times its
size, and what it cannot use is shared again among the others by weight. Complete epochs come
first (every document once per epoch); the rest of a target is a fraction of one more epoch, taken
in the order of exponential keys ``-ln(u) / quality`` (``u`` from a hash of id and size), so a
document of twice the quality weight is twice as likely to come next. Whole documents are taken; the one
at the target is taken when that brings the source nearer to it.

No source is ever sorted as a whole. The key at which a source reaches its target is enclosed by
histograms of its words over ``CELLS`` key intervals (partial sums, a few rounds), until at most
``EXACT`` distinct documents remain in the interval; only those are sorted and prefix-summed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.common import bounded_batches, checkpoint, text_or_empty

CELLS = 256
EXACT = 4096
LEAST_WEIGHT = 1e-6


def word_count(text: str | Column) -> Column:
    """Number of runs of characters other than U+0020 and U+0009 to U+000D (null text: 0)."""
    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((len(t.as_py().encode("utf-8", "surrogatepass").split()) for t in texts), np.int64,
                                    len(texts)))
    return count(text_or_empty(text))


def exponential_key(seed: str, parts: Sequence[str | Column], weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1] from 52 bits of an MD5 over seed and parts."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("-"))
                                           for p in parts])
    u = (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 1) / F.lit(float(1 << 52))
    return -F.ln(u) / F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(LEAST_WEIGHT))


def targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """``(source, source_size, target)`` from one row per source.

    Sources in code-point order, null last, take the weights in turn. The level of sharing is found
    in closed form: with sources by the level at which they fill up, the first that the level reached
    there would not fill ends the search.
    """
    whole = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]),
                                           (F.pmod(F.row_number().over(whole) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("full_at", F.col("most") / F.col("w"))
    by = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(every) - (F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, 0))
                                                              - F.col("most"))
    heavy = F.sum("w").over(every) - F.sum("w").over(by.rowsBetween(Window.unboundedPreceding, 0)) + F.col("w")
    s = s.withColumn("left", left).withColumn("heavy", heavy).withColumn("k", F.row_number().over(by))
    s = s.withColumn("stop", F.min(F.when(F.col("left") / F.col("heavy") <= F.col("full_at"), F.col("k"))).over(every))
    s = s.withColumn("left", F.max(F.when(F.col("k") == F.col("stop"), F.col("left"))).over(every)) \
        .withColumn("heavy", F.max(F.when(F.col("k") == F.col("stop"), F.col("heavy"))).over(every))
    return s.select("source", "source_size", F.when(
        F.col("stop").isNull() | (F.col("k") < F.col("stop")), F.col("most")).otherwise(
        F.least(F.col("most"), F.col("left") * F.col("w") / F.col("heavy"))).alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def mix(docs: DataFrame, id_col: str = "doc_id", size: str = "size", source: str = "source", quality: str = "quality",
        weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """``(id, source, size, n_rows, source_size, target, epochs, extra)``, one row per distinct id, source and size.

    Each of the ``n_rows`` equal rows is taken ``epochs`` times, and ``extra`` of them once more.
    Null ids, sources (a source of their own) and sizes (0) are kept; quality weights that are null or
    not positive count as ``LEAST_WEIGHT``. Equal rows with several qualities take the largest. Empty
    sources have target 0. An empty table gives no rows. The same rows give the same result in any
    order and partitioning.
    """
    thin = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"),
                       F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"), F.col(quality).cast("double").alias("q"))
    rows = thin.groupBy("id", "source", "size").agg(F.count("*").alias("n_rows"), F.max("q").alias("q"))
    rows = checkpoint(rows.withColumn("key", exponential_key(seed, ["id", "size"], F.col("q"))).drop("q"))
    aims = targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size")),
                   weights, share, cap)
    aims = aims.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                           .otherwise(0).cast("long"))
    aims = checkpoint(aims.withColumn("need", F.col("target") - F.col("epochs") * F.col("source_size")))
    # Words taken before ``lo`` and the interval [lo, hi) in which each source reaches what it needs.
    spans = rows.groupBy("source").agg(F.min("key").alias("lo"), F.max("key").alias("top"), F.count("*").alias("n"))
    spans = spans.withColumn("hi", F.col("top") * (1 + 2.0 ** -50) + 2.0 ** -1000).withColumn("before", F.lit(0).cast("long"))
    spans = checkpoint(spans.join(aims, _same(spans["source"], aims["source"]))
                       .select(spans["source"], "lo", "hi", "before", "n", "need"))
    while True:
        wide = spans.filter((F.col("n") > EXACT) & (F.col("lo") + (F.col("hi") - F.col("lo")) / CELLS > F.col("lo")))
        if wide.isEmpty():
            break
        cell = F.least(F.floor((F.col("key") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / CELLS)), F.lit(CELLS - 1))
        inner = rows.join(wide.withColumnRenamed("source", "s"), _same(F.col("source"), F.col("s"))) \
            .filter("key >= lo and key < hi").withColumn("cell", cell)
        hist = inner.groupBy("source", "lo", "hi", "before", "need", "cell").agg(
            F.sum(F.col("size") * F.col("n_rows")).alias("words"), F.count("*").alias("n"),
            F.min("key").alias("first"), F.max("key").alias("last"))
        run = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("ahead", F.col("before") + F.coalesce(F.sum("words").over(run), F.lit(0)))
        # The last cell that starts at or below the need holds the boundary.
        found = hist.filter("ahead <= need").groupBy("source").agg(F.max_by(
            F.struct("first", "last", "ahead", "n", "need"), "cell").alias("c"))
        narrow = found.select("source", F.col("c.first").alias("lo"),
                              (F.col("c.last") * (1 + 2.0 ** -50) + 2.0 ** -1000).alias("hi"),
                              F.col("c.ahead").alias("before"), F.col("c.n").alias("n2"), F.col("c.need").alias("need"))
        narrow = narrow.withColumnRenamed("n2", "n").select("source", "lo", "hi", "before", "n", "need")
        spans = checkpoint(spans.join(narrow.select(F.col("source").alias("s")), _same(F.col("source"), F.col("s")), "left_anti")
                           .unionByName(narrow))
    marked = rows.join(spans.withColumnRenamed("source", "s"), _same(F.col("source"), F.col("s"))).drop("s")
    order = Window.partitionBy("source").orderBy("key", "id", "size")
    near = marked.filter("key >= lo and key < hi")
    words = F.sum(F.col("size") * F.col("n_rows")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("ahead", F.col("before") + words - F.col("size") * F.col("n_rows"))
    fits = F.floor((2 * F.col("need") - 2 * F.col("ahead") - F.col("size")) / (2 * F.col("size"))) + 1
    near = near.withColumn("extra", F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("n_rows"), fits)))
                           .otherwise(0).cast("long"))
    far = marked.filter("key < lo or key >= hi").withColumn(
        "extra", F.when(F.col("key") < F.col("lo"), F.col("n_rows")).otherwise(0).cast("long"))
    cols = ["id", "source", "size", "n_rows", "extra"]
    got = near.select(*cols).union(far.select(*cols))
    return got.join(aims.withColumnRenamed("source", "s"), _same(F.col("source"), F.col("s"))).select(
        "id", "source", "size", "n_rows", "source_size", "target", "epochs", "extra")


def per_row(mixed: DataFrame) -> DataFrame:
    """One row per input row: ``(id, source, size, source_size, target, times)``.

    Equal rows are counted out in two steps, so no array grows with their number.
    """
    block = 4096
    out = mixed.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_rows") - 1) / block))))
    out = out.withColumn("i", F.explode(F.sequence(F.col("b") * block, F.least(
        F.col("b") * block + (block - 1), F.col("n_rows") - 1))))
    return out.select("id", "source", "size", "source_size", "target",
                      (F.col("epochs") + (F.col("i") < F.col("extra")).cast("long")).alias("times"))


def quality_weights(docs: DataFrame, labels: DataFrame, good: float = 1.0, unknown: float = 0.5,
                    poor: float = 0.25, out: str = "quality") -> DataFrame:
    """``docs`` plus ``out``: a weight by the document's quality label (several: the best)."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("__id")) \
        .agg(F.max("quality").alias("__q"))
    return docs.join(known, docs["doc_id"] == known["__id"], "left").withColumn(
        out, F.when(F.col("__q") >= 1, good).when(F.col("__q") < 1, poor).otherwise(unknown)).drop("__id", "__q")


def sized(docs: DataFrame, text: str = "text", out: str = "size") -> DataFrame:
    """``docs`` plus the number of words of the whole text."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(out, word_count(text))


def repeat_documents(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", size: str = "size",
                     source: str = "source") -> DataFrame:
    """Documents as often as the mix takes them (``docs`` must carry the size column it was given)."""
    m = mixed.filter("epochs > 0 or extra > 0").select(
        *[F.col(c).alias(f"__m_{c}") for c in ("id", "source", "size")], *[F.col(c).alias(f"__{c}") for c in ("n_rows", "epochs", "extra")])
    cond = _same(F.col(id_col), F.col("__m_id")) & _same(F.col(source), F.col("__m_source")) & (F.col(size) == F.col("__m_size"))
    out = docs.join(m, cond)
    # Equal in id, source and size, but perhaps not in text: ordered by all columns, so that reruns agree.
    copies = Window.partitionBy("__m_id", "__m_source", "__m_size").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    whole = out.filter("__extra = 0 or __extra = __n_rows").withColumn(
        "__times", F.col("__epochs") + (F.col("__extra") > 0).cast("long"))
    # Some but not all of equal rows: at most one such class per source.
    part = out.filter("__extra > 0 and __extra < __n_rows").withColumn(
        "__times", F.col("__epochs") + (F.row_number().over(copies) <= F.col("__extra")).cast("long"))
    out = whole.unionByName(part).filter("__times > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(
        *[c for c in docs.columns if c != size])

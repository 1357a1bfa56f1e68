"""Tables that grow by numbered batches, each published as a whole.

A batch is one Parquet folder ``batch=<id>``; its ``_SUCCESS`` marker, written last, publishes it.
Readers see published batches only. Writing a batch again replaces it, so a stopped or replayed run
leaves the same table. ``compact`` merges older batches, so that readers list few folders. All paths go through Hadoop's file-system API: any store Spark can reach.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

# Pieces of one level that are merged into one of the next.
FAN = 16


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there; storage errors are raised, not taken for absence."""
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def folders(spark: SparkSession, root: str, prefix: str) -> list[str]:
    """Values of the folders ``<prefix><value>`` directly below ``root``."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(n[len(prefix):] for n in names if n.startswith(prefix))


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


class Piece(NamedTuple):
    """A folder of a table: one batch (level 0) or several merged ones, from the first to the last id."""

    first: int
    last: int
    level: int
    path: str


def _pieces(spark: SparkSession, root: str) -> list[Piece]:
    """Published folders, whether or not a merged one took their place."""
    found = [Piece(int(v), int(v), 0, f"{root}/batch={v}") for v in folders(spark, root, "batch=")]
    for v in folders(spark, root, "merged="):
        level, first, last = map(int, v.split("_"))
        found.append(Piece(first, last, level, f"{root}/merged={v}"))
    return [p for p in found if exists(spark, f"{p.path}/_SUCCESS")]


def current(found: Sequence[Piece]) -> list[Piece]:
    """The pieces that make up the table, ascending: those that lie in no piece of a higher level."""
    kept: list[Piece] = []
    for p in sorted(found, key=lambda p: -p.level):
        if not any(k.first <= p.first and p.last <= k.last for k in kept):
            kept.append(p)
    return sorted(kept)


def due(pieces: Sequence[Piece], fan: int) -> list[Piece]:
    """The pieces to merge next: a whole level that has at least ``fan`` pieces, the lowest such."""
    for level in sorted({p.level for p in pieces}):
        same = [p for p in pieces if p.level == level]
        if len(same) >= fan:
            return same
    return []


def published(spark: SparkSession, root: str, before: int | None = None) -> list[Piece]:
    """Published pieces, ascending; ``before`` leaves out this batch and later ones."""
    live = current(_pieces(spark, root))
    if before is not None and any(p.first < before <= p.last for p in live):
        raise ValueError(f"batch {before} of {root} was merged with later ones and cannot be written again")
    return [p for p in live if before is None or p.last < before]


def read_batches(spark: SparkSession, root: str, schema: str, before: int | None = None) -> DataFrame:
    """Rows of the published batches; an empty table when there is none."""
    paths = [p.path for p in published(spark, root, before)]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def publish(df: DataFrame, root: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")


def compact(spark: SparkSession, root: str, schema: str, before: int, fan: int = FAN) -> None:
    """Merges batches older than ``before`` (the one that may be written again) level by level.

    ``fan`` pieces of a level become one of the next, so a table of n batches has at most about fan * log(n) folders
    and a row is rewritten at most log(n) times. A merged folder counts from its ``_SUCCESS`` on, in place
    of those it was made of; these are removed by the next call, as readers may still be at them. Stopped anywhere and
    run again, it leaves the same table.
    """
    found = _pieces(spark, root)
    live = current(found)
    replaced = [p for p in found if p not in live]
    while run := due([p for p in live if p.last < before], fan):
        level, first, last = run[0].level + 1, run[0].first, run[-1].last
        merged = Piece(first, last, level, f"{root}/merged={level}_{first}_{last}")
        spark.read.schema(schema).parquet(*[p.path for p in run]).write.mode("overwrite").parquet(merged.path)
        live = current([*live, merged])
    for p in replaced:
        remove(spark, p.path)

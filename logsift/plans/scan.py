"""Ordered scans that stay balanced when one key holds a large share of the rows.

A plain ``Window.partitionBy(key).orderBy(pos)`` sends every row of a key to one task. Here
each key is cut into blocks (a column that is monotone in the order, e.g. ``line_no div B``
or an hour of event time). Windows run per ``(key, block)`` — groups of bounded size.

Islands need no totals: they are numbered inside their block, and only a block's first and last
piece are stitched to those of other blocks (``local_islands``, ``stitch``). Running sums
(``blocked_cumsum``) take the totals of earlier blocks from a small per-block table, one row per
``(key, block)``, partially aggregated before its shuffle and joined back on ``(key, block)``; the big
side is already partitioned on exactly those columns by the window, so only the small side moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows per block for position-ordered data (lines of a log).
LINE_BLOCK = 1 << 16

_BLK = "__blk"


def line_block(pos: str | Column, size: int | None = None) -> Column:
    size = size or LINE_BLOCK
    c = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(c / F.lit(size)).cast("bigint")


def with_block(df: DataFrame, pos: str = "line_no", size: int | None = None) -> DataFrame:
    """Adds the block column that ``block_window`` and ``local_islands`` work on."""
    return df.withColumn(_BLK, line_block(pos, size))


def local_islands(df: DataFrame, key: Sequence[str], starts: dict[str, Column], pos: str = "line_no") -> DataFrame:
    """Numbers islands inside each block: per ``{out: flag}`` the running count of flagged rows in ``out``, and in
    ``out_last`` whether the row lies in its block's last island. Rows come with a block column.

    Island 0 holds the rows before the block's first start: it continues the island that was last before it.
    Every block is summarised by its own rows alone, so nothing is added up over blocks; see ``stitch``.
    """
    whole = Window.partitionBy(*key, _BLK)
    for out, flag in starts.items():
        df = df.withColumn(out, F.sum(flag).over(block_window(key, pos)))
        df = df.withColumn(f"{out}_last", F.col(out) == F.max(out).over(whole))
    return df


def island_key(key: Sequence[str], island: str) -> list[str]:
    """Columns that tell the pieces of islands apart. Rows dealt out by key and block are dealt out by them, too."""
    return [*key, _BLK, island, f"{island}_last"]


def stitch(pieces: DataFrame, key: Sequence[str], island: str) -> tuple[DataFrame, list[str]]:
    """Pieces (one row per ``island_key``) with columns that all pieces of one island share, and these columns.

    Only a block's first and last piece can be part of an island that crosses a boundary: these, two per block,
    are chained per key, each piece 0 to the one before it. Every other piece is an island by itself. A block's last
    piece must not be missing; first pieces and whole blocks may be.
    """
    cut = (F.col(island) == 0) | F.col(f"{island}_last")
    d = pieces.withColumn("__route", F.when(cut, -1).otherwise(F.col(_BLK))) \
        .withColumn("__of", F.when(cut, 0).otherwise(F.col(island)))
    along = Window.partitionBy(*key, "__route", "__of").orderBy(_BLK, island)
    d = d.withColumn("__chain", F.sum(F.when(F.col(island) > 0, 1).otherwise(0)).over(along))
    return d, [*key, "__route", "__of", "__chain"]


def block_window(key: Sequence[str], pos: str = "line_no"):
    """Rows of a key and block up to the current one, by position."""
    return Window.partitionBy(*key, _BLK).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def blocked_cumsum(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], block: Column,
                   values: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """Add running sums ``{out: value}`` per ``key`` in ``order``.

    ``block`` must be non-decreasing along ``order`` inside a key. ``inclusive=False`` gives the
    sum over strictly earlier rows.
    """
    key = list(key)
    tmp = {out: f"__v_{out}" for out in values}
    d = df.withColumn(_BLK, block)
    for out, expr in values.items():
        d = d.withColumn(tmp[out], expr)
    # Per-block totals come from the rows before the window: a partial aggregate (map-side
    # combine), so the summary branch shuffles one row per (key, block) and task.
    tot = d.groupBy(*key, _BLK).agg(*[F.sum(tmp[o]).alias(f"__tot_{o}") for o in values])
    w = Window.partitionBy(*key, _BLK).orderBy(*order).rowsBetween(Window.unboundedPreceding,
                                                                   Window.currentRow)
    for out in values:
        d = d.withColumn(f"__loc_{out}", F.sum(tmp[out]).over(w))
    wb = Window.partitionBy(*key).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*key, _BLK, *[F.coalesce(F.sum(f"__tot_{o}").over(wb), F.lit(0)).alias(f"__off_{o}")
                                   for o in values])
    d = d.join(off, [*key, _BLK], "inner")
    for out in values:
        run = F.col(f"__off_{out}") + F.col(f"__loc_{out}")
        if not inclusive:
            run = run - F.col(tmp[out])
        d = d.withColumn(out, run)
    drops = [_BLK] + [c for o in values for c in (tmp[o], f"__loc_{o}", f"__off_{o}")]
    return d.drop(*drops)


def dense_prev(df: DataFrame, key: Sequence[str], pos: str, cols: Sequence[str],
               size: int | None = None, prefix: str = "prev_", keep_block: bool = False) -> DataFrame:
    """``prefix+c`` = value of ``c`` at position ``pos - 1`` of the same key (null at the first).

    For dense positions (every line of a log, numbered 1..n). One window pass, no join: the
    last row of each block is also sent to the next block as a halo row, so the first row of a
    block sees its predecessor; halo rows are dropped after the window. ``keep_block`` leaves the
    block column in place for a following ``local_islands``, which then needs neither another exchange nor
    another sort.
    """
    key, cols = list(key), list(cols)
    size = size or LINE_BLOCK
    blk = F.floor(F.col(pos) / F.lit(size)).cast("bigint")
    last_of_block = (F.col(pos) % F.lit(size)) == F.lit(size - 1)
    d = df.withColumn("__own", blk).withColumn(
        _BLK, F.explode(F.when(last_of_block, F.array(blk, blk + 1)).otherwise(F.array(blk))))
    w = Window.partitionBy(*key, _BLK).orderBy(pos)
    for c in cols:
        d = d.withColumn(prefix + c, F.lag(c).over(w))
    d = d.filter(F.col(_BLK) == F.col("__own")).drop("__own")
    return d if keep_block else d.drop(_BLK)

"""Connected components of a link table, by alternating star contraction.

Input: links ``(a, b)`` between node ids of any orderable type. Each round replaces the links of
every node by links to its smallest neighbour ("large star" towards larger nodes, "small star"
towards smaller ones); the number of rounds grows with the logarithm of the longest chain. Only
minima are aggregated (map-side combined), so a node with very many links is no unbounded group.
Rounds are cut by reliable checkpoints and go on until nothing changes; there is no round limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import checkpoint


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour larger than u is linked to the smallest node of u's neighbourhood."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a <> b").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Links point from larger a to smaller b; all of a's partners and a meet in the smallest."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node with a link; root is the smallest node reachable.

    Null ends and loops are ignored; repeated links count once; no links give no rows.
    """
    cur = checkpoint(links.select("a", "b").filter("a is not null and b is not null and a <> b").distinct())
    before = None
    while True:
        cur = checkpoint(_small_star(_large_star(cur)))
        now = cur.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if before == tuple(now):
            break
        before = tuple(now)
    nodes = cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return nodes.union(roots)

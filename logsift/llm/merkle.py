"""Merkle manifest of a dataset, with leaf coordinates from bitmap ranks.

Every row is a leaf; the leaves of a group ascend by id and are hashed together two by two, level by
level, to the group's subroot; the subroots, ordered by group, likewise give the root.

*Ranks.* No leaf is sorted to learn its place. The ids of a group are set as bits; only words of 64 ids
that hold one are kept (``bit_or`` merges what the tasks found). A directory of prefix popcounts lies
above the words: 1,024 words a chunk, 1,024 chunks a node and so on, so no window sees more than 1,024
rows, however large a group is. The place of a leaf is the sum of the directory's counts before it
plus the popcount of its word below its bit. Repeated ids count with their number of rows.

*Levels.* A leaf goes to the slot array of its block (place div 1,024). Each task reduces whole slot
arrays by ten levels to one node; the nodes are the leaves of the next step. Paths then come down the
same arrays: the siblings inside the block, followed by those of the block's own node.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.common import checkpoint

#: Levels that one slot array holds, and bits of the directory's fan-out.
DEPTH, FAN = 10, 10


def field(col: str | Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    c = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def leaf(fields: Sequence[str | Column]) -> Column:
    """SHA-256 (32 bytes) over the fields; lengths before the values keep different rows apart."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in fields]).cast("binary"), 256))


def ranked(ids: DataFrame, group: Sequence[str], key: str, weight: str) -> DataFrame:
    """Words of the bitmap with all that a rank query needs: ``(*group, word, mask, more, first, total)``.

    ``ids`` holds one row per group and key (a long, null before all) with the rows it stands for;
    ``first`` is the place of the word's first row, ``more`` lists the bits that stand for several rows,
    ``total`` the rows of the group. An empty table gives no words.
    """
    bits = F.col(key).bitwiseXOR(F.lit(-(1 << 63)))  # as unsigned, so negative ids come first
    word = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.shiftrightunsigned(bits, 6))
    bit = F.when(F.col(key).isNull(), F.lit(0)).otherwise(bits.bitwiseAND(F.lit(63))).cast("int")
    words = ids.select(*group, word.cast("long").alias("word"), bit.alias("bit"), F.col(weight).alias("w")).groupBy(*group, "word").agg(
        F.expr("bit_or(shiftleft(1L, bit))").alias("mask"), F.sum("w").alias("n"),
        F.collect_list(F.when(F.col("w") > 1, F.struct("bit", (F.col("w") - 1).alias("w")))).alias("more"))
    words = checkpoint(words)
    low, high = words.agg(F.min(F.when(F.col("word") >= 0, F.col("word"))), F.max("word")).first()
    nodes, steps = words.select(*group, F.col("word").alias("node"), "n"), []
    while True:  # directory levels, until one node holds all words of a group (and one the null id)
        parent = F.shiftright("node", FAN)
        before = Window.partitionBy(*group, "parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        steps.append(nodes.withColumn("parent", parent).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
        nodes = nodes.groupBy(*group, parent.alias("node")).agg(F.sum("n").alias("n"))
        low, high = (low or 0) >> FAN, (high or 0) >> FAN
        if low >= high:
            break
    top = Window.partitionBy(*group)
    first = nodes.withColumn("first", F.coalesce(F.sum("n").over(top.orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
        .withColumn("total", F.sum("n").over(top)).drop("n")
    for step in reversed(steps):
        above = first.withColumnRenamed("node", "parent")
        first = step.join(above, [*group, "parent"]).select(*group, "node", (F.col("first") + F.col("before")).alias("first"), "total")
    return words.join(first.withColumnRenamed("node", "word"), [*group, "word"]).drop("n")


def rank(rows: DataFrame, words: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """``rows`` plus ``place`` (rows before the first row of its key) and ``total`` of its group."""
    bits = F.col(key).bitwiseXOR(F.lit(-(1 << 63)))
    asked = rows.withColumn("word", F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.shiftrightunsigned(bits, 6)).cast("long")) \
        .withColumn("bit", F.when(F.col(key).isNull(), F.lit(0)).otherwise(bits.bitwiseAND(F.lit(63))).cast("int"))
    below = F.bit_count(F.expr("mask & ~shiftleft(-1L, bit)"))
    extra = F.aggregate("more", F.lit(0).cast("long"), lambda s, m: s + F.when(m["bit"] < F.col("bit"), m["w"]).otherwise(0))
    return asked.join(words, [*group, "word"]).withColumn("place", F.col("first") + below + extra).drop("word", "bit", "mask", "more", "first")


def _places(rows: DataFrame) -> DataFrame:
    """Distinct rows ``(g, id, leaf, claimed, copies)`` plus ``place`` and ``total``. Rows of one id
    ascend by their leaves, whose own ranks come from the same bitmaps."""
    ids = rows.groupBy("g", "id").agg(F.sum("copies").alias("n"), F.count("*").alias("forms"))
    placed = checkpoint(rank(rows, ranked(ids, ["g"], "id", "n"), ["g"], "id"))
    several = placed.groupBy("g", "id").agg(F.count("*").alias("forms")).filter("forms > 1").drop("forms")
    tied = rows.join(several.withColumnRenamed("g", "g2").withColumnRenamed("id", "id2"),
                     F.col("g").eqNullSafe(F.col("g2")) & F.col("id").eqNullSafe(F.col("id2")), "left_semi")
    tied = tied.withColumn("head", F.conv(F.substring(F.hex("leaf"), 1, 15), 16, 10).cast("long")) \
        .withColumn("gid", F.concat_ws(":", "g", F.coalesce(F.col("id").cast("string"), F.lit("-"))))
    heads = tied.groupBy("gid", "head").agg(F.sum("copies").alias("n"))
    same = Window.partitionBy("gid", "head").orderBy("leaf", "claimed").rowsBetween(Window.unboundedPreceding, -1)  # equal for equal leaves
    order = rank(tied, ranked(heads, ["gid"], "head", "n"), ["gid"], "head") \
        .withColumn("later", F.col("place") + F.coalesce(F.sum("copies").over(same), F.lit(0))) \
        .select(F.col("g").alias("g2"), F.col("id").alias("id2"), F.col("leaf").alias("leaf2"), F.col("claimed").alias("claimed2"), "later")
    found = placed.join(order, F.col("g").eqNullSafe(F.col("g2")) & F.col("id").eqNullSafe(F.col("id2"))
                        & (F.col("leaf") == F.col("leaf2")) & F.col("claimed").eqNullSafe(F.col("claimed2")), "left")
    return found.withColumn("place", F.col("place") + F.coalesce("later", F.lit(0))).drop("g2", "id2", "leaf2", "claimed2", "later")


def _hash(nodes: Sequence[bytes]) -> bytes:
    return sha256(b"".join(n.hex().encode() for n in nodes)).digest()


def levels(slots: list[bytes], total: int) -> list[list[bytes]]:
    """The levels of one slot array, up to its node. ``total``: nodes of the whole level it is part of."""
    out = [slots]
    while len(out) <= DEPTH and total > 1:
        at = out[-1]
        out.append([_hash(at[i:i + 2]) for i in range(0, len(at), 2)])
        total = -(-total // 2)
    return out


def path(tree: list[list[bytes]], slot: int) -> list[tuple[str, bytes]]:
    """Per level the sibling of a slot and its side (``L``, ``R``; a run of one node: ``-`` and nothing)."""
    out = []
    for at in tree[:-1]:
        other = slot ^ 1
        out.append(("L" if other < slot else "R", at[other]) if other < len(at) else ("-", b""))
        slot >>= 1
    return out


def fold(node: bytes, siblings: Sequence[tuple[str, bytes]]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for side, other in siblings:
        node = _hash((other, node) if side == "L" else (node, other) if side == "R" else (node,))
    return node


def _packed(siblings: Sequence[tuple[str, bytes]]) -> str:
    return ",".join(side + other.hex() for side, other in siblings)


def _unpacked(text: str) -> list[tuple[str, bytes]]:
    return [(p[0], bytes.fromhex(p[1:])) for p in text.split(",")] if text else []


def _arrays(nodes: DataFrame) -> DataFrame:
    """Nodes ``(g, place, total, copies, leaf, *)`` gathered into slot arrays, one row per block.
    A node that stands for several copies is kept once per block, with its run length."""
    rest = [c for c in nodes.columns if c not in ("g", "place", "total", "copies")]
    last = F.col("place") + F.col("copies") - 1
    runs = nodes.withColumn("b", F.explode(F.sequence(F.shiftright("place", DEPTH), F.shiftright(last, DEPTH)))) \
        .withColumn("slot", F.greatest("place", F.shiftleft("b", DEPTH))) \
        .withColumn("run", F.least(last + 1, F.shiftleft(F.col("b") + 1, DEPTH)) - F.col("slot"))
    return runs.groupBy("g", "total", "b").agg(F.array_sort(F.collect_list(F.struct("slot", "run", *rest))).alias("slots"))


def _tree(row: dict) -> tuple[list[dict], list[list[bytes]]]:
    spread = [s for s in row["slots"] for _ in range(s["run"])]
    return spread, levels([s["leaf"] for s in spread], row["total"])


def _reduced(arrays: DataFrame) -> DataFrame:
    """One node per slot array, in the form ``_arrays`` takes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, _tree(r)[1][-1][0]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "g": pa.array([r["g"] for r, _ in rows], pa.string()), "place": pa.array([r["b"] for r, _ in rows], pa.int64()),
                "total": pa.array([-(-r["total"] >> DEPTH) for r, _ in rows], pa.int64()),
                "copies": pa.array([1] * len(rows), pa.int64()), "leaf": pa.array([n for _, n in rows], pa.binary())})
    return arrays.mapInArrow(run, "g string, place long, total long, copies long, leaf binary")


def _paths(arrays: DataFrame, above: DataFrame) -> DataFrame:
    """``(g, b, path, subroot, root)`` of every node in these arrays; ``above`` has them for the arrays' own nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                spread, tree = _tree(r)
                own = [_packed(path(tree, i)) for i in range(len(spread))]
                yield pa.RecordBatch.from_pydict({
                    "g": pa.array([r["g"]] * len(own), pa.string()), "b": pa.array([s["slot"] for s in spread], pa.int64()),
                    "path": pa.array([",".join(p for p in (o, r["path"]) if p) for o in own], pa.string()),
                    "subroot": pa.array([r["subroot"]] * len(own), pa.binary()),
                    "root": pa.array([r["root"]] * len(own), pa.binary())})
    return arrays.join(above, ["g", "b"]).mapInArrow(run, "g string, b long, path string, subroot binary, root binary")


def _climb(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Slot arrays of every step, and one node per group. ``most``: leaves of the largest group."""
    steps = []
    while True:
        steps.append(checkpoint(_arrays(nodes)))
        nodes = _reduced(steps[-1])
        most = -(-most >> DEPTH)
        if most <= 1:
            return steps, checkpoint(nodes)


def manifest(docs: DataFrame, fields: Sequence[str | Column], id_col: str = "doc_id", group: str = "lang",
             claimed: Column | None = None, with_path: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``(id, leaf_no, leaf, subroot, root, proof, folded, verified)``, digests as hex.

    ``proof`` digests the siblings from the leaf to the root; ``folded`` is the root they give to ``claimed``
    (a leaf digest; default the row's own), ``verified`` says that it is the root. ``with_path`` adds ``path``,
    the siblings themselves, each after its side.

    Null values are fields of their own kind; a null id comes before all others, a null group before all
    groups. Rows of one id ascend by their leaves; equal rows are leaves of their own, side by side. One
    row alone is subroot and root with no siblings; no rows give no rows. Columns not among the
    fields are ignored. Groups are ranked in one window of one row per group.
    """
    own = leaf(fields)
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # null first
    rows = docs.select(g.alias("g"), F.col(id_col).cast("long").alias("id"), own.alias("leaf"),
                       (claimed if claimed is not None else F.lit(None).cast("binary")).alias("claimed"))
    rows = checkpoint(rows.groupBy("g", "id", "leaf", "claimed").agg(F.count("*").alias("copies")))
    placed = _places(rows)
    leaves = checkpoint(_arrays(placed))
    most = leaves.agg(F.coalesce(F.max("total"), F.lit(0))).first()[0]
    steps, subroots = _climb(_reduced(leaves), -(-most >> DEPTH)) if most > 1 << DEPTH else ([], checkpoint(_reduced(leaves)))
    tops = subroots.select(F.lit("").alias("g"), (F.row_number().over(Window.orderBy("g")) - 1).cast("long").alias("place"),
                           F.count("*").over(Window.partitionBy()).alias("total"), F.lit(1).cast("long").alias("copies"),
                           "leaf", F.col("g").alias("of"))
    tops = checkpoint(tops)
    groups = tops.count()
    if not groups:
        return _rows(leaves.withColumn("path", F.lit("")).withColumn("subroot", F.col("g").cast("binary"))
                     .withColumn("root", F.col("subroot")), with_path)
    above_steps, root = _climb(tops, groups)
    down = root.select("g", F.lit(0).cast("long").alias("b"), F.lit("").alias("path"), F.col("leaf").alias("subroot"),
                       F.col("leaf").alias("root"))
    for arrays in reversed(above_steps):
        down = _paths(arrays, down)
    down = tops.join(down.withColumnRenamed("b", "place").select("place", "path", "root"), "place").select(
        F.col("of").alias("g"), F.lit(0).cast("long").alias("b"), "path", F.col("leaf").alias("subroot"), "root")
    for arrays in reversed(steps):
        down = _paths(arrays, down)
    return _rows(leaves.join(down, ["g", "b"]), with_path)


def _rows(arrays: DataFrame, with_path: bool) -> DataFrame:
    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), *[pa.string()] * 5, pa.bool_(), *[pa.string()] * with_path)
        names = ("id", "leaf_no", "leaf", "subroot", "root", "proof", "folded", "verified", *["path"] * with_path)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                spread, tree = _tree(r)
                above = _unpacked(r["path"])
                root, subroot = r["root"].hex(), r["subroot"].hex()
                first = r["b"] << DEPTH
                rows = []
                for i, s in enumerate(spread):
                    siblings = path(tree, i) + above
                    proof = sha256("".join(x.hex() for _, x in siblings).encode()).hexdigest()
                    folded = fold(s["claimed"] or s["leaf"], siblings).hex()
                    row = (s["id"], first + i, s["leaf"].hex(), subroot, root, proof, folded, folded == root)
                    rows.append((*row, _packed(siblings)) if with_path else row)
                yield out(rows)
    schema = "id long, leaf_no long, leaf string, subroot string, root string, proof string, folded string, verified boolean"
    return arrays.mapInArrow(run, schema + (", path string" if with_path else ""))

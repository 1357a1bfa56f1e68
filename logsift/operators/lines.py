"""Line-level operators: split (O13) and message assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift import constants as C
from logsift.functions.text import split_lines_array, starts_message
from logsift.plans.scan import island_key, local_islands, stitch, with_block


def split_lines(df: DataFrame, id_col: str = "artifact_id", text_col: str = "text",
                keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per line, numbered from 1 (``str.splitlines`` semantics). Narrow: no shuffle."""
    return df.select(F.col(id_col).alias("artifact_id"), *keep,
                     F.posexplode(split_lines_array(text_col)).alias("pos", "line")) \
        .select("artifact_id", *keep, (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")


def assemble_messages(lines: DataFrame, max_len: int = C.DEFAULT_SNIPPET_LEN,
                      keep: tuple[str, ...] = ()) -> DataFrame:
    """Join continuation lines into messages: ``(artifact_id, *keep, line_number, text)``.

    A message starts at a line whose first character is not whitespace or ``|`` (or at the
    first non-empty line). Empty lines are skipped but counted. When the running message
    exceeds ``max_len`` it is cut to ``max_len-11`` chars plus ``<truncated>`` and emitted at
    once; a following continuation line then starts a new chunk at its own line number.

    Plan: islands are numbered by a running count of message starts inside blocks, gathered where
    their lines already are, and stitched at block boundaries; each island is folded with ``aggregate``
    over its ordered lines, which reproduces the sequential cut exactly.
    """
    if max_len < C.MIN_SNIPPET_LEN:
        raise ValueError(f"Snippets must be at least {C.MIN_SNIPPET_LEN} chars long")
    keys = ["artifact_id", *keep]
    ne = lines.filter(F.length("line") > 0).withColumn("msg_start", message_start_flag())
    ne = local_islands(with_block(ne), keys, {"msg_island": F.col("msg_start")})
    return messages_from_islands(ne, max_len, keep)


def message_start_flag():
    """1 on a non-empty line that starts a message, else 0 (empty lines never start one)."""
    return F.when((F.length("line") > 0) & starts_message("line"), 1).otherwise(0)


def messages_from_islands(d: DataFrame, max_len: int = C.DEFAULT_SNIPPET_LEN,
                          keep: tuple[str, ...] = ()) -> DataFrame:
    """Fold the non-empty lines of each ``msg_island`` into chunks (cut at ``max_len``)."""
    keys = ["artifact_id", *keep]
    pieces = d.filter(F.length("line") > 0).groupBy(*island_key(keys, "msg_island")).agg(
        F.collect_list(F.struct("line_no", "line")).alias("ls"))
    chained, whole = stitch(pieces, keys, "msg_island")
    grp = chained.groupBy(*whole).agg(F.array_sort(F.flatten(F.collect_list("ls"))).alias("ls"))
    keep_n = max(max_len - len(C.TRUNCATED), 0)
    init = F.struct(F.lit("").alias("acc"), F.lit(0).cast("bigint").alias("start"),
                    F.array().cast("array<struct<line_number:bigint,text:string>>").alias("out"))

    def step(s, x):
        acc = F.when(s["acc"] == "", x["line"]).otherwise(F.concat(s["acc"], F.lit("\n"), x["line"]))
        start = F.when(s["acc"] == "", x["line_no"]).otherwise(s["start"])
        over = F.length(acc) > max_len
        emitted = F.array_append(s["out"], F.struct(
            start.alias("line_number"),
            F.concat(F.left(acc, F.lit(keep_n)), F.lit(C.TRUNCATED)).alias("text")))
        return F.struct(F.when(over, F.lit("")).otherwise(acc).alias("acc"),
                        start.alias("start"),
                        F.when(over, emitted).otherwise(s["out"]).alias("out"))

    def finish(s):
        tail = F.array(F.struct(s["start"].alias("line_number"), s["acc"].alias("text")))
        return F.when(s["acc"] != "", F.concat(s["out"], tail)).otherwise(s["out"])

    folded = grp.select(*keys, F.explode(F.aggregate("ls", init, step, finish)).alias("c"))
    return folded.select(*keys, F.col("c.line_number").alias("line_number"), F.col("c.text").alias("text"))

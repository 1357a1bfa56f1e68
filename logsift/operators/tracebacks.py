"""O33 — Python traceback extraction as window operators.

Each non-blank line gets a class:
  S  right-trimmed line equals the traceback header
  C  right-trimmed line is one of the two chaining sentences
  F  starts with space or tab (frame / code line)
  E  anything else (the exception line, or unrelated text)
A line belongs to the block of the previous non-blank line iff it is S or C, or the previous
line is not E and no blank line lies between them. Islands are runs of linked lines (a running
count of unlinked lines). An island holding an exact, unstripped header yields one snippet:
from its first exact header to the island's end, lines right-trimmed, blank lines dropped.
Noise rules run on the snippet, then long snippets are cut in the middle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift import constants as C
from logsift.functions.text import is_blank, noise_predicate, truncate_middle
from logsift.plans.scan import block_window, dense_prev, island_key, local_islands, stitch

RTRIM_RE = "(?U)[\\s\\x1C-\\x1F]+$"


def python_tracebacks(lines: DataFrame, max_len: int = C.DEFAULT_SNIPPET_LEN,
                      rules: Sequence = tuple(C.DEFAULT_NOISE_RULES),
                      keep: tuple[str, ...] = (), source_file: str | None = None) -> DataFrame:
    """``lines(artifact_id, line_no, line)`` -> ``(artifact_id, *keep, line_number, text)``."""
    keys = ["artifact_id", *keep]
    d = dense_prev(lines.withColumn("cls", traceback_class()), keys, "line_no", ["cls"], keep_block=True)
    d = d.withColumn("tb_unlinked", traceback_unlinked_flag()).withColumn("tb_open", traceback_open_flag(keys))
    d = local_islands(d, keys, {"tb_island": F.col("tb_unlinked")})
    return tracebacks_from_islands(d, max_len, rules, keep, source_file)


def traceback_class():
    """B blank, F frame (leading space/tab), S header, C chain sentence, E other."""
    rt = F.regexp_replace("line", RTRIM_RE, "")
    return (F.when(is_blank("line"), F.lit("B"))
            .when(F.col("line").startswith(" ") | F.col("line").startswith("\t"), F.lit("F"))
            .when(rt == C.TB_HEADER, F.lit("S"))
            .when(rt.isin(C.TB_CHAIN), F.lit("C"))
            .otherwise(F.lit("E")))


def traceback_unlinked_flag():
    """1 on a non-blank line that does not continue the block above it, 0 otherwise (and on
    blank lines). The previous *line* decides: blank or E -> only S/C continue a block; S, C, F ->
    every non-blank line continues it. Needs ``cls`` and ``prev_cls``."""
    linked = F.col("cls").isin("S", "C") | (F.col("prev_cls").isNotNull() & ~F.col("prev_cls").isin("E", "B"))
    return F.when(F.col("cls") == "B", 0).when(linked, 0).otherwise(1)


def traceback_open_flag(keys: Sequence[str]):
    """Whether a header may have been seen in the line's island so far, judged within its block: the last
    header is not above the island's first line, or the island began in an earlier block. Lines without
    it are in no snippet and need not be grouped. Needs ``tb_unlinked`` and the block column."""
    w = block_window(keys)
    start = F.max(F.when(F.col("tb_unlinked") == 1, F.col("line_no"))).over(w)
    header = F.max(F.when(F.col("line") == C.TB_HEADER, F.col("line_no"))).over(w)
    return start.isNull() | F.coalesce(header >= start, F.lit(False))


def tracebacks_from_islands(d: DataFrame, max_len: int = C.DEFAULT_SNIPPET_LEN,
                            rules: Sequence = tuple(C.DEFAULT_NOISE_RULES), keep: tuple[str, ...] = (),
                            source_file: str | None = None) -> DataFrame:
    """One snippet per island holding an exact header: from the header to the island end.

    Lines are gathered per block first (they are dealt out that way); of islands without a header only the
    last of a block goes on, as a mark without lines."""
    keys = ["artifact_id", *keep]
    nb = d.filter((F.col("cls") != "B") & (F.col("tb_open") | F.col("tb_island_last")))
    line = F.struct("line_no", F.regexp_replace("line", RTRIM_RE, "").alias("rt"))
    pieces = nb.groupBy(*island_key(keys, "tb_island")).agg(
        F.min(F.when(F.col("line") == C.TB_HEADER, F.col("line_no"))).alias("line_number"),
        F.collect_list(F.when(F.col("tb_open"), line)).alias("ls"))
    chained, whole = stitch(pieces.filter(F.col("line_number").isNotNull() | (F.col("tb_island") == 0) | F.col("tb_island_last")),
                            keys, "tb_island")
    grp = chained.groupBy(*whole).agg(F.min("line_number").alias("line_number"), F.flatten(F.collect_list("ls")).alias("ls"))
    grp = grp.filter(F.col("line_number").isNotNull())
    body = F.transform(
        F.array_sort(F.filter("ls", lambda x: x["line_no"] >= F.col("line_number"))),
        lambda x: x["rt"])
    snip = grp.select(*keys, "line_number", F.array_join(body, "\n").alias("text"))
    if rules:
        src = F.col(source_file) if source_file else None
        snip = snip.filter(~noise_predicate("text", rules, src))
    return snip.select(*keys, F.col("line_number").cast("bigint").alias("line_number"),
                       truncate_middle("text", max_len).alias("text"))


class TracebackFeed:
    """The same rule for one log, line by line (see ``extract.python_extractor``): holds the open block from its first
    exact header on. Snippets come whole, before noise rules and cutting."""

    def __init__(self):
        self.above, self.at, self.body = "", None, []

    def _end(self) -> list[tuple[int, str]]:
        done = [] if self.at is None else [(self.at, "\n".join(self.body))]
        self.at, self.body = None, []
        return done

    def feed(self, number: int, line: str | None) -> list[tuple[int, str]]:
        text, done = (line or "").rstrip(), []
        kind = ("blank" if not text else "frame" if line[0] in " \t"
                else "mark" if text in (C.TB_HEADER, *C.TB_CHAIN) else "other")
        if kind not in ("blank", "mark") and self.above not in ("mark", "frame"):
            done = self._end()
        self.above = kind
        if self.at is None and line == C.TB_HEADER:
            self.at = number
        if self.at is not None and text:
            self.body.append(text)
        return done

    def close(self) -> list[tuple[int, str]]:
        return self._end()

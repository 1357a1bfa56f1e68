"""Compiler diagnostics (O34), external defect reports.

``compiler_errors`` finds ``file:line[:col]: [fatal] error: msg`` and ``tool: error: msg`` lines
and attaches the indented lines right below them (source excerpt, caret) as further events of
the same defect. Each defect becomes a snippet at the log line of its first event whose text
is the event messages joined by newlines; identical defects are reported once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift import constants as C
from logsift.functions.text import is_blank, noise_predicate
from logsift.plans.scan import block_window, island_key, local_islands, stitch, with_block

# FIXED VALUES — diagnostic line shapes
LOCATED_ERROR_RE = (r"^([^:\s][^:]*):(\d+):(?:(\d+):)?\s+(?:fatal\s+)?error:\s+(.*?)"
                    r"(?:\s+\[(-W[^\]]+)\])?$")
TOOL_ERROR_RE = r"^([\w.+-]+):\s+(?:fatal\s+)?error:\s+(.*)$"

EVENT = T.StructType([
    T.StructField("file_name", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("event", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("input_file", T.StringType()),
    T.StructField("input_line", T.IntegerType()),
    T.StructField("verbosity_level", T.IntegerType()),
])
DEFECT = T.StructType([
    T.StructField("checker", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("tool", T.StringType()),
    T.StructField("key_event_idx", T.IntegerType()),
    T.StructField("events", T.ArrayType(EVENT)),
])
REPORT = T.StructType([T.StructField("defects", T.ArrayType(DEFECT))])


def compiler_errors(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``lines(artifact_id, line_no, line)`` -> ``(artifact_id, *keep, file_name, src_line,
    line_number, text)``, one row per distinct defect (first occurrence)."""
    keys = ["artifact_id", *keep]
    d = with_block(lines.withColumn("is_cont", continuation_flag()))
    d = d.withColumn("diag_open", diagnostic_open_flag(keys))
    d = local_islands(d, keys, {"diag_island": F.when(F.col("is_cont"), 0).otherwise(1)})
    return diagnostics_from_islands(d, keep)


def continuation_flag():
    """An indented, non-blank line (source excerpt / caret) continuing the defect above."""
    return F.col("line").rlike("^[ \t]") & ~is_blank("line")


def is_error_head():
    return F.col("line").rlike(LOCATED_ERROR_RE) | F.col("line").rlike(TOOL_ERROR_RE)


def diagnostic_open_flag(keys: Sequence[str]):
    """Whether the line's island may be headed by an error line, judged within its block: the last line
    that is no continuation is an error line, or lies in an earlier block. Needs ``is_cont`` and the block
    column."""
    last = F.last(F.when(~F.col("is_cont"), is_error_head()), ignorenulls=True).over(block_window(keys))
    return F.coalesce(last, F.lit(True))


def diagnostics_from_islands(d: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One defect per island headed by an error line; identical defects once."""
    keys = ["artifact_id", *keep]
    loc = F.col("line").rlike(LOCATED_ERROR_RE)
    tool = F.col("line").rlike(TOOL_ERROR_RE)
    # Only error heads and the indented lines below them can be part of a defect; a block's last island goes on
    # even without a head, as a mark.
    d = d.filter(F.col("diag_open") | F.col("diag_island_last")).withColumn("kind", F.when(loc, F.lit(1)).when(tool, F.lit(2)))
    d = d.filter(F.col("kind").isNotNull() | F.col("is_cont") | F.col("diag_island_last"))
    head = F.when(F.col("kind") == 1, F.struct(
        F.regexp_extract("line", LOCATED_ERROR_RE, 1).alias("file_name"),
        F.regexp_extract("line", LOCATED_ERROR_RE, 2).cast("int").alias("src_line"),
        F.regexp_extract("line", LOCATED_ERROR_RE, 4).alias("message"),
        F.col("line_no").alias("line_no"))).when(F.col("kind") == 2, F.struct(
            F.regexp_extract("line", TOOL_ERROR_RE, 1).alias("file_name"),
            F.lit(0).alias("src_line"),
            F.regexp_extract("line", TOOL_ERROR_RE, 2).alias("message"),
            F.col("line_no").alias("line_no")))
    pieces = d.groupBy(*island_key(keys, "diag_island")).agg(
        F.max(head).alias("head"),
        F.collect_list(F.when(F.col("is_cont") & F.col("diag_open"), F.struct("line_no", "line"))).alias("conts"))
    chained, whole = stitch(pieces, keys, "diag_island")
    g = chained.groupBy(*whole).agg(F.max("head").alias("head"), F.flatten(F.collect_list("conts")).alias("conts"))
    g = g.filter(F.col("head").isNotNull())
    conts = F.transform(F.array_sort("conts"), lambda x: x["line"])
    text = F.array_join(F.concat(F.array(F.col("head.message")), conts), "\n")
    defects = g.select(*keys, F.col("head.file_name").alias("file_name"),
                       F.col("head.src_line").alias("src_line"),
                       F.col("head.line_no").cast("bigint").alias("line_number"), text.alias("text"))
    # --remove-duplicates: identical defects once, at their first log line.
    return defects.groupBy(*keys, "file_name", "src_line", "text").agg(
        F.min("line_number").alias("line_number")) \
        .select(*keys, "file_name", "src_line", "line_number", "text")


def read_diagnostic_reports(df: DataFrame, json_col: str = "report") -> DataFrame:
    """Parse defect-report JSON (``{defects: [...]}``) into the nested schema; malformed input
    fails the job (FAILFAST), as a malformed report is an error."""
    return df.withColumn("report", F.from_json(json_col, REPORT, {"mode": "FAILFAST"}))


def report_snippets(reports: DataFrame, keys: Sequence[str] = ("artifact_id",),
                    rules=tuple(C.DEFAULT_NOISE_RULES), source_file: str | None = None) -> DataFrame:
    """Per defect with at least one event: ``(line_number = first event input_line, text =
    messages joined by newline)``, noise-filtered."""
    keys = list(keys)
    extra = [source_file] if source_file else []
    d = reports.select(*keys, *extra, F.explode(F.filter("report.defects", lambda x: F.size(x["events"]) > 0))
                       .alias("d"))
    out = d.select(*keys, *extra,
                   F.col("d.events")[0]["input_line"].cast("bigint").alias("line_number"),
                   F.array_join(F.transform("d.events", lambda e: e["message"]), "\n").alias("text"))
    if rules:
        src = F.col(source_file) if source_file else None
        out = out.filter(~noise_predicate("text", rules, src))
    return out

"""Combining extractors (O36), work tracking (O37) and analysis attachment."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SNIPPET_COLUMNS = ["artifact_id", "extractor", "line_number", "text"]


def extract_all(lines: DataFrame, extractors: dict[str, Callable[[DataFrame], DataFrame]],
                materialize: bool = False) -> DataFrame:
    """Apply every extractor to the same lines and concatenate (overlaps kept).

    An extractor is any ``lines -> (artifact_id, line_number, text)`` function; custom
    extractors plug in the same way (U1). With ``materialize`` the lines are written once
    as a Parquet table under the cluster's checkpoint folder, so the upstream (file scan,
    decode, split, numbering shuffle) runs once instead of once per extractor."""
    if materialize and len(extractors) > 1:
        lines = materialize_table(lines)
    out = None
    for name, fn in extractors.items():
        part = fn(lines).select("artifact_id", F.lit(name).alias("extractor"), "line_number", "text")
        out = part if out is None else out.unionByName(part)
    return out


def python_extractor(start: Callable[[], object]) -> Callable[[DataFrame], DataFrame]:
    """An extractor written in Python, fed line by line: ``lines -> (artifact_id, line_number, text)``.

    ``start()`` makes the state of one log: ``feed(line_no, line)`` gives the snippets ``(line number, text)`` that are
    complete with this line, ``close()`` those that are open at the end. It is a table function over lines partitioned
    by log and ordered by number, so Spark sorts (and spills) the lines and a task holds one log's state, never a
    whole log. Lines come in order; a null line comes as None. One log is one task's work: order is all that such a
    function may rely on, and use the DataFrame extractors where logs are huge. Logs without lines are not started.
    """
    class Feed:
        def __init__(self):
            self.log = None

        def eval(self, row):
            if self.log is None:
                self.artifact_id, self.log = row["artifact_id"], start()
            for number, text in self.log.feed(row["line_no"], row["line"]):
                yield self.artifact_id, number, text

        def terminate(self):
            if self.log is not None:
                for number, text in self.log.close():
                    yield self.artifact_id, number, text

    table = F.udtf(Feed, returnType="artifact_id bigint, line_number bigint, text string")
    return lambda lines: table(lines.select("artifact_id", "line_no", "line").asTable()
                               .partitionBy("artifact_id").orderBy("line_no"))


def materialize_table(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder: written once, read by all that follows, and
    removed with the last reference (``spark.cleaner.referenceTracking.cleanCheckpoints``)."""
    from logsift.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def remaining_artifacts(artifacts: DataFrame, done: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Artifacts not yet processed (anti join)."""
    return artifacts.join(done, key, "left_anti")


def attach_analysis(snippets: DataFrame, analyses: DataFrame,
                    within: Sequence[str] = ("request_id",)) -> tuple[DataFrame, DataFrame]:
    """Attach ``analyses(*within, analysis_id, source_file, line_number, snippet_analysis)`` to
    ``snippets(*within, source_file, line_number, ...)`` on file and line of the same request.

    The first analysis (lowest id) of a snippet wins. Returns ``(analysed, rejects)``; rejects
    carry ``reason`` in {unknown_file, unknown_line, already_analyzed}.
    """
    file = [*within, "source_file"]
    keys = [*file, "line_number"]
    known = analyses.join(snippets.select(*keys).distinct(), keys, "left_semi")
    # min_by aggregates partially before the shuffle: a snippet with very many analyses is fine.
    first = known.groupBy(*keys).agg(
        F.min_by(F.struct(*[c for c in analyses.columns if c not in keys]), F.col("analysis_id")).alias("a"))
    first = first.select(*keys, "a.*")
    analysed = snippets.join(first.drop("analysis_id"), keys, "left")
    files = snippets.select(*file).distinct()
    unknown_file = analyses.join(files, file, "left_anti") \
        .select("analysis_id", F.lit("unknown_file").alias("reason"))
    unknown_line = analyses.join(files, file, "left_semi") \
        .join(snippets.select(*keys).distinct(), keys, "left_anti") \
        .select("analysis_id", F.lit("unknown_line").alias("reason"))
    repeat = known.join(first.select("analysis_id"), "analysis_id", "left_anti") \
        .select("analysis_id", F.lit("already_analyzed").alias("reason"))
    return analysed, unknown_file.unionByName(unknown_line).unionByName(repeat)


def extract_fused(lines: DataFrame, max_clusters: int = 8, max_snippet_len: int = 2000,
                  rules=None, keep: tuple[str, ...] = (), source_file: str | None = None,
                  materialize: bool = True) -> DataFrame:
    """The three built-in extractors (templates, compiler errors, tracebacks) from ONE pass.

    One classification and one halo-lag window give every line its message, traceback and
    diagnostic island inside its block at once (a running count over all lines where excluded
    lines count 0 numbers the included lines exactly as the separate operators do). The
    islanded lines are written once (``materialize``); each builder groups its own subset and
    stitches it at block boundaries. Same output as ``extract_all`` with the three extractors.
    """
    from logsift import constants as C
    from logsift.operators.diagnostics import continuation_flag, diagnostic_open_flag, diagnostics_from_islands
    from logsift.operators.lines import message_start_flag, messages_from_islands
    from logsift.operators.noise import drop_noise
    from logsift.operators.templates import mine_templates, representative_snippets
    from logsift.operators.tracebacks import (traceback_class, traceback_open_flag, traceback_unlinked_flag,
                                               tracebacks_from_islands)
    from logsift.plans.scan import dense_prev, island_key, local_islands

    rules = tuple(C.DEFAULT_NOISE_RULES) if rules is None else rules
    keys = ["artifact_id", *keep]
    d = lines.withColumn("cls", traceback_class()).withColumn("is_cont", continuation_flag()) \
        .withColumn("msg_start", message_start_flag())
    d = dense_prev(d, keys, "line_no", ["cls"], keep_block=True).withColumn("tb_unlinked", traceback_unlinked_flag())
    d = d.withColumn("tb_open", traceback_open_flag(keys)).withColumn("diag_open", diagnostic_open_flag(keys))
    islands = {"msg_island": F.col("msg_start"), "tb_island": F.col("tb_unlinked"),
               "diag_island": F.when(F.col("is_cont"), 0).otherwise(1)}
    d = local_islands(d, keys, islands)
    d = d.select("line_no", "line", "cls", "is_cont", "tb_open", "diag_open",
                 *dict.fromkeys(c for i in islands for c in island_key(keys, i)))
    if materialize:
        d = materialize_table(d)
    src = source_file
    chunks = drop_noise(messages_from_islands(d, max_snippet_len, keep), rules, source_file=src)
    drain = representative_snippets(mine_templates(chunks.drop(*keep)), max_clusters)
    diag = drop_noise(diagnostics_from_islands(d, keep), rules, source_file=src).select(
        "artifact_id", "line_number", "text")
    csgrep = representative_snippets(mine_templates(diag), max_clusters)
    tb = tracebacks_from_islands(d, max_snippet_len, rules, keep, src).select("artifact_id", "line_number", "text")
    parts = [("drain", drain), ("csgrep", csgrep), ("python_traceback", tb)]
    out = None
    for name, part in parts:
        p = part.select("artifact_id", F.lit(name).alias("extractor"), "line_number", "text")
        out = p if out is None else out.unionByName(p)
    return out

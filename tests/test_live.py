"""Live tracebacks and templates: the stream's rows are the batch operator's on ended logs."""

import itertools
import os

from pyspark.sql import functions as F

from logsift import constants as C
from logsift.operators.lines import assemble_messages
from logsift.operators.templates import mine_templates, representative_snippets
from logsift.operators.tracebacks import python_tracebacks
from logsift.streaming import live as L
from logsift.streaming import ops as S

LINES = "artifact_id long, line_no long, line string"
ATOMS = {"S": C.TB_HEADER, "C": C.TB_CHAIN[0], "B": " ", "F": "  frame", "E": "Err: x", "T": C.TB_HEADER + "  "}


def stream_of(spark, parts, src, schema=LINES):
    """The parts as micro-batches, one file each."""
    for k, rows in enumerate(parts):
        df = spark.createDataFrame(rows, schema) if isinstance(rows, list) else rows
        df.coalesce(1).write.parquet(f"{src}/p{k}")
        os.utime(next(os.path.join(f"{src}/p{k}", f) for f in os.listdir(f"{src}/p{k}") if f.endswith(".parquet")), (k + 1, k + 1))
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(src)


def run(df, name):
    q = df.writeStream.outputMode("append").option(
        "checkpointLocation", S.checkpoint_path(df.sparkSession, name + str(os.getpid()))).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def found(df):
    return sorted((r["artifact_id"], r["line_number"], r["text"]) for r in df.collect())


def test_live_tracebacks_equal_batch_for_all_class_strings(spark, tmp_path):
    logs = [s for n in range(1, 6) for s in itertools.product("SCBFE", repeat=n)] + [tuple("ETFSFE"), tuple("TSFEBCSFE")]
    rows = [(i, j + 1, ATOMS[c]) for i, s in enumerate(logs) for j, c in enumerate(s)]
    # Each log is cut at a place of its own; its end comes with a later part.
    cut = [(r[0] * 7) % (len(logs[r[0]]) + 1) for r in rows]
    parts = [[r for r, c in zip(rows, cut) if r[1] <= c], [r for r, c in zip(rows, cut) if r[1] > c],
             [(i, 99, None) for i in range(len(logs))]]
    got = run(L.live_tracebacks(stream_of(spark, parts, str(tmp_path / "in")), rules=()), "tb_classes")
    want = python_tracebacks(spark.createDataFrame(rows, LINES), rules=())
    assert not got.filter("late").count()
    assert found(got) == found(want) and len(found(want)) > 1000


def test_live_tracebacks_line_by_line_with_noise_and_long_snippets(spark, tmp_path):
    text = [C.TB_HEADER, "  f" * 60, "", "", C.TB_CHAIN[1], "", C.TB_HEADER, "  g", "KeyError: 1  ", "x", C.TB_HEADER, " h", "V: 2"]
    parts = [[(1, n + 1, t)] for n, t in enumerate(text)] + [[(1, 2, "behind"), (2, 1, None), (1, 50, None)]]
    rules = [("kind", "(?s).*V: 2", None)]
    got = run(L.live_tracebacks(stream_of(spark, parts, str(tmp_path / "in")), 120, rules), "tb_steps")
    want = python_tracebacks(spark.createDataFrame([p[0] for p in parts[:-1]], LINES), 120, rules)
    assert found(got.filter("not late")) == found(want) and len(found(want)) == 1
    assert found(got.filter("late")) == [(1, 2, "behind")]


def test_quiet_logs_close_by_watermark(spark, tmp_path):
    schema = "artifact_id long, line_no long, line string, at timestamp"
    at = lambda m: __import__("datetime").datetime(2024, 5, 1, 12, m)
    parts = [[(1, 1, C.TB_HEADER, at(0)), (1, 2, "  f", at(0)), (2, 1, C.TB_HEADER, at(0))],
             [(1, 3, "E: 1", at(2))], [(3, 1, "later", at(30))], [(3, 2, "later", at(31))]]
    st = stream_of(spark, parts, str(tmp_path / "in"), schema).withWatermark("at", "1 minute")
    got = run(L.live_tracebacks(st, rules=(), event_time="at", quiet=60_000), "tb_quiet")
    assert found(got) == [(1, 1, f"{C.TB_HEADER}\n  f\nE: 1"), (2, 1, C.TB_HEADER)]


def test_live_templates_equal_batch(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    rows = [(log, i + 1, f"{words[(i * i + log) % (2 + log)]} step {i}") for log in (1, 2, 4) for i in range(40)]
    lines = spark.createDataFrame(rows, LINES)
    messages = assemble_messages(lines, 100)
    want = representative_snippets(mine_templates(messages), 2)
    # Messages in any order over micro-batches; a log without messages; one that never ends.
    parts = [messages.filter(F.col("line_number") % 3 == r) for r in (2, 0, 1)]
    ends = [(log, 99, None) for log in (1, 2, 4, 7)] + [(8, 1, "open log")]
    schema = "artifact_id long, line_number long, text string"
    got = run(L.live_templates(stream_of(spark, [*parts, ends], str(tmp_path / "in"), schema), 2), "tpl")
    assert found(got) == found(want) and len(found(want)) == 6
    total = {r["artifact_id"]: r["n"] for r in got.groupBy("artifact_id").agg(F.sum("n").alias("n")).collect()}
    assert total[1] == 40


def test_messages_and_templates_in_a_row(spark, tmp_path):
    rows = [(log, i + 1, t) for log in (1, 2) for i, t in enumerate(["make all 1", "  more", "make all 2", "", "link x", "|tail"])]
    lines = spark.createDataFrame(rows, LINES)
    parts = [[r for r in rows if r[1] <= 3], [r for r in rows if r[1] > 3] + [(1, 10, None), (2, 10, None)]]
    told = run(S.live_messages(stream_of(spark, parts, str(tmp_path / "in")), 100, mark_end=True), "msg_ends").filter("not late")
    assert told.filter("text is null").count() == 2
    schema = "artifact_id long, line_number long, text string"
    second = stream_of(spark, [told.select("artifact_id", "line_number", "text")], str(tmp_path / "second"), schema)
    got = run(L.live_templates(second, 8), "tpl_row")
    assert found(got) == found(representative_snippets(mine_templates(assemble_messages(lines, 100)), 8))

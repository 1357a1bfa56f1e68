"""Streaming operators: stream result equals the batch operator (closed windows / ended logs)."""

import datetime as dt
import os

from pyspark.sql import functions as F

from logsift.operators.corpus import annotated_builds, annotated_snippets
from logsift.operators.lines import assemble_messages, split_lines
from logsift.plans.views import request_metrics
from logsift.streaming import ops as S

SMOKE = "/root/testdata/sf0.001"


def run_stream(df, name, foreach=None, mode="append"):
    w = df.writeStream.outputMode(mode).option(
        "checkpointLocation", S.checkpoint_path(df.sparkSession, name + str(os.getpid())))
    q = w.foreachBatch(foreach).start() if foreach else w.format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
        # One more pass lets the advanced watermark close windows / expire state.
        q.processAllAvailable()
    finally:
        q.stop()
    return None if foreach else df.sparkSession.table(name)


def test_metrics_windows_equal_batch(spark, tmp_path):
    rm = request_metrics(spark.read.parquet(f"{SMOKE}/events.parquet"))
    src = str(tmp_path / "rm")
    rm.filter(F.col("id") % 2 == 0).write.parquet(src + "/a")
    rm.filter(F.col("id") % 2 == 1).write.parquet(src + "/b")
    stream = spark.readStream.schema(rm.schema).option("recursiveFileLookup", "true").parquet(src)
    got = run_stream(S.metrics_windows(stream, "1 day", "2 hours"), "s1")
    batch = S.metrics_windows(rm, "1 day", "2 hours")
    max_ts = rm.agg(F.max("request_received_at")).first()[0]
    closed = batch.filter(F.col("bucket") + F.expr("interval 1 day") <= F.lit(max_ts - dt.timedelta(hours=2)))
    norm = lambda d: sorted((r["bucket"], r["endpoint"], r["requests"], round(r["avg_response_time"], 6),
                             None if r["avg_response_length"] is None else round(r["avg_response_length"], 6))
                            for r in d.collect())
    g = norm(got)
    assert g and set(norm(closed)) <= set(g) and set(g) <= set(norm(batch))


def test_pair_requests(spark, tmp_path):
    rm = request_metrics(spark.read.parquet(f"{SMOKE}/events.parquet"))
    req = rm.select("id", "endpoint", "request_received_at")
    resp = rm.filter(F.col("response_sent_at").isNotNull()).select("id", "response_sent_at", "response_length")
    req.write.parquet(str(tmp_path / "req"))
    resp.write.parquet(str(tmp_path / "resp"))
    rs = spark.readStream.schema(req.schema).parquet(str(tmp_path / "req"))
    ss = spark.readStream.schema(resp.schema).parquet(str(tmp_path / "resp"))
    got = run_stream(S.pair_requests(rs, ss), "s2")
    matched = {r["id"]: r["response_length"] for r in got.filter(F.col("response_sent_at").isNotNull()).collect()}
    want = {r["id"]: r["response_length"] for r in resp.collect()}
    assert matched == want
    # Requests without a response come out with nulls once the watermark has passed their time.
    last = rm.agg(F.max("request_received_at")).first()[0]
    settled = {r["id"] for r in rm.filter(F.col("response_sent_at").isNull()
                                          & (F.col("request_received_at") < F.lit(last - dt.timedelta(hours=1)))).collect()}
    empty = {r["id"] for r in got.filter(F.col("response_sent_at").isNull()).collect()}
    assert settled and settled <= empty and not empty & set(want)


def test_collapse_bursts(spark, tmp_path):
    base = dt.datetime(2024, 5, 1, 12, 0)
    rows = [("f", 1, 7, base + dt.timedelta(seconds=s)) for s in (0, 10, 20)] + \
           [("f", 1, 8, base + dt.timedelta(seconds=5))]
    df = spark.createDataFrame(rows, "forge string, project_id long, mr_iid long, ts timestamp")
    df.write.parquet(str(tmp_path / "ev"))
    st = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))
    got = run_stream(S.collapse_bursts(st), "s3")
    assert sorted(r["mr_iid"] for r in got.collect()) == [7, 8]


def test_live_messages_equal_batch(spark, tmp_path):
    text = "\n".join(["Build start", "  detail a", "  detail b", "|table", "Second message", "",
                      "Third " + "y" * 150, "   tail"])
    lines = split_lines(spark.createDataFrame([(1, text)], "artifact_id long, text string"))
    src = str(tmp_path / "lines")
    lines.filter(F.col("line_no") <= 4).write.parquet(src + "/p1")
    eof = spark.createDataFrame([(1, 10_000, None)], "artifact_id long, line_no long, line string")
    lines.filter(F.col("line_no") > 4).unionByName(eof).write.parquet(src + "/p2")
    st = spark.readStream.schema(lines.schema).option("recursiveFileLookup", "true") \
        .option("maxFilesPerTrigger", 1).parquet(src)
    got = run_stream(S.live_messages(st, 100), "s6")
    want = assemble_messages(lines, 100)
    key = lambda d: sorted((r["line_number"], r["text"]) for r in d.collect())
    assert key(got) == key(want) and not got.filter("late").count()


def test_live_messages_mark_late_lines(spark, tmp_path):
    src = str(tmp_path / "lines")
    schema = "artifact_id long, line_no long, line string"
    for k, rows in enumerate(([(1, 1, "one"), (1, 4, " four")], [(1, 2, "two"), (1, 5, "five"), (1, 9, None)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/p{k}")
    st = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(src)
    got = sorted((r["line_number"], r["text"], r["late"]) for r in run_stream(S.live_messages(st, 100), "s6late").collect())
    assert got == [(1, "one\n four", False), (2, "two", True), (5, "five", False)]


SNAPSHOTS = "comment_id long, snapshot_time timestamp, reactions array<struct<reaction_type string, cnt long>>"


def test_reaction_sync_sink(spark, tmp_path):
    root = str(tmp_path / "reactions")
    sink = S.reaction_sync_sink(root)
    t = lambda h: dt.datetime(2024, 5, 1, h)
    table = lambda: sorted(map(tuple, S.read_reactions(spark, root).collect()))
    sink(spark.createDataFrame([(1, t(1), [("up", 2), ("heart", 1)]), (1, t(2), [("up", 3)]), (2, t(1), [("down", 1)]),
                                (3, t(1), [("up", 1)])], SNAPSHOTS), 0)
    assert table() == [(1, "up", 3), (2, "down", 1), (3, "up", 1)]  # the newer snapshot counts as a whole
    second = spark.createDataFrame([(1, t(3), [("heart", 1)]), (2, t(3), [])], SNAPSHOTS)
    for _ in range(2):  # a replay of the same batch
        sink(second, 1)
        assert table() == [(1, "heart", 1), (3, "up", 1)]
    sink(spark.createDataFrame([(3, t(4), None)], SNAPSHOTS), 2)
    sink(spark.createDataFrame([], SNAPSHOTS), 3)
    assert table() == [(1, "heart", 1)]


def test_reaction_batch_stopped_before_its_manifest(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "reactions")
    sink = S.reaction_sync_sink(root)
    at = dt.datetime(2024, 5, 1)
    sink(spark.createDataFrame([(1, at, [("up", 1)])], SNAPSHOTS), 0)
    change = spark.createDataFrame([(1, at, [("down", 5)])], SNAPSHOTS)
    with monkeypatch.context() as m:
        m.setattr(S.batches, "publish", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with __import__("pytest").raises(OSError):
            sink(change, 1)
    assert sorted(map(tuple, S.read_reactions(spark, root).collect())) == [(1, "up", 1)]
    sink(change, 1)
    assert sorted(map(tuple, S.read_reactions(spark, root).collect())) == [(1, "down", 5)]


def test_contribution_ingest_stream(spark, tmp_path):
    import json
    src = tmp_path / "in" / "results" / "results"
    src.mkdir(parents=True)
    good = {"fail_reason": "r", "how_to_fix": "f", "logs": {"b.log": {"snippets": [{"text": "t", "user_comment": "c"}]}}}
    for name in ("a.json", "b.json"):
        (src / name).write_text(json.dumps(good))
    (src / "bad.json").write_text("{nope")
    root = str(tmp_path / "corpus")
    raw = spark.readStream.option("wholetext", "true").option("recursiveFileLookup", "true") \
        .option("pathGlobFilter", "*.json").text(str(tmp_path / "in")) \
        .select(F.regexp_extract(F.col("_metadata.file_path"), "(results/results/.*)$", 1).alias("source_path"),
                F.col("value").alias("raw"))
    run_stream(raw, "s5", foreach=S.contribution_ingest_sink(root))
    run_stream(raw, "s5b", foreach=S.contribution_ingest_sink(root))  # a second run over the same files
    got = sorted(r["source_path"] for r in annotated_builds(spark, root).collect())
    assert got == ["results/results/a.json", "results/results/b.json"]
    snippets = annotated_snippets(spark, root)
    assert snippets.count() == 2 and snippets.filter(F.size("text_embedding") == 384).count() == 2

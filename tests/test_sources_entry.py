"""Sources (log files, requests, tables), options, and the driver contract."""

import os

import pytest
from pyspark.sql import functions as F

from logsift.options import ExtractorOptions
from logsift.operators.extract import extract_all
from logsift.sources.logs import read_logs, read_table, with_day, write_table
from logsift.sources.requests import explode_requests, validate_artifacts


def test_read_logs_size_and_decode(spark, tmp_path):
    d = tmp_path / "logs"
    d.mkdir()
    (d / "build.log").write_bytes(b"line one\nbad byte \xff here\n")
    (d / "huge.log").write_bytes(b"x" * 5000)
    ok, rejects = read_logs(spark, str(d), max_bytes=1000, glob="*.log")
    got = ok.collect()
    assert [r["artifact_name"] for r in got] == ["build.log"]
    assert "�" in got[0]["text"]
    assert [r["path"].endswith("huge.log") for r in rejects.collect()] == [True]


def test_explode_and_validate_requests(spark):
    req = spark.createDataFrame([
        ("r1", [("build.log", "text", None), ("root.log", None, "https://x/root.log")]),
        ("r2", [("a b", "t", None), ("a b", "t", "https://x"), ("bad*name", "t", None)]),
        ("r3", [(f"f{i}.log", "t", None) for i in range(16)]),
    ], "request_id string, files array<struct<name:string,content:string,url:string>>")
    a = explode_requests(req)
    assert a.filter(F.col("request_id") == "r1").orderBy("pos").select("artifact_name").collect()[1][0] == "root.log"
    v = {(r["request_id"], r["pos"], r["violation"]) for r in validate_artifacts(a).collect()}
    assert ("r2", 1, "content_xor_url") in v and ("r2", 2, "bad_name") in v
    assert ("r2", 0, "duplicate_name") in v and ("r2", 1, "duplicate_name") in v
    assert {x for x in v if x[0] == "r3"} == {("r3", i, "file_count") for i in range(16)}
    assert not [x for x in v if x[0] == "r1"]


def test_tables_partitioned_by_day(spark, tmp_path):
    import datetime as dt
    df = spark.createDataFrame([(1, dt.datetime(2024, 5, 1, 3)), (2, dt.datetime(2024, 5, 2, 3))],
                               "id long, request_received_at timestamp")
    write_table(with_day(df), str(tmp_path), "metrics", "overwrite", ["day"])
    assert {"day=2024-05-01", "day=2024-05-02"} <= set(os.listdir(tmp_path / "metrics"))
    back = read_table(spark, str(tmp_path), "metrics").filter(F.col("day") == "2024-05-02")
    assert [r["id"] for r in back.collect()] == [2]


def test_options_and_extract_all(spark):
    with pytest.raises(ValueError):
        ExtractorOptions(max_snippet_len=50)
    opts = ExtractorOptions(max_clusters=2, compiler_errors=True, python_traceback=True)
    text = "\n".join(["a.c:3:1: error: nope", "   3 | x", "Traceback (most recent call last):",
                      "  File \"x.py\", line 1, in <module>", "ValueError: v", "plain"])
    lines = spark.createDataFrame([(1, text)], "artifact_id long, text string")
    from logsift.operators.lines import split_lines
    out = extract_all(split_lines(lines), opts.extractors())
    by = {}
    for r in out.collect():
        by.setdefault(r["extractor"], []).append(r["line_number"])
    assert by["csgrep"] == [1] and by["python_traceback"] == [3] and len(by["drain"]) == 2


def test_entry_contract(spark):
    import __spark_entry__ as E
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    df = E.entry(spark)
    assert df.columns == ["artifact_id", "line_number", "text"]
    assert df.count() > 0


def test_cluster_conf_sizing():
    from logsift.session import cluster_conf
    c = cluster_conf(100 * 1024 ** 4, executors=1000)  # 100 TiB on 1000 executors
    assert int(c["spark.sql.shuffle.partitions"]) == 100 * 1024 ** 4 // (256 << 20)
    small = cluster_conf(1 << 30, executors=10)
    assert int(small["spark.sql.shuffle.partitions"]) == 80  # 2 x cores floor
    assert small["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_extract_fused_equals_separate(spark):
    from logsift.operators.extract import extract_fused
    from logsift.operators.lines import split_lines
    from logsift.queries.mining import EXTRACTORS
    import random
    rnd = random.Random(4)
    pieces = ["Traceback (most recent call last):", "  File \"a.py\", line 1, in f", "ValueError: x", "",
              "a.c:3:1: error: nope", "   3 | x", "      ^", "took 12 ms", "|row", "INFO: x", "plain text"]
    logs = ["\n".join(rnd.choice(pieces) for _ in range(rnd.randint(3, 40))) for _ in range(30)]
    lines = split_lines(spark.createDataFrame(list(enumerate(logs)), "artifact_id long, text string"))
    lines = lines.withColumn("source_file", F.when(F.col("artifact_id") % 3 == 0, F.lit("mock_output.log"))
                             .otherwise(F.lit("build.log")))
    sep = extract_all(lines.drop("source_file"), EXTRACTORS)
    fused = extract_fused(lines, keep=("source_file",), source_file="source_file")
    assert sorted(map(tuple, sep.collect())) == sorted(map(tuple, fused.collect()))

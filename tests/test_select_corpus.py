"""Failed-log selection, contributions, corpus ingest and nearest neighbours."""

import datetime as dt
import json
import os

import pytest

from logsift.operators import corpus as K
from logsift.operators import select as S
from logsift.sources.batches import read_batches
from logsift.sources.contributions import archive_date, parse_contributions, read_contributions


def test_select_failed_log(spark):
    files = spark.createDataFrame([
        (1, 0, "kojilogs/noarch-1/task_failed.log", "top level"),
        (1, 1, "kojilogs/noarch-1/aarch64-2/task_failed.log", "see build.log for more information"),
        (1, 2, "kojilogs/noarch-1/x86_64-3/task_failed.log", "see build.log or root.log for more"),
        (2, 0, "kojilogs/noarch-9/task_failed.log", "top"),
        (3, 0, "kojilogs/noarch-5/zz80-1/task_failed.log", "nothing named"),
        (3, 1, "kojilogs/noarch-5/mips-1/task_failed.log", "see root.log"),
        (4, 0, "kojilogs/noarch-5/x86_64-1/build.log", "not a failure file"),
    ], "job_id long, pos long, path string, content string")
    chosen, missing = S.select_failed_log(files)
    got = {r["job_id"]: (r["arch"], r["log_path"]) for r in chosen.collect()}
    assert got[1] == ("x86_64", "kojilogs/noarch-1/x86_64-3/build.log")
    assert got[2] == ("~toplevel", "kojilogs/noarch-9/task_failed.log")
    assert got[3] == ("mips", "kojilogs/noarch-5/mips-1/root.log")
    assert [r["job_id"] for r in missing.collect()] == [4]


def test_select_failed_subtask(spark):
    tasks = spark.createDataFrame([
        (100, None, "build", "FAILED", "noarch"), (101, 100, "buildArch", "FAILED", "s390x"),
        (102, 100, "buildArch", "FAILED", "x86_64"), (103, 100, "buildArch", "CLOSED", "aarch64"),
        (200, None, "build", "CANCELED", "noarch"), (201, 200, "buildArch", "FAILED", "zarch"),
        (202, 200, "buildArch", "FAILED", "armv7"), (300, None, "build", "CLOSED", "noarch"),
        (400, None, "buildArch", "FAILED", "ppc64le"), (500, None, "build", "FAILED", "noarch"),
    ], "task_id long, parent_id long, method string, state string, arch string")
    req = spark.createDataFrame([(100,), (200,), (300,), (400,), (500,), (999,)], "task_id long")
    chosen, rejects = S.select_failed_subtask(tasks, req)
    got = {r["task_id"]: r["subtask_id"] for r in chosen.collect()}
    assert got == {100: 102, 200: 202, 400: 400}
    assert {r["task_id"]: r["reason"] for r in rejects.collect()} == {
        300: "primary task not failed", 500: "no failed subtask", 999: "task does not exist"}


def test_failed_log_of_task(spark):
    faults = spark.createDataFrame([(1, "see build.log for details"), (2, "no log here"), (3, "see root.log"),
                                    (4, "see build.log")], "task_id long, fault string")
    outs = spark.createDataFrame([(1, "build.log", 10), (3, "build.log", 5), (4, "build.log", 10**9)],
                                 "task_id long, name string, size long")
    rows = S.failed_log_of_task(faults, outs, 1000).collect()
    assert {r["task_id"]: r["log_text"] for r in rows if r["log_text"]} == {2: "no log here"}
    got = {r["task_id"]: (r["log_name"], r["status"]) for r in rows}
    assert got == {1: ("build.log", "ok"), 2: ("task_failed.log", "fault_text"), 3: ("root.log", "missing"),
                   4: ("build.log", "too_large")}


def test_fixed_later(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    builds = spark.createDataFrame([
        (1, 7, "FAILED", t(2), "1.2", "1", "build"), (2, 7, "COMPLETE", t(3), "1.2", "1", "build"),
        (3, 7, "COMPLETE", t(4), "1.10", "1", "build"), (4, 7, "COMPLETE", t(5), "1.3", "1", "build"),
        (5, 8, "FAILED", t(2), "2.0", "3", "build"), (6, 8, "COMPLETE", t(1), "3.0", "1", "build"),
    ], "build_id long, package_id long, state string, completion_time timestamp, version string, "
       "release string, method string")
    got = {r["build_id"]: r["newer_build_id"] for r in S.fixed_later(builds, "2023-12-31", 200).collect()}
    assert got == {1: 3, 5: None}


CONTRIBS = {
    "results/results/a.json": {"fail_reason": "r", "how_to_fix": "f", "logs": {"build.log": {"snippets": [
        {"text": "t1", "user_comment": "c1"}, {"text": "t2"}, 5, {"text": "t3", "user_comment": "c3"}]}}},
    "results/results/b.json": {"fail_reason": {"text": "foo"}, "how_to_fix": "f", "logs": {}},
    "results/results/c.json": {"fail_reason": "r", "how_to_fix": "f", "logs": {"x": "junk"}},
    "results/results/d.json": ["not", "an", "object"],
    "results/results/e.json": {"fail_reason": "r", "how_to_fix": "", "logs": {"x": {"snippets": []}}},
    "results/other/f.json": {"fail_reason": "r", "how_to_fix": "f", "logs": {"x": {"snippets": [
        {"text": "t", "user_comment": "c"}]}}},
}


def _write_tree(root):
    for rel, obj in CONTRIBS.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w") as fh:
            json.dump(obj, fh)
    with open(os.path.join(root, "results/results/broken.json"), "w") as fh:
        fh.write("{not json")


def test_contributions(spark, tmp_path):
    _write_tree(str(tmp_path))
    raw = read_contributions(spark, str(tmp_path))
    assert sorted(r["source_path"] for r in raw.collect()) == sorted(
        [k for k in CONTRIBS if k.startswith("results/results/")] + ["results/results/broken.json"])
    builds, rejects = parse_contributions(raw)
    b = builds.collect()
    assert [r["source_path"] for r in b] == ["results/results/a.json"]
    assert [(s["text"], s["user_comment"]) for s in b[0]["snippets"]] == [("t1", "c1"), ("t3", "c3")]
    reasons = {r["source_path"].split("/")[-1]: r["reason"] for r in rejects.collect()}
    assert reasons == {"b.json": "bad fail_reason", "c.json": "no valid snippets found", "d.json": "not an object",
                       "e.json": "bad how_to_fix", "broken.json": "malformed json"}


def test_insert_new_builds_and_report(spark, tmp_path):
    snip = "array<struct<log_name:string,text:string,user_comment:string>>"
    batch = spark.createDataFrame([
        (1, "p1", "r", "f", [("l", "t", "c")]), (2, "p2", "r", "f", [("l", "t", "c"), ("l", "u", "d")]),
        (3, "p1", "r2", "f2", [("l", "x", "y")]), (4, "p0", "r", "f", [("l", "t", "c")]),
    ], f"seq long, source_path string, fail_reason string, how_to_fix string, snippets {snip}")
    existing = spark.createDataFrame([("p0",)], "source_path string")
    builds, snippets = K.insert_new_builds(existing, batch)
    assert sorted((r["source_path"], r["seq"]) for r in builds.collect()) == [("p1", 1), ("p2", 2)]
    assert snippets.count() == 3
    rep = K.run_report(batch, builds).first()
    assert (rep["processed"], rep["added"], rep["snippets"], rep["skipped"]) == (4, 2, 3, 2)
    root = str(tmp_path / "ann")
    new = K.new_annotations(existing, batch)
    planned = K.write_annotations(new, root, 1, dry_run=True).first()
    assert (planned["builds"], planned["snippets"]) == (2, 3) and not os.path.exists(root)
    for reset in (False, True, False):  # the same batch again replaces itself
        K.write_annotations(new, root, 1, reset=reset)
        assert K.annotated_builds(spark, root).count() == 2 and K.annotated_snippets(spark, root).count() == 3


def test_sync_annotations_bootstrap_then_delta(spark, tmp_path):
    snip = "array<struct<log_name:string,text:string,user_comment:string>>"
    schema = f"seq long, source_path string, fail_reason string, how_to_fix string, snippets {snip}"
    full = spark.createDataFrame([(1, "p1", "r", "f", [("l", "t", "c")])], schema)
    delta = spark.createDataFrame([(2, "p2", "r", "f", [("l", "t", "c")]), (3, "p1", "r", "f", [("l", "t", "c")])], schema)
    root = str(tmp_path / "corpus")
    r1 = K.sync_annotations(spark, root, full, delta, None, dt.date(2024, 5, 1)).first()
    assert (r1["processed"], r1["added"]) == (3, 2)
    r2 = K.sync_annotations(spark, root, full, delta, dt.date(2024, 5, 1), dt.date(2024, 5, 2)).first()
    assert (r2["processed"], r2["added"]) == (2, 0)
    upd = read_batches(spark, root + "/annotation_updates", K.UPDATES)
    s = K.update_log_summary(upd).first()
    assert s["total_files"] == 5 and s["latest_archive"] == dt.date(2024, 5, 2)
    empty = K.update_log_summary(spark.createDataFrame([], "id long, file_count int, archive_date date")).first()
    assert empty["total_files"] == 0 and empty["latest_archive"] is None


def test_sync_stopped_between_writes_is_made_good(spark, tmp_path, monkeypatch):
    snip = "array<struct<log_name:string,text:string,user_comment:string>>"
    schema = f"seq long, source_path string, fail_reason string, how_to_fix string, snippets {snip}"
    delta = spark.createDataFrame([(1, "p1", "r", "f", [("l", "linker failed on x", "c"), ("l", "disk is full", "d")])], schema)
    root, day = str(tmp_path / "corpus"), dt.date(2024, 5, 1)
    whole = K.publish
    with monkeypatch.context() as m:
        m.setattr(K, "publish", lambda df, path, n: whole(df, path, n) if "updates" not in path else (_ for _ in ()).throw(OSError()))
        with pytest.raises(OSError):
            K.sync_annotations(spark, root, None, delta, None, day)
    report = K.sync_annotations(spark, root, None, delta, None, day).first()
    assert (report["processed"], report["added"], report["snippets"]) == (1, 1, 2)
    found = K.annotated_snippets(spark, root)
    assert found.count() == 2 and K.annotated_builds(spark, root).count() == 1
    query = K.embed(spark.createDataFrame([(1, "the disk is full")], "query_id long, text string"))
    best = K.nearest_snippets(query, found, 1).join(found, "id").first()
    assert best["annotation"] == "d"
    with pytest.raises(ValueError):
        K.sync_annotations(spark, root, None, delta, day, day, today=dt.date(2025, 1, 1))


def test_sync_of_raw_contributions(spark, tmp_path):
    _write_tree(str(tmp_path / "in"))
    raw = read_contributions(spark, str(tmp_path / "in"))
    report = K.sync_annotations(spark, str(tmp_path / "out"), raw, raw.limit(0), None, dt.date(2024, 5, 1)).first()
    assert (report["added"], report["snippets"]) == (1, 2)


def test_version_order(spark):
    rising = ["", "1.0~rc1", "1.0~rc2", "1.0", "1.0^git1", "1.0a", "1.0b", "1.0.0", "1.0.1", "1.2", "1.10", "2a", "2.0",
              "10", "1" + "0" * 30]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rising)] + [(99, "0001.02"), (98, None)], "i long, v string")
    got = [r["i"] for r in df.filter("i < 90").withColumn("k", S.version_key(df["v"])).orderBy("k").collect()]
    assert got == list(range(len(rising)))
    same = df.withColumn("k", S.version_key(df["v"]))
    key = {r["i"]: r["k"] for r in same.collect()}
    assert key[99] == key[9] and key[98] == key[0]


def test_analysis_stays_in_its_request(spark):
    from logsift.operators.extract import attach_analysis
    snippets = spark.createDataFrame([(1, "build.log", 12), (2, "build.log", 12), (2, "root.log", 3)],
                                     "request_id long, source_file string, line_number long")
    analyses = spark.createDataFrame([(1, 1, "build.log", 12, "a"), (2, 2, "build.log", 12, "b"), (3, 2, "build.log", 12, "c"),
                                      (4, 1, "root.log", 3, "d"), (5, 2, "root.log", 4, "e")],
                                     "analysis_id long, request_id long, source_file string, line_number long, snippet_analysis string")
    done, rejects = attach_analysis(snippets, analyses)
    assert sorted((r["request_id"], r["source_file"], r["snippet_analysis"]) for r in done.collect()) == [
        (1, "build.log", "a"), (2, "build.log", "b"), (2, "root.log", None)]
    assert {r["analysis_id"]: r["reason"] for r in rejects.collect()} == {3: "already_analyzed", 4: "unknown_file", 5: "unknown_line"}


def test_archive_date(spark):
    d = spark.createDataFrame([("results-2024-05-01.tar.gz",), ("results-since-2024-04-30.tar.gz",), ("x.tgz",)],
                              "n string")
    assert [r[0] for r in d.select(archive_date("n")).collect()] == [dt.date(2024, 5, 1), dt.date(2024, 4, 30), None]


def test_nearest(spark):
    import numpy as np
    rnd = np.random.default_rng(1)
    corpus = [(i, rnd.normal(size=8).astype(float).tolist()) for i in range(200)]
    queries = [(1000 + i, rnd.normal(size=8).astype(float).tolist(), "text" if i else "  ") for i in range(20)]
    c = spark.createDataFrame(corpus, "id long, text_embedding array<float>").repartition(5)
    q = spark.createDataFrame(queries, "query_id long, text_embedding array<float>, text string")
    got = K.nearest_snippets(q, c, 3, text_col="text").collect()
    cm = np.array([np.float32(v) for _, v in corpus], dtype=np.float64)
    for qid, v, _ in queries[1:]:
        d = np.sqrt(((cm - np.array(v, dtype=np.float32).astype(np.float64)) ** 2).sum(1))
        want = [int(i) for i in np.lexsort((np.arange(200), d))[:3]]
        assert [r["id"] for r in sorted((r for r in got if r["query_id"] == qid), key=lambda r: r["rank"])] == want
    assert not [r for r in got if r["query_id"] == 1000]  # blank query -> no rows
    approx = K.nearest_snippets_approx(q, c, 3, probes=6)
    assert approx.groupBy("query_id").count().filter("count = 3").count() == 20
    told = K.probe_quality(q, c, 3, probes=6).first()
    assert told["recall"] >= 0.8 and told["candidate_share"] < 0.7 and told["wanted"] == 60
    copies = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(500)] + [(900, [0.0, 1.0])], "id long, text_embedding array<float>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, text_embedding array<float>")
    assert [r["id"] for r in K.nearest_snippets(one, copies, 3).orderBy("rank").collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        K.nearest_snippets(q, c, 4)


def test_model_calls_take_whole_builds(spark):
    """No call gets over ``most`` texts unless one build has more, and no build is split over calls."""
    sizes = [3, 7, 1, 70, 2, 30, 31, 64, 5, 1, 1]
    rows = [(None if b == 4 else f"build{b}", f"{b}:{i}") for i in range(70) for b, n in enumerate(sizes) if i < n]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        def model(texts):  # tells the size of its call, and the call by its least text
            return [[float(len(texts)), float(sum(map(hash_of, texts)))] for _ in texts]

        def hash_of(text):
            return sum(ord(c) * 31 ** (i % 5) for i, c in enumerate(text)) % 10_007
        df = spark.createDataFrame(rows, "source_path string, text string").repartition(5, "text")
        got = K.embed(df, "text", model=model, whole=("source_path",)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert sorted((r.source_path or "", r.text) for r in got) == sorted((s or "", t) for s, t in rows)
    calls = {}
    for r in got:
        calls.setdefault(tuple(r.text_embedding), []).append(r.source_path)
    for (n, _), paths in calls.items():
        assert len(paths) % n == 0
        assert n <= 64 or len(set(paths)) == 1
    for path in {r.source_path for r in got}:
        assert len({tuple(r.text_embedding) for r in got if r.source_path == path}) == 1

"""Compiler diagnostics and defect reports."""

import json

import pytest
from pyspark.sql import functions as F

from logsift.operators.diagnostics import compiler_errors, read_diagnostic_reports, report_snippets

from helpers import lines_df

CARET_LOG = "\n".join([
    "/src/lib/Handler.h:45:49: error: expected expression before token [-Wtemplate-body]",
    "   45 |   static_assert(check<S>::value);",
    "      |                 ^",
    "next step",
])
LINKER_LOG = "\n".join([
    "/usr/bin/ld: obj.c:835:(.text+0x6003): undefined reference to `kernel'",
    "collect2: error: ld returned 1 exit status",
    "[234/235] g++ -o out main.o",
])


def diag(spark, text):
    return sorted((r["line_number"], r["text"], r["file_name"]) for r in compiler_errors(lines_df(spark, text)).collect())


def test_caret_lines_joined(spark):
    got = diag(spark, CARET_LOG)
    assert got == [(1, "expected expression before token\n   45 |   static_assert(check<S>::value);\n"
                       "      |                 ^", "/src/lib/Handler.h")]


def test_linker_message_line(spark):
    assert diag(spark, LINKER_LOG) == [(2, "ld returned 1 exit status", "collect2")]


def test_duplicates_removed(spark):
    log = "\n".join(["a.c:1:2: error: bad", "x", "a.c:1:2: error: bad"])
    assert [n for n, _, _ in diag(spark, log)] == [1]


def _report(defects):
    return json.dumps({"defects": defects})


def _ev(line, msg, input_line):
    return {"file_name": "t.c", "line": line, "event": "error", "message": msg, "input_file": "x.log",
            "input_line": input_line, "verbosity_level": 0}


def test_report_snippets(spark):
    rep = _report([
        {"checker": "c", "language": "C", "tool": "gcc", "key_event_idx": 0, "events": [_ev(3, "file not found", 3)]},
        {"checker": "c", "language": "C++", "tool": "g++", "key_event_idx": 0,
         "events": [_ev(4, "permission denied", 4)]},
        {"checker": "c", "language": "C", "tool": "gcc", "key_event_idx": 0, "events": []},
        {"checker": "c", "language": "C", "tool": "gcc", "key_event_idx": 0,
         "events": [_ev(1, "first", 1), _ev(0, "  second", 2)]},
    ])
    d = read_diagnostic_reports(spark.createDataFrame([(1, rep)], "artifact_id long, report string"), "report")
    got = sorted((r["line_number"], r["text"]) for r in report_snippets(d, ["artifact_id"], rules=()).collect())
    assert got == [(1, "first\n  second"), (3, "file not found"), (4, "permission denied")]


def test_malformed_report_fails(spark):
    d = spark.createDataFrame([(1, '{"defects": [{"checker": ')], "artifact_id long, report string")
    with pytest.raises(Exception):
        read_diagnostic_reports(d, "report").select(F.col("report.defects")).collect()

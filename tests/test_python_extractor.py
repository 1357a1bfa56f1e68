"""Extractors written in Python, fed line by line."""

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from logsift import constants as C
from logsift.operators.extract import extract_all, python_extractor
from logsift.operators.lines import assemble_messages, split_lines
from logsift.operators.templates import mine_templates, representative_snippets
from logsift.operators.tracebacks import TracebackFeed, python_tracebacks
from logsift.plans.views import log_lines

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test module


class Count:
    """Gives the number of lines, and fails where lines do not come one after the other."""

    def __init__(self):
        self.n = 0

    def feed(self, number, line):
        assert number == self.n + 1
        self.n = number
        return ()

    def close(self):
        return [(self.n, "lines")]


def rows(df):
    return sorted(map(tuple, df.select("artifact_id", "line_number", "text").collect()))


def test_line_by_line_equals_dataframe_form(spark):
    lines = log_lines(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    want = rows(python_tracebacks(lines, 1_000_000, rules=()))
    assert rows(python_extractor(TracebackFeed)(lines)) == want and len(want) > 20


def test_lines_come_in_order_and_logs_apart(spark):
    lines = spark.range(3000).select((F.col("id") % 7).alias("artifact_id"), (F.floor(F.col("id") / 7) + 1).alias("line_no"),
                                     F.lit("x").alias("line")).repartition(5, "line_no")
    got = rows(python_extractor(Count)(lines))
    assert got == sorted((a, sum(1 for i in range(3000) if i % 7 == a), "lines") for a in range(7))
    assert rows(python_extractor(Count)(lines.limit(0))) == []


def test_beside_the_built_in_extractors(spark):
    lines = split_lines(spark.createDataFrame([(1, "make\n  x\nlink"), (2, C.TB_HEADER + "\n  f\nE: 1")], "artifact_id long, text string"))
    drain = lambda d: representative_snippets(mine_templates(assemble_messages(d, 100)))
    got = extract_all(lines, {"drain": drain, "own": python_extractor(TracebackFeed)})
    assert [tuple(r) for r in got.filter("extractor = 'own'").collect()] == [(2, "own", 1, C.TB_HEADER + "\n  f\nE: 1")]
    assert got.filter("extractor = 'drain'").count() == 4

"""The blocked scans with tiny blocks: every boundary case (halo lag, per-block offsets, islands
spanning blocks) must give the same result as one block does."""

import random

import pytest

from logsift.operators.diagnostics import compiler_errors
from logsift.operators.lines import assemble_messages, split_lines
from logsift.operators.tracebacks import python_tracebacks
from logsift.plans import scan


def same_in_one_block(spark, logs, run):
    """Rows of ``run`` over the logs, which must not depend on the block size."""
    d = spark.createDataFrame(list(enumerate(logs)), "artifact_id long, text string")
    small = sorted(tuple(r) for r in run(split_lines(d)).collect())
    scan.LINE_BLOCK = 1 << 16
    assert small and small == sorted(tuple(r) for r in run(split_lines(d)).collect())


@pytest.fixture(params=[2, 3, 7])
def tiny_blocks(request, monkeypatch):
    monkeypatch.setattr(scan, "LINE_BLOCK", request.param)
    return request.param


def _logs(seed, pieces, n=40):
    rnd = random.Random(seed)
    return ["\n".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 30))) for _ in range(n)]


def test_chunks_across_blocks(spark, tiny_blocks):
    logs = _logs(11, ["msg", " cont", "|bar", "", "\tTab", "x" * 60, "word word word"])
    same_in_one_block(spark, logs, lambda lines: assemble_messages(lines, 100))


def test_tracebacks_across_blocks(spark, tiny_blocks):
    from logsift import constants as C
    logs = _logs(12, [C.TB_HEADER, C.TB_CHAIN[0], "", "  frame", "Err: x", "plain"])
    same_in_one_block(spark, logs, lambda lines: python_tracebacks(lines, rules=()))


def test_compiler_errors_across_blocks(spark, tiny_blocks):
    logs = _logs(13, ["a.c:1:2: error: bad", "   1 | x", "      ^", "other", "ld: error: y", ""])
    same_in_one_block(spark, logs, compiler_errors)


def test_islands_across_empty_blocks(spark, tiny_blocks):
    """A chain sentence and a continuation line go on above blocks of empty lines; a closed island does not."""
    from logsift import constants as C
    head = [C.TB_HEADER, "  frame", "Err: x"]
    logs = ["\n".join([*head, *[""] * 20, C.TB_CHAIN[0], "", *head]), "\n".join(["msg", *[""] * 20, " cont", "other", *[""] * 9, "|x"]),
            "\n".join([*head, *["plain"] * 20, "  f", *head])]
    same_in_one_block(spark, logs, lambda lines: python_tracebacks(lines, rules=()))
    scan.LINE_BLOCK = tiny_blocks
    same_in_one_block(spark, logs, lambda lines: assemble_messages(lines, 100))


def test_lines_are_dealt_out_once(spark):
    """One exchange of lines, then one of the pieces that matter."""
    lines = spark.createDataFrame([(1, 1, "x")], "artifact_id long, line_no long, line string")
    for run in (python_tracebacks, lambda d: assemble_messages(d, 100)):
        plan = run(lines)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2

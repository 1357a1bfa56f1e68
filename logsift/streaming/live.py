"""S6 — tracebacks and templates of logs that are still being written.

Both operators keep one keyed state per log in the state store (``transformWithStateInPandas``; the session
must use the RocksDB provider, see ``session.DEFAULT_CONF``), so state is not held in a worker's memory between
micro-batches. A row without text ends a log. With ``quiet`` a log also ends once the watermark of
``event_time`` passes its last event by that many milliseconds; nothing depends on arrival times. A micro-batch
brings at most what its source admits per trigger, and that is what one call holds of one log.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from logsift import constants as C
from logsift.functions.text import noise_predicate, truncate_middle
from logsift.operators.templates import mine_templates
from logsift.operators.tracebacks import RTRIM_RE, traceback_class


class _ClosingProcessor(StatefulProcessor):
    """A log's state with its closing timer: ``finish`` gives what a log still holds and clears it."""

    def __init__(self, quiet: int | None):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long")

    def _await_quiet(self, rows: list[pd.DataFrame], timers) -> None:
        """Moves the closing timer behind the newest event of these rows."""
        if self.quiet is None:
            return
        newest = max(int(r["at_ms"].max()) for r in rows) + self.quiet
        newest = max(newest, timers.getCurrentWatermarkInMs() + 1)
        if self.timer.exists():
            (before,) = self.timer.get()
            if before >= newest:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(newest)
        self.timer.update((newest,))

    def _drop_timer(self) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        yield from self.finish(key[0])

    def close(self) -> None:
        pass


TRACEBACK_OUT = "artifact_id long, line_number long, text string, late boolean"


class TracebackProcessor(_ClosingProcessor):
    """A finite-state machine over line classes: the class of the line before, and the open block.

    A block is held from its first exact header on; lines of blocks without one are never held."""

    def init(self, handle):
        super().init(handle)
        self.place = handle.getValueState("place", "last long, above string, header long")
        self.open = handle.getListState("open", "line string")

    def _rows(self, artifact_id, found, late=False) -> pd.DataFrame:
        return pd.DataFrame({"artifact_id": pd.Series([artifact_id] * len(found), dtype="int64"),
                             "line_number": pd.Series([n for n, _ in found], dtype="int64"),
                             "text": pd.Series([t for _, t in found], dtype="object"), "late": late})

    def handleInputRows(self, key, rows, timerValues):
        parts = list(rows)
        got = pd.concat(parts).sort_values("line_no", kind="stable")
        last, before, header = self.place.get() if self.place.exists() else (0, None, None)
        ended = bool(got["cls"].isna().any())
        got = got[got["cls"].notna()]
        behind = got["line_no"] <= last
        if behind.any():
            yield self._rows(key[0], list(zip(got["line_no"][behind], got["rt"][behind])), late=True)
        got = got[~behind].drop_duplicates("line_no")
        if len(got):
            cls = got["cls"].to_numpy(dtype=object)
            number, text, exact = got["line_no"].to_numpy(), got["rt"].to_numpy(dtype=object), got["exact"].to_numpy(dtype=bool)
            above = np.concatenate([[before], cls[:-1]])
            above[number != np.concatenate([[last], number[:-1]]) + 1] = None
            linked = np.isin(cls, ["S", "C"]) | np.isin(above, ["S", "C", "F"])
            shown = cls != "B"
            block = np.cumsum(shown & ~linked)
            done = []
            for b in ([0] if header is not None else []) + sorted(set(block[shown & exact]) - ({0} if header is not None else set())):
                mine = np.flatnonzero(shown & (block == b))
                if header is None:  # else the block was opened by an earlier micro-batch
                    mine = mine[mine >= mine[exact[mine]][0]]
                    header = int(number[mine[0]])
                if b == block[-1]:  # may go on
                    if len(mine):
                        self.open.appendList([(t,) for t in text[mine]])
                    break
                done.append((header, "\n".join([t for (t,) in self.open.get()] + list(text[mine]))))
                self.open.clear()
                header = None
            if done:
                yield self._rows(key[0], done)
            last, before = int(number[-1]), str(cls[-1])
        if ended:
            self.place.update((last, before, header))
            self._drop_timer()
            yield from self.finish(key[0])
        else:
            self.place.update((last, before, header))
            self._await_quiet(parts, timerValues)

    def finish(self, artifact_id):
        _, _, header = self.place.get()
        if header is not None:
            yield self._rows(artifact_id, [(header, "\n".join(t for (t,) in self.open.get()))])
        self.open.clear()
        self.place.clear()


def _run(stream: DataFrame, processor: _ClosingProcessor, out: str) -> DataFrame:
    return stream.groupBy("artifact_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="Append",
        timeMode="None" if processor.quiet is None else "EventTime")


def _at(event_time: str | None, quiet: int | None) -> list:
    if (event_time is None) != (quiet is None):
        raise ValueError("closing quiet logs needs both an event time and a wait")
    return [] if event_time is None else [event_time, F.unix_millis(F.col(event_time).cast("timestamp")).alias("at_ms")]


def live_tracebacks(lines: DataFrame, max_len: int = C.DEFAULT_SNIPPET_LEN, rules: Sequence = tuple(C.DEFAULT_NOISE_RULES),
                    event_time: str | None = None, quiet: int | None = None) -> DataFrame:
    """Tracebacks (same rule as ``python_tracebacks``) over a stream of ``(artifact_id, line_no, line)``:
    ``(artifact_id, line_number, text, late)``.

    Lines are classified before they are sent to the state. A snippet comes out when its block is over, or when its log
    ends (a null line, or ``quiet``). A line number given again in one micro-batch counts once. Lines that arrive after
    a later line of their log come back right-trimmed, marked ``late``. Logs without lines give nothing.
    """
    d = lines.select("artifact_id", "line_no", F.when(F.col("line").isNotNull(), traceback_class()).alias("cls"),
                     F.regexp_replace("line", RTRIM_RE, "").alias("rt"),
                     F.coalesce(F.col("line") == C.TB_HEADER, F.lit(False)).alias("exact"), *_at(event_time, quiet))
    out = _run(d, TracebackProcessor(quiet), TRACEBACK_OUT)
    if rules:
        out = out.filter(F.col("late") | ~noise_predicate("text", rules))
    return out.withColumn("text", F.when(F.col("late"), F.col("text")).otherwise(truncate_middle("text", max_len)))


TEMPLATE_OUT = "artifact_id long, line_number long, text string, template string, last_seen long, n long"


class TemplateProcessor(_ClosingProcessor):
    """Per log a map of its templates: first message, last line and count. A micro-batch touches only the entries
    of its own templates. First, last and count merge in any order, so messages may come in any order."""

    def __init__(self, k: int, quiet: int | None):
        super().__init__(quiet)
        self.k = k

    def init(self, handle):
        super().init(handle)
        self.seen = handle.getMapState("seen", "template string", "line_number long, text string, last_seen long, n long")

    def handleInputRows(self, key, rows, timerValues):
        parts = list(rows)
        ended = any(r["text"].isna().any() for r in parts)
        got = pd.concat(parts)
        got = got[got["text"].notna()].sort_values("line_number", kind="stable")
        for template, g in got.groupby("template", sort=False):
            line, text, last, n = int(g["line_number"].iloc[0]), g["text"].iloc[0], int(g["line_number"].iloc[-1]), len(g)
            if self.seen.containsKey((template,)):
                line0, text0, last0, n0 = self.seen.getValue((template,))
                if line0 <= line:
                    line, text = line0, text0
                last, n = max(last, last0), n + n0
            self.seen.updateValue((template,), (line, text, last, n))
        if ended:
            self._drop_timer()
            yield from self.finish(key[0])
        else:
            self._await_quiet(parts, timerValues)

    def finish(self, artifact_id):
        import heapq
        entries = ((v[2], t, *v) for (t,), v in self.seen.iterator())
        top = heapq.nlargest(self.k, entries, key=lambda e: e[0])
        self.seen.clear()
        if top:
            yield pd.DataFrame([(artifact_id, line, text, t, last, n) for _, t, line, text, last, n in top],
                               columns=["artifact_id", "line_number", "text", "template", "last_seen", "n"])


def live_templates(messages: DataFrame, k: int = C.DEFAULT_MAX_CLUSTERS, event_time: str | None = None,
                   quiet: int | None = None) -> DataFrame:
    """Representative snippets (same rule as ``representative_snippets``) over a stream of messages
    ``(artifact_id, line_number, text)``, as ``live_messages(..., mark_end=True)`` gives them:
    ``(artifact_id, line_number, text, template, last_seen, n)`` of the ``k`` templates of a log seen last.

    Snippets come out when their log ends (a null text, or ``quiet``). Masks and templates are computed before
    the state; the state has one entry per template of an open log, so a template that fell out of the last ``k``
    and comes again still has its first message. A message delivered twice counts twice in ``n`` alone.
    """
    d = mine_templates(messages, text_col="text").select("artifact_id", "line_number", "text", "template", *_at(event_time, quiet))
    return _run(d, TemplateProcessor(k, quiet), TEMPLATE_OUT)

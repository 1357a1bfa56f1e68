"""Extraction queries over the derived ``log_lines`` view and ``documents``."""

from __future__ import annotations

from logsift import constants as C
from logsift.catalog import noise_sql, register, sql_str
from logsift.functions.text import noise_predicate, truncate_middle
from logsift.operators.extract import python_extractor
from logsift.operators.tracebacks import TracebackFeed, python_tracebacks
from logsift.plans.views import LOG_LINES_SQL, log_lines, table, with_views

_HDR = sql_str(C.TB_HEADER)
_CHAIN = ", ".join(sql_str(s) for s in C.TB_CHAIN)
_BORDER = (C.DEFAULT_SNIPPET_LEN - len(C.TRUNCATE_MIDDLE)) // 2


@register("ll_lines", with_views(
    "SELECT artifact_id, line_no, line FROM log_lines", LOG_LINES_SQL))
def q_ll_lines(spark, sf):
    return log_lines(table(spark, sf, "events"))


TRACEBACKS_SQL = with_views(f""",
nb AS (SELECT artifact_id, line_no, line, regexp_replace(line, '\\s+$', '') AS rt
         FROM log_lines WHERE regexp_matches(line, '\\S')),
c AS (SELECT *, CASE WHEN starts_with(line, ' ') OR starts_with(line, chr(9)) THEN 'F'
                     WHEN rt = {_HDR} THEN 'S' WHEN rt IN ({_CHAIN}) THEN 'C' ELSE 'E' END AS cls FROM nb),
p AS (SELECT *, lag(cls) OVER w AS prev_cls, lag(line_no) OVER w AS prev_line_no
      FROM c WINDOW w AS (PARTITION BY artifact_id ORDER BY line_no)),
l AS (SELECT *, CASE WHEN cls IN ('S', 'C') OR (prev_cls IS NOT NULL AND prev_cls <> 'E'
                     AND prev_line_no = line_no - 1) THEN 0 ELSE 1 END AS unlinked FROM p),
i AS (SELECT *, sum(unlinked) OVER (PARTITION BY artifact_id ORDER BY line_no
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM l),
h AS (SELECT artifact_id, island, min(CASE WHEN line = {_HDR} THEN line_no END) AS hdr FROM i GROUP BY 1, 2),
s AS (SELECT i.artifact_id, h.hdr AS line_number, string_agg(i.rt, chr(10) ORDER BY i.line_no) AS text
      FROM i JOIN h USING (artifact_id, island)
      WHERE h.hdr IS NOT NULL AND i.line_no >= h.hdr GROUP BY i.artifact_id, h.hdr)
SELECT artifact_id, CAST(line_number AS BIGINT) AS line_number,
       CASE WHEN length(text) > {C.DEFAULT_SNIPPET_LEN}
            THEN left(text, {_BORDER}) || {sql_str(C.TRUNCATE_MIDDLE)} || right(text, {_BORDER})
            ELSE text END AS text
FROM s WHERE NOT {noise_sql('text', C.DEFAULT_NOISE_RULES)}
""", LOG_LINES_SQL)


@register("tracebacks", TRACEBACKS_SQL)
def q_tracebacks(spark, sf):
    return python_tracebacks(log_lines(table(spark, sf, "events")))


@register("tracebacks_by_line", TRACEBACKS_SQL)
def q_tracebacks_by_line(spark, sf):
    """The extractor as Python fed line by line; noise rules and cutting stay expressions."""
    found = python_extractor(TracebackFeed)(log_lines(table(spark, sf, "events")))
    return found.filter(~noise_predicate("text", C.DEFAULT_NOISE_RULES)).select(
        "artifact_id", "line_number", truncate_middle("text", C.DEFAULT_SNIPPET_LEN).alias("text"))

"""Derived views over the driver tables, built identically in Spark and in SQL.

* ``log_lines(artifact_id, line_no, line)`` — one build log per ``user_id``; each event of the
  user expands to a few log lines (progress, copies, continuation lines, compiler errors,
  Python tracebacks, personal data); lines are numbered in ``(ts, event_id)`` order.
* ``request_metrics(id, endpoint, request_received_at, response_sent_at, response_length)``.
* ``jobs``, ``comments``, ``reactions`` — merge-request feedback tables.

The Spark side numbers lines with a blocked prefix sum over events (hour blocks), so a
user holding a large share of all events is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.constants import ENDPOINTS, FORGES
from logsift.plans.scan import blocked_cumsum

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Reactions of a comment are the user's non-error events within this many ids after the job.
REACTION_SPAN = 500
HOUR_US = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` for queries that spend all their time on regular expressions over whole texts.

    A small test file is one row group and hence one task, however small the split size; it is dealt out
    to the cores. A table of several files or row groups is read as it is.
    """
    df = table(spark, sf_dir, "documents")
    if len(df.inputFiles()) > 1:
        return df
    return df.repartition(spark.sparkContext.defaultParallelism)


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def _event_lines(k: Column, u: Column, etype: Column, eid: Column) -> Column:
    ks, us = k.cast("string"), u.cast("string")
    lit = F.lit
    click = F.array(F.concat(lit("INFO: click widget "), ks, lit(" took "), ks, lit(" ms")))
    view = F.array(F.concat(lit("Copying file /builddir/build/"), ks),
                   F.concat(lit("    indented detail "), ks),
                   F.concat(lit("| table row "), ks))
    signup = F.array(F.concat(lit("user"), us, lit("@example.com registered key pubkey-deadbeef-"),
                              F.lpad(ks, 8, "0")),
                     lit(""))
    purchase = F.array(F.concat(lit("src/file"), ks, lit(".c:"), ks,
                                lit(":7: error: expected declaration before token")),
                       F.concat(lit("    "), ks, lit(" | int x = "), ks, lit(";")),
                       lit("      |         ^"))
    err_even = F.array(lit("Traceback (most recent call last):"),
                       F.concat(lit('  File "app.py", line '), ks, lit(", in main")),
                       lit("    run()"),
                       F.concat(lit("ValueError: bad "), ks))
    err_odd = F.array(lit("Traceback (most recent call last):"),
                      F.concat(lit('  File "a.py", line '), ks, lit(", in f")),
                      lit("    g()"),
                      lit("KeyError: 'x'"),
                      lit(""),
                      lit("During handling of the above exception, another exception occurred:"),
                      lit(""),
                      lit("Traceback (most recent call last):"),
                      F.concat(lit('  File "b.py", line '), ks, lit(", in h")),
                      lit("    f()"),
                      F.concat(lit("RuntimeError: failed "), ks))
    return (F.when(etype == "click", click)
            .when(etype == "view", view)
            .when(etype == "signup", signup)
            .when(etype == "purchase", purchase)
            .when((etype == "error") & (eid % 2 == 0), err_even)
            .when(etype == "error", err_odd)
            .otherwise(F.array().cast("array<string>")))


def log_lines(events: DataFrame) -> DataFrame:
    """``(artifact_id, line_no, line)`` from ``events``."""
    shown = _event_lines(F.col("k"), F.col("artifact_id"), F.col("event_type"), F.col("event_id"))
    ev = events.select(F.col("user_id").alias("artifact_id"), "event_id", "ts", "event_type", _k().alias("k"))
    ev = ev.withColumn("n", F.size(shown).cast("bigint"))  # numbers are dealt out before any line is built
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(HOUR_US)).cast("bigint")
    ev = blocked_cumsum(ev, ["artifact_id"], ["ts", "event_id"], hour, {"before": F.col("n")},
                        inclusive=False)
    return ev.select("artifact_id", F.posexplode(shown).alias("pos", "line"), "before") \
        .select("artifact_id", (F.col("before") + F.col("pos") + 1).cast("bigint").alias("line_no"), "line")


def request_metrics(events: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    missing = (F.col("event_id") % 7) == 0
    sent = F.timestamp_micros(F.unix_micros(ts) + F.round(F.col("value") * 1_000_000).cast("bigint"))
    endpoints = F.array(*[F.lit(e) for e in ENDPOINTS])
    return events.select(
        F.col("event_id").alias("id"),
        F.element_at(endpoints, (F.col("event_id") % 3 + 1).cast("int")).alias("endpoint"),
        ts.alias("request_received_at"),
        F.when(missing, F.lit(None)).otherwise(sent).alias("response_sent_at"),
        F.when(missing, F.lit(None)).otherwise(_k() * 50).cast("bigint").alias("response_length"),
    )


def _forge() -> Column:
    forges = F.array(*[F.lit(f) for f in FORGES])
    return F.element_at(forges, (F.col("user_id") % 2 + 1).cast("int"))


def jobs(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("id"), _forge().alias("forge"), F.col("user_id").alias("project_id"),
        _k().alias("mr_iid"), F.col("event_id").alias("job_id"))


def comments(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("id"), F.col("event_id").alias("merge_request_job_id"),
        _forge().alias("forge"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("comment_id"),
        F.col("ts").cast("timestamp").alias("created_at"))


def reactions(events: DataFrame, span: int = REACTION_SPAN) -> DataFrame:
    """Non-error events of the job's user within ``REACTION_SPAN`` ids after it, per type.

    Range join done as an equi join on ``(user_id, event_id div span)``: each job looks at its
    own bucket and the next, so a busy user is spread over many join keys.
    """
    j = events.filter(F.col("event_type") == "error").select(
        "user_id", F.col("event_id").alias("job_event"),
        F.explode(F.array(F.floor(F.col("event_id") / span).cast("bigint"),
                          (F.floor(F.col("event_id") / span) + 1).cast("bigint"))).alias("bucket"))
    x = events.filter(F.col("event_type") != "error").select(
        "user_id", "event_id", "event_type", F.floor(F.col("event_id") / span).cast("bigint").alias("bucket"))
    m = j.join(x, ["user_id", "bucket"]).filter(
        (F.col("event_id") >= F.col("job_event")) & (F.col("event_id") <= F.col("job_event") + span))
    return m.groupBy(F.col("job_event").alias("comment_id"), F.col("event_type").alias("reaction_type")) \
        .agg(F.count(F.lit(1)).cast("bigint").alias("cnt"))


# ---------------------------------------------------------------------------
# SQL (DuckDB) text of the same views, used by oracle_sql()
# ---------------------------------------------------------------------------

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

LOG_LINES_SQL = f"""
log_lines AS (
  WITH ev AS (
    SELECT user_id AS artifact_id, event_id, ts, event_type, {_K} AS k,
           CAST({_K} AS VARCHAR) AS ks, CAST(user_id AS VARCHAR) AS us FROM events),
  arr AS (
    SELECT artifact_id, event_id, ts,
      CASE
        WHEN event_type = 'click' THEN ['INFO: click widget ' || ks || ' took ' || ks || ' ms']
        WHEN event_type = 'view' THEN ['Copying file /builddir/build/' || ks,
                                       '    indented detail ' || ks, '| table row ' || ks]
        WHEN event_type = 'signup' THEN ['user' || us || '@example.com registered key pubkey-deadbeef-'
                                         || lpad(ks, 8, '0'), '']
        WHEN event_type = 'purchase' THEN ['src/file' || ks || '.c:' || ks
                                           || ':7: error: expected declaration before token',
                                           '    ' || ks || ' | int x = ' || ks || ';',
                                           '      |         ^']
        WHEN event_type = 'error' AND event_id % 2 = 0 THEN
          ['Traceback (most recent call last):', '  File "app.py", line ' || ks || ', in main',
           '    run()', 'ValueError: bad ' || ks]
        WHEN event_type = 'error' THEN
          ['Traceback (most recent call last):', '  File "a.py", line ' || ks || ', in f', '    g()',
           'KeyError: ''x''', '', 'During handling of the above exception, another exception occurred:',
           '', 'Traceback (most recent call last):', '  File "b.py", line ' || ks || ', in h', '    f()',
           'RuntimeError: failed ' || ks]
        ELSE []::VARCHAR[]
      END AS lines
    FROM ev),
  ex AS (
    SELECT artifact_id, event_id, ts, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM arr)
  SELECT artifact_id,
         CAST(row_number() OVER (PARTITION BY artifact_id ORDER BY ts, event_id, pos) AS BIGINT) AS line_no,
         line
  FROM ex)
"""

REQUEST_METRICS_SQL = f"""
request_metrics AS (
  SELECT event_id AS id,
         (['{ENDPOINTS[0]}', '{ENDPOINTS[1]}', '{ENDPOINTS[2]}'])[CAST(event_id % 3 AS INTEGER) + 1] AS endpoint,
         ts AS request_received_at,
         CASE WHEN event_id % 7 = 0 THEN NULL
              ELSE ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) END AS response_sent_at,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST({_K} * 50 AS BIGINT) END AS response_length
  FROM events)
"""

_FORGE_SQL = f"(['{FORGES[0]}', '{FORGES[1]}'])[CAST(user_id % 2 AS INTEGER) + 1]"

FEEDBACK_SQL = f"""
jobs AS (
  SELECT event_id AS id, {_FORGE_SQL} AS forge, user_id AS project_id, {_K} AS mr_iid, event_id AS job_id
  FROM events WHERE event_type = 'error'),
comments AS (
  SELECT event_id AS id, event_id AS merge_request_job_id, {_FORGE_SQL} AS forge,
         'c' || CAST(event_id AS VARCHAR) AS comment_id, ts AS created_at
  FROM events WHERE event_type = 'error'),
reactions AS (
  SELECT j.event_id AS comment_id, x.event_type AS reaction_type, CAST(count(*) AS BIGINT) AS cnt
  FROM events j JOIN events x
    ON x.user_id = j.user_id AND x.event_id BETWEEN j.event_id AND j.event_id + {REACTION_SPAN}
  WHERE j.event_type = 'error' AND x.event_type <> 'error'
  GROUP BY j.event_id, x.event_type)
"""


def with_views(body: str, *views: str) -> str:
    """Prefix ``body`` with a WITH clause holding the named views (``LOG_LINES_SQL`` ...).

    A body starting with ``,`` continues the WITH list with its own CTEs.
    """
    head = "WITH " + ",\n".join(v.strip() for v in views)
    return head + ("" if body.lstrip().startswith(",") else "\n") + body

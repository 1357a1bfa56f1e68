"""Metrics, feedback and selection queries over the derived request-metrics / feedback views,
``events`` and ``orders``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift import constants as C
from logsift.catalog import register, sql_str
from logsift.functions.text import merge_request_id
from logsift.operators import feedback as FB
from logsift.operators import metrics as M
from logsift.operators import select as S
from logsift.plans.views import (FEEDBACK_SQL, REQUEST_METRICS_SQL, comments, jobs, reactions,
                                 request_metrics, table, with_views)


def ntz(df: DataFrame) -> DataFrame:
    """Timestamps leave as wall-clock UTC ``timestamp_ntz`` (what the SQL side returns)."""
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name)
                       if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
                       for f in df.schema.fields])


def _ev(spark, sf):
    return table(spark, sf, "events")


def _rm(spark, sf):
    return request_metrics(_ev(spark, sf))


def _fb(spark, sf):
    e = _ev(spark, sf)
    return jobs(e), comments(e), reactions(e)


def _lit_ts(x: dt.datetime) -> str:
    return f"TIMESTAMP '{x.replace(tzinfo=None).isoformat(sep=' ')}'"


RM = lambda body: with_views(body, REQUEST_METRICS_SQL)
FBV = lambda body: with_views(body, FEEDBACK_SQL)
RMFB = lambda body: with_views(body, REQUEST_METRICS_SQL, FEEDBACK_SQL)

HOURLY = M.period_bounds(hours=72, end=dt.datetime(2024, 1, 10))
DAILY = M.period_bounds(days=20, end=dt.datetime(2024, 1, 25, 12, 0))
WEEKLY = M.period_bounds(weeks=2, end=dt.datetime(2024, 1, 29))


def _between(p: M.Period) -> str:
    return f"request_received_at BETWEEN {_lit_ts(p.start)} AND {_lit_ts(p.end)}"


# --- O53–O57 -----------------------------------------------------------------------------------------

@register("requests_hourly", RM(f"""
SELECT 'requests' AS metric, date_trunc('hour', request_received_at) AS bucket, CAST(count(DISTINCT id) AS DOUBLE) AS value
FROM request_metrics WHERE {_between(HOURLY)} AND endpoint = 'analyze' GROUP BY 2"""))
def q_requests_hourly(spark, sf):
    return M.requests_per_bucket(_rm(spark, sf), HOURLY, "analyze")


@register("avg_response_time_daily", RM(f"""
SELECT 'avg_response_time' AS metric, date_trunc('day', request_received_at) AS bucket,
       round(coalesce(avg(epoch_us(response_sent_at) - epoch_us(request_received_at)) / 1e6, 0), 6) AS value
FROM request_metrics WHERE {_between(DAILY)} AND endpoint = 'analyze_gitlab_job' GROUP BY 2"""))
def q_avg_time(spark, sf):
    d = M.avg_response_time(_rm(spark, sf), DAILY, "analyze_gitlab_job")
    return d.withColumn("value", F.round("value", 6))


@register("avg_response_length_daily", RM(f"""
SELECT 'avg_response_length' AS metric, date_trunc('day', request_received_at) AS bucket,
       round(avg(response_length), 6) AS value
FROM request_metrics WHERE {_between(DAILY)} AND endpoint = 'analyze_koji_task' GROUP BY 2"""))
def q_avg_len(spark, sf):
    d = M.avg_response_length(_rm(spark, sf), DAILY, "analyze_koji_task")
    return d.withColumn("value", F.round("value", 6))


@register("reaction_series_weekly", FBV(f"""
SELECT 'emoji_' || r.reaction_type AS metric, date_trunc('day', c.created_at) AS bucket,
       CAST(sum(r.cnt) AS DOUBLE) AS value
FROM reactions r JOIN comments c ON r.comment_id = c.id
WHERE c.created_at > {_lit_ts(WEEKLY.start)} GROUP BY 1, 2"""))
def q_reaction_series(spark, sf):
    j, c, r = _fb(spark, sf)
    return M.reaction_series(r, c, WEEKLY)


@register("all_metrics_daily", RMFB(f"""
, u AS (
  SELECT 'requests' AS metric, date_trunc('day', request_received_at) AS bucket, CAST(count(DISTINCT id) AS DOUBLE) AS value
  FROM request_metrics WHERE {_between(DAILY)} AND endpoint = 'analyze' GROUP BY 2
  UNION ALL
  SELECT 'avg_response_time', date_trunc('day', request_received_at),
         coalesce(avg(epoch_us(response_sent_at) - epoch_us(request_received_at)) / 1e6, 0)
  FROM request_metrics WHERE {_between(DAILY)} AND endpoint = 'analyze' GROUP BY 2
  UNION ALL
  SELECT 'avg_response_length', date_trunc('day', request_received_at), avg(response_length)
  FROM request_metrics WHERE {_between(DAILY)} AND endpoint = 'analyze' GROUP BY 2
  UNION ALL
  SELECT 'emoji_' || r.reaction_type, date_trunc('day', c.created_at), CAST(sum(r.cnt) AS DOUBLE)
  FROM reactions r JOIN comments c ON r.comment_id = c.id WHERE c.created_at > {_lit_ts(DAILY.start)} GROUP BY 1, 2)
SELECT metric, bucket, round(coalesce(value, 0), 6) AS value FROM u""".replace("\n, u AS", ",\nu AS", 1)))
def q_all_metrics(spark, sf):
    j, c, r = _fb(spark, sf)
    d = M.all_metrics(_rm(spark, sf), r, c, DAILY, "analyze")
    return d.withColumn("value", F.round("value", 6))


# --- O58 / O59 / O59a -------------------------------------------------------------------------------

@register("certainty_users", """
SELECT user_id AS response_id, round(quantile_cont(exp(-value / 100.0) * 100, 0.5), 6) AS certainty
FROM events GROUP BY user_id""")
def q_certainty(spark, sf):
    lp = _ev(spark, sf).select(F.col("user_id").alias("response_id"), (-F.col("value") / 100.0).alias("logprob"))
    return M.certainty(lp).withColumn("certainty", F.round("certainty", 6))


@register("count_reactions_events", """
WITH a AS (SELECT user_id AS discussion_id, event_id // 100 AS note_id, event_type AS name FROM events),
f AS (SELECT discussion_id, min(note_id) AS note_id FROM a GROUP BY 1)
SELECT a.discussion_id, a.name AS reaction_type, CAST(count(*) AS BIGINT) AS cnt
FROM a JOIN f USING (discussion_id, note_id) GROUP BY 1, 2""")
def q_count_reactions(spark, sf):
    a = _ev(spark, sf).select(F.col("user_id").alias("discussion_id"),
                              (F.col("event_id") / 100).cast("bigint").alias("note_id"),
                              F.col("event_type").alias("name"))
    return M.count_reactions(a)


@register("table_counts", FBV("""
, upd AS (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS file_count FROM events WHERE event_type = 'signup')
SELECT 'jobs' AS what, CAST(count(*) AS BIGINT) AS n FROM jobs
UNION ALL SELECT 'comments', CAST(count(*) AS BIGINT) FROM comments
UNION ALL SELECT 'reactions', CAST(count(*) AS BIGINT) FROM reactions
UNION ALL SELECT 'files', CAST(coalesce(sum(file_count), 0) AS BIGINT) FROM upd""".replace("\n, upd AS", ",\nupd AS", 1)))
def q_table_counts(spark, sf):
    from logsift.operators.corpus import table_count
    e = _ev(spark, sf)
    j, c, r = _fb(spark, sf)
    files = e.filter(F.col("event_type") == "signup").select(
        F.get_json_object("props", "$.k").cast("int").alias("file_count"))
    total = files.agg(F.coalesce(F.sum("file_count"), F.lit(0)).cast("bigint").alias("n"))
    return table_count(j, "jobs").unionByName(table_count(c, "comments")) \
        .unionByName(table_count(r, "reactions")).unionByName(total.select(F.lit("files").alias("what"), "n"))


@register("latest_archive", """
SELECT arg_max(CAST(ts AS DATE), event_id) AS archive_date, CAST(count(*) AS BIGINT) AS updates
FROM events WHERE event_type = 'signup'""")
def q_latest_archive(spark, sf):
    from logsift.operators.corpus import latest_update
    upd = _ev(spark, sf).filter(F.col("event_type") == "signup").select(
        F.col("event_id").alias("id"), F.to_date("ts").alias("archive_date"))
    return latest_update(upd)


# --- O64 / O65 / O66 / O51 ----------------------------------------------------------------------------

@register("pair_request_response", RM("""
SELECT q.id, q.endpoint, q.request_received_at, s.response_sent_at, s.response_length
FROM request_metrics q LEFT JOIN (SELECT id, response_sent_at, response_length FROM request_metrics
                                  WHERE response_sent_at IS NOT NULL) s USING (id)"""))
def q_pair(spark, sf):
    rm = _rm(spark, sf)
    req = rm.select("id", "endpoint", "request_received_at")
    resp = rm.filter(F.col("response_sent_at").isNotNull()).select("id", "response_sent_at", "response_length")
    return ntz(M.pair_request_response(req, resp))


@register("link_to_job", RMFB("""
SELECT m.id, m.endpoint, j.id AS merge_request_job_id
FROM request_metrics m LEFT JOIN jobs j ON m.endpoint = 'analyze_gitlab_job' AND m.id = j.id"""))
def q_link(spark, sf):
    e = _ev(spark, sf)
    return M.link_to_job(request_metrics(e), jobs(e)).select("id", "endpoint", "merge_request_job_id")


_TASK_SQL = """
sub AS (SELECT user_id AS task_id, max(ts) AS request_received_at FROM events GROUP BY 1),
resp AS (SELECT user_id AS task_id, arg_min(event_id, (epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT), event_id))
                AS response_id
         FROM events WHERE event_type = 'purchase' AND value > 45 GROUP BY 1),
tasks AS (SELECT sub.task_id, sub.request_received_at, resp.response_id FROM sub LEFT JOIN resp USING (task_id))
"""


def _tasks(spark, sf):
    e = _ev(spark, sf)
    subs = e.select(F.col("user_id").alias("task_id"), F.col("ts").cast("timestamp").alias("received_at"))
    resp = e.filter((F.col("event_type") == "purchase") & (F.col("value") > 45)).select(
        F.col("user_id").alias("task_id"), F.col("event_id").alias("response_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 1e6).cast("bigint"))
        .alias("responded_at"))
    return M.record_task_response(subs, resp)


@register("record_task_response", "WITH " + _TASK_SQL + "SELECT task_id, request_received_at, response_id FROM tasks")
def q_record_task(spark, sf):
    return ntz(_tasks(spark, sf))


NOW = dt.datetime(2024, 1, 30, 23, 50)


@register("task_status", "WITH " + _TASK_SQL + f""",
lk AS (SELECT DISTINCT user_id AS task_id FROM events UNION SELECT DISTINCT user_id + 100000 FROM events)
SELECT lk.task_id,
  CASE WHEN t.request_received_at IS NULL THEN 'not_found' WHEN t.response_id IS NOT NULL THEN 'done'
       WHEN t.request_received_at + INTERVAL {C.TASK_ANALYSIS_TIMEOUT_MIN} MINUTE < {_lit_ts(NOW)} THEN 'timed_out'
       ELSE 'in_progress' END AS status
FROM lk LEFT JOIN tasks t USING (task_id)""")
def q_task_status(spark, sf):
    e = _ev(spark, sf)
    lk = e.select(F.col("user_id").alias("task_id")).union(
        e.select((F.col("user_id") + 100000).alias("task_id"))).distinct()
    return M.task_status(lk, _tasks(spark, sf), NOW)


# --- O43–O50, O52 --------------------------------------------------------------------------------------

@register("requests_of_jobs", RMFB("""
SELECT m.id, j.forge, j.project_id, j.mr_iid, j.job_id
FROM request_metrics m JOIN jobs j ON m.endpoint = 'analyze_gitlab_job' AND m.id = j.id"""))
def q_requests_of_jobs(spark, sf):
    e = _ev(spark, sf)
    linked = M.link_to_job(request_metrics(e), jobs(e))
    return FB.requests_of_jobs(linked, jobs(e)).select("id", "forge", "project_id", "mr_iid", "job_id")


@register("comment_by_forge_id", FBV("""
SELECT c.id, c.forge, c.comment_id, j.project_id, j.mr_iid, j.job_id
FROM comments c JOIN jobs j ON c.merge_request_job_id = j.id WHERE c.id % 5 = 0"""))
def q_comment_by_forge_id(spark, sf):
    j, c, r = _fb(spark, sf)
    keys = c.filter(F.col("id") % 5 == 0).select("forge", "comment_id")
    return FB.comment_by_forge_id(c, j, keys).select("id", "forge", "comment_id", "project_id", "mr_iid", "job_id")


@register("comments_of_mrs", FBV("""
SELECT c.forge, j.project_id, j.mr_iid, c.comment_id, c.created_at
FROM comments c JOIN jobs j ON c.merge_request_job_id = j.id WHERE j.mr_iid < 30"""))
def q_comments_of_mrs(spark, sf):
    j, c, r = _fb(spark, sf)
    mrs = j.filter(F.col("mr_iid") < 30).select(*FB.MR_KEY).distinct()
    return ntz(FB.comments_of_mrs(c, j, mrs).select("forge", "project_id", "mr_iid", "comment_id", "created_at"))


@register("reactions_of_comments", FBV("""
SELECT c.forge, j.project_id, j.mr_iid, j.job_id, c.comment_id, r.reaction_type, r.cnt
FROM reactions r JOIN comments c ON r.comment_id = c.id JOIN jobs j ON c.merge_request_job_id = j.id
WHERE j.job_id % 3 = 0"""))
def q_reactions_of_comments(spark, sf):
    j, c, r = _fb(spark, sf)
    keys = FB.comments_with_jobs(c, j).filter(F.col("job_id") % 3 == 0).select(*FB.JOB_KEY, "comment_id")
    return FB.reactions_of_comments(r, c, j, keys).select(*FB.JOB_KEY, "comment_id", "reaction_type", "cnt")


@register("reaction_of_type", FBV("""
SELECT c.forge, j.project_id, j.mr_iid, j.job_id, c.comment_id, r.cnt
FROM reactions r JOIN comments c ON r.comment_id = c.id JOIN jobs j ON c.merge_request_job_id = j.id
WHERE r.reaction_type = 'view'"""))
def q_reaction_of_type(spark, sf):
    j, c, r = _fb(spark, sf)
    return FB.reactions_of_comments(r, c, j, None, "view").select(*FB.JOB_KEY, "comment_id", "cnt")


SINCE = dt.datetime(2024, 1, 20)


@register("reactions_since", FBV(f"""
SELECT r.comment_id, r.reaction_type, r.cnt, c.created_at FROM reactions r JOIN comments c ON r.comment_id = c.id
WHERE c.created_at > {_lit_ts(SINCE)}"""))
def q_reactions_since(spark, sf):
    j, c, r = _fb(spark, sf)
    return ntz(FB.reactions_since(r, c, SINCE).select("comment_id", "reaction_type", "cnt", "created_at"))


SINCE2 = dt.datetime(2024, 1, 25, 6)


@register("comments_since", FBV(f"""
SELECT id, forge, comment_id, created_at FROM comments WHERE created_at > {_lit_ts(SINCE2)}"""))
def q_comments_since(spark, sf):
    j, c, r = _fb(spark, sf)
    return ntz(FB.comments_since(c, SINCE2).select("id", "forge", "comment_id", "created_at"))


@register("comments_of_jobs", FBV("""
SELECT c.id, c.comment_id FROM comments c WHERE c.merge_request_job_id IN (SELECT id FROM jobs WHERE job_id % 4 = 0)"""))
def q_comments_of_jobs(spark, sf):
    j, c, r = _fb(spark, sf)
    keys = j.filter(F.col("job_id") % 4 == 0).select(*FB.JOB_KEY)
    return FB.comments_of_jobs(c, j, keys).select("id", "comment_id")


@register("jobs_of_mrs", FBV("""
SELECT * FROM jobs WHERE (forge, project_id, mr_iid) IN (SELECT (forge, project_id, mr_iid) FROM jobs WHERE mr_iid < 20)"""))
def q_jobs_of_mrs(spark, sf):
    j, c, r = _fb(spark, sf)
    mrs = j.filter(F.col("mr_iid") < 20).select(*FB.MR_KEY).distinct()
    return FB.jobs_of_mrs(j, mrs)


@register("jobs_by_id", FBV("""
SELECT * FROM jobs WHERE id IN (SELECT event_id FROM events WHERE event_id % 3 = 0)"""))
def q_jobs_by_id(spark, sf):
    j, c, r = _fb(spark, sf)
    ids = _ev(spark, sf).filter(F.col("event_id") % 3 == 0).select(F.col("event_id").alias("id"))
    found, _ = FB.lookup_by_id(j, ids)
    return found


@register("missing_metric_ids", RM("""
SELECT e.event_id + 5000 AS id FROM events e WHERE e.event_id % 50 = 0
  AND e.event_id + 5000 NOT IN (SELECT id FROM request_metrics)"""))
def q_missing_metrics(spark, sf):
    ids = _ev(spark, sf).filter(F.col("event_id") % 50 == 0).select((F.col("event_id") + 5000).alias("id"))
    _, missing = FB.lookup_by_id(_rm(spark, sf), ids)
    return missing


_INCOMING_SQL = f"""
incoming AS (SELECT event_id AS id, ([{sql_str(C.FORGES[0])}, {sql_str(C.FORGES[1])}])[CAST(user_id % 2 AS INTEGER) + 1] AS forge,
                    user_id AS project_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS mr_iid, event_id AS job_id
             FROM events WHERE event_type IN ('error', 'purchase'))
"""


def _incoming(spark, sf):
    e = _ev(spark, sf).filter(F.col("event_type").isin("error", "purchase"))
    forge = F.element_at(F.array(*[F.lit(f) for f in C.FORGES]), (F.col("user_id") % 2 + 1).cast("int"))
    return e.select(F.col("event_id").alias("id"), forge.alias("forge"), F.col("user_id").alias("project_id"),
                    F.get_json_object("props", "$.k").cast("bigint").alias("mr_iid"), F.col("event_id").alias("job_id"))


@register("skip_resubmissions", FBV(",\n" + _INCOMING_SQL + """
SELECT i.* FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.forge = i.forge AND j.project_id = i.project_id
  AND j.mr_iid = i.mr_iid AND j.job_id = i.job_id)"""))
def q_skip_resubmissions(spark, sf):
    j, c, r = _fb(spark, sf)
    return FB.skip_resubmissions(_incoming(spark, sf), j)


@register("comments_for_forge", FBV(f"""
SELECT c.id, c.comment_id, j.project_id, j.mr_iid, j.job_id FROM comments c JOIN jobs j ON c.merge_request_job_id = j.id
WHERE c.forge = {sql_str(C.FORGES[0])} AND c.created_at > {_lit_ts(SINCE)}"""))
def q_comments_for_forge(spark, sf):
    j, c, r = _fb(spark, sf)
    return FB.comments_for_forge(c, j, C.FORGES[0], SINCE).select("id", "comment_id", "project_id", "mr_iid", "job_id")


@register("known_forges", f"""
SELECT event_id, ([{sql_str(C.FORGES[0])}, {sql_str(C.FORGES[1])}, 'https://forge.example.org'])[CAST(user_id % 3 AS INTEGER) + 1] AS forge
FROM events WHERE user_id % 3 < 2""")
def q_known_forges(spark, sf):
    e = _ev(spark, sf)
    forge = F.element_at(F.array(*[F.lit(f) for f in [*C.FORGES, "https://forge.example.org"]]),
                         (F.col("user_id") % 3 + 1).cast("int"))
    ok, _ = FB.split_known_forges(e.select("event_id", forge.alias("forge")))
    return ok


# --- O60 / O62 / O63 / O73 -----------------------------------------------------------------------------

@register("sync_reactions", FBV("""
, snap AS (
  SELECT j.event_id AS comment_id, x.event_type AS reaction_type, CAST(count(*) AS BIGINT) AS cnt
  FROM events j JOIN events x ON x.user_id = j.user_id AND x.event_id BETWEEN j.event_id AND j.event_id + 300
  WHERE j.event_type = 'error' AND x.event_type <> 'error' GROUP BY 1, 2),
fetched AS (SELECT id AS comment_id FROM comments WHERE id % 4 <> 0)
SELECT * FROM reactions WHERE comment_id NOT IN (SELECT comment_id FROM fetched)
UNION ALL
SELECT * FROM snap WHERE comment_id IN (SELECT comment_id FROM fetched)""".replace("\n, snap AS", ",\nsnap AS", 1)))
def q_sync_reactions(spark, sf):
    e = _ev(spark, sf)
    j, c, r = _fb(spark, sf)
    snap = reactions(e, span=300)
    fetched = c.filter(F.col("id") % 4 != 0).select(F.col("id").alias("comment_id"))
    return FB.sync_reactions(r, snap, fetched)


@register("assert_unique_jobs", FBV("""
SELECT forge, job_id, count(*) AS n FROM jobs GROUP BY 1, 2 HAVING count(*) > 1"""))
def q_assert_unique(spark, sf):
    j, c, r = _fb(spark, sf)
    return FB.assert_unique(j, ["forge", "job_id"])


@register("get_or_create_jobs", FBV(",\n" + _INCOMING_SQL + """,
new AS (SELECT min(id) AS id, forge, project_id, mr_iid, job_id FROM incoming i
        WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.forge = i.forge AND j.project_id = i.project_id
                          AND j.mr_iid = i.mr_iid AND j.job_id = i.job_id) GROUP BY 2, 3, 4, 5)
SELECT * FROM jobs UNION ALL SELECT * FROM new"""))
def q_get_or_create(spark, sf):
    j, c, r = _fb(spark, sf)
    return FB.get_or_create_jobs(j, _incoming(spark, sf))


@register("latest_comment", FBV("""
SELECT c.forge, j.project_id, j.mr_iid, arg_max(c.id, (c.created_at, c.id)) AS id,
       arg_max(c.comment_id, (c.created_at, c.id)) AS comment_id, max(c.created_at) AS created_at
FROM comments c JOIN jobs j ON c.merge_request_job_id = j.id GROUP BY 1, 2, 3"""))
def q_latest_comment(spark, sf):
    j, c, r = _fb(spark, sf)
    return ntz(FB.latest_comment(c, j))


# --- O24 / O25 -------------------------------------------------------------------------------------------

@register("merge_request_ids", """
SELECT event_id, CASE WHEN event_id % 2 = 0
  THEN CAST(regexp_extract('refs/merge-requests/' || json_extract_string(props, '$.k') || '/head', 'refs/merge-requests/(\\d+)/.*$', 1) AS BIGINT)
  END AS mr_iid
FROM events""")
def q_mr_ids(spark, sf):
    e = _ev(spark, sf)
    ref = F.when(F.col("event_id") % 2 == 0,
                 F.concat(F.lit("refs/merge-requests/"), F.get_json_object("props", "$.k"), F.lit("/head"))) \
        .otherwise(F.lit("refs/heads/main"))
    return e.select("event_id", merge_request_id(ref).alias("mr_iid"))


@register("failed_build_events", """
WITH h AS (SELECT event_id AS build_id, user_id AS project_id,
                  (['build_rpm', 'build_centos_stream_rpm', 'lint', 'build_srpm'])[CAST(event_id % 4 AS INTEGER) + 1] AS build_name,
                  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS build_status,
                  CASE WHEN user_id % 5 = 0 THEN 'pipeline' ELSE 'build' END AS object_kind,
                  CASE WHEN event_id % 3 = 0 THEN 'push' ELSE 'merge_request_event' END AS source FROM events)
SELECT build_id, project_id, build_name FROM h
WHERE regexp_matches(build_name, '^build.*rpm$') AND build_status = 'failed' AND object_kind = 'build'
  AND source = 'merge_request_event'""")
def q_failed_build_events(spark, sf):
    from logsift.sources.webhooks import failed_build_events
    e = _ev(spark, sf)
    h = e.select(F.col("event_id").alias("build_id"), F.col("user_id").alias("project_id"),
                 F.element_at(F.array(*[F.lit(x) for x in ["build_rpm", "build_centos_stream_rpm", "lint", "build_srpm"]]),
                              (F.col("event_id") % 4 + 1).cast("int")).alias("build_name"),
                 F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("build_status"),
                 F.when(F.col("user_id") % 5 == 0, "pipeline").otherwise("build").alias("object_kind"),
                 F.when(F.col("event_id") % 3 == 0, "push").otherwise("merge_request_event").alias("source"))
    return failed_build_events(h).select("build_id", "project_id", "build_name")


# --- O39–O42 ---------------------------------------------------------------------------------------------

_ARCHES = ["x86_64", "aarch64", "ppc64le", "s390x", "i686", "riscv", "noarch"]
_ARCH_SQL = "[" + ", ".join(sql_str(a) for a in _ARCHES) + "]"


def _listing(spark, sf):
    e = _ev(spark, sf).filter(F.col("event_type").isin("error", "view", "purchase"))
    arch = F.element_at(F.array(*[F.lit(a) for a in _ARCHES]), (F.col("event_id") % 7 + 1).cast("int"))
    top = F.col("event_id") % 11 == 0
    path = F.when(top, F.concat(F.lit("kojilogs/noarch-"), F.col("user_id").cast("string"), F.lit("/task_failed.log"))) \
        .otherwise(F.concat(F.lit("kojilogs/noarch-"), F.col("user_id").cast("string"), F.lit("/"), arch, F.lit("-"),
                            F.col("event_id").cast("string"), F.lit("/task_failed.log")))
    content = F.when(F.col("event_type") == "view", F.lit("no details")) \
        .otherwise(F.concat(F.lit("see "), F.when(F.col("event_type") == "error", "build.log").otherwise("root.log"),
                            F.lit(" for more information")))
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("pos"), path.alias("path"),
                    content.alias("content"))


_LISTING_SQL = f"""
l AS (SELECT user_id AS job_id, event_id AS pos,
        CASE WHEN event_id % 11 = 0 THEN 'kojilogs/noarch-' || CAST(user_id AS VARCHAR) || '/task_failed.log'
             ELSE 'kojilogs/noarch-' || CAST(user_id AS VARCHAR) || '/' || {_ARCH_SQL}[CAST(event_id % 7 AS INTEGER) + 1]
                  || '-' || CAST(event_id AS VARCHAR) || '/task_failed.log' END AS path,
        CASE WHEN event_type = 'view' THEN 'no details'
             ELSE 'see ' || CASE WHEN event_type = 'error' THEN 'build.log' ELSE 'root.log' END || ' for more information' END AS content
      FROM events WHERE event_type IN ('error', 'view', 'purchase')),
f AS (SELECT job_id, pos, len(string_split(path, '/')) AS n, path, content FROM l WHERE ends_with(path, 'task_failed.log')),
g AS (SELECT job_id, pos,
        CASE WHEN n <= 3 THEN '{C.TOPLEVEL_ARCH}' ELSE string_split(string_split(path, '/')[n - 1], '-')[1] END AS arch,
        CASE WHEN n > 3 AND regexp_extract(content, '(\\w*\\.log)', 1) <> ''
             THEN regexp_replace(path, '/[^/]*$', '') || '/' || regexp_extract(content, '(\\w*\\.log)', 1) ELSE path END AS log_path
      FROM f),
pa AS (SELECT job_id, arch, arg_max(log_path, pos) AS log_path FROM g GROUP BY 1, 2),
rk AS (SELECT *, coalesce(list_position({"[" + ", ".join(sql_str(a) for a in C.ARCH_PREFERENCE) + "]"}, arch),
                          {len(C.ARCH_PREFERENCE) + 1}) AS p FROM pa)
"""


@register("select_failed_log", "WITH " + _LISTING_SQL + """
SELECT job_id, arg_min(arch, (p, arch)) AS arch, arg_min(log_path, (p, arch)) AS log_path FROM rk GROUP BY job_id""")
def q_select_failed_log(spark, sf):
    chosen, _ = S.select_failed_log(_listing(spark, sf))
    return chosen


def _tasks_tree(spark, sf):
    e = _ev(spark, sf)
    parents = e.select(F.col("user_id") + 1_000_000).distinct().toDF("task_id").select(
        "task_id", F.lit(None).cast("bigint").alias("parent_id"), F.lit("build").alias("method"),
        F.element_at(F.array(F.lit("FAILED"), F.lit("CANCELED"), F.lit("CLOSED"), F.lit("FAILED")),
                     (F.col("task_id") % 4 + 1).cast("int")).alias("state"), F.lit("noarch").alias("arch"))
    arch = F.element_at(F.array(*[F.lit(a) for a in _ARCHES]), (F.col("event_id") % 7 + 1).cast("int"))
    kids = e.select(F.col("event_id").alias("task_id"), (F.col("user_id") + 1_000_000).alias("parent_id"),
                    F.when(F.col("event_type") == "click", "tagBuild")
                    .when(F.col("event_id") % 7 == 6, "buildSRPMFromSCM").otherwise("buildArch").alias("method"),
                    F.when(F.col("event_type") == "error", "FAILED").otherwise("CLOSED").alias("state"),
                    arch.alias("arch"))
    return parents.unionByName(kids)


_TREE_SQL = f"""
parents AS (SELECT DISTINCT user_id + 1000000 AS task_id FROM events),
tasks AS (
  SELECT task_id, CAST(NULL AS BIGINT) AS parent_id, 'build' AS method,
         (['FAILED', 'CANCELED', 'CLOSED', 'FAILED'])[CAST(task_id % 4 AS INTEGER) + 1] AS state, 'noarch' AS arch FROM parents
  UNION ALL
  SELECT event_id, user_id + 1000000, CASE WHEN event_type = 'click' THEN 'tagBuild' WHEN event_id % 7 = 6
         THEN 'buildSRPMFromSCM' ELSE 'buildArch' END, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'CLOSED' END,
         {_ARCH_SQL}[CAST(event_id % 7 AS INTEGER) + 1] FROM events),
req AS (SELECT task_id FROM parents UNION ALL SELECT event_id FROM events WHERE event_id % 97 = 0
        UNION ALL SELECT 5 * 1000000 + event_id FROM events WHERE event_id % 500 = 0)
"""


@register("select_failed_subtask", "WITH " + _TREE_SQL + f""",
ok AS (SELECT t.* FROM req JOIN tasks t USING (task_id) WHERE t.state IN ('FAILED', 'CANCELED')),
direct AS (SELECT task_id, task_id AS subtask_id, arch FROM ok WHERE method IN ('buildArch', 'buildSRPMFromSCM')),
par AS (SELECT task_id AS parent_id FROM ok WHERE method NOT IN ('buildArch', 'buildSRPMFromSCM')),
kids AS (SELECT parent_id, arch, max(task_id) AS subtask_id FROM tasks
         WHERE method IN ('buildArch', 'buildSRPMFromSCM') AND state = 'FAILED' AND parent_id IN (SELECT parent_id FROM par)
         GROUP BY 1, 2),
rk AS (SELECT *, coalesce(list_position({"[" + ", ".join(sql_str(a) for a in C.SUBTASK_ARCH_PREFERENCE) + "]"}, arch),
                          {len(C.SUBTASK_ARCH_PREFERENCE) + 1}) AS p FROM kids)
SELECT task_id, subtask_id, arch FROM direct
UNION ALL
SELECT parent_id, arg_min(subtask_id, (p, arch)), arg_min(arch, (p, arch)) FROM rk GROUP BY parent_id""")
def q_select_failed_subtask(spark, sf):
    e = _ev(spark, sf)
    req = e.select((F.col("user_id") + 1_000_000).alias("task_id")).distinct() \
        .unionByName(e.filter(F.col("event_id") % 97 == 0).select(F.col("event_id").alias("task_id"))) \
        .unionByName(e.filter(F.col("event_id") % 500 == 0).select((F.col("event_id") + 5_000_000).alias("task_id")))
    chosen, _ = S.select_failed_subtask(_tasks_tree(spark, sf), req)
    return chosen


@register("failed_log_of_task", f"""
WITH fa AS (SELECT event_id AS task_id, CASE WHEN event_id % 3 = 0 THEN 'BuildError: error building package (arch x86_64), mock exited with status 1; see build.log for more information'
                  ELSE 'GenericError: no space left' END AS fault FROM events WHERE event_type = 'error'),
ou AS (SELECT event_id AS task_id, 'build.log' AS name, CAST(json_extract_string(props, '$.k') AS BIGINT) * 1000 AS size
       FROM events WHERE event_type = 'error' AND event_id % 4 <> 0),
j AS (SELECT fa.task_id, CASE WHEN regexp_extract(fault, '(\\w*\\.log)', 1) = '' THEN 'task_failed.log'
             ELSE regexp_extract(fault, '(\\w*\\.log)', 1) END AS log_name,
             regexp_extract(fault, '(\\w*\\.log)', 1) = '' AS from_fault, fault FROM fa)
SELECT j.task_id, j.log_name,
  CASE WHEN from_fault THEN 'fault_text' WHEN NOT EXISTS (SELECT 1 FROM ou WHERE ou.task_id = j.task_id) THEN 'missing'
       WHEN o.size IS NULL THEN 'missing' WHEN o.size > 60000 THEN 'too_large' ELSE 'ok' END AS status,
  CASE WHEN from_fault THEN fault END AS log_text
FROM j LEFT JOIN ou o ON o.task_id = j.task_id AND o.name = j.log_name""")
def q_failed_log_of_task(spark, sf):
    e = _ev(spark, sf).filter(F.col("event_type") == "error")
    fa = e.select(F.col("event_id").alias("task_id"), F.when(
        F.col("event_id") % 3 == 0,
        F.lit("BuildError: error building package (arch x86_64), mock exited with status 1; "
              "see build.log for more information")).otherwise(F.lit("GenericError: no space left")).alias("fault"))
    ou = e.filter(F.col("event_id") % 4 != 0).select(
        F.col("event_id").alias("task_id"), F.lit("build.log").alias("name"),
        (F.get_json_object("props", "$.k").cast("bigint") * 1000).alias("size"))
    return S.failed_log_of_task(fa, ou, 60000)


_BUILDS_SQL = """
b AS (SELECT o_orderkey AS build_id, o_custkey % 200 AS package_id,
             CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'COMPLETE' ELSE 'DELETED' END AS state,
             o_orderdate AS completion_time,
             CAST(o_orderkey % 4 AS VARCHAR) || '.' || CAST(o_orderkey % 7 AS VARCHAR) AS version,
             CAST(o_orderkey % 5 AS VARCHAR) || '.fc40' AS release,
             CASE WHEN o_orderpriority LIKE '5%' THEN 'buildArch' ELSE 'build' END AS method FROM orders)
"""


def _builds(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("build_id"), (F.col("o_custkey") % 200).alias("package_id"),
                    F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "COMPLETE")
                    .otherwise("DELETED").alias("state"),
                    F.col("o_orderdate").cast("timestamp").alias("completion_time"),
                    F.concat((F.col("o_orderkey") % 4).cast("string"), F.lit("."), (F.col("o_orderkey") % 7).cast("string"))
                    .alias("version"),
                    F.concat((F.col("o_orderkey") % 5).cast("string"), F.lit(".fc40")).alias("release"),
                    F.when(F.col("o_orderpriority").startswith("5"), "buildArch").otherwise("build").alias("method"))


def _vk(x: str) -> str:
    return (f"list_transform(list_filter(regexp_split_to_array({x}, '[^0-9]+'), lambda s: s <> ''), "
            f"lambda s: CAST(s AS BIGINT))")


@register("fixed_later", "WITH " + _BUILDS_SQL + f""",
f AS (SELECT * FROM (SELECT * FROM b WHERE state = 'FAILED' AND completion_time > TIMESTAMP '2000-06-01'
                     ORDER BY build_id DESC LIMIT 200) WHERE method = 'build'),
c AS (SELECT * FROM b WHERE state = 'COMPLETE'),
p AS (SELECT f.build_id, min(c.build_id) AS newer_build_id FROM f JOIN c ON c.package_id = f.package_id
      AND c.completion_time > f.completion_time
      AND ({_vk('c.version')} > {_vk('f.version')} OR ({_vk('c.version')} = {_vk('f.version')}
           AND {_vk('c.release')} > {_vk('f.release')})) GROUP BY 1)
SELECT f.build_id, f.package_id, p.newer_build_id FROM f LEFT JOIN p USING (build_id)""")
def q_fixed_later(spark, sf):
    return S.fixed_later(_builds(spark, sf), "2000-06-01", 200)


@register("get_or_create_comments", FBV(",\n" + _INCOMING_SQL + """,
inc AS (SELECT i.*, 'c' || CAST(i.job_id AS VARCHAR) AS comment_id, e.ts AS created_at
        FROM incoming i JOIN events e ON e.event_id = i.id),
newj AS (SELECT min(id) AS id, forge, project_id, mr_iid, job_id FROM inc i
         WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.forge = i.forge AND j.project_id = i.project_id
                           AND j.mr_iid = i.mr_iid AND j.job_id = i.job_id) GROUP BY 2, 3, 4, 5),
jobs2 AS (SELECT * FROM jobs UNION ALL SELECT * FROM newj),
cand AS (SELECT i.id, j2.id AS merge_request_job_id, i.forge, i.comment_id, i.created_at
         FROM inc i JOIN jobs2 j2 ON j2.forge = i.forge AND j2.project_id = i.project_id
              AND j2.mr_iid = i.mr_iid AND j2.job_id = i.job_id
         WHERE NOT EXISTS (SELECT 1 FROM comments c WHERE c.forge = i.forge AND c.comment_id = i.comment_id)
           AND j2.id NOT IN (SELECT merge_request_job_id FROM comments)),
firstc AS (SELECT arg_min(id, id) AS id, merge_request_job_id, arg_min(forge, id) AS forge,
                  arg_min(comment_id, id) AS comment_id, arg_min(created_at, id) AS created_at
           FROM cand GROUP BY merge_request_job_id)
SELECT * FROM comments UNION ALL SELECT * FROM firstc"""))
def q_get_or_create_comments(spark, sf):
    j, c, r = _fb(spark, sf)
    e = _ev(spark, sf).select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"))
    inc = _incoming(spark, sf).join(e, "id").withColumn(
        "comment_id", F.concat(F.lit("c"), F.col("job_id").cast("string")))
    _, comments2 = FB.get_or_create_comments(c, j, inc)
    return ntz(comments2)


# --- second outputs: rejects and violations ---------------------------------------------------------

_CLASH_SQL = """
clash AS (SELECT event_id + 7000000 AS id, ([{f0}, {f1}])[CAST(user_id % 2 AS INTEGER) + 1] AS forge,
                 user_id + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS project_id, {k} AS mr_iid, event_id AS job_id
          FROM events WHERE event_type = 'error' AND event_id % 2 = 0)""".format(
    f0=sql_str(C.FORGES[0]), f1=sql_str(C.FORGES[1]), k="CAST(json_extract_string(props, '$.k') AS BIGINT)")


def _clashing_jobs(spark, sf):
    """Known jobs again, every third of them under another project."""
    j, _, _ = _fb(spark, sf)
    return j.filter(F.col("job_id") % 2 == 0).select(
        (F.col("job_id") + 7_000_000).alias("id"), "forge",
        (F.col("project_id") + F.when(F.col("job_id") % 3 == 0, 1).otherwise(0)).alias("project_id"), "mr_iid", "job_id")


@register("rejected_jobs", FBV(",\n" + _CLASH_SQL + """
SELECT id, 'job belongs to another merge request' AS reason FROM clash c
WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.forge = c.forge AND j.project_id = c.project_id
                  AND j.mr_iid = c.mr_iid AND j.job_id = c.job_id)"""))
def q_rejected_jobs(spark, sf):
    j, _, _ = _fb(spark, sf)
    return FB.merge_jobs(j, _clashing_jobs(spark, sf))[1]


@register("violated_job_keys", FBV(",\n" + _CLASH_SQL + """,
u AS (SELECT forge, job_id FROM jobs UNION ALL SELECT forge, job_id FROM clash)
SELECT forge, job_id, count(*) AS n FROM u GROUP BY 1, 2 HAVING count(*) > 1"""))
def q_violated_job_keys(spark, sf):
    j, _, _ = _fb(spark, sf)
    return FB.assert_unique(j.select("forge", "job_id").union(_clashing_jobs(spark, sf).select("forge", "job_id")), ["forge", "job_id"])


@register("sync_empty_snapshots", FBV("""
SELECT comment_id, reaction_type, cnt FROM reactions WHERE comment_id % 5 <> 0
UNION ALL
SELECT comment_id, reaction_type, cnt + 1 FROM reactions WHERE comment_id % 10 = 5"""))
def q_sync_empty_snapshots(spark, sf):
    """Comments divisible by ten lost all reactions, other multiples of five gained one of each type;
    an older snapshot of each is overruled."""
    _, _, r = _fb(spark, sf)
    mine = r.filter(F.col("comment_id") % 5 == 0)
    now = mine.groupBy("comment_id").agg(F.collect_list(F.struct("reaction_type", (F.col("cnt") + 1).alias("cnt"))).alias("all")).select(
        "comment_id", F.lit(2).alias("snapshot_time"), F.when(F.col("comment_id") % 10 == 0, F.filter("all", lambda x: F.lit(False)))
        .otherwise(F.col("all")).alias("reactions"))
    old = now.select("comment_id", F.lit(1).alias("snapshot_time"), F.array(F.struct(
        F.lit("old").alias("reaction_type"), F.lit(9).cast("long").alias("cnt"))).alias("reactions"))
    return FB.sync_reactions(r, *FB.latest_snapshots(now.unionByName(old)))


@register("rejected_subtasks", "WITH " + _TREE_SQL + """
SELECT task_id, CASE WHEN state IS NULL THEN 'task does not exist' WHEN state NOT IN ('FAILED', 'CANCELED') THEN 'primary task not failed'
                     ELSE 'no failed subtask' END AS reason
FROM req LEFT JOIN tasks t USING (task_id)
WHERE state IS NULL OR state NOT IN ('FAILED', 'CANCELED')
   OR (method NOT IN ('buildArch', 'buildSRPMFromSCM') AND NOT EXISTS (
       SELECT 1 FROM tasks k WHERE k.parent_id = t.task_id AND k.method IN ('buildArch', 'buildSRPMFromSCM') AND k.state = 'FAILED'))""")
def q_rejected_subtasks(spark, sf):
    e = _ev(spark, sf)
    req = e.select((F.col("user_id") + 1_000_000).alias("task_id")).distinct() \
        .unionByName(e.filter(F.col("event_id") % 97 == 0).select(F.col("event_id").alias("task_id"))) \
        .unionByName(e.filter(F.col("event_id") % 500 == 0).select((F.col("event_id") + 5_000_000).alias("task_id")))
    return S.select_failed_subtask(_tasks_tree(spark, sf), req)[1]


@register("jobs_without_failed_log", "WITH " + _LISTING_SQL + """,
more AS (SELECT DISTINCT user_id + 1000000 AS job_id FROM events WHERE event_type = 'view')
SELECT job_id, 'Could not detect failed architecture.' AS error FROM (SELECT job_id FROM l UNION SELECT job_id FROM more)
WHERE job_id NOT IN (SELECT job_id FROM rk)""")
def q_jobs_without_failed_log(spark, sf):
    """The listings, and as many jobs again whose archives hold no log of a failed task."""
    more = _ev(spark, sf).filter(F.col("event_type") == "view").select(
        (F.col("user_id") + 1_000_000).alias("job_id"), F.col("event_id").alias("pos"),
        F.lit("kojilogs/noarch-1/build.log").alias("path"), F.lit("fine").alias("content"))
    listing = _listing(spark, sf).select("job_id", "pos", "path", "content")
    return S.select_failed_log(listing.unionByName(more))[1]


@register("requests_of_conversations", """
SELECT conv_id AS request_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos,
       role AS artifact_name, text AS content, CAST(NULL AS VARCHAR) AS url FROM conversations""")
def q_requests_of_conversations(spark, sf):
    """Each conversation as one request whose files are its turns, exploded again."""
    from logsift.sources.requests import explode_requests
    c = table(spark, sf, "conversations")
    turn = F.struct("turn", F.col("role").alias("name"), F.col("text").alias("content"), F.lit(None).cast("string").alias("url"))
    whole = c.groupBy(F.col("conv_id").alias("request_id")).agg(F.array_sort(F.collect_list(turn)).alias("files"))
    return explode_requests(whole)

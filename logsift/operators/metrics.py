"""Request/response/feedback metrics.

Time series are long tables ``(metric, bucket, value)``; buckets are ``date_trunc`` of the
receive (or comment) time, in UTC, emitted as ``timestamp_ntz``. Empty buckets are absent.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift import constants as C


@dataclasses.dataclass(frozen=True)
class Period:
    start: dt.datetime
    end: dt.datetime
    grain: str  # 'hour' or 'day'


def period_bounds(weeks: int | None = None, days: int | None = None, hours: int | None = None,
                  end: dt.datetime | None = None) -> Period:
    """Exactly one of weeks/days/hours (default 2 days), positive. A naive end time is UTC.
    Hours use hourly buckets; days and weeks use daily buckets."""
    given = [v for v in (weeks, days, hours) if v is not None]
    if len(given) > 1:
        raise ValueError("give at most one of weeks, days and hours")
    if not given:
        days = 2
    for v in (weeks, days, hours):
        if v is not None and v <= 0:
            raise ValueError("a period needs a length above zero")
    end = end or dt.datetime.now(dt.timezone.utc)
    if end.tzinfo is None:
        end = end.replace(tzinfo=dt.timezone.utc)
    end = end.astimezone(dt.timezone.utc)
    if weeks:
        delta, grain = dt.timedelta(weeks=weeks), "day"
    elif days:
        delta, grain = dt.timedelta(days=days), "day"
    else:
        delta, grain = dt.timedelta(hours=hours), "hour"
    return Period(end - delta, end, grain)


def _ts(x: dt.datetime) -> Column:
    return F.lit(x.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp")


def _bucket(col: str, grain: str) -> Column:
    return F.date_trunc(grain, F.col(col)).cast("timestamp_ntz")


def _in_period(df: DataFrame, period: Period, endpoint: str | None) -> DataFrame:
    d = df.filter(F.col("request_received_at").between(_ts(period.start), _ts(period.end)))
    return d.filter(F.col("endpoint") == endpoint) if endpoint else d


def _seconds(a: str, b: str) -> Column:
    return (F.unix_micros(F.col(a)) - F.unix_micros(F.col(b))) / F.lit(1_000_000.0)


def request_series(rm: DataFrame, period: Period, endpoint: str | None = "analyze",
                   names: Sequence[str] = ("requests", "avg_response_time", "avg_response_length")) -> DataFrame:
    """The named request series, unsorted, from one pass and one aggregate over the rows of the period."""
    value = {
        "requests": F.count_distinct("id").cast("double"),
        # Null responses are skipped; a bucket without any response has mean time 0 and mean length null.
        "avg_response_time": F.coalesce(F.avg(_seconds("response_sent_at", "request_received_at")), F.lit(0.0)),
        "avg_response_length": F.avg("response_length"),
    }
    d = _in_period(rm, period, endpoint).groupBy(_bucket("request_received_at", period.grain).alias("bucket")).agg(
        *[value[n].alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
    return d.select("bucket", F.explode(pairs).alias("p")).select("p.metric", "bucket", "p.value")


def requests_per_bucket(rm: DataFrame, period: Period, endpoint: str = "analyze") -> DataFrame:
    """Distinct requests per bucket."""
    return request_series(rm, period, endpoint, ["requests"]).orderBy("bucket")


def avg_response_time(rm: DataFrame, period: Period, endpoint: str = "analyze") -> DataFrame:
    """Mean seconds from receipt to response; null responses are skipped, an all-null bucket is 0."""
    return request_series(rm, period, endpoint, ["avg_response_time"]).orderBy("bucket")


def avg_response_length(rm: DataFrame, period: Period, endpoint: str = "analyze") -> DataFrame:
    """Mean response length; an all-null bucket stays null."""
    return request_series(rm, period, endpoint, ["avg_response_length"]).orderBy("bucket")


def reaction_series(reactions: DataFrame, comments: DataFrame, period: Period) -> DataFrame:
    """Sum of reaction counts per (type, bucket of comment time) for comments created strictly
    after the period start (no upper bound); metric name ``emoji_<type>``."""
    c = comments.filter(F.col("created_at") > _ts(period.start)).select(
        F.col("id").alias("comment_id"), "created_at")
    j = reactions.join(c, "comment_id")
    return j.groupBy("reaction_type", _bucket("created_at", period.grain).alias("bucket")).agg(
        F.sum("cnt").cast("double").alias("value")).select(
        F.concat(F.lit("emoji_"), F.col("reaction_type")).alias("metric"), "bucket", "value")


def all_metrics(rm: DataFrame, reactions: DataFrame, comments: DataFrame, period: Period,
                endpoint: str = "analyze", kind: str = "all") -> DataFrame:
    """Union of the series selected by ``kind`` (all / requests / responses / emojis); reactions
    ignore the endpoint; missing values become 0."""
    names = [n for n, of in (("requests", "requests"), ("avg_response_time", "responses"), ("avg_response_length", "responses"))
             if kind in ("all", of)]
    parts = [request_series(rm, period, endpoint, names)] if names else []
    if kind in ("all", "emojis"):
        parts.append(reaction_series(reactions, comments, period))
    out = functools.reduce(DataFrame.unionByName, parts)
    return out.withColumn("value", F.when(F.isnan("value") | F.col("value").isNull(), 0.0)
                          .otherwise(F.col("value"))).orderBy("metric", "bucket")


#: Values of one key that are selected at once; more are narrowed down first.
SELECT_AT_ONCE = 4096
#: Intervals that one round tells apart.
INTERVALS = 1024


def _written(df: DataFrame) -> DataFrame:
    from logsift.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def kth_smallest(values: DataFrame, wanted: DataFrame, key: str, value: str, at_once: int = SELECT_AT_ONCE,
                 intervals: int = INTERVALS) -> tuple[DataFrame, int]:
    """``(key, rank, value)`` for ``wanted(key, rank, n, lo, hi)``, and the number of rounds: the value at each rank
    (from 0) of a key's ``n`` finite values between ``lo`` and ``hi``.

    A round counts the values of the interval in question in ``intervals`` equal parts (combined before the shuffle:
    at most that many rows per key, rank and task) and goes on with the part that holds the rank, as wide as the values
    in it reach. Least and greatest value are never in one part, so every round leaves fewer distinct values. An
    interval of one distinct value is the answer; one with few values is listed and sorted.
    """
    at = [key, "rank"]
    todo = wanted.select(key, "rank", F.col("rank").alias("left"), "n", "lo", "hi")
    within = F.col(value).between(F.col("lo"), F.col("hi"))
    told, rounds = [], 0
    while True:
        todo = _written(todo)
        told.append(todo.filter("lo = hi").select(*at, F.col("lo").alias(value)))
        few = values.join(todo.filter((F.col("lo") < F.col("hi")) & (F.col("n") <= at_once)), key).filter(within)
        told.append(few.groupBy(*at, "left").agg(F.array_sort(F.collect_list(value)).alias("vs")).select(
            *at, F.element_at("vs", F.col("left").cast("int") + 1).alias(value)))
        todo = todo.filter((F.col("lo") < F.col("hi")) & (F.col("n") > at_once))
        if todo.isEmpty():
            return functools.reduce(DataFrame.unionByName, told), rounds
        rounds += 1
        share = (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo"))
        part = F.when(F.col(value) >= F.col("hi"), intervals - 1).otherwise(F.floor(share * (intervals - 1)))
        parts = values.join(todo, key).filter(within).groupBy(*at, "left", part.alias("part")).agg(
            F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
        below = F.sum("n").over(Window.partitionBy(*at).orderBy("part")) - F.col("n")
        todo = parts.withColumn("below", below).filter(F.col("left").between(F.col("below"), F.col("below") + F.col("n") - 1)) \
            .select(*at, (F.col("left") - F.col("below")).alias("left"), "n", "lo", "hi")


def certainty(logprobs: DataFrame, key: str = "response_id", at_once: int = SELECT_AT_ONCE) -> DataFrame:
    """Median of ``exp(logprob) * 100`` per response, exact.

    Responses of up to ``at_once`` values are one aggregate; of the others the middle values are selected by
    ``kth_smallest``, so no task holds all values of a response. Null values do not count; a response with a NaN, or without any
    value, has no certainty (``certainty_rejects``)."""
    # exp is 0 and infinite beyond these bounds, so infinite log probabilities keep their certainty.
    bounded = F.when(F.col("logprob").isNotNull(), F.greatest(F.least(F.col("logprob"), F.lit(800.0)), F.lit(-800.0)))
    # Rows are joined by key, a null one, too: fields of structs compare as groups do.
    v = logprobs.select(F.struct(key).alias("of"), bounded.alias("v"), F.coalesce(F.isnan("logprob"), F.lit(False)).alias("bad"))
    per = v.groupBy("of").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("bad").alias("bad"))
    long = _written(per.filter(F.col("n") > at_once))
    percent = F.exp("v") * 100
    if not long.isEmpty():
        rest = v.join(long.select("of"), "of", "left_anti")
        middle = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)))
        wanted = long.filter("not bad").withColumn("rank", F.explode(middle))
        found, _ = kth_smallest(v.filter("v is not null").select("of", "v"), wanted, "of", "v", at_once)
        # One or two middle values; their halves are added as the aggregate does it.
        selected = found.groupBy("of").agg(F.when(F.count(F.lit(1)) == 1, F.max(percent)).otherwise(F.sum(percent * 0.5)).alias("certainty"))
    else:
        rest, selected = v, None
    out = rest.groupBy("of").agg(F.percentile(percent, F.lit(0.5)).alias("certainty"), F.max("bad").alias("bad")) \
        .filter("certainty is not null and not bad").drop("bad")
    return (out if selected is None else out.unionByName(selected)).select("of.*", "certainty")


def certainty_rejects(logprobs: DataFrame, key: str = "response_id") -> DataFrame:
    """Responses whose certainty cannot be computed: some log probability is NaN, or there is none."""
    per = logprobs.groupBy(key).agg(F.coalesce(F.max(F.isnan("logprob")), F.lit(False)).alias("bad"), F.count("logprob").alias("n"))
    return per.filter("bad or n = 0").select(key, F.when(F.col("bad"), "certainty is not a number")
                                             .otherwise("no log probability").alias("reason"))


def count_reactions(awards: DataFrame) -> DataFrame:
    """Occurrences per award name on the first note of each discussion."""
    first = awards.groupBy("discussion_id").agg(F.min("note_id").alias("note_id"))
    return awards.join(first, ["discussion_id", "note_id"], "left_semi") \
        .groupBy("discussion_id", F.col("name").alias("reaction_type")) \
        .agg(F.count(F.lit(1)).cast("bigint").alias("cnt"))


def pair_request_response(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Receipt rows left-joined with the response that later filled them in."""
    return requests.join(responses, "id", "left")


def link_to_job(rm: DataFrame, jobs: DataFrame, endpoint: str = "analyze_gitlab_job") -> DataFrame:
    """Attach the merge-request job of gitlab-job requests (request id = job id)."""
    j = jobs.select(F.col("id").alias("merge_request_job_id"))
    linked = rm.join(j, (rm["endpoint"] == endpoint) & (rm["id"] == j["merge_request_job_id"]), "left")
    return linked


def record_task_response(submissions: DataFrame, responses: DataFrame) -> DataFrame:
    """Per task: the last submission time (a restart moves it) and the first response
    (later responses are dropped). Both are partial aggregates."""
    s = submissions.groupBy("task_id").agg(F.max("received_at").alias("request_received_at"))
    r = responses.groupBy("task_id").agg(F.min_by("response_id", F.struct("responded_at", "response_id"))
                                         .alias("response_id"))
    return s.join(r, "task_id", "left")


def task_status(lookups: DataFrame, tasks: DataFrame, now: dt.datetime,
                timeout_min: int = C.TASK_ANALYSIS_TIMEOUT_MIN) -> DataFrame:
    """not_found / in_progress / timed_out (received + timeout < now) / done."""
    t = tasks.select("task_id", "request_received_at", "response_id")
    j = lookups.join(t, "task_id", "left")
    deadline = F.col("request_received_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(timeout_min))
    status = (F.when(F.col("request_received_at").isNull(), F.lit("not_found"))
              .when(F.col("response_id").isNotNull(), F.lit("done"))
              .when(deadline < _ts(now), F.lit("timed_out"))
              .otherwise(F.lit("in_progress")))
    return j.select("task_id", status.alias("status"))


def to_time_series(long: DataFrame) -> DataFrame:
    """``(metric, bucket, value)`` -> one row per metric with ``timestamps`` and ``values`` arrays
    in bucket order (the response shape). A series holds at most the buckets of one period."""
    g = long.groupBy("metric").agg(F.array_sort(F.collect_list(F.struct("bucket", "value"))).alias("s"))
    return g.select("metric", F.transform("s", lambda x: x["bucket"]).alias("timestamps"),
                    F.transform("s", lambda x: x["value"]).alias("values"))

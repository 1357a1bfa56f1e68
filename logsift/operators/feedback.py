"""Merge-request feedback tables: lookups (O43–O49e, O52), resubmission skip (O50),
set-based merges (O60, O63), uniqueness checks (O62) and latest comment (O73).

Lookups take a *table* of keys (bulk form) and use semi/anti joins; a single lookup is the
same call with a one-row key table. Merges never create duplicates and are idempotent:
running one twice yields the same table.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift import constants as C
from logsift.functions.text import known_forge

JOB_KEY = ["forge", "project_id", "mr_iid", "job_id"]
MR_KEY = ["forge", "project_id", "mr_iid"]


def _ts(x: dt.datetime):
    return F.lit(x.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp")


def comments_with_jobs(comments: DataFrame, jobs: DataFrame) -> DataFrame:
    j = jobs.select(F.col("id").alias("merge_request_job_id"), F.col("forge").alias("job_forge"),
                    "project_id", "mr_iid", "job_id")
    return comments.join(j, "merge_request_job_id")


def requests_of_jobs(metrics: DataFrame, jobs: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Metric rows linked to jobs, optionally restricted to a key table of JOB_KEY."""
    j = jobs.withColumnRenamed("id", "merge_request_job_id")
    if keys is not None:
        j = j.join(keys, JOB_KEY, "left_semi")
    return metrics.join(j, "merge_request_job_id")


def comment_by_forge_id(comments: DataFrame, jobs: DataFrame, keys: DataFrame) -> DataFrame:
    """Comments by (forge, comment_id) with their job."""
    return comments_with_jobs(comments.join(keys, ["forge", "comment_id"], "left_semi"), jobs)


def comments_of_mrs(comments: DataFrame, jobs: DataFrame, mrs: DataFrame | None = None) -> DataFrame:
    """Comments of merge requests, newest first (global sort, range-partitioned)."""
    c = comments_with_jobs(comments, jobs)
    if mrs is not None:
        c = c.join(mrs, MR_KEY, "left_semi")
    return c.orderBy(*MR_KEY, F.col("created_at").desc(), F.col("comment_id"))


def reactions_of_comments(reactions: DataFrame, comments: DataFrame, jobs: DataFrame,
                          keys: DataFrame | None = None, reaction_type: str | None = None) -> DataFrame:
    """Reactions with their comment and job, filtered by (forge, project, mr, job,
    comment_id) keys and optionally one reaction type."""
    c = comments_with_jobs(comments, jobs).select(
        F.col("id").alias("comment_pk"), "forge", "project_id", "mr_iid", "job_id", "comment_id", "created_at")
    r = reactions.withColumnRenamed("comment_id", "comment_pk")
    if reaction_type is not None:
        r = r.filter(F.col("reaction_type") == reaction_type)
    out = r.join(c, "comment_pk")
    if keys is not None:
        out = out.join(keys, [*JOB_KEY, "comment_id"], "left_semi")
    return out


def reactions_since(reactions: DataFrame, comments: DataFrame, since: dt.datetime) -> DataFrame:
    """Reactions whose comment was created strictly after ``since``."""
    c = comments.filter(F.col("created_at") > _ts(since)).select(F.col("id").alias("comment_id"), "created_at")
    return reactions.join(c, "comment_id")


def comments_since(comments: DataFrame, since: dt.datetime) -> DataFrame:
    """O49a."""
    return comments.filter(F.col("created_at") > _ts(since))


def comments_of_jobs(comments: DataFrame, jobs: DataFrame, keys: DataFrame) -> DataFrame:
    """The comment of given jobs."""
    j = jobs.join(keys, JOB_KEY, "left_semi").select(F.col("id").alias("merge_request_job_id"))
    return comments.join(j, "merge_request_job_id", "left_semi")


def jobs_of_mrs(jobs: DataFrame, mrs: DataFrame) -> DataFrame:
    """O49c."""
    return jobs.join(mrs, MR_KEY, "left_semi")


def lookup_by_id(table: DataFrame, ids: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """O49d/O49e: rows for the requested ids, plus the ids that do not exist (errors)."""
    found = table.join(ids, id_col, "left_semi")
    missing = ids.join(table.select(id_col), id_col, "left_anti")
    return found, missing


def skip_resubmissions(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """Incoming job events whose (forge, project, mr, job) is not known yet."""
    return events.join(jobs.select(*JOB_KEY), JOB_KEY, "left_anti")


def comments_for_forge(comments: DataFrame, jobs: DataFrame, forge: str, since: dt.datetime) -> DataFrame:
    """Comments of one configured forge created since ``since``, with their job."""
    c = comments_since(comments, since).filter(F.col("forge") == forge)
    return comments_with_jobs(c, jobs)


def split_known_forges(df: DataFrame, col: str = "forge",
                       forges: Sequence[str] = tuple(C.FORGES)) -> tuple[DataFrame, DataFrame]:
    """Rows of the configured forges and the rest."""
    ok = known_forge(col, forges)
    return df.filter(ok), df.filter(~ok)


def sync_reactions(current: DataFrame, snapshot: DataFrame, fetched: DataFrame) -> DataFrame:
    """New reactions table.

    ``snapshot(comment_id, reaction_type, cnt)`` holds the upstream counts of the comments listed
    in ``fetched(comment_id)``; for those comments counts are updated, new types inserted and
    types gone from the snapshot deleted. Comments not fetched (e.g. missing upstream) keep their
    rows. Idempotent: applying the same snapshot again changes nothing.
    """
    untouched = current.join(fetched, "comment_id", "left_anti")
    fresh = snapshot.join(fetched, "comment_id", "left_semi")
    return untouched.unionByName(fresh.select(*current.columns))


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once (empty when the constraint holds)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def _settle(candidates: DataFrame, uniques: Sequence[Sequence[str]]) -> DataFrame:
    """Adds ``accepted``: rows taken in id order, each only if none of its keys is taken yet.

    Rounds instead of a sequential scan: a row that comes first under all its keys is taken, rows that
    share a key with a taken one fall out, and the rest go on until no row is left. A round is cut by
    a reliable checkpoint; rows without conflicts (nearly all) are settled in the first.
    """
    from logsift.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(candidates.sparkSession)
    left, done = candidates.checkpoint(), None
    while True:
        first = left
        for i, key in enumerate(uniques):
            least = left.groupBy(*key).agg(F.min("id").alias(f"__first{i}"))
            first = first.join(least, list(key))
        ok = F.lit(True)
        for i in range(len(uniques)):
            ok = ok & (F.col("id") == F.col(f"__first{i}"))
        taken = first.filter(ok).select(*candidates.columns).dropDuplicates(["id"]).checkpoint()
        rest = left.join(taken.select("id"), "id", "left_anti")
        clash = F.lit(False)
        for i, key in enumerate(uniques):
            rest = rest.join(taken.select(*key).distinct().withColumn(f"__hit{i}", F.lit(True)), list(key), "left")
            clash = clash | F.col(f"__hit{i}").isNotNull()
        rest = rest.withColumn("__clash", clash).checkpoint()
        settled = taken.withColumn("accepted", F.lit(True)).unionByName(
            rest.filter("__clash").select(*candidates.columns).withColumn("accepted", F.lit(False)))
        done = settled if done is None else done.unionByName(settled)
        left = rest.filter("not __clash").select(*candidates.columns)
        if left.isEmpty():
            return done


def merge_jobs(jobs: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs after adding those of ``incoming(id, forge, project_id, mr_iid, job_id)`` that are
    new, and the rejected rows ``(id, reason)``.

    A job is unique per (forge, job_id). A row that repeats a known job as it is adds nothing and is
    no reject; one that names a known (forge, job_id) under another project or merge request is. The
    lowest id wins inside the batch.
    """
    known = incoming.join(jobs.select(*JOB_KEY), JOB_KEY, "left_anti")
    new = known.groupBy(*JOB_KEY).agg(F.min("id").alias("id"))
    taken = new.join(jobs.select("forge", "job_id"), ["forge", "job_id"], "left_anti")
    first = taken.groupBy("forge", "job_id").agg(F.min_by(F.struct("id", "project_id", "mr_iid"), "id").alias("j"))
    added = first.select("j.id", "forge", "j.project_id", "j.mr_iid", "job_id")
    after = jobs.unionByName(added.select(*jobs.columns))
    rejects = incoming.join(after.select(*JOB_KEY), JOB_KEY, "left_anti").select(
        "id", F.lit("job belongs to another merge request").alias("reason"))
    return after, rejects


def get_or_create_jobs(jobs: DataFrame, incoming: DataFrame) -> DataFrame:
    """The jobs of ``merge_jobs``."""
    return merge_jobs(jobs, incoming)[0]


def merge_comments(comments: DataFrame, jobs: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A comment implies its job. ``incoming`` has JOB_KEY + (id, comment_id, created_at).

    Returns jobs and comments after the merge and the rejects ``(id, reason)``. Comments are unique
    per (forge, comment_id) and per job: known ones stay, of the incoming the lowest id wins, the
    others are rejected.
    """
    jobs2, bad_jobs = merge_jobs(jobs, incoming.select("id", *JOB_KEY))
    ids = jobs2.select(F.col("id").alias("merge_request_job_id"), *JOB_KEY)
    named = incoming.join(ids, JOB_KEY).select("id", "merge_request_job_id", "forge", "comment_id", "created_at")
    free = named.join(comments.select("forge", "comment_id"), ["forge", "comment_id"], "left_anti") \
        .join(comments.select("merge_request_job_id"), "merge_request_job_id", "left_anti")
    settled = _settle(free, (["forge", "comment_id"], ["merge_request_job_id"]))
    new = settled.filter("accepted")
    same = named.join(comments.select("forge", "comment_id", "merge_request_job_id"),
                      ["forge", "comment_id", "merge_request_job_id"], "left_semi")
    bad = named.join(new.select("id"), "id", "left_anti").join(same.select("id"), "id", "left_anti").select(
        "id", F.lit("comment or its job is taken").alias("reason"))
    return jobs2, comments.unionByName(new.select(*comments.columns)), bad_jobs.unionByName(bad)


def get_or_create_comments(comments: DataFrame, jobs: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs and comments of ``merge_comments``."""
    return merge_comments(comments, jobs, incoming)[:2]


def latest_snapshots(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(snapshot, fetched)`` for ``sync_reactions`` out of ``(comment_id, snapshot_time, reactions
    array<struct<reaction_type, cnt>>)``: the newest snapshot of each comment counts as a whole, and a
    comment whose newest snapshot is empty or null is fetched all the same, so its rows go. Snapshots of
    one time: the one with more reaction types; a type repeated inside a snapshot counts by its maximum.
    """
    latest = batch.filter("comment_id is not null").groupBy("comment_id").agg(F.max_by(
        F.coalesce("reactions", F.array().cast("array<struct<reaction_type:string,cnt:bigint>>")),
        F.struct("snapshot_time", F.size("reactions"), F.xxhash64("reactions"))).alias("reactions"))
    rows = latest.select("comment_id", F.explode("reactions").alias("r")).groupBy(
        "comment_id", F.col("r.reaction_type").alias("reaction_type")).agg(F.max("r.cnt").cast("bigint").alias("cnt"))
    return rows, latest.select("comment_id")


def latest_comment(comments: DataFrame, jobs: DataFrame) -> DataFrame:
    """Newest comment per merge request (ties: highest comment row id)."""
    c = comments_with_jobs(comments, jobs)
    return c.groupBy(*MR_KEY).agg(
        F.max_by(F.struct("id", "comment_id", "created_at"), F.struct("created_at", "id")).alias("c")) \
        .select(*MR_KEY, F.col("c.id").alias("id"), F.col("c.comment_id").alias("comment_id"),
                F.col("c.created_at").alias("created_at"))

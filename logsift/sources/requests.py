"""Analysis requests: explode (O02), validation (O06), request budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift import constants as C
from logsift.plans.scan import blocked_cumsum, line_block

ARTIFACT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("url", T.StringType()),
])


def explode_requests(df: DataFrame, files_col: str = "files", id_col: str = "request_id") -> DataFrame:
    """``(request_id, files array<struct<name, content, url>>)`` -> ordered artifact rows."""
    return df.select(id_col, F.posexplode(files_col).alias("pos", "f")).select(
        id_col, F.col("pos").cast("int").alias("pos"), F.col("f.name").alias("artifact_name"),
        F.col("f.content").alias("content"), F.col("f.url").alias("url"))


def validate_artifacts(a: DataFrame, max_files: int = C.MAX_FILES_PER_REQUEST) -> DataFrame:
    """Violations ``(request_id, pos, violation)`` of an artifact table
    ``(request_id, pos, artifact_name, content, url)``.

    Counts per request and per (request, name) are partial aggregates joined back, so a large
    request never funnels its rows through one window task.
    """
    name_ok = (F.length("artifact_name").between(1, 255)
               & F.col("artifact_name").rlike(C.ARTIFACT_NAME_RE))
    bad_name = a.filter(~F.coalesce(name_ok, F.lit(False))).select(
        "request_id", "pos", F.lit("bad_name").alias("violation"))
    xor = a.filter(F.col("content").isNull() == F.col("url").isNull()).select(
        "request_id", "pos", F.lit("content_xor_url").alias("violation"))
    n = a.groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_files)
    too_many = a.join(n, "request_id", "left_semi").select(
        "request_id", "pos", F.lit("file_count").alias("violation"))
    d = a.groupBy("request_id", "artifact_name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    dup = a.join(d, ["request_id", "artifact_name"], "left_semi").select(
        "request_id", "pos", F.lit("duplicate_name").alias("violation"))
    return bad_name.unionByName(xor).unionByName(too_many).unionByName(dup)


def admit_by_request_budget(files: DataFrame, limit: int) -> DataFrame:
    """Per URL file of a request ``(request_id, pos, size, is_url)``: the cap that remains
    (``limit - request_size - earlier URL sizes``) and whether it is admitted.

    Inline files are already part of the request size. Sizes are non-negative, so the first
    rejection also rejects every later file: a prefix sum is exact. The prefix sum is blocked
    by file position so one huge request stays spread over many tasks.
    """
    req = files.groupBy("request_id").agg(
        F.sum(F.when(~F.col("is_url"), F.col("size")).otherwise(0)).alias("request_size"))
    urls = files.filter(F.col("is_url"))
    urls = blocked_cumsum(urls, ["request_id"], ["pos"], line_block("pos"),
                          {"before": F.col("size")}, inclusive=False)
    rem = F.lit(limit) - F.col("request_size") - F.col("before")
    return urls.join(req, "request_id").select(
        "request_id", "pos", "size", rem.cast("bigint").alias("remaining_limit"),
        ((rem > 0) & (F.col("size") <= rem)).alias("admitted"))

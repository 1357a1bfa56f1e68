"""Failed-log selection.

Choices "one row per job/task by architecture preference" are ``min_by`` aggregates over a
rank struct, so they aggregate partially before the shuffle (no per-job window).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift import constants as C


def arch_rank(arch: Column, preference: Sequence[str]) -> Column:
    """Struct ordering archs: preferred ones in list order, then the rest alphabetically."""
    pos = F.array_position(F.array(*[F.lit(a) for a in preference]), arch)
    return F.struct(F.when(pos > 0, pos).otherwise(F.lit(len(preference) + 1)).alias("p"),
                    arch.alias("a"))


def select_failed_log(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From archive listings ``(job_id, pos, path, content)`` choose one log per job.

    ``*task_failed.log`` entries only. A path of at most 3 parts is the top-level entry
    (arch ``~toplevel``, sorts last). Otherwise arch = part of the parent directory before ``-``
    and the log is the first ``\\w*.log`` named in the file's content (in the same directory),
    or the file itself. Per arch the later listing entry wins. Returns (chosen, jobs_without).
    """
    f = files.filter(F.col("path").endswith("task_failed.log"))
    parts = F.split("path", "/")
    n = F.size(parts)
    parent = F.element_at(parts, -2)
    arch = F.when(n <= 3, F.lit(C.TOPLEVEL_ARCH)).otherwise(F.split(parent, "-")[0])
    named = F.regexp_extract("content", C.FAILED_LOG_NAME_RE, 1)
    parent_dir = F.regexp_replace("path", "/[^/]*$", "")
    log_path = F.when((n > 3) & (named != ""), F.concat(parent_dir, F.lit("/"), named)).otherwise(F.col("path"))
    f = f.select("job_id", "pos", arch.alias("arch"), log_path.alias("log_path"))
    per_arch = f.groupBy("job_id", "arch").agg(F.max_by("log_path", "pos").alias("log_path"))
    chosen = per_arch.groupBy("job_id").agg(
        F.min_by(F.struct("arch", "log_path"), arch_rank(F.col("arch"), C.ARCH_PREFERENCE)).alias("c")) \
        .select("job_id", F.col("c.arch").alias("arch"), F.col("c.log_path").alias("log_path"))
    missing = files.select("job_id").distinct().join(chosen, "job_id", "left_anti") \
        .select("job_id", F.lit("Could not detect failed architecture.").alias("error"))
    return chosen, missing


FAILED, CANCELED = "FAILED", "CANCELED"


def select_failed_subtask(tasks: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For requested task ids pick the failed build subtask.

    ``tasks(task_id, parent_id, method, state, arch)``. The requested task must be FAILED or
    CANCELED; a buildArch / buildSRPMFromSCM task is returned as is; otherwise its FAILED
    buildArch / buildSRPMFromSCM children are ranked x86_64 > aarch64 > riscv > ppc64le > s390x >
    alphabetical. Returns (chosen(task_id, subtask_id, arch), rejects(task_id, reason)).
    """
    req = requested.join(tasks, "task_id", "left")
    not_found = req.filter(F.col("state").isNull()).select("task_id", F.lit("task does not exist").alias("reason"))
    bad_state = req.filter(F.col("state").isNotNull() & ~F.col("state").isin(FAILED, CANCELED)) \
        .select("task_id", F.lit("primary task not failed").alias("reason"))
    ok = req.filter(F.col("state").isin(FAILED, CANCELED))
    direct = ok.filter(F.col("method").isin(C.SUBTASK_METHODS)).select(
        "task_id", F.col("task_id").alias("subtask_id"), "arch")
    parents = ok.filter(~F.col("method").isin(C.SUBTASK_METHODS)).select(F.col("task_id").alias("parent_id"))
    children = tasks.filter(F.col("method").isin(C.SUBTASK_METHODS) & (F.col("state") == FAILED)) \
        .join(parents, "parent_id", "left_semi")
    per_arch = children.groupBy("parent_id", "arch").agg(F.max("task_id").alias("subtask_id"))
    picked = per_arch.groupBy("parent_id").agg(
        F.min_by(F.struct("subtask_id", "arch"), arch_rank(F.col("arch"), C.SUBTASK_ARCH_PREFERENCE)).alias("c")) \
        .select(F.col("parent_id").alias("task_id"), F.col("c.subtask_id").alias("subtask_id"),
                F.col("c.arch").alias("arch"))
    none = parents.withColumnRenamed("parent_id", "task_id").join(picked, "task_id", "left_anti") \
        .select("task_id", F.lit("no failed subtask").alias("reason"))
    return direct.unionByName(picked), not_found.unionByName(bad_state).unionByName(none)


def failed_log_of_task(faults: DataFrame, outputs: DataFrame, max_size: int) -> DataFrame:
    """``faults(task_id, fault)``, ``outputs(task_id, name, size)`` -> ``(task_id, log_name,
    status, log_text)``: the log named in the fault (first ``\\w*.log``), else the fault text itself as
    ``task_failed.log`` (``log_text`` holds it); status ok / missing / too_large / fault_text."""
    named = F.regexp_extract("fault", C.FAILED_LOG_NAME_RE, 1)
    f = faults.select("task_id", F.when(named == "", F.lit("task_failed.log")).otherwise(named).alias("log_name"),
                      (named == "").alias("from_fault"), "fault")
    o = outputs.select("task_id", F.col("name").alias("log_name"), "size")
    anyo = outputs.select("task_id").distinct().withColumn("has_output", F.lit(True))
    j = f.join(o, ["task_id", "log_name"], "left").join(anyo, "task_id", "left")
    status = (F.when(F.col("from_fault"), F.lit("fault_text"))
              .when(F.col("has_output").isNull(), F.lit("missing"))
              .when(F.col("size").isNull(), F.lit("missing"))
              .when(F.col("size") > max_size, F.lit("too_large"))
              .otherwise(F.lit("ok")))
    return j.select("task_id", "log_name", status.alias("status"), F.when(F.col("from_fault"), F.col("fault")).alias("log_text"))


def version_key(v: Column) -> Column:
    """Sort key of a package version: ``array<string>``, compared element by element.

    Runs of digits and runs of letters are segments, all other characters only separate. Each
    segment starts with its rank: ``~`` sorts before the end of a version, the end before ``^``,
    then letters (by character), then numbers (by value, of any length). A null version is empty.
    """
    digits = lambda s: F.regexp_replace(s, "^0+(?=[0-9])", "")
    segments = F.regexp_extract_all(F.coalesce(v, F.lit("")), F.lit("([0-9]+|[A-Za-z]+|~|\\^)"), 1)
    ranked = F.transform(segments, lambda s: F.when(s == "~", F.lit("0")).when(s == "^", F.lit("2"))
                         .when(s.rlike("^[0-9]"), F.concat(F.lit("4"), F.lpad(F.length(digits(s)).cast("string"), 10, "0"), digits(s)))
                         .otherwise(F.concat(F.lit("3"), s)))
    return F.concat(ranked, F.array(F.lit("1")))


def fixed_later(builds: DataFrame, after: str, n: int = 200) -> DataFrame:
    """Latest ``n`` failed ``build``-method builds completed after ``after``, each with the first
    later COMPLETE build of the same package whose (version, release) is greater.

    The failed side is at most ``n`` rows (a top-k), so it is broadcast with a proven bound; the
    complete side streams once and pairs are reduced map-side by ``min_by``.
    """
    failed = builds.filter((F.col("state") == "FAILED") & (F.col("completion_time") > F.lit(after).cast("timestamp"))) \
        .orderBy(F.col("build_id").desc()).limit(n) \
        .filter(F.col("method") == "build")
    f = failed.select("build_id", "package_id", F.col("completion_time").alias("failed_at"),
                      version_key(F.col("version")).alias("fv"), version_key(F.col("release")).alias("fr"))
    c = builds.filter(F.col("state") == "COMPLETE").select(
        F.col("build_id").alias("newer_build_id"), "package_id", F.col("completion_time").alias("done_at"),
        version_key(F.col("version")).alias("cv"), version_key(F.col("release")).alias("cr"))
    cond = ((f["package_id"] == c["package_id"]) & (c["done_at"] > f["failed_at"])
            & ((c["cv"] > f["fv"]) | ((c["cv"] == f["fv"]) & (c["cr"] > f["fr"]))))
    pairs = c.join(F.broadcast(f), cond, "inner")
    newer = pairs.groupBy("build_id").agg(F.min("newer_build_id").alias("newer_build_id"))
    return f.select("build_id", "package_id").join(newer, "build_id", "left")

"""Log files as rows (O01) and engine tables on Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift import constants as C


def read_logs(spark: SparkSession, path: str, max_bytes: int = C.MAX_ARTIFACT_MIB * 1024 * 1024,
              glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One row per log file: ``(artifact_id, path, artifact_name, n_bytes, text)`` and rejects
    ``(path, n_bytes, reason)``.

    The size check runs on file metadata before any content is decoded; oversize files are
    rejected with a reason. Undecodable bytes are replaced (UTF-8 with replacement characters).
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.load(path)
    meta = raw.select("path", F.col("length").alias("n_bytes"))
    rejects = meta.filter(F.col("n_bytes") > max_bytes).withColumn(
        "reason", F.concat(F.lit("larger than "), F.lit(str(max_bytes)), F.lit(" bytes")))
    ok = raw.filter(F.col("length") <= max_bytes).select(
        F.xxhash64("path").alias("artifact_id"), "path",
        F.regexp_extract("path", "([^/]*)$", 1).alias("artifact_name"),
        F.col("length").alias("n_bytes"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return ok, rejects


def write_table(df: DataFrame, root: str, name: str, mode: str = "append",
                partition_by: list[str] | None = None) -> None:
    """Write an engine table (Parquet). Metrics tables are partitioned by day for pruning."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def with_day(df: DataFrame, ts_col: str = "request_received_at") -> DataFrame:
    """Adds the ``day`` partition column used by the metrics tables."""
    return df.withColumn("day", F.to_date(F.col(ts_col)))

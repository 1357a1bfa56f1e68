"""Annotation contributions: archive dates (O08), reading JSON files (O07) and strict
validation (O70).

Contributions are JSON documents ``{fail_reason, how_to_fix, logs: {name: {snippets: [...]}}}``.
Validation is done on ``VARIANT`` values so every level is type-checked: a string field that
holds an object is rejected, a mixed snippet list keeps only its good items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift import constants as C


def archive_date(name: Column | str) -> Column:
    n = F.col(name) if isinstance(name, str) else name
    v = F.regexp_extract(n, C.ARCHIVE_DATE_RE, 1)
    return F.when(v == "", F.lit(None)).otherwise(F.to_date(v, "yyyy-MM-dd"))


def is_stale(d: Column, today: Column, max_age_days: int = C.ARCHIVE_MAX_AGE_DAYS) -> Column:
    return F.datediff(today, d) > max_age_days


def read_contributions(spark: SparkSession, root: str) -> DataFrame:
    """``(source_path, raw)`` for ``*.json`` files under ``results/results/`` below ``root``.

    Absolute or ``..`` member paths are refused; each file is one row (whole text)."""
    df = (spark.read.option("wholetext", "true").option("recursiveFileLookup", "true")
          .option("pathGlobFilter", "*.json").text(root)
          .select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("raw")))
    rel = F.regexp_extract("file_path", "(results/results/.*)$", 1)
    df = df.select(rel.alias("source_path"), "raw")
    parts = F.split("source_path", "/")
    safe = (F.col("source_path") != "") & ~F.array_contains(parts, "..") & ~F.col("source_path").startswith("/")
    return df.filter(safe)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _truthy_string(v: Column) -> Column:
    """A JSON string with at least one character."""
    s = F.try_variant_get(v, "$", "string")
    return _is(v, "STRING") & F.coalesce(F.length(s) > 0, F.lit(False))


def parse_contributions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validate ``(source_path, raw)`` into ``(builds, rejects)``.

    builds: ``(source_path, fail_reason, how_to_fix, snippets array<struct<log_name, text, user_comment>>)``
    rejects: ``(source_path, reason)``.
    """
    v = raw.select("source_path", F.try_parse_json("raw").alias("v"))
    v = v.withColumn("is_obj", _is(F.col("v"), "OBJECT"))
    fr = F.try_variant_get("v", "$.fail_reason", "variant")
    hf = F.try_variant_get("v", "$.how_to_fix", "variant")
    logs = F.try_variant_get("v", "$.logs", "variant")
    v = v.withColumn("fr_ok", _truthy_string(fr)).withColumn("hf_ok", _truthy_string(hf)) \
        .withColumn("logs_ok", _is(logs, "OBJECT"))
    # Walk logs -> entries -> snippet items with typed guards at every level.
    entries = F.try_variant_get("v", "$.logs", "map<string,variant>")
    v = v.withColumn("entries", F.when(F.col("is_obj") & F.col("logs_ok"), entries))

    def keep_items(entry):
        items = F.try_variant_get(entry, "$.snippets", "array<variant>")
        good = F.filter(F.coalesce(items, F.array().cast("array<variant>")),
                        lambda it: _is(it, "OBJECT")
                        & _truthy_value(F.try_variant_get(it, "$.text", "variant"))
                        & _truthy_value(F.try_variant_get(it, "$.user_comment", "variant")))
        return F.when(_is(entry, "OBJECT"), good).otherwise(F.array().cast("array<variant>"))

    per_log = F.transform(F.map_entries(F.coalesce("entries", F.create_map().cast("map<string,variant>"))),
                          lambda e: F.transform(keep_items(e["value"]), lambda it: F.struct(
                              e["key"].alias("log_name"),
                              F.try_variant_get(it, "$.text", "string").alias("text"),
                              F.try_variant_get(it, "$.user_comment", "string").alias("user_comment"))))
    v = v.withColumn("snippets", F.flatten(per_log))
    reason = (F.when(F.col("v").isNull(), F.lit("malformed json"))
              .when(~F.col("is_obj"), F.lit("not an object"))
              .when(~F.col("fr_ok"), F.lit("bad fail_reason"))
              .when(~F.col("hf_ok"), F.lit("bad how_to_fix"))
              .when(~F.col("logs_ok"), F.lit("logs must be an object"))
              .when(F.size("snippets") == 0, F.lit("no valid snippets found")))
    v = v.withColumn("reason", reason)
    builds = v.filter(F.col("reason").isNull()).select(
        "source_path", F.try_variant_get("v", "$.fail_reason", "string").alias("fail_reason"),
        F.try_variant_get("v", "$.how_to_fix", "string").alias("how_to_fix"), "snippets")
    rejects = v.filter(F.col("reason").isNotNull()).select("source_path", "reason")
    return builds, rejects


def _truthy_value(v: Column) -> Column:
    """Python truthiness of a JSON value used as snippet text/comment (must be a non-empty
    string to pass the later ``min_length=1`` string check)."""
    return _truthy_string(v)

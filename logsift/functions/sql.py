"""SQL access: pure-column operators as SQL functions, derived tables as temp views.

The functions are SQL UDFs (``CREATE TEMPORARY FUNCTION ... RETURN <expr>``): Spark inlines
their bodies into the plan, so they stay JVM-side and inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from logsift import constants as C
from logsift.functions.text import REDACTIONS


def _raw(s: str) -> str:
    if "'" in s:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "r'" + s + "'"


def _chain(arg: str, steps) -> str:
    out = arg
    for pattern, repl in steps:
        out = f"regexp_replace({out}, {_raw(pattern)}, {_raw(repl)})"
    return out


def register_functions(spark: SparkSession) -> list[str]:
    border = f"((n - {len(C.TRUNCATE_MIDDLE)}) div 2)"
    mid = C.TRUNCATE_MIDDLE.replace("\n", "\\n")
    defs = {
        "ls_sanitize(t STRING) RETURNS STRING":
            _chain("t", [("(?iU)" + p, r) for p, r in REDACTIONS]),
        "ls_mask(t STRING) RETURNS STRING":
            _chain("t", [("(?dU)" + p, C.MASK_PREFIX + tag + C.MASK_SUFFIX) for p, tag in C.MASK_RULES]),
        "ls_truncate_head(t STRING, n INT) RETURNS STRING":
            f"CASE WHEN length(t) > n THEN concat(left(t, greatest(n - {len(C.TRUNCATED)}, 0)), "
            f"'{C.TRUNCATED}') ELSE t END",
        "ls_truncate_middle(t STRING, n INT) RETURNS STRING":
            f"CASE WHEN length(t) > n THEN concat(left(t, {border}), '{mid}', right(t, {border})) ELSE t END",
        "ls_has_leading_close_tag(t STRING) RETURNS BOOLEAN":
            "coalesce(t rlike r'(?s)\\A</[^<]+>', false)",
        "ls_merge_request_id(r STRING) RETURNS BIGINT":
            f"CAST(nullif(regexp_extract(r, {_raw(C.MR_REF_RE)}, 1), '') AS BIGINT)",
        "ls_starts_message(line STRING) RETURNS BOOLEAN":
            "NOT (line rlike r'(?U)\\A[\\s\\x1C-\\x1F|]')",
    }
    names = []
    for sig, body in defs.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {sig} RETURN {body}")
        names.append(sig.split("(")[0])
    return names


def register_views(spark: SparkSession, sf_dir: str) -> list[str]:
    """Temp views of the driver tables and the derived views built by Spark."""
    from logsift.plans import views as V
    for t in V.TABLES:
        V.table(spark, sf_dir, t).createOrReplaceTempView(t)
    ev = V.table(spark, sf_dir, "events")
    derived = {"log_lines": V.log_lines(ev), "request_metrics": V.request_metrics(ev), "jobs": V.jobs(ev),
               "comments": V.comments(ev), "reactions": V.reactions(ev)}
    for name, df in derived.items():
        df.createOrReplaceTempView(name)
    return [*V.TABLES, *derived]

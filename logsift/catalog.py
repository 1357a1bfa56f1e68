"""Registered queries: a Spark implementation and (where expressible) the DuckDB SQL oracle.

Every query reads the driver tables (or views Spark derives from them) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def noise_sql(text: str, rules, source_file: str | None = None) -> str:
    """DuckDB predicate for the noise rules (RE2 partial match anchored at the start)."""
    glob = [p for _, p, files in rules if not files]
    parts = []
    if glob:
        parts.append(f"regexp_matches({text}, {sql_str('(?s)^(?:' + '|'.join(glob) + ')')})")
    if source_file:
        for _, p, files in rules:
            if files:
                fl = ", ".join(sql_str(f) for f in files)
                parts.append(f"({source_file} IN ({fl}) AND regexp_matches({text}, {sql_str('(?s)^(?:' + p + ')')}))")
    return "(" + " OR ".join(parts) + ")" if parts else "FALSE"


# Importing the modules fills the registry.
from logsift import queries as _queries  # noqa: E402,F401

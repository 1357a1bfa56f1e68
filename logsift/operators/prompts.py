"""Prompt assembly (O21, O22) and summary ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift import constants as C


def format_snippets(snippets: DataFrame, keys: Sequence[str], line_col: str | None = "line_number",
                    text_col: str = "text") -> DataFrame:
    """One text block per group: leading newline, then for snippet ``i`` (0-based, line order)
    ``Snippet No. i at line #n:`` (or ``Snippet No. i:`` without a line), a blank line, the text,
    and the 16-character delimiter. Groups are the snippets of one log (at most k of them)."""
    keys = list(keys)
    line = F.col(line_col) if line_col else F.lit(None).cast("bigint")
    grp = snippets.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(line.alias("n"), F.col(text_col).alias("t")))).alias("s"))

    def block(x, i):
        header = F.when(x["n"].isNull(), F.concat(F.lit("Snippet No. "), i.cast("string"), F.lit(":"))) \
            .otherwise(F.concat(F.lit("Snippet No. "), i.cast("string"), F.lit(" at line #"),
                                x["n"].cast("string"), F.lit(":")))
        return F.concat(header, F.lit("\n\n"), x["t"], F.lit("\n" + C.SNIPPET_DELIMITER + "\n\n"))

    return grp.select(*keys, F.concat(F.lit("\n"), F.array_join(F.transform("s", block), "")).alias("summary"))


def to_messages(df: DataFrame, system_prompt: Column, user_message: Column,
                system_role: Column, user_role: Column) -> DataFrame:
    """Adds ``messages array<struct<role, content>>``: one concatenated message when the two
    roles are equal, else a system message and a user message."""
    one = F.array(F.struct(system_role.alias("role"),
                           F.concat(system_prompt, F.lit("\n"), user_message).alias("content")))
    two = F.array(F.struct(system_role.alias("role"), system_prompt.alias("content")),
                  F.struct(user_role.alias("role"), user_message.alias("content")))
    return df.withColumn("messages", F.when(system_role == user_role, one).otherwise(two))


def compression_ratio(snippets: DataFrame, logs: DataFrame, key: str = "artifact_id") -> DataFrame:
    """chars of newline-joined snippet texts / chars of the log; null for an empty log.

    ``logs`` is ``(key, log_chars)``. Only sums are shuffled (partial aggregation)."""
    s = snippets.groupBy(key).agg(
        (F.sum(F.length("text")) + F.count(F.lit(1)) - 1).alias("snippet_chars"))
    return logs.join(s, key, "left").select(
        key, F.try_divide(F.coalesce(F.col("snippet_chars"), F.lit(0)).cast("double"),
                          F.when(F.col("log_chars") > 0, F.col("log_chars")).cast("double")).alias("ratio"))

"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger row keeps the measurements and one integer
whose bit k is set when rule k failed. Policies are versioned sets of rules, applied afterwards with
one bitwise AND, and ablations (what a policy would drop without one of its rules) are counted from
the distinct bit patterns, so neither needs the texts again.

Words are runs of characters other than U+0020 and U+0009 to U+000D. All rules compare integers.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import bounded_batches, text_or_empty

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
            "n_letters", "n_marks", "longest_word")
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
MARKS = b"!?"


def _triples_repeated(ids: np.ndarray, n_ids: int) -> int:
    """Positions covered by windows of three ids that occur at least twice."""
    if len(ids) < 4:
        return 0
    first = ids[:-2] * n_ids + ids[1:-1]
    if n_ids >= 1 << 21:  # three factors no longer fit 63 bits
        first = np.unique(first, return_inverse=True)[1]
    key = first * n_ids + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift:len(key) + shift] |= twice
    return int(covered.sum())


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of ``MEASURES``."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return (len(words), len(text) - (len(raw) - len(raw.translate(None, BLANKS))),
            len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            _triples_repeated(ids, len(number)), len(lines), upper, upper + lower,
            len(raw) - len(raw.translate(None, MARKS)),
            max((len(w) if w.isascii() else len(w.decode("utf-8", "surrogatepass")) for w in number), default=0))


@dataclass(frozen=True)
class Rule:
    """One bit of the ledger: ``failed`` says when a row of measurements breaks the rule."""

    bit: int
    name: str
    failed: Callable[[Callable[[str], Column]], Column]


# Bits are never reused: a retired rule keeps its place, so stored ledgers stay readable.
RULES = (
    Rule(0, "too_few_words", lambda m: m("n_words") < 50),
    Rule(1, "repeated_word_windows", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    Rule(2, "symbols", lambda m: 100 * m("n_symbols") > 10 * m("n_words")),
    Rule(3, "repeated_lines", lambda m: 100 * m("n_dup_lines") > 50 * m("n_lines")),
    Rule(4, "capitals", lambda m: 100 * m("n_upper") > 50 * m("n_letters")),
    Rule(5, "marks", lambda m: 100 * m("n_marks") > 50 * m("n_words")),
    Rule(6, "word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 20 * m("n_words"))),
    Rule(7, "endless_word", lambda m: m("longest_word") > 1000),
)
BASE = ("too_few_words", "repeated_word_windows")


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a document passes when none of them failed."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bit = {r.name: 1 << r.bit for r in RULES}
        return functools.reduce(operator.or_, (bit[name] for name in self.rules), 0)


POLICIES = {p.version: p for p in (
    Policy("base", BASE),
    Policy("v1", (*BASE, "symbols", "repeated_lines")),
    Policy("v2", (*BASE, "symbols", "repeated_lines", "capitals", "marks", "word_length", "endless_word")),
)}


def ledger(docs: DataFrame, text: str = "text", measures: str = "measures", failed: str = "failed") -> DataFrame:
    """``docs`` plus a struct of measurements and the bit mask (long) of the rules that failed.

    Null text counts as empty: no words, which fails ``too_few_words``. Rows are independent;
    repeated rows and other columns pass through; an empty table gives an empty ledger.
    """
    bounded_batches(docs.sparkSession)
    form = ", ".join(f"{m} long" for m in MEASURES)

    @F.pandas_udf(f"struct<{form}>")
    def measured(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            yield pd.DataFrame(np.array([measure(t) for t in s], np.int64).reshape(-1, len(MEASURES)),
                               columns=list(MEASURES))

    marked = docs.withColumn(measures, measured(text_or_empty(text)))
    bits = [F.when(r.failed(lambda m: F.col(f"{measures}.{m}")), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long")
            for r in RULES]
    return marked.withColumn(failed, functools.reduce(lambda a, b: a.bitwiseOR(b), bits))


def passes(policy: Policy, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def only_rule(policy: Policy, failed: str = "failed") -> Column:
    """The rule of the policy that a document fails alone, so that it would pass without it; null for all others."""
    bits = F.col(failed).bitwiseAND(F.lit(policy.mask).cast("long"))
    return F.coalesce(*[F.when(bits == 1 << r.bit, F.lit(r.name)) for r in RULES if r.name in policy.rules])


def ablation(kept_ledger: DataFrame, policy: Policy, failed: str = "failed") -> DataFrame:
    """One row per rule of the policy: documents it fails, fails alone, and that pass without it.

    Counted over the distinct bit patterns (at most two to the number of rules), which are
    aggregated before any shuffle.
    """
    mask = F.lit(policy.mask).cast("long")
    patterns = kept_ledger.groupBy(F.col(failed).bitwiseAND(mask).alias("bits")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit"))
             for r in RULES if r.name in policy.rules]
    each = patterns.select("bits", "n", F.explode(F.array(*rules)).alias("r")).select("bits", "n", "r.*")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0))
        .alias("n_kept_without"), F.sum("n").alias("n_documents")).withColumn("policy", F.lit(policy.version))

"""Column -> Column text functions. All JVM-side (regexp/substring built-ins), codegen-friendly.

Regex dialect notes: patterns run on Java regex. ``(?U)`` makes ``\\w \\d \\s \\b`` Unicode-aware
like Python's ``re`` on ``str``; ``(?s)`` is DOTALL; ``(?d)`` restricts ``$``/``.`` line
terminators to ``\\n`` as in Python.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from logsift import constants as C

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- O11 redaction --------------------------------------------------------------------------

REDACTIONS = [
    (C.REDACT_EMAIL_RE, C.REDACT_EMAIL_WITH),
    (C.REDACT_FINGERPRINT_RE, C.REDACT_FINGERPRINT_WITH),
    (C.REDACT_RSA_RE, C.REDACT_RSA_WITH),
    (C.REDACT_PUBKEY_RE, C.REDACT_PUBKEY_WITH),
]


def sanitize(text: ColumnOrName) -> Column:
    """Redact e-mails, key fingerprints, RSA keys and pubkeys (in that order, case-insensitive)."""
    out = _c(text)
    for pattern, repl in REDACTIONS:
        out = F.regexp_replace(out, F.lit("(?iU)" + pattern), F.lit(repl.replace("$", "\\$")))
    return out


# --- O12 -------------------------------------------------------------------------------------

def strip_nulls(text: ColumnOrName) -> Column:
    return F.translate(_c(text), "\x00", "")


# --- O13 line split ---------------------------------------------------------------------------

# Python str.splitlines separators.
LINE_BREAK_RE = "\\r\\n|[\\n\\x0B\\f\\r\\x1C-\\x1E\\x85\\u2028\\u2029]"


def split_lines_array(text: ColumnOrName) -> Column:
    """``array<string>`` of lines, matching ``str.splitlines()`` (no trailing empty element)."""
    arr = F.split(_c(text), LINE_BREAK_RE, -1)
    return F.when(F.element_at(arr, -1) == F.lit(""), F.slice(arr, 1, F.size(arr) - 1)).otherwise(arr)


# --- O14 -------------------------------------------------------------------------------------

def starts_message(line: ColumnOrName) -> Column:
    """False when the first character is whitespace or a vertical bar."""
    return ~_c(line).rlike("(?U)\\A[\\s\\x1C-\\x1F|]")


def is_blank(line: ColumnOrName) -> Column:
    return ~_c(line).rlike("(?U)[^\\s\\x1C-\\x1F]")


# --- O15 noise predicate -------------------------------------------------------------------------

def noise_regex(pattern: str) -> str:
    """Java regex equal to Python ``re.match(pattern, s, re.DOTALL)``."""
    return "(?sdU)\\A(?:" + pattern + ")"


def noise_predicate(text: ColumnOrName, rules: Sequence[tuple[str, str, Sequence[str] | None]],
                    source_file: ColumnOrName | None = None) -> Column:
    """True when any applicable rule matches the start of ``text``.

    Rules without files apply everywhere and share one alternation (rules with back references
    keep a regex of their own); scoped rules apply only where ``source_file`` is one of the files.
    """
    t = _c(text)
    f = _c(source_file) if source_file is not None else None
    everywhere = [p for _, p, files in rules if not files]
    joined = [p for p in everywhere if not re.search(r"\\[1-9k]|\(\?P?<[a-zA-Z]", p)]
    alone = [p for p in everywhere if p not in joined]
    hits = [t.rlike(noise_regex("|".join(f"(?:{p})" for p in joined)))] if joined else []
    hits += [t.rlike(noise_regex(p)) for p in alone]
    if f is not None:
        hits += [f.isin(list(files)) & t.rlike(noise_regex(p)) for _, p, files in rules if files]
    return F.coalesce(functools.reduce(lambda a, b: a | b, hits, F.lit(False)), F.lit(False))


# --- O17 / O18 masks and tokens ---------------------------------------------------------------------

def _mask_guard(pattern: str, tag: str) -> str | None:
    """A literal that every match of ``pattern`` contains, or None."""
    if pattern.startswith("(?<=executed cmd )"):
        return "executed cmd "
    if pattern.startswith("/usr/bin/systemd-nspawn"):
        return "/usr/bin/systemd-nspawn"
    return C.MASK_GUARDS.get(tag)


def _mask_guard_regex(pattern: str, tag: str) -> str | None:
    """A cheap regex found in every text that ``pattern`` matches: without the look-behind alternation
    that the rule tries at each character. None: the rule has no such guard."""
    if tag == "NUM":
        return "(?U)\\d"
    if tag == "SEQ":
        return "[0-9a-f]{6} [0-9a-f]{6}" if "0-9a-f" in pattern else "[0-9A-F]{4} [0-9A-F]{4}"
    return None


def mask(text: ColumnOrName, rules: Iterable[tuple[str, str]] = C.MASK_RULES) -> Column:
    """Apply the mask rules in order (one regex pass per rule)."""
    out = _c(text)
    for pattern, tag in rules:
        out = F.regexp_replace(out, F.lit("(?dU)" + pattern), F.lit(C.MASK_PREFIX + tag + C.MASK_SUFFIX))
    return out


def mask_column(df, text_col: str, out_col: str, rules: Iterable[tuple[str, str]] = C.MASK_RULES):
    """``mask`` as a sequence of projections, skipping a rule whose required literal is absent.

    ``instr`` on the UTF-8 bytes is far cheaper than a regex pass (which converts the text to
    UTF-16 and back). Each step is its own projection and references the previous value more
    than once, so Catalyst keeps the steps apart and computes every value once. A literal absent
    from the original text cannot appear later (replacements only insert ``<:TAG:>``), so the
    guards test the original text."""
    d = df.withColumn(out_col, F.col(text_col))
    for pattern, tag in rules:
        rep = F.regexp_replace(F.col(out_col), F.lit("(?dU)" + pattern),
                               F.lit(C.MASK_PREFIX + tag + C.MASK_SUFFIX))
        guard, regex = _mask_guard(pattern, tag), _mask_guard_regex(pattern, tag)
        needed = F.instr(F.col(text_col), guard) > 0 if guard else F.col(text_col).rlike(regex) if regex else None
        d = d.withColumn(out_col, rep if needed is None else F.when(needed, rep).otherwise(F.col(out_col)))
    return d


def tokens(text: ColumnOrName, extra_delimiters: Sequence[str] = tuple(C.TEMPLATE_EXTRA_DELIMITERS)) -> Column:
    """Trim, turn extra delimiters into spaces, split on whitespace runs."""
    out = _c(text)
    for d in extra_delimiters:
        out = F.replace(out, F.lit(d), F.lit(" "))
    out = F.regexp_replace(out, "(?U)^\\s+|\\s+$", "")
    return F.filter(F.split(out, "(?U)\\s+"), lambda x: x != F.lit(""))


# --- O19 / O20 truncation --------------------------------------------------------------------------

def truncate_head(text: ColumnOrName, n: int) -> Column:
    """``text[:n-11] + '<truncated>'`` (applied by callers only when ``length(text) > n``)."""
    keep = max(n - len(C.TRUNCATED), 0)
    return F.concat(F.left(_c(text), F.lit(keep)), F.lit(C.TRUNCATED))


def truncate_middle(text: ColumnOrName, n: int) -> Column:
    """Keep both ends around a 19-character marker when ``text`` is longer than ``n``."""
    t = _c(text)
    border = (n - len(C.TRUNCATE_MIDDLE)) // 2
    cut = F.concat(F.left(t, F.lit(border)), F.lit(C.TRUNCATE_MIDDLE), F.right(t, F.lit(border)))
    return F.when(F.length(t) > n, cut).otherwise(t)


# --- O23 / O24 / O26 / O27 / O29 predicates and extractors ------------------------------------------

def has_leading_close_tag(text: ColumnOrName) -> Column:
    """``re.match(r'</[^<]+>', s, re.DOTALL)`` — a closing tag at the very start."""
    return F.coalesce(_c(text).rlike("(?s)\\A</[^<]+>"), F.lit(False))


def drop_leading_close_tag(text: ColumnOrName) -> Column:
    return F.when(has_leading_close_tag(text), F.lit(None).cast("string")).otherwise(_c(text))


def merge_request_id(ref: ColumnOrName) -> Column:
    v = F.regexp_extract(_c(ref), C.MR_REF_RE, 1)
    return F.when(v == "", F.lit(None)).otherwise(v).cast("bigint")


def is_eligible(name: ColumnOrName, allow: Sequence[str], deny: Sequence[str]) -> Column:
    """Any allow pattern found and no deny pattern found (deny wins)."""
    n = _c(name)
    allowed = F.lit(False)
    for p in allow:
        allowed = allowed | n.rlike("(?U)" + p)
    denied = F.lit(False)
    for p in deny:
        denied = denied | n.rlike("(?U)" + p)
    return F.coalesce(allowed & ~denied, F.lit(False))


def known_forge(forge: ColumnOrName, forges: Sequence[str] = tuple(C.FORGES)) -> Column:
    """Whether the URL is one of the configured forges (a null is not)."""
    return F.coalesce(_c(forge).isin(*forges), F.lit(False))


def response_length(explanation: ColumnOrName) -> Column:
    return F.length(_c(explanation)).cast("bigint")


# --- O03 URL rule -----------------------------------------------------------------------------------

def is_valid_log_url(url: ColumnOrName) -> Column:
    """http/https only; no params, query or fragment; netloc or path non-empty (urlparse rules)."""
    u = _c(url)
    scheme_ok = u.rlike("(?is)\\Ahttps?:")
    rest = F.regexp_extract(u, "(?is)\\Ahttps?:(.*)\\z", 1)
    frag = rest.rlike("(?s)\\A[^#]*#.")
    before_frag = F.regexp_extract(rest, "(?s)\\A([^#]*)", 1)
    query = before_frag.rlike("(?s)\\A[^?]*\\?.")
    before_q = F.regexp_extract(before_frag, "(?s)\\A([^?]*)", 1)
    has_netloc_part = before_q.startswith("//")
    netloc = F.when(has_netloc_part, F.regexp_extract(before_q, "(?s)\\A//([^/]*)", 1)).otherwise(F.lit(""))
    path = F.when(has_netloc_part, F.regexp_extract(before_q, "(?s)\\A//[^/]*(.*)\\z", 1)).otherwise(before_q)
    params = path.rlike("(?s)(?:\\A|/)[^/;]*;[^/]+\\z")
    return F.coalesce(scheme_ok & ~frag & ~query & ~params & ((netloc != "") | (path != "")), F.lit(False))


# --- O04 declared size -------------------------------------------------------------------------------

def admit_by_declared_size(content_length: ColumnOrName, limit: int, require_header: bool = True) -> Column:
    """``struct(proceed boolean, size bigint)`` from a Content-Length value."""
    raw = _c(content_length)
    size = raw.try_cast("bigint")
    proceed = (F.when(raw.isNull(), F.lit(not require_header))
               .when(size.isNull(), F.lit(False))
               .otherwise(size <= F.lit(limit)))
    return F.struct(proceed.alias("proceed"), size.alias("size_in_bytes"))

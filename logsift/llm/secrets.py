"""Secret scans: fixed-format credentials, and guessable-or-not values in credential contexts.

Base kinds are patterns (``assign``, ``access``, ``hex``). The method adds ``guess`` spans: values
that stand in a credential context (``login: …``, ``pwd is …``, ``Authorization: Bearer …``) and
whose guess cost is high. The cost of a value is the least, over its segmentations, of the sum of the
segments' costs (log10 of guesses). Segments are any part of the value that is:

* word: rank in a frequency-ranked dictionary, plus capital letters and look-alike digits
* date: years, or day-month-year runs with or without separators
* repeat: a unit's own cost plus the number of times it stands there
* keyboard walk: start keys, length and turns along neighbouring keys; or a sequence of the alphabet
* brute force: a fixed cost per character, by its class

found by dynamic programming over the positions of the value. Values that are cheap to guess
(``password123``, placeholders) are prose or examples and are left alone; base spans always stay.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import bounded_batches, text_or_empty

# Base patterns and their least lengths, in the order of the kinds.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
                    r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run of 32 or more is what remains of [0-9a-f]+
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

# Credential contexts of the method, wider than the base pattern: a cue, a joint, a value (in quotes: up to the
# closing quote of the line). The cue may stand inside an identifier, between any number of ``_``, ``-`` or
# camel-case parts. Cue, parts and value are matched one after the other, see ``contexts``.
CONTEXT_WORDS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"login", b"bearer", b"basic",
                 b"auth", b"pin")
CUE = re.compile(
    r"""(?:(?<![A-Za-z0-9])|(?-i:(?<=[a-z0-9])(?=[A-Z])))"""
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret[ _-]?access[ _-]?key|secret|token|(?:api|access|private|secret|client)[ _-]?key"""
    r"""|credential|login|auth(?:orization)?|pin)s?(?-i:(?![a-z0-9]))|\b(bearer|basic)\x20+(?=[^\s"'`<>,;])""", re.IGNORECASE | re.ASCII)
PARTS = re.compile(r"(?:[_-][A-Za-z0-9]++|[A-Z][a-z0-9]++)*+")
VALUE = re.compile(
    r"""["']?(?:\x20*(?:[:=]|=>)\x20*|\x20+(is|was)\x20+)(?:(?:bearer|basic)\x20+)?"""
    r"""(?:"((?:[^"\\\r\n]|\\.)++)"|'((?:[^'\\\r\n]|\\.)++)'|`([^`\r\n]++)`|["'`]?([^\s"'`<>,;]+))""", re.IGNORECASE | re.ASCII)
BARE = re.compile(r"""[^\s"'`<>,;]+""")
OPEN = 5  # in this group, the value has no closing quote and may end in punctuation of its sentence
GUESS_LEAST = 8
#: Values from this cost on (log10 of guesses) are secrets: out of reach of 10 billion guesses.
COST = 10.0
#: Letters only after ``is`` or ``was`` are mostly prose and must cost this much more.
PROSE_COST = 2.0

# Keyboard rows (each row lies half a key to the right of the one above), look-alikes.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./"))
LOOK_ALIKE = str.maketrans("@431!0$57", "aaeiiosst")
_DATE = re.compile(r"(?:19|20)\d\d(?:([-/. ]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?"
                   r"|(?:0?[1-9]|[12]\d|3[01])([-/. ]?)(?:0?[1-9]|1[0-2])\2(?:(?:19|20)\d\d|\d\d)")
_DATE_COST = math.log10(365 * 120)
_YEAR_COST = math.log10(120)
_SEGMENT = 0.3  # each further segment: guessers try arrangements, too


@functools.cache
def _neighbours() -> dict[str, frozenset[str]]:
    place = {c: (r, k + (0, 1, 1.25, 1.75)[r]) for r, row in enumerate(ROWS) for k, c in enumerate(row)}
    return {c: frozenset(d for d, (q, y) in place.items() if d != c and abs(q - r) <= 1 and abs(y - x) <= 1)
            for c, (r, x) in place.items()}


class Words(dict):
    """Ranks by word, with the length of the longest one."""

    @functools.cached_property
    def longest(self) -> int:
        return max(map(len, self), default=0)


def dictionary(tokens: dict[bytes, int], least: int = 3) -> Words:
    """Ranked words out of a byte-pair rank file: letters-only tokens in rank order, lower case."""
    words = Words()
    for token, _ in sorted(tokens.items(), key=lambda x: x[1]):
        w = token.decode("ascii", "ignore").strip().lower()
        if len(w) >= least and w.isalpha() and len(w) >= len(token) - 1:
            words.setdefault(w, len(words) + 1)
    return words


def _char_cost(c: str) -> float:
    if c.isdigit():
        return 1.0
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return math.log10(26)
    return math.log10(33) if c.isascii() else 2.0


class _Open:
    """Segments of one kind that start at different places and are still open; a segment costs the logarithm of
    its length above what its start costs.

    The logarithm grows ever more slowly, so a start that is no cheaper than an earlier one now never will be: it
    is dropped, and few stay open however long a run is. A start is added once the run that holds it can no longer
    leave out an earlier one alone, so all starts from ``floor`` on stay valid or end together."""

    __slots__ = ("starts", "least", "scale")

    def __init__(self, least: int, scale: float):
        self.starts: list[tuple[int, float]] = []
        self.least, self.scale = least, scale

    def add(self, at: int, cost: float) -> None:
        self.starts.append((at, cost))

    def end(self, at: int, floor: int) -> float:
        """Least cost of a segment from ``floor`` on that ends here."""
        found = cheapest = math.inf
        kept = []
        for a, cost in self.starts:
            if a < floor:
                continue
            now = cost + math.log10(self.scale * (at - a))
            if now < cheapest:
                kept.append((a, cost))
                cheapest = now
                if at - a >= self.least:
                    found = now
        self.starts = kept
        return found


def _least_times(unit: int) -> int:
    return 3 if unit < 3 else 2


def _repeat_units(low: str, most: int) -> list[int]:
    """Units of up to ``most`` characters that are repeated often enough somewhere."""
    found = []
    for unit in range(1, min(most, len(low) // 2) + 1):
        same, need = 0, unit * (_least_times(unit) - 1)
        for x, y in zip(low, low[unit:]):
            same = same + 1 if x == y else 0
            if same == need:
                found.append(unit)
                break
    return found


def _dates(value: str, at: int) -> Iterator[tuple[int, float]]:
    """End and cost of every date or year that starts here."""
    for end in range(at + 4, min(at + 10, len(value)) + 1):
        if m := _DATE.fullmatch(value, at, end):
            yield end, _YEAR_COST if m.group(1) is None and m.group(2) is None else _DATE_COST


def guess_cost(value: str, words: dict[str, int], exact_to: float = COST + PROSE_COST) -> float:
    """log10 of the guesses that the cheapest segmentation needs; the empty value costs nothing.

    The minimum over all segmentations into words, dates and years, repeats of a unit, walks over neighbouring keys
    and alphabet sequences (of 3 characters and more, any part of a longer one as well) and brute force. A cost above
    ``exact_to`` may be too high, but the minimum is above it, too: units of repeats are no longer than that, as
    every character of a unit costs at least 1. Time grows with the length of the value times that of the longest word.
    """
    n = len(value)
    words = words if isinstance(words, Words) else Words(words)
    low = value.lower() if len(value.lower()) == n else value
    plain = low.translate(LOOK_ALIKE)
    letters = [0] * (n + 1)  # letters in a row from here on: no word is longer
    for i in range(n - 1, -1, -1):
        letters[i] = letters[i + 1] + 1 if plain[i].isalpha() else 0
    beside, flat = _neighbours(), [SHIFTED.get(c, c) for c in low]
    upper = [c in ROWS[0] or c in ROWS[1] for c in flat]
    turns = [0] * (n + 1)  # changes between the two upper and the two lower rows up to a character
    for i in range(1, n):
        turns[i] = turns[i - 1] + (upper[i] != upper[i - 1])
    turns[n] = turns[n - 1] if n else 0
    walk, walk_from = _Open(3, 47), 0
    steps, steps_from, step = _Open(3, 26), 0, 0
    repeats = {}  # by unit, one for each rest of the start
    for unit in _repeat_units(low, int(min(exact_to, n))):
        repeats[unit] = [_Open(unit * _least_times(unit), 1 / unit) for _ in range(unit)]
    repeat_from = dict.fromkeys(repeats, 0)
    near = [math.inf] * (n + 1)
    near[0], loose = -_SEGMENT, math.inf  # loose: cheapest with a brute-force segment open here
    for i in range(n + 1):
        if i:
            last = _char_cost(value[i - 1])
            loose = min(loose, near[i - 1] + _SEGMENT) + last
            before = low[i - 2] if i > 1 else ""
            if i > 1 and flat[i - 1] not in beside.get(flat[i - 2], ()):
                walk_from = i - 1
            now = ord(low[i - 1]) - ord(before) if before else 0
            if now not in (1, -1):
                steps_from = i - 1
            elif now != step:
                steps_from = i - 2
            step = now
            walk.add(i - 1, near[i - 1] + _SEGMENT - 0.7 * turns[i])
            if i > 1:
                steps.add(i - 2, near[i - 2] + _SEGMENT)
            near[i] = min(near[i], loose, walk.end(i, walk_from) + 0.7 * turns[i - 1], steps.end(i, steps_from))
            for unit, by_rest in repeats.items():
                if i >= unit:
                    if i > unit and low[i - 1] != low[i - 1 - unit]:
                        repeat_from[unit] = i - unit
                    known = by_rest[i % unit]
                    known.add(i - unit, near[i - unit] + _SEGMENT + sum(map(_char_cost, low[i - unit:i])))
                    near[i] = min(near[i], known.end(i, repeat_from[unit]))
        if i == n:
            break
        here = near[i] + _SEGMENT
        for size in range(3, min(words.longest, letters[i]) + 1):
            rank, extra = words.get(low[i:i + size]), 0.0
            if rank is None:
                rank, extra = words.get(plain[i:i + size]), 0.5
            if rank is not None:
                part = value[i:i + size]
                if not part.islower() and any(x.isupper() for x in part):
                    extra += 0.3 if part[1:].islower() or part.isupper() else 1.0
                near[i + size] = min(near[i + size], here + math.log10(rank + 1) + extra)
        if value[i].isdigit():
            for end, cost in _dates(value, i):
                near[end] = min(near[end], here + cost)
    return max(0.0, near[n])


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, in code points, by start and then kind order."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    low = raw.lower()
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def contexts(text: str) -> Iterator[tuple[int, int, bool, bool]]:
    """(start, end, without closing quote, after ``is`` or ``was``) of every value after a credential cue.

    The parts of an identifier are read once: cues inside parts that led to no value lead to none either."""
    at = read = 0
    while m := CUE.search(text, at):
        at = m.end()
        if m.group(1):
            value = BARE.match(text, at)
            yield *value.span(), True, False
            at = value.end()
        elif m.start() >= read:
            read = PARTS.match(text, at).end()
            if value := VALUE.match(text, read):
                yield *value.span(value.lastindex), value.lastindex == OPEN, bool(value.group(1))
                at = value.end()


def guess_spans(text: str, base: list[tuple[str, int, int]], words: dict[str, int], least_cost: float = COST,
                low: bytes | None = None) -> list[tuple[str, int, int, float]]:
    """(guess, start, end, cost) of costly values in credential contexts that no base span holds whole."""
    low = text.encode("utf-8", "surrogatepass").lower() if low is None else low
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    out = []
    for a, b, is_open, is_prose in contexts(text):
        while is_open and b > a and text[b - 1] in ".:!?)]}":
            b -= 1
        if b - a < GUESS_LEAST or any(s <= a and b <= e for _, s, e in base):
            continue
        cost = guess_cost(text[a:b], words)
        if cost >= least_cost + (PROSE_COST if is_prose and text[a:b].isalpha() else 0.0):
            out.append(("guess", a, b, cost))
    return out


def scan(text: str, words: dict[str, int], least_cost: float = COST) -> list[tuple[str, int, int]]:
    raw = text.encode("utf-8", "surrogatepass")
    base = base_spans(text, raw)
    more = [s[:3] for s in guess_spans(text, base, words, least_cost, raw.lower())]
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]))) if more else base


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans) -> str:
    """The text with every span (overlaps merged) replaced by a mark that names its first kind."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def with_secrets(docs: DataFrame, words: dict[str, int], text: str = "text", out: str = "secrets",
                 least_cost: float = COST, redacted: str | None = None) -> DataFrame:
    """``docs`` plus ``out array<struct<kind,start,end>>``, all spans of the whole text by start and kind.

    Null text: no spans, and with ``redacted`` (name of a column for the text without its secrets)
    null again. Rows are independent; repeated rows and other columns pass through.
    """
    bounded_batches(docs.sparkSession)
    form = "spans array<struct<kind string, start long, end long>>" + (", clean string" if redacted else "")

    @F.pandas_udf(f"struct<{form}>")
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            spans = [scan(t, words, least_cost) for t in s]
            made = {"spans": [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in spans]}
            if redacted:
                made["clean"] = [redact(t, x) if x else None for t, x in zip(s, spans)]
            yield pd.DataFrame(made)

    found = docs.withColumn("__found", find(text_or_empty(text))).withColumn(out, F.col("__found.spans"))
    if redacted:
        found = found.withColumn(redacted, F.coalesce(F.col("__found.clean"), F.col(text)))
    return found.drop("__found")



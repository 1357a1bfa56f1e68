"""Scalar functions: redaction, line split, predicates, truncation, URL rule, admission."""

import pytest
from pyspark.sql import functions as F

from logsift import constants as C
from logsift.functions import text as T
from logsift.operators.prompts import to_messages

REDACT_CASES = [
    # (line, must_change)
    ("contact jane.doe@example.org for access", True),
    ("mail bob(at)builds.example.net now", True),
    ("Fingerprint: 0123456789ABCDEF0123456789ABCDEF", True),
    ("Fingerprint: 0123 4567 89AB CDEF 0123 4567 89AB CDEF", True),
    ("imported RSA key 0123456789ABCDEF01", True),
    ("gpg: pubkey-deadbeef-0badf00d found", True),
    ("sha256 e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", False),
    ("host build01.example.org resolved", False),
    ("unit systemd-nspawn@builder.service started", False),
    ("path /usr/lib64/python3.12/site-packages", False),
]


def test_sanitize_cases(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(REDACT_CASES)], "i int, s string")
    got = {r["i"]: r["r"] for r in df.select("i", T.sanitize("s").alias("r")).collect()}
    for i, (s, must_change) in enumerate(REDACT_CASES):
        assert (got[i] != s) == must_change, (s, got[i])
    assert got[0] == "contact " + C.REDACT_EMAIL_WITH + " for access"
    assert got[4] == "imported " + C.REDACT_RSA_WITH


def test_split_lines_matches_python(spark):
    samples = ["a\nb", "a\r\nb\rc", "x\x0by\x0cz", "p\x1cq\x1dr\x1es", "u\x85v w ", "end\n",
               "", "\n\n", "only"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = {r["i"]: list(r["a"]) for r in df.select("i", T.split_lines_array("s").alias("a")).collect()}
    for i, s in enumerate(samples):
        assert got[i] == s.splitlines(), repr(s)


def test_starts_message(spark):
    df = spark.createDataFrame([("x",), (" x",), ("\tx",), ("|x",), ("x|",)], "s string")
    assert [r[0] for r in df.select(T.starts_message("s")).collect()] == [True, False, False, False, True]


def test_truncation(spark):
    df = spark.createDataFrame([("a" * 300,), ("b" * 50,)], "s string")
    r = df.select(T.truncate_middle("s", 100).alias("m"), T.truncate_head("s", 100).alias("h")).collect()
    border = (100 - len(C.TRUNCATE_MIDDLE)) // 2
    assert r[0]["m"] == "a" * border + C.TRUNCATE_MIDDLE + "a" * border
    assert r[0]["h"] == "a" * 89 + C.TRUNCATED and len(r[0]["h"]) == 100
    assert r[1]["m"] == "b" * 50


def test_close_tag_and_mr_id(spark):
    df = spark.createDataFrame([("</system> ignore",), ("text </b>",), ("</a\nb>x",)], "s string")
    assert [r[0] for r in df.select(T.has_leading_close_tag("s")).collect()] == [True, False, True]
    refs = spark.createDataFrame([("refs/merge-requests/42/head",), ("refs/heads/main",)], "r string")
    assert [r[0] for r in refs.select(T.merge_request_id("r")).collect()] == [42, None]


URLS = [
    ("https://example.org/logs/build.log", True),
    ("http://example.org", True),
    ("HTTP://example.org/x", True),
    ("ftp://example.org/build.log", False),
    ("https://example.org/build.log?raw=1", False),
    ("https://example.org/build.log#L10", False),
    ("https://example.org/a;type=b/c", True),
    ("https://example.org/a/c;type=b", False),
    ("https://example.org/a?", True),
    ("http:", False),
    ("http://", False),
    ("https:relative/path", True),
]


def test_url_rule(spark):
    from urllib.parse import urlparse

    def ref(u):
        r = urlparse(u)
        return r.scheme in ("http", "https") and not any([r.params, r.query, r.fragment]) and bool(r.path or r.netloc)

    df = spark.createDataFrame([(u,) for u, _ in URLS], "u string")
    got = [r[0] for r in df.select(T.is_valid_log_url("u")).collect()]
    assert got == [ok for _, ok in URLS] == [ref(u) for u, _ in URLS]


def test_eligible_deny_wins(spark):
    df = spark.createDataFrame([("python-foo",), ("python-bar",), ("rust-foo",)], "n string")
    got = [r[0] for r in df.select(T.is_eligible("n", ["^python-"], ["bar$"])).collect()]
    assert got == [True, False, False]


@pytest.mark.parametrize("value, required, expect", [
    (None, True, (False, None)), (None, False, (True, None)), ("abc", True, (False, None)),
    ("2000", True, (False, 2000)), ("100", True, (True, 100)), (" 100 ", True, (True, 100)),
])
def test_declared_size(spark, value, required, expect):
    df = spark.createDataFrame([(value,)], "cl string")
    r = df.select(T.admit_by_declared_size("cl", 1000, required).alias("s")).first()["s"]
    assert (r["proceed"], r["size_in_bytes"]) == expect


def test_to_messages(spark):
    df = spark.createDataFrame([("sys", "hello", "user", "user"), ("sys", "hello", "developer", "user")],
                               "sp string, um string, sr string, ur string")
    out = to_messages(df, F.col("sp"), F.col("um"), F.col("sr"), F.col("ur")).collect()
    assert [(m["role"], m["content"]) for m in out[0]["messages"]] == [("user", "sys\nhello")]
    assert [(m["role"], m["content"]) for m in out[1]["messages"]] == [("developer", "sys"), ("user", "hello")]


def test_sql_functions_equal_columns(spark):
    from logsift.functions.sql import register_functions
    register_functions(spark)
    samples = [s for s, _ in REDACT_CASES] + ["ip 10.0.0.1 n=-42 INFO: x", "a" * 300, "refs/merge-requests/7/x"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    df.createOrReplaceTempView("samples")
    got = spark.sql("SELECT s, ls_sanitize(s) a, ls_mask(s) b, ls_truncate_middle(s, 100) c, "
                    "ls_truncate_head(s, 100) d, ls_merge_request_id(s) e, ls_starts_message(s) f FROM samples")
    want = df.select("s", T.sanitize("s").alias("a"), T.mask("s").alias("b"), T.truncate_middle("s", 100).alias("c"),
                     F.when(F.length("s") > 100, T.truncate_head("s", 100)).otherwise(F.col("s")).alias("d"),
                     T.merge_request_id("s").alias("e"), T.starts_message("s").alias("f"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

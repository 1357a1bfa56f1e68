import hashlib
import random
import re
import string

import public_tokenizers
import pytest

from logsift.llm import bpe, secrets


@pytest.fixture(scope="module")
def words():
    return secrets.dictionary(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))


def brute_base(text):
    """The three patterns as stated, every match kept or dropped by its length."""
    assign = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                        re.ASCII)
    out = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m.group(1)) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_base_spans_equal_patterns():
    rnd = random.Random(4)
    bits = ["password", "PassWd", "secret", "TOKEN", "api_key", "apikey", "ſecret", "'", '"', " ", "  ", ":", "=",
            "abcdefgh", "x", "AKIA", "AKIAABCDEFGHIJKL", "Z9", "0123456789abcdef" * 2, "deadbeef", "é", "\n", "日"]
    for _ in range(3000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))
        assert secrets.base_spans(text) == brute_base(text), text


KEYS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFT = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./"))
DATES = [re.compile(p) for p in (r"(19|20)\d\d([-/. ]?)(0[1-9]|1[0-2])\2(0[1-9]|[12]\d|3[01])",
                                 r"(0?[1-9]|[12]\d|3[01])([-/. ]?)(0?[1-9]|1[0-2])\2((19|20)\d\d|\d\d)")]


def place(c):
    for row, keys in enumerate(KEYS):
        if SHIFT.get(c, c) in keys:
            return row, keys.index(SHIFT.get(c, c)) + (0, 1, 1.25, 1.75)[row]


def beside(c, d):
    p, q = place(c), place(d)
    return p and q and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def segment_cost(part, words):
    """Cost of a text as one segment, by the definition of each kind."""
    from math import log10
    brute = lambda t: sum(1 if c.isdigit() else log10(26) if c in string.ascii_letters else log10(33) if c < "\x80" else 2 for c in t)
    low, n = part.lower(), len(part)
    costs = [brute(part)]
    for form, extra in ((low, 0), ("".join(dict(zip("@431!0$57", "aaeiiosst")).get(c, c) for c in low), 0.5)):
        if form in words and (not extra or form != low):
            upper = [c.isupper() for c in part]
            case = 0 if not any(upper) else 0.3 if part[1:].islower() or part.isupper() else 1
            costs.append(log10(words[form] + 1) + extra + case)
    if re.fullmatch(r"(19|20)\d\d", part):
        costs.append(log10(120))
    if any(p.fullmatch(part) for p in DATES):
        costs.append(log10(365 * 120))
    if n >= 3 and all(beside(c, d) for c, d in zip(low, low[1:])):
        turns = sum((place(c)[0] < 2) != (place(d)[0] < 2) for c, d in zip(low[1:], low[2:]))
        costs.append(log10(47 * n) + 0.7 * turns)
    if n >= 3 and len({ord(d) - ord(c) for c, d in zip(low, low[1:])}) == 1 and abs(ord(low[1]) - ord(low[0])) == 1:
        costs.append(log10(26 * n))
    for unit in range(1, n // 2 + 1):
        if n % unit == 0 and n // unit >= (3 if unit < 3 else 2) and low == low[:unit] * (n // unit):
            costs.append(brute(low[:unit]) + log10(n // unit))
    return min(costs)


def brute_cost(value, words):
    """Least cost by trying every segment between every two positions."""
    best = [-0.3] + [float("inf")] * len(value)
    for b in range(1, len(value) + 1):
        best[b] = min(best[a] + 0.3 + segment_cost(value[a:b], words) for a in range(b))
    return max(0.0, best[-1])


def test_cost_is_the_minimum(words):
    rnd = random.Random(7)
    bits = ["pass", "word", "monkey", "1999", "2012-05-17", "1.2.99", "aaaa", "abab", "qwerty", "asdf", "x9", "#", "K", "é", "7", "house",
            "responsibilities", "P@ss", "fgh", "cba", "9876", "!q", "Zt7Qw93Lm5", "Zt7Qw93Lm5", "19", "12"]
    values = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 6))) for _ in range(400)]
    values += ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 24)))
               for letters in ("qwe", "aab", "12", "asqw1!", "abcba", "0129-", "dersw") for _ in range(60)]
    for v in values:
        want = brute_cost(v, words)
        assert abs(secrets.guess_cost(v, words, 1_000) - want) < 1e-9, v
        cost = secrets.guess_cost(v, words)
        assert abs(cost - want) < 1e-9 or min(cost, want) > secrets.COST + secrets.PROSE_COST, v


def test_parts_of_runs_are_segments(words):
    """Walks, sequences and repeats need not be taken as long as they go."""
    for value in ("qwertyhouse", "abcdefrog", "19991231house", "aaaaapple"):
        assert secrets.guess_cost(value, words) == pytest.approx(brute_cost(value, words))
    assert secrets.guess_cost("qwertyhouse", words) < secrets.guess_cost("qwertyh", words) + 3 * 1.415
    long = max(words, key=len)
    assert secrets.guess_cost(long, words) < 5 and len(long) > 16


def test_cheap_and_costly_values(words):
    cheap = ["password", "Password123", "aaaaaaaaaaaaaaaa", "qwertyuiop", "1234567890", "monkey1999", "2012-05-17",
             "changeme", "p@ssw0rd", "abcabcabcabc"]
    dear = ["xK9#vQ2!pLz8", "f33e61083db5dbdf4b", "Zt7-Qw93-Lm55-Xe01", "hG5kLp0QzVb8YtRw"]
    assert max(secrets.guess_cost(v, words) for v in cheap) < secrets.COST
    assert min(secrets.guess_cost(v, words) for v in dear) > secrets.COST
    assert secrets.guess_cost("", words) == 0.0
    assert secrets.guess_cost("a" * 20_000, words) < 8
    assert secrets.guess_cost("x9K#" * 5_000 + "q", words) < 20


def test_contexts(words):
    text = "The pwd is xK9#vQ2!pLz8. Authorization: Bearer aZ93-kd02-QQ17; login: monkey1999, key words are many"
    spans = secrets.scan(text, words)
    assert [text[a:b] for _, a, b in spans] == ["xK9#vQ2!pLz8", "aZ93-kd02-QQ17"]
    assert {k for k, _, _ in spans} == {"guess"}
    assert secrets.redact(text, spans).startswith("The pwd is [guess]. Authorization: Bearer [guess];")
    both = 'password = "0123456789abcdef0123456789abcdef"'
    assert [s[0] for s in secrets.scan(both, words)] == ["assign", "hex"]
    assert secrets.redact(both, secrets.scan(both, words)) == '[assign]"'


def test_whole_values_beside_base_spans_and_in_quotes(words):
    for text, clean in [("password: xK9vQ2pLz#8!mW7 end", "[assign] end"),
                        ('token = "xK9vQ2pLz;8,mW7 e" end', '[assign]" end'),
                        ('pwd: "xK9,vQ2;pLz8 mW7" end', 'pwd: "[guess]" end'),
                        ("pwd => 'x,9;vQ2\\'pLz8mW7!' end", "pwd => '[guess]' end"),
                        ('pwd: "xK9vQ2pLz8mW7', 'pwd: "[guess]'),
                        ('password: abcdefgh99 end', "[assign] end")]:
        assert secrets.redact(text, secrets.scan(text, words)) == clean
    spans = secrets.scan("password: xK9vQ2pLz#8!mW7", words)
    assert spans == [("assign", 0, 19), ("guess", 10, 25)]


def test_costly_values_of_letters_only(words):
    for text in ("pwd: kXqWzRtPvBnMgHjL", "login: qzxvkjwpqhgtbnmd", "Bearer kXqWzRtPvBnMgHjLkdQw",
                 "The pwd is kXqWzRtPvBnMgHjL"):
        spans = secrets.scan(text, words)
        assert [text[a:b] for _, a, b in spans] == [text.split()[-1]]
    for text in ("The login is unfortunately closed", "basic understanding", "pin: immediately", "auth was successful",
                 "The secret was lexicographically"):
        assert secrets.scan(text, words) == []


def test_cues_inside_identifiers(words):
    value = "xK9vQ2pLz8mW7"
    for cue in ("DB_PWD=", "MYSQL_PWD=", "DB_PASS=", "user_login=", "AWS_SECRET_ACCESS_KEY=", "aws_secret_access_key = ",
                "secretAccessKey: ", "passwords: ", "db-pass: ", "dbPwd: ", "PASS_PROD=", "DB_PASS_1=", "api_keys = ", "secret-key: ",
                "clientKeyId: ", '"user_pwd": "', "export PG_PASS_MAIN='", "--login-pin="):
        text = f"a {cue}{value} b"
        assert [text[x:y] for k, x, y in secrets.scan(text, words) if k == "guess"] == [value], text
    for text in (f"passenger: {value}", f"spin: {value}", f"author: {value}", f"PASSENGER: {value}"):
        assert secrets.scan(text, words) == []
    assert secrets.scan("pass_" * 50_000, words) == []


def test_frames(spark, words):
    long = "word " * 60_000 + "token=ABCDEFGH99"
    rows = [(1, "token: abcd1234efgh", "a"), (1, "token: abcd1234efgh", "a"), (2, None, "b"), (3, "", None),
            (None, "no secrets here", "c"), (4, long, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = secrets.with_secrets(docs, words, redacted="clean").collect()
    by = {(r.doc_id, r.text): r for r in got}
    assert len(got) == 6 and by[1, "token: abcd1234efgh"].clean == "[assign]"
    assert by[2, None].secrets == [] and by[2, None].clean is None and by[3, ""].clean == ""
    assert by[4, long].secrets[0].start == 300_000 and by[4, long].clean.endswith(" [assign]")
    assert secrets.with_secrets(docs.limit(0), words).count() == 0


def test_query(spark, sf_mid, words):
    from logsift.llm.queries import op5_secret_guess_cost
    got = {r.doc_id: r for r in op5_secret_guess_cost(spark, sf_mid).collect()}
    seen = 0
    for r in spark.read.parquet(f"{sf_mid}/documents.parquet").collect():
        base, g = brute_base(r.text), got.pop(r.doc_id)
        seen += len(base)
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(s[0] == k for s in base) for k in ("assign", "access", "hex"))
        assert g.base_sha256 == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
        assert g.spans == secrets.joined(secrets.scan(r.text, words))
    assert not got and seen


def test_identifiers_of_any_number_of_parts():
    words = {}
    for parts in (1, 16, 17, 400):
        for cue in ("pwd", "token", "secret_access_keyring"):
            text = cue + "_a" * parts + ": Zx81kQpw93LmQQ"
            assert [s for s in secrets.scan(text, words) if s[0] == "guess" and text[s[1]:s[2]] == "Zx81kQpw93LmQQ"], (cue, parts)


def test_a_line_of_cues_is_read_once():
    import time
    text = "token_" * 40_000 + "x. nothing here"
    began = time.perf_counter()
    assert secrets.scan(text, {}) == []
    assert time.perf_counter() - began < 5
    text = "pass_tokenKey: Zx81kQpw93LmQQ and secretKey=kd83Jx.qQ71z"
    assert len([s for s in secrets.scan(text, {}) if s[0] == "guess"]) == 2

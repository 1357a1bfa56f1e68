import random

import pytest

from logsift.llm import urls
from logsift.llm.queries import URL_RULES


def brute(url, rules, listed=()):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    n = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
    rest = rest[n:]
    path = rest[:min([rest.index(c) for c in "?#" if c in rest] + [len(rest)])]
    fit = [(len(h), len(p), h + p, v) for h, p, v in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[2], max(fit)[3]
    name = (host[4:] if host.startswith("www.") else host) + path.rstrip("/")
    return host, path, None, "block" if host and name in listed else "allow"


def frames(spark, url_rows, rules, listed):
    return (spark.createDataFrame(url_rows, "page_id long, url string, rule string"),
            spark.createDataFrame([(h, p, v, h + p) for h, p, v in rules], "host string, path string, verdict string, rule string"),
            spark.createDataFrame(listed, "host string, path string, verdict string"))


@pytest.mark.parametrize("blocks", [1 << 17, 1])
def test_judgement_equals_rule(spark, monkeypatch, blocks):
    monkeypatch.setattr(urls, "MOST_BLOCKS", blocks)  # one block: nearly every candidate is a possible hit
    rnd = random.Random(5)
    hosts = ["a.net", "example.net", "B.Example.NET", "example.com", "notexample.com", "x.org", "org", "net", "", "www.bad.io",
             "bad.io", "a..net", "u@h.net:80", "net.", "örg"]
    paths = ["", "/", "/en/", "/en", "/en/x", "/de/1", "/fr/", "/fr/a//", "//", "/EN/"]
    tails = ["", "?a=://b/c", "#x", "?", "#/en/"]
    made = ["http://" + rnd.choice(hosts) + rnd.choice(paths) + rnd.choice(tails) for _ in range(300)]
    made += [None, "", "no scheme", "://", "://net", "a://b://c/d", "mailto:x@net/", "http://a.net/" + "y" * 100_000]
    made += ["https://tion.example.net/en/1"] * 50
    rows = [(i, u, "clash") for i, u in enumerate(made)] + [(None, "http://net/", None), (1, "http://org/fr/", None)]
    listed = [("bad.io", "/fr/", "block"), ("Örg", None, "block"), (None, "/x", "block"), ("", "/", "block"), ("www.x.org", "/en", "block")]
    names = {"bad.io/fr", "Örg", "x.org/en"}
    got = urls.judge(*frames(spark, rows, URL_RULES, listed)).collect()
    want = sorted(str((i, *brute(u, URL_RULES, names))) for i, u, _ in rows)
    assert sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got) == want


def test_empty_tables(spark):
    pages, rules, listed = frames(spark, [(1, "http://net/", None)], URL_RULES, [("q.io", "/", "block")])
    assert urls.judge(pages.limit(0), rules, listed).count() == 0
    r = urls.judge(pages, rules.limit(0), listed.limit(0)).first()
    assert (r.host, r.path, r.rule, r.verdict, r.listed) == ("net", "/", None, "allow", False)


def test_filter_never_misses(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) as key")
    blocks, n = urls.bloom_filter(keys)
    assert urls.possible(keys, "key", blocks, n).count() == 5000
    others = spark.range(5000, 25000).selectExpr("concat('k', id) as key")
    assert urls.possible(others, "key", blocks, n).count() < 1000


def test_query_equals_oracle(spark, sf_mid, llm_oracle):
    llm_oracle("op3_url_bloom", sf_mid)

"""Noise rules, template mining and representative selection."""

import pytest

from logsift import constants as C
from logsift.operators.lines import assemble_messages
from logsift.operators.noise import drop_noise, load_patterns, validate_patterns
from logsift.operators.templates import mine_templates, representative_snippets

from helpers import lines_df

RULES = validate_patterns({
    "start": {"pattern": "^Start"},
    "anywhere": {"pattern": ".*ignore me"},
    "scoped": {"pattern": "^DEBUG ", "files": ["mock_output.log"]},
})


def texts(df):
    return sorted(r["text"] for r in df.collect())


def test_rules_match_from_start_and_scope(spark):
    d = spark.createDataFrame(
        [("Start: build", "build.log"), ("x Start", "build.log"), ("a\nplease ignore me", None),
         ("DEBUG x", "mock_output.log"), ("DEBUG y", "build.log"), ("DEBUG z", None)],
        "text string, source_file string")
    kept = texts(drop_noise(d, RULES, source_file="source_file"))
    assert kept == ["DEBUG y", "DEBUG z", "x Start"]


def test_validate_and_load(tmp_path):
    with pytest.raises(ValueError):
        validate_patterns({"bad": {"files": ["a"]}})
    with pytest.raises(ValueError):
        validate_patterns({"bad": {"pattern": "(unclosed"}})
    assert load_patterns(str(tmp_path / "missing.toml")) is None
    empty = tmp_path / "empty.toml"
    empty.write_text("")
    assert load_patterns(str(empty)) is None
    f = tmp_path / "rules.toml"
    f.write_text("[one]\npattern = '^A'\nfiles = ['x.log']\n")
    assert load_patterns(str(f)) == [("one", "^A", ["x.log"])]
    assert len(C.DEFAULT_NOISE_RULES) == 20


SEVEN = "\n".join([
    "alpha one", "beta two two", "gamma three three three", "delta four", "  four continued",
    "epsilon five five five five", "zeta six six six six six", "eta seven seven seven seven seven seven", "",
])


def reps(spark, text, k):
    ch = assemble_messages(lines_df(spark, text), 2000).drop("source_file")
    return sorted((r["line_number"], r["text"]) for r in representative_snippets(mine_templates(ch), k).collect())


def test_capacity_two_keeps_last_two(spark):
    assert reps(spark, SEVEN, 2) == [(7, "zeta six six six six six"), (8, "eta seven seven seven seven seven seven")]


def test_package_manager_log_all_kept(spark):
    log = "\n".join(["Installing packages:", "  gcc-14", "  make-4.4", "Downloading", "  100%",
                     "Verifying", "  ok", "Complete!"])
    got = reps(spark, log, 4)
    assert [n for n, _ in got] == [1, 4, 6, 8]


def test_repeated_template_first_member(spark):
    log = "\n".join(["took 12 ms", "other line", "took 99 ms", "final"])
    got = reps(spark, log, 8)
    assert (1, "took 12 ms") in got and all(n != 3 for n, _ in got)


def test_mask(spark):
    from logsift.functions.text import mask
    d = spark.createDataFrame([("ip 10.0.0.1 id 0x1F n=-42 a1 INFO: rest",)], "s string")
    assert d.select(mask("s")).first()[0] == "ip <:IP:> id <:HEX:> n=<:NUM:> a1 <:INFO:>"


def test_similar_messages_are_one_cluster(spark):
    from logsift.operators.templates import cluster_templates, latest_clusters
    log = "\n".join(["KeyError: foo missing in config", "unrelated", "KeyError: bar missing in config", "KeyError: only",
                     "KeyError: baz is nowhere at all", "KeyError: a b c d"])
    mined = mine_templates(assemble_messages(lines_df(spark, log), 2000).drop("source_file"))
    got = sorted((r["line_number"], r["n"], r["last_seen"]) for r in cluster_templates(mined).collect())
    # Lines 1 and 3 agree in 4 of 5 tokens; lines 5 (6 tokens), 4 (2) and 6 (5 tokens, 1 agreeing) stand alone.
    assert got == [(1, 2, 3), (2, 1, 2), (4, 1, 4), (5, 1, 5), (6, 1, 6)]
    top = latest_clusters(cluster_templates(mined), 3).collect()
    assert sorted(r["line_number"] for r in top) == [4, 5, 6]
    strict = cluster_templates(mined, threshold=0.9)
    assert strict.count() == 6


def clusters_of(spark, log, **kw):
    from logsift.operators.templates import cluster_templates
    mined = mine_templates(assemble_messages(lines_df(spark, log), 2000).drop("source_file"))
    return sorted((r["line_number"], r["template"], r["n"]) for r in cluster_templates(mined, **kw).collect())


def test_members_that_differ_at_two_places_merge(spark):
    log = "\n".join(["Package: foo not available from repo alpha", "Package: bar not available from repo beta",
                     "Package: foo not available from repo gamma", "Package: foo was never in any repo"])
    assert clusters_of(spark, log) == [(1, "Package: <*> not available from repo <*>", 3), (4, "Package: foo was never in any repo", 1)]


def leaders_by_hand(messages, threshold=0.4):
    """One message after the other: the first leader it agrees with takes it."""
    seen, leaders, members = set(), [], {}
    for line, text in enumerate(messages, 1):
        toks = text.split(" ")
        if text in seen:
            continue
        seen.add(text)
        home = next((i for i, other in leaders if len(other) == len(toks) and other[0] == toks[0]
                     and sum(a == b for a, b in zip(other, toks)) >= threshold * len(toks)), None)
        if home is None:
            leaders.append((line, toks))
            home = line
        members.setdefault(home, []).append(toks)
    return {i: " ".join(x[0] if len(set(x)) == 1 else "<*>" for x in zip(*m)) for i, m in members.items()}


def test_clusters_of_random_messages(spark):
    import random
    rng = random.Random(8)
    words = [f"w{c}" for c in "abcdefgh"]
    log = [" ".join(["E:", *(rng.choice(words[:rng.choice((2, 8))]) for _ in range(rng.choice((1, 4, 6))))]) for _ in range(400)]
    got = {line: t for line, t, _ in clusters_of(spark, "\n".join(log))}
    assert got == leaders_by_hand(log)


def test_many_unlike_signatures_take_few_rounds(spark, monkeypatch):
    from logsift.operators import templates as T
    letters = "abcdefghijklmnopqrst"

    def word(i):
        return letters[i // 400 % 20] + letters[i // 20 % 20] + letters[i % 20]
    # All share the first token, half of them a second one; none agrees with another in three of six.
    log = [" ".join(["ERROR", word(i) + "x", word(i) + "y", word(i) + "z", word(i) + "u", "late" if i % 2 else word(i)]) for i in range(2000)]
    log.append("ERROR aaax aaay aaaz other words")
    rounds = []
    elect = T.elect_leaders
    monkeypatch.setattr(T, "elect_leaders", lambda *a: (rounds.append(elect(*a)), rounds[-1])[1])
    got = clusters_of(spark, "\n".join(log))
    assert len(got) == 2000 and got[0] == (1, "ERROR aaax aaay aaaz <*> <*>", 2)
    assert rounds[0][1] <= 11

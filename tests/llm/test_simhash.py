import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logsift.llm import simhash
from logsift.llm.components import components


def brute_fp(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, cur = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if cur:
                words.append(cur)
            cur = ""
        else:
            cur += c
    if not words:
        return 0
    parts = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps, t=4):
    fps = sorted(set(fps))
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= t:
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {f: root(f) for f in fps}


def test_fingerprint_equals_rule():
    rnd = random.Random(3)
    texts = ["", " \n\t", "One", "One two THREE four", "É a b c d e", "x y z w q r s", "a b c d " * 50]
    texts += [" ".join(rnd.choice("ab cd EF gh ij kl mn").strip() or "z" for _ in range(rnd.randint(1, 60)))
              for _ in range(40)]
    for t in texts:
        assert simhash.fingerprint(t) & (2**64 - 1) == brute_fp(t)
    long = " ".join(f"w{i % 977}" for i in range(70_000))  # more shingles than one block
    assert simhash.fingerprint(long) & (2**64 - 1) == brute_fp(long)


def test_code_covers_and_linked_words_meet():
    words = np.arange(1 << 15)
    gap = np.bitwise_count(words ^ simhash._nearest_codeword(words))
    assert gap.max() == 1 and len(set(simhash._nearest_codeword(words).tolist())) == 1 << 11
    rnd = np.random.default_rng(5)
    for t in (2, 4, 6):
        for _ in range(150):
            a = int(rnd.integers(0, 2**63)) * 2 + int(rnd.integers(0, 2))
            b = a
            for bit in rnd.choice(64, t, replace=False):
                b ^= 1 << int(bit)
            pair = np.array([a, b], np.uint64).view(np.int64)
            met = False
            for first, width in simhash.stretches(t):
                home, row, anchor = simhash.anchors(pair, first, width)
                met |= home[0] in anchor[row == 1]
            assert met
    with pytest.raises(ValueError):
        simhash.stretches(8)


def near_set(rnd, groups=12, size=9, lone=300):
    out = [int(x) for x in rnd.integers(0, 2**63, lone)]
    for _ in range(groups):
        f = int(rnd.integers(0, 2**63))
        for _ in range(size):
            out.append(f)
            for bit in rnd.choice(64, int(rnd.integers(1, 7)), replace=False):
                f ^= 1 << int(bit)
    return [int(np.uint64(x).astype(np.int64)) for x in out]


@pytest.mark.parametrize("small_blocks", [False, True])
def test_links_equal_brute_force(spark, monkeypatch, small_blocks):
    if small_blocks:  # every crowded anchor is cut into blocks
        for name, v in (("HOME_BLOCK", 2), ("REACH_BLOCK", 3), ("GROUP_ROWS", 500), ("PAIRS_AT_ONCE", 7)):
            monkeypatch.setattr(simhash, name, v)
    fps = near_set(np.random.default_rng(8))
    df = spark.createDataFrame([(f,) for f in fps] + [(None,)], "fp long")
    got = {r.node: r.root for r in components(simhash.links(df, 4)).collect()}
    want = {}
    for f, r in brute_classes([f & (2**64 - 1) for f in fps]).items():
        want.setdefault(r, set()).add(int(np.uint64(f).astype(np.int64)))
    classes = {}
    for f in set(fps):
        classes.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (5, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_odd_rows(spark):
    long = "alpha beta gamma delta " * 30_000
    rows = [(5, long, "x"), (3, long, "y"), (9, None, None), (8, "", "z"), (4, "solo words only here", "x"),
            (4, "solo words only here", "x"), (None, "nobody owns this text at all", "x"), (2, "a b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, None), (2, 2), (3, 3), (4, 4), (4, 4), (5, 3), (8, 8), (9, 8)]
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 2, 3, 4, 8]
    empty = docs.limit(0)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_query_equals_brute_force(spark, sf_small):
    from logsift.llm.queries import op10_simhash_anchors
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op10_simhash_anchors(spark, sf_small).collect()}
    docs = {r.doc_id: brute_fp(r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    root = brute_classes(docs.values())
    least = {}
    for d, f in docs.items():
        least[root[f]] = min(d, least.get(root[f], d))
    assert got == {d: (f"{f:016x}", least[root[f]]) for d, f in docs.items()}

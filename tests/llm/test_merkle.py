"""Merkle manifest: a plain tree over sorted rows, ranks against sorting, proofs that fold to the root."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from logsift.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    by = dict(zip(("doc_id", "text", "lang", "source", "n_chars"), row))
    return h(*["-" if by[f] is None else f"{len(str(by[f]).encode())}:{by[f]}" for f in FIELDS])


def climb(nodes):
    """Root of a list of nodes, and the siblings of each."""
    paths, at, where = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(at) > 1:
        for k, i in enumerate(where):
            paths[k] += [at[i ^ 1]] if i ^ 1 < len(at) else []
        at = [h(*at[i:i + 2]) for i in range(0, len(at), 2)]
        where = [i // 2 for i in where]
    return at[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    subs = {g: climb([leaf(r) for r in groups[g]]) for g in order}
    root, tops = climb([subs[g][0] for g in order])
    return sorted((str(r[0]), i, leaf(r), subs[g][0], root, h(*subs[g][1][i], *top))
                  for g, top in zip(order, tops) for i, r in enumerate(groups[g]))


def manifest(spark, rows, **kw):
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), FIELDS, **kw).collect()
    assert all(r.verified and r.folded == r.root for r in got)
    return sorted((str(r.id), r.leaf_no, r.leaf, r.subroot, r.root, r.proof) for r in got)


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_small_groups(spark, size):
    rows = [(i * 7, f"t{i}", lang, "web", i) for lang in ("de", None, "é", "z")[:size] for i in range(size)]
    assert manifest(spark, rows) == plain(rows)


def test_nulls_repeats_and_ties(spark):
    rows = [(None, "a", "en", None, 1), (None, "b", "en", "s", None), (None, "a", "en", None, 1), (-5, None, "en", "s", 2),
            (3, "", "en", "s", 0), (3, "x", "en", "s", 1), (3, "y", "en", "s", 1), (3, "x", "en", "s", 1), (-(1 << 63), "low", "en", "s", 3),
            ((1 << 63) - 1, "high", "en", "s", 4), (9, "ü" * 3000, None, "s", 3000), (9, "x", "", "s", 1)]
    assert manifest(spark, rows) == plain(rows)


def test_several_slot_arrays(spark):
    """More than one block of 1,024 leaves, ids far apart, a run of equal rows across blocks."""
    rng = random.Random(5)
    rows = [(rng.randrange(-(1 << 40), 1 << 40), f"t{i}", "en", "s", i) for i in range(1500)] + [(7, "same", "en", "s", 1)] * 2300
    rows += [(i, "x", "fr", "s", i) for i in range(1025)]
    assert manifest(spark, rows) == plain(rows)


def test_ranks_are_positions(spark):
    rng = random.Random(3)
    ids = sorted(set(rng.sample(range(200_000), 3000)) | {rng.randrange(1 << 50) for _ in range(300)})
    rows = spark.createDataFrame([("g", i, 1 + i % 3) for i in ids], "g string, k long, w long")
    got = {r.k: r.place for r in merkle.rank(rows, merkle.ranked(rows, ["g"], "k", "w"), ["g"], "k").collect()}
    at = 0
    for i in ids:
        assert got[i] == at
        at += 1 + i % 3


def test_tampered_rows_and_paths(spark):
    rows = [(i, f"t{i}", "en" if i % 3 else "de", "web", None if i == 4 else i) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("path", F.lit("clash")).withColumn("leaf", F.lit(1))
    forged = F.when(F.col("doc_id") % 4 == 0, merkle.leaf([F.col(c) + 1 if c == "n_chars" else c for c in FIELDS]))
    got = merkle.manifest(df, FIELDS, claimed=forged, with_path=True).collect()
    for r in got:
        assert r.verified == (r.id % 4 != 0 or r.id == 4)
        siblings = merkle._unpacked(r.path)
        assert merkle.fold(bytes.fromhex(r.leaf), siblings).hex() == r.root
        assert h(*[s.hex() for _, s in siblings]) == r.proof


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), FIELDS).collect() == []


def test_query_is_the_sql(llm_oracle, sf_small):
    llm_oracle("op11_merkle_manifest", sf_small)

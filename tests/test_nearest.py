"""Exact lookup with pivots and the stored index, against NumPy."""

import os
import tracemalloc

import numpy as np
import pytest

from logsift.operators import nearest as N

VECTORS = "id long, text_embedding array<float>"


def clustered(n, dim=8, clusters=12, seed=3):
    """Twelve far clusters; the first holds a third of the rows, and every fifth row is a copy of another."""
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(size=(clusters, dim)) * 50
    own = np.where(np.arange(n) % 3 == 0, 0, rnd.integers(0, clusters, n))
    rows = (centre[own] + rnd.normal(size=(n, dim))).astype(np.float32)
    rows[::5] = rows[0]
    return rows


def table(spark, rows, first=0, name="id"):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(rows)],
                                 f"{name} long, text_embedding array<float>").repartition(5)


def brute(queries, rows, k):
    out = {}
    for i, v in enumerate(queries.astype(np.float64)):
        d = np.sqrt(((rows.astype(np.float64) - v) ** 2).sum(1))
        out[i] = [int(j) for j in np.lexsort((np.arange(len(rows)), d))[:k]]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.mark.parametrize("pivots", [2, 7, 30])
def test_pivots_lose_nothing(spark, monkeypatch, pivots):
    monkeypatch.setattr(N, "CORPUS_BLOCK", 64)  # cells are dealt to several tasks
    monkeypatch.setattr(N, "QUERY_BLOCK", 16)
    rows, rnd = clustered(600), np.random.default_rng(5)
    queries = np.vstack([clustered(60)[7:47], rnd.normal(size=(10, 8)) * 60]).astype(np.float32)
    got = N.nearest_snippets(table(spark, queries, name="query_id"), table(spark, rows), 4, max_k=None, pivots=pivots)
    assert answers(got) == brute(queries, rows, 4)


def test_pivots_skip_far_cells(spark):
    rows = clustered(600)
    told = N.pivot_share(table(spark, rows[1:41], name="query_id"), table(spark, rows), 4, pivots=40).first()
    assert told["pairs"] == 40 * 600 and told["skipped_share"] > 0.5


def test_pivots_with_odd_vectors(spark):
    """Dimensions meet their own only; null, empty and non-finite vectors; fewer rows than k; no rows at all."""
    rows = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [1.0, 1.0, 1.0]), (4, None), (5, [float("nan"), 0.0]), (6, [None, 1.0]),
            (7, [float("inf"), 1.0]), (8, []), (2, [3.0, 4.0])]
    c = spark.createDataFrame(rows, VECTORS)
    q = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0, 2.0]), (3, None), (4, [1.0] * 5)], "query_id long, text_embedding array<float>")
    for pivots in (1, 4):
        got = answers(N.nearest_snippets(q, c.dropDuplicates(["id"]), 5, max_k=None, pivots=pivots))
        assert got == {1: [1, 2], 2: [3]}
        assert not answers(N.nearest_snippets(q, c.limit(0), 5, max_k=None, pivots=pivots))
    assert N.pivot_share(q.limit(0), c, 2, pivots=3).first()["skipped_share"] is None


def test_stored_index(spark, tmp_path, monkeypatch):
    """One index answers several lookups, reads only folders of probed lists, and tells recall and share."""
    monkeypatch.setattr(N, "CORPUS_BLOCK", 64)
    monkeypatch.setattr(N, "QUERY_BLOCK", 16)
    rows, root = clustered(900), str(tmp_path / "index")
    N.build_index(table(spark, rows), root, lists=30)
    stored = spark.read.parquet(f"{root}/rows")
    assert sorted(r["cid"] for r in stored.select("cid").collect()) == list(range(900))
    queries = clustered(60)[7:47]
    q = table(spark, queries, name="query_id")
    want, got = brute(queries, rows, 3), answers(N.search_index(q, root, 3))
    assert all(len(v) == 3 for v in got.values()) and len(got) == 40
    assert sum(len(set(want[i]) & set(got[i])) for i in want) >= 0.9 * 3 * 40
    told = N.index_quality(q, root, 3).first()
    assert told["wanted"] == 120 and told["recall"] >= 0.9 and told["candidate_share"] < 0.5
    whole = answers(N.search_index(q, root, 3, probes=30, refine=300))
    assert whole == want  # all lists and all candidates: exact
    one = N.search_index(q.filter("query_id = 1"), root, 3, probes=1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    read = [int(p.split("=")[1]) for p in os.listdir(f"{root}/rows") if p.startswith("list=")]
    assert len(read) > 5 and "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [(list" in plan


def test_index_of_evenly_spread_vectors(spark, tmp_path):
    rnd = np.random.default_rng(11)
    rows = rnd.normal(size=(1200, 32))
    rows = (rows / np.linalg.norm(rows, axis=1)[:, None]).astype(np.float32)
    root = str(tmp_path / "even")
    N.build_index(table(spark, rows), root)
    told = N.index_quality(table(spark, rows[::20], name="query_id"), root, 5).first()
    assert told["wanted"] == 300 and told["recall"] >= 0.9


def test_index_of_few_rows(spark, tmp_path):
    q = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], "query_id long, text_embedding array<float>")
    for n in (0, 1, 2):
        root = str(tmp_path / f"few{n}")
        c = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(n)] + [(9, None)], VECTORS)
        N.build_index(c, root)
        assert answers(N.search_index(q, root, 3)) == ({1: list(range(n))} if n else {})
    with pytest.raises(ValueError):
        N.build_index(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], VECTORS), str(tmp_path / "mixed"))


def peak_mb(work):
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


def test_memory_of_code_words():
    """The distances of a sample to all code words or centres are never held at once."""
    rows = np.random.default_rng(1).normal(size=(32_768, 4))
    assert peak_mb(lambda: N._code_words(rows, 7)) < 60
    assert (N._closest(rows[:3000], rows[:700]) == N._squares(rows[:3000], rows[:700]).argmin(axis=1)).all()


def test_queries_meet_shelves_of_lists(spark, tmp_path, monkeypatch):
    """A query leaves with its best estimates once a shelf, however many of its lists it reads."""
    rows, root, seen = clustered(600), str(tmp_path / "index"), []
    N.build_index(table(spark, rows), root, lists=20)
    meet = N._meet

    def spied(asked, held, cell, *rest):
        found = meet(asked, held, cell, *rest)
        if "told" in found.columns:
            seen.append((asked.count(), found.count()))
        return found

    monkeypatch.setattr(N, "_meet", spied)
    queries = clustered(60)[7:17]
    got = answers(N.search_index(table(spark, queries, name="query_id"), root, 2, probes=20, refine=5))
    assert seen == [(10, 100)] and all(len(v) == 2 for v in got.values())
    assert N._shelves([(0, 9000), (2, 7000), (3, 400), (5, 50_000), (6, 1)]) == [[0, 2], [3], [5], [6]]


def test_memory_of_a_block_and_of_bounds():
    """Distances of a full block, and bounds of a batch of queries to 64 cells by 64 pivots, are made piece by piece."""
    rnd = np.random.default_rng(2)
    q, c = rnd.normal(size=(1024, 64)), rnd.normal(size=(N.CORPUS_BLOCK, 64))
    assert peak_mb(lambda: N._near(np.arange(len(q)), q, np.arange(len(c)), c, 3)) < 100
    d, lo = rnd.random((3000, 64)) + 1, rnd.random((64, 64))
    span, names, limit, got = np.stack([lo, lo + 0.1], axis=2), np.arange(64), rnd.random(3000), []
    assert peak_mb(lambda: got.extend(N._others(d, names, span, limit))) < 60
    least = np.maximum(lo[None] - d[:100, None], d[:100, None] - lo[None] - 0.1).max(axis=2)
    want = [[j for j in np.flatnonzero(least[i] <= np.sqrt(limit[i]) + 1e-8) if j != d[i].argmin()] for i in range(100)]
    assert [list(x) for x in got[:100]] == want

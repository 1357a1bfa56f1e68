import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsift.llm import neighbours


def brute(rows, is_query, k=10):
    """Exact neighbours in double precision: {query: [(distance, id)]}."""
    ok = {}
    for i, v in rows:
        if i is None or v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        ok.setdefault(i, []).append(np.array(v, np.float64))
    out = {}
    for i, mine in ok.items():
        if is_query(i):
            q = min(mine, key=lambda v: v.tolist())
            near = {(float(np.sqrt(((v - q) ** 2).sum())), j) for j, vs in ok.items() if j != i for v in vs if len(v) == len(q)}
            out[i] = sorted(near)[:k]
    return out


def recall(got, want):
    hit = total = 0
    for q, near in want.items():
        mine = {r.vec_id for r in got if r.query_id == q}
        hit += len(mine & {j for _, j in near})
        total += len(near)
    return hit / total


def check_rows(got, rows, want, k=10):
    vec = {}
    for i, v in rows:
        vec.setdefault(i, []).append(v)
    for q, near in want.items():
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(near) + 1))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
    assert {r.query_id for r in got} == {q for q, near in want.items() if near}


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))


def test_few_odd_and_tied_vectors(spark):
    e = [1.0, 0.0, 0.0]
    rows = [(0, e), (1, [0.0, 1.0, 0.0]), (2, e), (3, e), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [float("nan"), 1.0, 0.0]),
            (8, [1.0, None, 0.0]), (9, [float("inf"), 0.0, 0.0]), (10, [0.0, 2.0, 0.0]), (None, e), (20, [1.0, 1.0]), (3, e),
            (30, [0.0, -0.0, 1.0]), (100, [2.0, 0.0]), (40, [-1.0, 0.0, 0.0])]
    got = neighbours.nearest(frame(spark, rows), F.col("vec_id") % 10 == 0, k=4).collect()
    want = brute(rows, lambda i: i % 10 == 0, 4)
    assert {q: [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in want} == want
    assert neighbours.nearest(frame(spark, rows).limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert neighbours.nearest(frame(spark, rows), F.lit(False)).count() == 0


@pytest.mark.parametrize("small_blocks", [False, True])
def test_copies_and_clusters(spark, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(neighbours, "VECTORS", 150)
        monkeypatch.setattr(neighbours, "QUERIES", 5)
    rnd = np.random.default_rng(2)
    centres = rnd.standard_normal((12, 24))
    rows = [(i, (centres[i % 12] + 0.4 * rnd.standard_normal(24)).astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(400)]  # one vector very often
    got = neighbours.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()
    want = brute(rows, lambda i: i % 50 == 0)
    check_rows(got, rows, want)
    assert recall(got, want) >= 0.95
    copies = [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 1200]
    assert copies == [0, *range(1000, 1009)]


def test_recall_of_the_query(spark):
    from logsift.llm.queries import op8_collision_counting
    d = "/root/testdata/sf0.1"
    got = op8_collision_counting(spark, d).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 100 == 0)
    check_rows(got, rows, want)
    assert recall(got, want) >= 0.9
    exact = {(q, j): d for q, near in want.items() for d, j in near}
    assert all(r.score == pytest.approx(exact[r.query_id, r.vec_id], abs=1e-12) for r in got if (r.query_id, r.vec_id) in exact)


def test_fewer_vectors_are_verified_than_there_are():
    rnd = np.random.default_rng(4)
    x = rnd.standard_normal((200, 32))[rnd.integers(0, 200, 4000)] + 0.2 * rnd.standard_normal((4000, 32))
    block = neighbours.Block(x)
    share = [len(block.search(x[i], 11)[0]) / len(x) for i in range(0, 4000, 200)]
    assert np.mean(share) < 0.3

"""Hard negatives: intervals that hold, searches against brute force, defined results at the edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsift.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, positives=5, count=10, least=30, most=90):
    def fine(r):
        return None not in r and all(x is not None and math.isfinite(x) for x in r[1])
    rows = sorted({(i, tuple(math.floor(256 * x) for x in v), c) for i, v, c in filter(fine, rows)})
    out = []
    for i, v, c in (r for r in rows if r[0] % 10 == 0):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, d) for j, w, d in rows if len(w) == len(v))
        for p, j, _ in [x for x in scored if x[2] == c and x[1] != i][:positives]:
            fit = [(n, k) for n, k, d in scored if d != c and least * -p <= 100 * -n <= most * -p][:count]
            out += [(i, j, r + 1, k, -p, -n) for r, (n, k) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("dim", F.lit("clash")).withColumn("anchor", F.lit(3))
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 10 == 0, **kw).collect())


@pytest.mark.parametrize("dim", [1, 3, 64, 130])
def test_bounds_hold(dim):
    rng = np.random.default_rng(dim)
    vecs = np.vstack((rng.integers(-300, 300, (200, dim)), np.zeros((1, dim), int), np.eye(1, dim, dtype=int) * 5000))
    codes = negatives.Codes.of(vecs, 1)
    for q in np.vstack((rng.integers(-300, 300, (20, dim)), vecs[:5], vecs[-2:])):
        _, low, high = negatives.score_bounds(codes, q, 1)
        exact = vecs @ q
        assert (low <= exact).all() and (exact <= high).all()


def test_intervals_drop_far_vectors():
    rng = np.random.default_rng(2)
    vecs = np.vstack([c + rng.integers(-8, 9, (50, 64)) for c in rng.integers(-200, 200, (20, 64))])
    codes, ids = negatives.Codes.of(vecs, 1), np.arange(1000)
    found, scored = negatives.search(vecs, codes, ids, ids != 3, vecs[3], 5, [(-(1 << 62), 1 << 62)], 1)
    exact = vecs @ vecs[3]
    assert found[0][0].tolist() == [i for i in np.lexsort((ids, -exact)) if i != 3][:5]
    assert scored < 100


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "VECTORS", 64)  # several blocks and batches
    monkeypatch.setattr(negatives, "QUERIES", 8)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 16))
    rows = [(i, (centres[i % 6] + 0.4 * rng.standard_normal(16)).tolist(), int(i * 7 % 4)) for i in range(300)]
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 500


def test_edges(spark):
    rows = [(0, [1.0, 0.0], 1), (10, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [0.5, 9.0], 2), (5, [0.5, -9.0], 2), (5, [0.5, -9.0], 2),
            (6, [0.5], 2), (20, [], 1), (21, [], 1), (22, [], 3), (None, [0.5, 0.0], 2), (7, None, 2), (8, [0.5, 0.0], None),
            (9, [float("nan"), 0.5], 2), (11, [float("inf"), 0.5], 2), (12, [None, 0.5], 2), (30, [0.0, 0.0], 5), (31, [0.0, 0.0], 5),
            (40, [-1.0, 0.0], 6), (41, [1.0, 0.001], 6), (50, [0.5, 1.0], 1)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows + [(13, [1e300, 1.0], 2), (14, [-1e300, 1.0], 1)]) == brute(rows)  # beyond longs: no part
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []


def test_large_components_are_exact(spark):
    rows = [(i, [float((i * 977 % 1000) * 2 ** 20 + 1) / 256, float(i * 31 % 97) / 256], i % 3) for i in range(60)]
    assert mined(spark, rows) == brute(rows)


def test_query_is_the_sql(llm_oracle, sf_small):
    llm_oracle("op12_one_bit_negatives", sf_small)

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from logsift.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Share by weight, stop at the cap, share what is left again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(full.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not over:
            return {**full, **{s: level * w[s] for s in open_}}
        full |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return full


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, size long, quality double")


def summed(mixed):
    got = defaultdict(lambda: [0, 0, None])
    for r in mixing.per_row(mixed).collect():
        g = got[r.source]
        g[0] += r.size * r.times
        g[1] += r.size
        g[2] = r.target
        assert r.times <= 2
    return got


@pytest.mark.parametrize("exact", [4096, 3])
def test_targets_are_met(spark, monkeypatch, exact):
    monkeypatch.setattr(mixing, "EXACT", exact)
    monkeypatch.setattr(mixing, "CELLS", 256 if exact > 3 else 4)
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "a", "a", "b", "c", "d", "é", None]), rnd.choice([0, 1, 5, 40, 200]),
             rnd.choice([1.0, 0.25, 0.5, None, 0.0])) for i in range(700)]
    rows += [(9, "a", 40, 1.0)] * 30 + [(None, "b", 5, 1.0)] * 3 + [(5000, "zero", 0, 1.0), (5001, "tiny", 3, 1.0)]
    got = summed(mixing.mix(frame(spark, rows)))
    sizes = defaultdict(int)
    for _, s, n, _ in rows:
        sizes[s] += n
    want = brute_targets(sizes)
    for s, (taken, size, target) in got.items():
        assert size == sizes[s] and target == pytest.approx(want[s]), s
        assert abs(taken - target) <= max(n for _, t, n, _ in rows if t == s) / 2 + 1e-6, s
    again = mixing.per_row(mixing.mix(frame(spark, rows[::-1]).repartition(7))).collect()
    first = mixing.per_row(mixing.mix(frame(spark, rows))).collect()
    assert sorted(map(str, again)) == sorted(map(str, first)) and len(first) == len(rows)


def test_quality_comes_first(spark):
    rows = [(i, "a", 1, 1.0 if i % 2 else 0.1) for i in range(4000)] + [(i, "b", 1, 1.0) for i in range(4000, 20000)]
    took = [r.id % 2 for r in mixing.per_row(mixing.mix(frame(spark, rows), share=0.1, weights=(1, 1))).collect()
            if r.source == "a" and r.times]
    assert len(took) == 1000 and sum(took) / len(took) > 0.8


def test_empty_and_repeats(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    docs = spark.createDataFrame([(1, "x y z", "a"), (1, "x y z", "a"), (2, "p q", "b"), (None, None, None)],
                                 "doc_id long, text string, source string").withColumn("epochs", F.lit(1))
    sized = mixing.sized(docs)
    mixed = mixing.mix(sized.withColumn("quality", F.lit(1.0)))
    out = mixing.repeat_documents(sized, mixed)
    assert out.columns == docs.columns
    times = {}
    for r in mixing.per_row(mixed).collect():
        times[r.id] = times.get(r.id, 0) + r.times
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in times.items() if v}


def test_word_count(spark):
    rows = [("a b\x0bc\x0c d\x85e f",), (None,), ("",), (" \n",), ("w " * 100_000,)]
    got = [r.n for r in spark.createDataFrame(rows, "text string").select(mixing.word_count("text").alias("n")).collect()]
    assert got == [5, 0, 0, 0, 100_000]


def test_query_equals_oracle(spark, sf_mid, llm_oracle):
    llm_oracle("op4_weighted_mix", sf_mid)

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsift.llm import toxicity


def test_risk_is_the_stated_sum():
    zp, zu, prior = np.array([2.0, -1.0, 0.5]), np.array([-2.0, 0.1, -3.0, 1.0]), 0.3
    sig = lambda z: 1 / (1 + np.exp(-z))
    pos = prior * np.mean([sig(-z) for z in zp])
    neg = np.mean([sig(z) for z in zu]) - prior * np.mean([sig(z) for z in zp])
    assert toxicity.risk(zp, zu, prior) == pytest.approx((pos, neg, pos + max(0, neg)))
    assert toxicity.risk(np.full(3, 9.0), np.full(3, -9.0), 0.5)[1] < 0
    assert toxicity.risk(np.full(3, 9.0), np.full(3, -9.0), 0.5)[2] >= 0


def test_fit_separates_a_mixture():
    rnd = np.random.default_rng(1)
    make = lambda toxic: np.unique(np.append(rnd.integers(5, 40, 6), rnd.integers(0, 5, 2) if toxic else []).astype(int))
    positive = [make(True) for _ in range(200)]
    truth = rnd.random(2000) < 0.1
    w, b = toxicity.fit(positive, [make(t) for t in truth], 0.1)
    w = np.append(w, np.zeros(40 - len(w)))
    fresh = rnd.random(1000) < 0.1
    said = np.array([w[make(t)].sum() + b > 0 for t in fresh])
    assert (said == fresh).mean() > 0.97


def rows_of(n=600, seed=3):
    rnd = random.Random(seed)
    words = [a + b for a in ("ber", "tion", "the", "and", "lor", "em") for b in ("a", "o", "ix", "um", "est", "ing")]
    out = []
    for i in range(n):
        t = [rnd.choice(words) for _ in range(rnd.randint(30, 120))]
        bad = rnd.random() < 0.15
        if bad:
            for _ in range(3):
                t[rnd.randrange(len(t))] = rnd.choice(["vileness", "vilemost", "rotter", "scoundrel"])
        out.append((i, " ".join(t), int(bad)))
    return out


def test_train_and_score(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, None, "x"), (1000, "", "x"), (1001, "vileness " * 60_000, "y")],
                                 "doc_id long, text string, score_old string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2 == 0] + [(None, 1), (4, None), (99_999, 1), (0, rows[0][2])],
                                   "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.with_score(docs, model).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    right = sum((by[i] >= toxicity.THRESHOLD) == bool(y) for i, _, y in rows)
    assert right / len(rows) > 0.97 and by[1001] >= toxicity.THRESHOLD
    assert by[1000] == by[None] < 0.5
    again = toxicity.train(docs.repartition(5), labels)
    assert np.array_equal(again.cells, model.cells) and np.allclose(again.weights, model.weights)


def test_held_out_labels_are_never_read(spark):
    rows = rows_of(300, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    out = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    flags = {r.doc_id: r.h for r in docs.select("doc_id", toxicity.held_out("doc_id").alias("h")).collect()}
    assert sorted(i for i, h in flags.items() if h) == out and out
    plain = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    swapped = plain.withColumn("toxic", F.when(F.col("doc_id").isin(out), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, plain), toxicity.train(docs, swapped)
    assert np.array_equal(a.cells, b.cells) and np.allclose(a.weights, b.weights) and a.prior == b.prior


def test_words_of_a_small_share_of_the_positives_are_learned(spark):
    rnd = random.Random(8)
    words = [a + b for a in ("ber", "tion", "lor", "em") for b in ("a", "o", "ix", "um", "est")]
    out = [i for i in range(6600) if zlib.crc32(str(i).encode()) % 3 == 1]
    learned = [i for i in range(6600) if zlib.crc32(str(i).encode()) % 3 != 1]
    # 400 learned positives, of which 7 (under 2 %) hold the word of a rare language.
    word = {i: "scoundrel" for i in learned[:393]} | {i: "malhechor" for i in learned[393:400] + out[:5]}
    rows = [(i, " ".join([rnd.choice(words) for _ in range(20)] + [word.get(i, "")])) for i in range(6600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in word)) for i in range(6600) if i in word or i % 2], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert set(toxicity._cells("malhechor")) <= set(model.cells.tolist())
    score = model.scorer()
    assert min(score(dict(rows)[i]) for i in out[:5]) >= toxicity.THRESHOLD
    assert max(score(t) for i, t in rows if i not in word) < toxicity.THRESHOLD


def test_long_words_are_whole_features():
    assert not np.array_equal(toxicity.features("x" * 64 + "a"), toxicity.features("x" * 64 + "b"))


def test_without_positives_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert [r.score for r in toxicity.with_score(docs, model).collect()] == pytest.approx([0.01, 0.01])
    assert toxicity.with_score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


def test_query_on_held_out_rows(spark):
    from logsift.llm.queries import op2_toxicity_nnpu
    d = "/root/testdata/sf0.1"
    got = op2_toxicity_nnpu(spark, d)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    rows = got.filter("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    # About one in eight of the toxic labels here marks a text that holds no toxic word at all.
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.75
    assert sum(r.predicted for r in clean) / len(clean) < 0.01
    better = sum((t.score > c.score) + 0.5 * (t.score == c.score) for t in toxic for c in clean) / (len(toxic) * len(clean))
    assert better > 0.9

"""Language identification: forward and expected counts against all segmentations, held-out accuracy."""

import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from logsift.llm import langid

PIECES = ["▁", "a", "b", "▁a", "ab", "▁ab", "ba", "aba"]


def segmentations(word):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in PIECES or k == 1:
            for rest in segmentations(word[k:]):
                yield [word[:k], *rest]


def weight(piece, p, lang):
    return p[PIECES.index(piece), lang] if piece in PIECES else p[-1, lang]


@pytest.fixture(scope="module")
def p():
    return langid._normalised(np.random.default_rng(1).random((len(PIECES), 2)) * 9)


@pytest.mark.parametrize("word", ["a", "ab", "abab", "bca", "ababa", "ccc"])
def test_forward_sums_all_segmentations(p, word):
    grid = langid.Pieces(PIECES).grid([word])
    got = langid.forward(grid, p)[-1][0]
    ways = list(segmentations("▁" + word))
    for lang in (0, 1):
        assert got[lang] == pytest.approx(sum(math.prod(weight(x, p, lang) for x in w) for w in ways))
    counts = langid.expected(grid, p[:, :1], np.array([3.0]))
    total = sum(math.prod(weight(x, p, 0) for x in w) for w in ways)
    for i, piece in enumerate(PIECES):
        want = sum(math.prod(weight(x, p, 0) for x in w) * w.count(piece) for w in ways) * 3 / total
        assert counts[i] == pytest.approx(want)


def test_units():
    assert langid.units("Ab, c²d\n_x9") == ["ab", "c", "d", "x"]
    assert langid.units("1 2 — _") == []
    assert langid.units("x" * 70) == ["x" * 32, "x" * 32, "x" * 6]


def test_long_words_stay_in_range(p):
    model = langid.Model(tuple(PIECES), ("k", "l"), p, np.zeros(2))
    got = model.scorer()(["z" * 5000, "ab" * 5000, "", "123"])
    assert [g[0] for g in got[2:]] == ["und", "und"] and all(0 <= g[1] <= 1 for g in got)


SCHEMA = "doc_id long, lang string, text string, score string, lang_pred int"


def rows(n):
    words = {"aa": "tra lo mina", "bb": "schu kex wod", "cc": "tra kex mina"}
    return [(i, lang, f"{w} {w} x{i}", "clash", 1) for i in range(n) for lang, w in words.items()]


def test_edges(spark):
    pieces = langid.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    extra = [(None, "aa", "tra lo", "", 0), (900, None, "schu kex wod", "", 0), (901, "aa", None, "", 0), (902, "aa", "", "", 0),
             (903, "bb", "12 34", "", 0), (904, None, "tra lo mina " * 20_000, "", 0), (900, None, "schu kex wod", "", 0), (905, None, "日本語", "", 0)]
    df = spark.createDataFrame(rows(60) + extra, SCHEMA).withColumn("__langid", F.lit("kept"))
    model = langid.train(df, pieces)
    assert model.languages == ("aa", "bb", "cc")
    again = langid.train(df.repartition(5), pieces)
    assert np.allclose(model.p, again.p)
    got = langid.with_language(df, model)
    assert got.columns == df.columns and got.filter("__langid = 'kept'").count() == df.count()
    by = {r.doc_id: (r.lang_pred, r.score) for r in got.filter("doc_id is null or doc_id >= 900").collect()}
    assert by[None][0] == "aa" and by[900][0] == "bb" and by[904][0] == "aa" and by[905][0] in model.languages
    assert by[901] == by[902] == by[903] == ("und", 0.0)
    assert got.filter("doc_id < 60 and lang <> lang_pred").count() == 0
    empty = langid.train(df.limit(0), pieces)
    assert {r.lang_pred for r in langid.with_language(df, empty).collect()} == {"und"}
    assert langid.with_language(df.limit(0), model).collect() == []


def test_only_learned_rows_teach(spark):
    """Labels of held-out rows change nothing."""
    pieces = langid.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    df = spark.createDataFrame(rows(30), SCHEMA)
    other = df.withColumn("lang", F.when(langid.held_out("doc_id"), "zz").otherwise(F.col("lang")))
    a, b = langid.train(df, pieces), langid.train(other, pieces)
    assert a.languages == b.languages and np.allclose(a.p, b.p) and np.allclose(a.prior, b.prior)


def test_query_held_out_accuracy(spark, sf_mid):
    from logsift.llm import REGISTRY
    docs = spark.read.parquet(f"{sf_mid}/documents.parquet").select("doc_id", "lang")
    got = REGISTRY["op13_segmentation_langid"](spark, sf_mid).join(docs, "doc_id").toPandas()
    assert len(got) == docs.count()
    assert got["score"].between(0, 1).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.99

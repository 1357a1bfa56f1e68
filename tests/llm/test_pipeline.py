import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from logsift.llm import bpe, secrets, toxicity
from test_mixing import brute_targets
from test_simhash import brute_classes, brute_fp


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


SF = "/root/testdata/sf0.001"


def test_toxic_documents_go_and_clean_ones_stay(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = cp.reject_toxic(spark, docs, sf)
    assert kept.columns == docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    before = {r.toxic: r["count"] for r in docs.join(labels, "doc_id").groupBy("toxic").count().collect()}
    after = {r.toxic: r["count"] for r in kept.join(labels, "doc_id").groupBy("toxic").count().collect()}
    assert after[0] / before[0] > 0.99 and after[1] / before[1] < 0.2


def test_one_document_of_each_group_stays(spark, docs):
    kept = cp.drop_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    fps = {r.doc_id: brute_fp(r.text) for r in docs.collect()}
    root = brute_classes(fps.values())
    want = {}
    for d, f in fps.items():
        want[root[f]] = min(d, want.get(root[f], d))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want.values())


def test_secrets_are_marked(spark, docs):
    planted = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(' token = "0a1b2c3d4e5f60718293a4b5c6d7e8f9"')))
                              .otherwise(F.col("text")))
    out = cp.redact_secrets(spark, planted, SF)
    assert out.columns == docs.columns and out.count() == docs.count()
    words = secrets.dictionary(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    clean = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    for r in planted.collect():
        text = secrets.redact(r.text, secrets.scan(r.text, words))
        assert clean[r.doc_id] == (text, len(text)) and "0a1b2c3d" not in text


def test_documents_repeat_as_mixed(spark, docs):
    out = cp.mix_sources(spark, docs, SF)
    assert out.columns == docs.columns
    size = {r.doc_id: len(r.text.encode().split()) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    want, taken = {}, {}
    for d, s in source.items():
        want[s] = want.get(s, 0) + size[d]
    want = brute_targets(want)
    times = {}
    for r in out.collect():
        taken[r.source] = taken.get(r.source, 0) + size[r.doc_id]
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) == 2
    for s, t in want.items():
        assert abs(taken.get(s, 0) - t) <= max(size[d] for d in size if source[d] == s) / 2 + 1e-6


def test_whole_run(spark):
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "secret_scan", "source_mix", "byte_bpe"]
    got = cp.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES:  # the same, stage by stage and without files between
        docs = stage(spark, docs, SF)
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((r.doc_id, r.n_tokens) for r in docs.collect())
    assert got and all(r.exact and len(r.ids) == r.n_tokens for r in got)


def test_encode(spark, docs):
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                               mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    got = {r.doc_id: r.ids for r in cp.encode(spark, docs, SF).collect()}
    assert got == {r.doc_id: oracle.encode_ordinary(r.text) for r in docs.collect()}


INTERNAL = ("row", "score", "size", "quality", "spans", "clean", "times", "__found", "__size", "__q", "__id", "__clean", "__copy", "__score",
            "__fp", "__f", "__times", "__extra", "__epochs", "__n_rows", "__m_id", "__bpe", "__own", "__row", "fp", "id", "a b")


def test_input_columns_of_any_name_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    clashing = docs.withColumns({c: F.concat(F.lit(c + ":"), F.col("doc_id").cast("string")) for c in INTERNAL})
    for name, stage in cp.STAGES[:-1]:
        out, plain = stage(spark, clashing, SF), stage(spark, docs, SF)
        assert out.columns == clashing.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in INTERNAL), name
        assert sorted(tuple(r) for r in out.select(*docs.columns).collect()) == sorted(tuple(r) for r in plain.collect()), name


def test_choices_do_not_depend_on_how_rows_are_dealt(spark):
    rows = [(7 if i % 3 else None, "the same words in every one of these rows", "en", f"s{i % 2}", i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES[:-1]:
        got = [sorted(str(tuple(r)) for r in stage(spark, d, SF).collect()) for d in (docs, docs.repartition(7, "n_chars").orderBy(F.desc("n_chars")))]
        assert got[0] == got[1], name


def test_odd_rows_in_every_stage(spark):
    rows = [(1, "plain words in a row for a test", "en", "a", 31), (1, "plain words in a row for a test", "en", "a", 31),
            (2, None, None, None, None), (None, "", "en", "a", 0), (3, "word " * 60_000, "en", "b", 300_000),
            (None, "nobody owns these words but they stay", None, "b", 5), (1, "quite another text under the same id", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for extra in (docs, docs.withColumn("score", F.lit(1)).withColumn("size", F.lit("s")).withColumn("ids", F.lit(0)), docs.limit(0)):
        for name, stage in cp.STAGES:
            out = stage(spark, extra, SF)
            n = out.count()
            if extra.isEmpty():
                assert n == 0, name
            elif name != "byte_bpe":
                assert out.columns == extra.columns, name
            if name == "simhash_near_dedup" and not extra.isEmpty():
                # the empty text without an id goes with document 2
                assert n == 5
    assert toxicity.THRESHOLD == 0.7

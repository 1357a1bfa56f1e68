import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from logsift.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.from_file(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH),
                             special_tokens={})


ODD = ["", " ", "\n\n  x", "<|endoftext|>", "Ünïcödé 日本語 🙂🙂 é", "a" * 3000, "don't 12 34!!\t\r\n", " 　x  "]


def test_ids_equal_tiktoken(vocabulary, oracle):
    assert bpe.encode_batch(ODD, vocabulary)[0] == [oracle.encode_ordinary(t) for t in ODD]
    assert bpe.encode_batch(ODD, vocabulary, offsets=True)[0] == [oracle.encode_ordinary(t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab  \n\t'sté日🙂12.!-ﬁ"), max_size=60), max_size=5))
def test_any_text(vocabulary, oracle, texts):
    assert bpe.encode_batch(texts, vocabulary)[0] == [oracle.encode_ordinary(t) for t in texts]


def test_small_table_of_seen_matches(vocabulary, oracle, monkeypatch):
    monkeypatch.setattr(bpe, "SEEN", 5)
    for _ in range(3):
        assert bpe.encode_batch(ODD, vocabulary)[0] == [oracle.encode_ordinary(t) for t in ODD]


def test_offsets_cover_characters(vocabulary):
    text = "Ü 日本 🙂!"
    ids, spans = bpe.encode_batch([text], vocabulary, offsets=True)
    at = 0
    for one, (a, b) in zip(ids[0], spans[0]):
        part = bpe.decode_pieces([[one]], vocabulary)[0]
        assert a <= at <= b and (part == text[a:b] or "�" in part or b - a == 1)
        at = b
    assert at == len(text)


def test_split_characters_decode_across_pieces(vocabulary):
    text = "x🙂y日"
    ids = bpe.encode_batch([text], vocabulary)[0][0]
    assert len(ids) > 4
    assert "".join(bpe.decode_pieces([[i] for i in ids], vocabulary)) == text


def test_frames(spark, vocabulary, oracle):
    rows = [(i, t, "e") for i, t in enumerate(ODD + ["word " * 50_000])] + [(None, None, None), (1, " ", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids_sha string")
    got = bpe.with_decoded(bpe.with_tokens(docs, vocabulary, offsets="spans"), vocabulary).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == oracle.encode_ordinary(r.text or "") and len(r.spans) == len(r.ids)
        assert bytes(r.decoded).decode() == (r.text or "")
    assert bpe.with_decoded(bpe.with_tokens(docs.limit(0), vocabulary), vocabulary).count() == 0
    nulls = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [bytes(r.decoded) for r in bpe.with_decoded(nulls, vocabulary).collect()] == [b"", b""]
    with pytest.raises(ValueError):
        bpe.decode_flat(__import__("numpy").array([60_000]), __import__("numpy").array([0, 1]), vocabulary)


def test_query(spark, sf_small, oracle):
    from logsift.llm.queries import op9_byte_bpe
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op9_byte_bpe(spark, sf_small).collect()}
    want = {}
    for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect():
        ids = oracle.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                          hashlib.sha256((r.text or "").encode()).hexdigest())
    assert got == want

import random

from pyspark.sql import functions as F

from logsift.llm import chat


def test_escapes_round_trip(spark):
    rnd = random.Random(6)
    bits = ["<", "|", "\\", "b", "p", "n", "\n", "im_end", ">", "<|im_end|>\n", "é", "<|im_start|>", " "]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for role in (False, True):
        e = chat.escape(F.col("t"), role)
        for r in df.select("t", e.alias("e"), chat.unescape(e, role).alias("u")).collect():
            assert r.u == r.t and "<|" not in r.e and not (role and "\n" in r.e)


def test_turns_and_mask_read_back(spark):
    rnd = random.Random(9)
    bits = ["<|im_end|>\n", "<|im_start|>user\n", "\\n", "\\", "a b", "\n", "日", ""]
    rows = [(c, t * 40, rnd.choice(["user", "assistant", "to\nol", None]), "".join(rnd.choice(bits) for _ in range(3)))
            for c in range(12) for t in range(rnd.randint(1, 6))]
    rows += [(3, None, "assistant", "first"), (None, 0, "user", None), (50, 0, "assistant", "x" * 300_000),
             (7, 0, "user", "same"), (7, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit("b"))
    got = chat.format_chats(df.withColumn("parts", chat.text_part("text"))).select(
        "*", chat.read_back("formatted").alias("turns"), chat.under_mask().alias("learned")).collect()
    back, learned = {}, {}
    for r in sorted(got, key=lambda r: r.block):
        assert r.n_turns == len(r.turns) and r.attachments == []
        back.setdefault(r.conv_id, []).extend((t.role, t.text) for t in r.turns)
        learned.setdefault(r.conv_id, []).extend(r.learned)
    def key(r):
        t = r[3] or ""
        return (r[1] is not None, r[1] or 0, r[2] or "", t.replace("\\", "\\b").replace("<|", "<\\p"))
    for c in {r[0] for r in rows}:
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]
        assert back[c] == want
        assert learned[c] == [t for role, t in want if role == "assistant"]
    assert chat.format_chats(df.limit(0).withColumn("parts", chat.text_part("text"))).count() == 0


def test_typed_parts(spark):
    rows = [(1, 0, "user", [("text", "see <|image|>", None, None, None, None, None),
                            ("image", None, "a.png", 56, 29, None, None),
                            ("audio", None, "b.wav", None, None, 1.5, None),
                            (None, "and", None, None, None, None, None),
                            ("document", None, "c.pdf", None, None, None, 3), None,
                            ("image", "alt", None, None, None, None, None)]),
            (1, 1, "assistant", [("text", "ok", None, None, None, None, None)]), (1, 2, "user", None), (1, 3, None, [])]
    got = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts array<{chat.PART}>")).collect()
    assert len(got) == 1
    r = got[0]
    assert r.formatted == ("<|im_start|>user\nsee <\\pimage|><|image|><|audio|>and<|document|><|image|><|im_end|>\n"
                           "<|im_start|>assistant\nok<|im_end|>\n<|im_start|>user\n<|im_end|>\n<|im_start|>\n<|im_end|>\n")
    assert [(a.turn, a.kind, a.ref, a.n_tokens) for a in r.attachments] == [
        (0, "image", "a.png", 4), (0, "audio", "b.wav", 38), (0, "document", "c.pdf", 768), (0, "image", None, 1)]
    assert [r.formatted[a.start:a.end] for a in r.attachments] == ["<|image|>", "<|audio|>", "<|document|>", "<|image|>"]
    assert [r.formatted[s.start:s.end] for s in r.mask] == ["ok"] and r.n_attachment_tokens == 811 and r.n_turns == 4


def test_no_python_in_the_plan(spark, sf_small):
    from logsift.llm.queries import op7_chat_parts
    plan = op7_chat_parts(spark, sf_small)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_query_equals_oracle(spark, sf_mid, llm_oracle):
    llm_oracle("op7_chat_parts", sf_mid)

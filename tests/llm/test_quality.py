import random
from collections import Counter

from logsift.llm import quality


def brute(text):
    words, cur = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            if cur:
                words.append(cur)
            cur = ""
        else:
            cur += c
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    wins = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if wins[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(hit))


def test_measures_equal_rule():
    rnd = random.Random(2)
    texts = ["", " \n ", "a", "a a a", "a a a a", "x\n\nx\n x\nx", "é ü z % #", " a b"]
    texts += [" ".join(rnd.choice("a b c | é\n x\ty").strip(" ") or "\n" for _ in range(rnd.randint(0, 50)))
              for _ in range(200)]
    for t in texts:
        assert quality.measure(t)[:5] == brute(t), t


def test_many_distinct_words():
    import numpy as np
    ids = np.array([0, 1, 2, 5, 0, 1, 2], np.int64)
    assert quality._triples_repeated(ids, 8) == quality._triples_repeated(ids, 1 << 22) == 6


def test_policies_and_ablation(spark):
    ok = " ".join(f"word{i}" for i in range(60))
    rows = [(1, ok), (2, "short"), (3, ok.replace(" ", " # ")), (4, None), (5, "same words again " * 30),
            (6, "# % " * 10), (1, ok), (None, ok)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "failed_id")
    led = quality.ledger(docs)
    bits = {(r.failed_id, r.text): r.failed for r in led.collect()}
    assert bits[1, ok] == 0 and bits[None, ok] == 0 and bits[2, "short"] == 1 and bits[4, None] == 1
    assert bits[5, rows[4][1]] == 2 and bits[3, rows[2][1]] & 4
    assert led.filter(quality.passes(quality.POLICIES["v2"])).count() == 3
    got = {r.rule: r for r in quality.ablation(led, quality.POLICIES["v1"]).collect()}
    for name, r in got.items():
        bit = next(x.bit for x in quality.RULES if x.name == name)
        mask = quality.POLICIES["v1"].mask
        fails = [f.failed & mask for f in led.collect()]
        assert r.n_documents == 8 and r.n_failed == sum(f >> bit & 1 for f in fails)
        assert r.n_failed_alone == sum(f == 1 << bit for f in fails)
        assert r.n_kept_without == sum(f & ~(1 << bit) == 0 for f in fails)
    assert quality.ledger(docs.limit(0)).count() == 0
    long = "w " * 200_000
    assert quality.measure(long)[:2] == (200_000, 200_000)


def test_query_equals_oracle(spark, sf_small, llm_oracle):
    llm_oracle("op6_quality_ledger", sf_small)

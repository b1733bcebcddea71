"""The trusted target of the quality rules counts every document labelled good."""

import math

import pytest
from pyspark.sql import functions as F

from tierwise.llm.quality_rules import BUCKETS, log_ratios


def test_target_beyond_ten_thousand_labels(spark):
    n = 10_500
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("word").alias("text")).unionByName(spark.createDataFrame([(None, "word"), (n, "word"), (1, "word")], "doc_id long, text string"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    got = log_ratios(docs, labels.unionByName(labels.limit(5))).first()["ratios"]
    # One word and one shape in all texts, so two buckets, the least ratio: n + 1 good rows (an id stands twice) of n + 3.
    assert min(got) == pytest.approx(1e6 * math.log((n + 2) / ((n + 3) * (n + 1) / (n + 3) + 1)), abs=1)
    assert max(got) == 0 and sum(g != 0 for g in got) <= 2


def test_no_labels_no_verdict(spark):
    from tierwise.llm.quality_rules import quality_rules

    docs = spark.createDataFrame([(i, "plain words that stand here often enough to be counted well") for i in range(50)], "doc_id long, text string")
    got = quality_rules(docs, spark.createDataFrame([(None, 1), (3, 0)], "doc_id long, quality int")).collect()
    assert all(r["kept"] and r["llr"] == 0 for r in got)


def brute_rules(rows, good):
    """doc -> (word_chars, n_symbols, n_dup_lines, llr) in plain Python; rows: (id, text)."""
    import re

    import xxhash

    split = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    word = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), 42))
    number = lambda n, seed: xxhash.xxh64_intdigest((n % (1 << 64)).to_bytes(8, "little"), seed)

    def shape(c):
        return "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isnumeric() else c

    def grams(t):
        words = split(t)
        shapes = [word(re.sub("0+", "0", re.sub("a+", "a", re.sub("A+", "A", "".join(map(shape, w)))))) for w in words]
        pairs = [signed(number(b, number(a, 42))) for a, b in zip(shapes, shapes[1:])]
        return [h % BUCKETS for h in [*map(word, words), *shapes, *pairs]]

    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for i, t in rows:
        for g in grams(t or ""):
            raw[g] += 1
            target[g] += i in good
    total = sum(raw)
    size = sum(target) / sum(raw)
    ratios = [round(1e6 * math.log((a + 1) / (b * size + 1))) for a, b in zip(target, raw)]
    out = {}
    for i, t in rows:
        t = t or ""
        lines = [x for x in t.split("\n") if split(x)]
        got = [ratios[g] for g in grams(t)]
        out[i] = (sum(map(len, split(t))), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), int(sum(got) / len(got)) if got else 0)
    return out


def test_statistics_and_verdicts(spark):
    import random

    from tierwise.llm.quality_rules import quality_rules

    rng = random.Random(9)
    good = " ".join("The quick brown foxes jump over lazy dogs and Run home again".split() * 1).split()
    rows = [(i, " ".join(rng.choice(good) for _ in range(rng.randint(9, 60)))) for i in range(60)]
    rows += [(100 + i, " ".join("".join(rng.choice("AZ09#$%|x") for _ in range(8)) for _ in range(20))) for i in range(10)]
    rows += [(200, None), (201, ""), (202, " \n\t\n"), (203, "same line here\nsame line here\n\n \nother\nsame line here"), (204, "Straße ÉCOLE 3½ 日本 x#y <b> & $5")]
    labels = [(i, 1) for i in range(50)] + [(100, 0), (None, 1), (7, None), (999, 1)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: r for r in quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    want = brute_rules(rows, set(range(50)))
    assert set(got) == set(want)
    for i, (chars, symbols, lines, llr) in want.items():
        r = got[i]
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (chars, symbols, lines), i
        assert r["llr"] == pytest.approx(llr, abs=2), i  # logarithms may be rounded differently at a half
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= -1_000_000)
    assert max(got[100 + i]["llr"] for i in range(10)) < min(got[i]["llr"] for i in range(60))

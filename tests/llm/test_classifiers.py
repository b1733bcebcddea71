"""The classifiers against plain versions of their methods, and their held-out recall and precision."""

import math

import numpy as np
import pytest

from tierwise.llm import entry
from tierwise.llm import quality_classifier as Q
from tierwise.llm import toxicity as T

TEXTS = [b"You stupid idiot, you stupid one", b"Lovely day in \xc3\x89COLE", b"stupid \xc3\xa9cole  idiot", b"", b"A quiet day, a quiet night", b"idiot", b"quiet day"]
Y = np.array([1, 0, 1, 0, 0, 1, 0], float)


def plain_grams(text):
    """n-grams as strings, with the hash of each."""
    t = " " + " ".join(text.decode().lower().split()) + " "
    out = []
    for n in T.ORDERS:
        for i in range(len(t) - n + 1):
            h = n
            for c in t[i : i + n]:
                h = ((h ^ ord(c)) * 0x01000193 + 0x9E3779B1) % 2**32
                h ^= h >> 15
            out.append(((h * 0x85EBCA6B) % 2**32) >> (32 - T.BITS))
    return out


def test_ngrams_are_characters():
    for t in TEXTS:
        assert sorted(T.grams(t).tolist()) == sorted(plain_grams(t))
    assert len(T.grams("éé".encode())) == 1  # one 4-gram: blank, two letters, blank


def test_ratios_and_scores_equal_plain_ones():
    counts = [{g: plain_grams(t).count(g) for g in plain_grams(t)} for t in TEXTS]
    got = T.ratios([T.features(T.grams(t)) for t in TEXTS], Y, 2, 0.5)
    want = {}
    for g in set().union(*counts):
        mass = [sum(math.log1p(c.get(g, 0)) for c, v in zip(counts, Y) if v == k) for k in (0, 1)]
        r = math.log((mass[1] + 0.5) / (Y.sum() + 1)) - math.log((mass[0] + 0.5) / (len(Y) - Y.sum() + 1))
        if sum(g in c for c in counts) >= 2 and abs(r) >= 0.5:
            want[g] = r
    assert {int(g): float(got[g]) for g in np.flatnonzero(got)} == pytest.approx(want)
    w = T.fit(TEXTS, Y, least=1, cut=0.1)["w"]
    for t, c in zip(TEXTS, counts):
        assert T.margin(w, t) == pytest.approx(w[-1] + sum(w[g] * math.log1p(n) for g, n in c.items()))
    assert all((T.margin(w, t) > 0) == bool(v) for t, v in zip(TEXTS, Y) if t)


def test_ftrl_equals_plain_updates():
    alpha, beta, l1, l2 = 0.5, 1.0, 0.3, 0.1
    size = 1 << Q.BITS
    z, n = {}, {}

    def weight(k):
        cut = 0.0 if k == size else l1
        if abs(z.get(k, 0.0)) <= cut:
            return 0.0
        return -(z[k] - math.copysign(cut, z[k])) / ((beta + math.sqrt(n.get(k, 0.0))) / alpha + l2)

    for epoch in range(4):
        for i in np.random.default_rng(epoch).permutation(len(TEXTS)):
            x = dict(zip(*[v.tolist() for v in Q.features(TEXTS[i])])) | {size: 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * x[k] for k in x)))
            for k in x:
                g = (p - Y[i]) * x[k]
                s = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / alpha
                z[k] = z.get(k, 0.0) + g - s * w[k]
                n[k] = n.get(k, 0.0) + g * g
    got = Q.fit(TEXTS, Y)["w"]
    assert {int(k): float(got[k]) for k in np.flatnonzero(got)} == pytest.approx({k: weight(k) for k in z if weight(k)})
    at, x = Q.features(TEXTS[0])
    assert Q.margin(got, TEXTS[0]) == pytest.approx(sum(got[k] * v for k, v in zip(at, x)) + got[-1])


@pytest.mark.parametrize(("name", "column", "label", "recall", "precision"), [("op8_toxicity", "toxic", 1, 0.9, 0.8), ("op6_quality_classifier", "quality", 1, 0.9, 0.9), ("op6_quality_classifier", "quality", 0, 0.9, 0.75)])
def test_held_out_recall_and_precision(spark, name, column, label, recall, precision):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r[column] for r in entry.table(spark, sf, "labels").collect()}
    got = [(r["predicted"], labels[r["doc_id"]]) for r in entry.queries()[name](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    hit = sum(p == y == label for p, y in got)
    assert hit / sum(y == label for _, y in got) >= recall
    assert hit / sum(p == label for p, _ in got) >= precision


def test_edge_cases(spark):
    rows = [(1, "stupid idiot", 7), (1, "stupid idiot", 7), (2, "fine day", 8), (3, None, 9), (4, "", 9), (None, "idiot", 9), (5, "x" * 100_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")  # a column named as one of the results
    one_kind = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (9, 0), (2, None)], "doc_id long, toxic int")
    for run, label in ((T.toxicity, "toxic"), (Q.quality_classifier, "quality")):
        got = run(docs, one_kind.withColumnRenamed("toxic", label)).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1 and [r["held_out"] for r in got if r["doc_id"] is None] == [True]
        assert run(docs.where("false"), one_kind.withColumnRenamed("toxic", label)).columns == ["doc_id", "held_out", "score", "predicted"]


def test_rows_of_one_labelled_id_are_one_training_row(spark):
    from pyspark.sql import functions as F

    from tierwise.llm.linear import training_rows

    same = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    docs = same.unionByName(spark.createDataFrame([(2, "é" * 50), (3, "b"), (4, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (1, 1)], "doc_id long, toxic int")
    got = training_rows(docs, labels, "toxic", F.lit(True), 6_000)
    assert sorted((r.doc_id, r.text, r.y) for r in got.collect()) == [(1, "text 0", 1), (2, "é" * 50, 0), (3, "b", 1), (4, None, 0)]
    few = training_rows(docs, labels, "toxic", F.lit(True), 6_000, most_bytes=100).collect()
    assert sum(len((r.text or "").encode()) for r in few) <= 100 and len(few) < 4
    assert training_rows(docs, labels, "toxic", F.lit(True), 2).count() == 2

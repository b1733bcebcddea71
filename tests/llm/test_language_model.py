import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tierwise.llm import gated_lm, lm_scoring

SCHEMA = "doc_id long, text string, word string, c long, row long"


def rows(n=120):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)] + ["Aé", "ÀB", "the", "THE"]
    made = [(i, " ".join(rng.choice(words, rng.integers(1, 60))), "x", 1, 2) for i in range(n)]
    made += [(7, made[7][1], "x", 1, 2), (None, "the null id", "x", 1, 2), (500, None, "x", 1, 2), (501, "", None, None, None), (502, " \t\x0b\n", "x", 1, 2)]
    return [*made, (10, "only here " + "held out " * 30, "x", 1, 2), (503, "w1 w2 " * 3000, "x", 1, 2)]


def base(rows):
    """Base columns by the formula, per row."""
    counts = Counter()
    split = [(i, [*(t or "").encode().lower().split(), None]) for i, t, *_ in rows]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    for i, words in split:
        if not held(i):
            counts.update(words)
    n, v = sum(counts.values()), len(counts)
    return [(i, held(i), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for i, w in split]


def key(r):
    return (r[0] is None, r[0] or 0, r[2], r[5])


@pytest.mark.parametrize("known", [1 << 18, 16])
def test_base_columns(spark, monkeypatch, known):
    monkeypatch.setattr(lm_scoring, "KNOWN", known)
    data = rows()
    got = lm_scoring.lm_scores(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    want = sorted(base(data), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)


def test_empty_and_untrained(spark):
    assert lm_scoring.lm_scores(spark.createDataFrame([], SCHEMA)).collect() == []
    (r,) = lm_scoring.lm_scores(spark.createDataFrame([(None, "a b", "x", 1, 2)], SCHEMA)).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)


def test_model_beats_unigrams_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lm_scoring.lm_scores(docs).where("held_out").selectExpr("sum(score) / sum(n_tokens) AS model", "sum(base_score) / sum(n_tokens) AS base").first()
    assert held.model > held.base + 0.1


def small():
    v = gated_lm.Vocabulary(np.array([50, 30, 20, 10, 5, 5, 2, 1]), 9, 4)
    p = {k: x.astype(np.float32) for k, x in gated_lm.start(v).items()}
    rng = np.random.default_rng(1)
    return v, p, [rng.integers(0, 10, n).astype(np.int32) for n in (5, 1, 0, 30, 12)]


def plain_score(p, v, doc):
    """Log probability of one document, token by token."""
    h, total, n = np.zeros(gated_lm.UNITS), 0.0, gated_lm.UNITS
    for x, y in zip([v.end, *doc], [*doc, v.end], strict=True):
        pre, a = p["x"][x].astype(float), h @ p["u"].astype(float)
        z, r = (1 / (1 + np.exp(-(pre[:n] + a[:n]))), 1 / (1 + np.exp(-(pre[n : 2 * n] + a[n : 2 * n]))))
        c = np.tanh(pre[2 * n :] + r * a[2 * n :])
        h = z * h + (1 - z) * c
        e = h @ p["wc"] + p["bc"]
        total += e[v.cls[y]] - np.log(np.exp(e).sum())
        if y < v.size:
            lo, hi = v.edges[v.cls[y]], v.edges[v.cls[y] + 1]
            e = p["wo"][lo:hi] @ h + p["bo"][lo:hi]
            total += e[y - lo] - np.log(np.exp(e).sum())
    return total


def test_lanes_score_as_one_document_at_a_time(monkeypatch):
    v, p, docs = small()
    want = [plain_score(p, v, [x if x < v.size else v.other for x in d]) for d in docs]
    docs = [np.where(d >= v.size, v.other, d).astype(np.int32) for d in docs]
    for lanes, steps in ((1, 4), (2, 3), (256, 64)):
        monkeypatch.setattr(gated_lm, "LANES", lanes)
        monkeypatch.setattr(gated_lm, "SCORE_STEPS", steps)
        assert np.allclose(gated_lm.score(p, v, docs), want, atol=1e-3)


def test_gradients_are_those_of_the_likelihood():
    v, p, _ = small()
    inputs = np.array([[v.end, 1], [3, 2], [v.end, 7], [0, v.other]], np.int32)
    target = np.array([[3, 2], [v.end, 7], [0, v.other], [4, v.end]], np.int32)

    def loss(q):
        f = gated_lm.forward(q, inputs, np.zeros((2, gated_lm.UNITS), np.float32), v.end)
        return -gated_lm.outputs(q, v, f["h"].reshape(-1, gated_lm.UNITS), target.reshape(-1))[0].sum()

    grads = {k: np.zeros_like(x) for k, x in p.items()}
    f = gated_lm.forward(p, inputs, np.zeros((2, gated_lm.UNITS), np.float32), v.end)
    _, dh = gated_lm.outputs(p, v, f["h"].reshape(-1, gated_lm.UNITS), target.reshape(-1), grads)
    gated_lm.backward(p, f, inputs, dh.reshape(f["h"].shape), v.end, grads)
    rng = np.random.default_rng(0)
    for name in p:
        way = rng.standard_normal(p[name].shape).astype(np.float32)
        up, down = ({**p, name: p[name] + s * np.float32(1e-2) * way} for s in (1, -1))
        assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(float((grads[name] * way).sum()), rel=0.05, abs=0.02)


def test_probabilities_of_all_tokens_sum_to_one():
    v, p, _ = small()
    h = np.full((v.size + 2, gated_lm.UNITS), 0.3, np.float32)
    assert np.exp(gated_lm.outputs(p, v, h, np.arange(v.size + 2))[0]).sum() == pytest.approx(1, abs=1e-5)

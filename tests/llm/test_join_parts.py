"""The parts of the grouped prefix join: no filter loses a link, skipped pairs are not verified, limits change nothing."""

import random

import numpy as np
import pytest

from tests.llm.test_operators import SCHEMA, brute_components, texts
from tierwise.llm import common
from tierwise.llm import ngram_join as J


def similar_sets(threshold, k=200):
    rng = np.random.default_rng(1)
    while k:
        a = np.unique(rng.integers(0, 2**64, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) > rng.random() * 0.15], rng.integers(0, 2**64, rng.integers(0, 4), dtype=np.uint64)])
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= threshold * (len(a) + len(b) - both):
            k -= 1
            yield a, b


@pytest.mark.parametrize("threshold", [60, 80, 85, 100])
def test_filters_keep_all_links(threshold):
    levels = np.random.default_rng(2).integers(0, 4, J.CELLS).astype(np.uint8)
    for a, b in similar_sets(threshold):
        p, q = J.prefix_of(a, levels, threshold), J.prefix_of(b, levels, threshold)
        common = np.intersect1d(p, q)
        assert len(common)
        first = min(common.tolist(), key=lambda x: p.tolist().index(x))
        one = lambda x: np.array([x])
        assert J.compatible(one(len(a)), one(p.tolist().index(first)), one(len(b)), one(q.tolist().index(first)), threshold).all()
        assert J.may_link(len(a), J.parity(a), len(b), J.parity(b), threshold)


def test_bitmaps_rule_out_unlike_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (100, 120, 1000, 1100, 9000, 9500)]
    assert not any(J.may_link(len(a), J.parity(a), len(b), J.parity(b), 80) for a, b in zip(sets[::2], sets[1::2], strict=True))


def test_levels_put_what_is_frequent_last():
    counts = np.full(1000, 100)
    counts[[1, 2, 3]] = 400, 1000, 10**5
    levels = J.levels_of(counts)
    assert levels[0] == 0 < levels[1] < levels[2] < levels[3]
    assert J.levels_of(np.zeros(8, np.int64)).tolist() == [0] * 8


def test_pairs_without_common_prefix_are_not_verified():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 2**64, 50, dtype=np.uint64)) for _ in range(40)]
    sets = base + [b[1:] for b in base]
    ids = np.arange(len(sets))
    root, links, verified = J.link_members(ids, np.zeros(len(sets), int), sets, 85, False)
    assert root.tolist() == [*range(40), *range(40)] and links.tolist() == [1] * 80
    assert verified == 40  # of 3,160 pairs


@pytest.mark.parametrize(("few", "chunk"), [(1, 3), (2, 1 << 16), (1, 1)])
def test_limits_change_nothing(spark, monkeypatch, few, chunk):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], SCHEMA)
    monkeypatch.setattr(J, "FEW", few)
    monkeypatch.setattr(J, "CHUNK", chunk)
    monkeypatch.setattr(common, "BATCH_ROWS", 7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.ngram_jaccard_join(docs, 4, 70).collect()}
    assert got == brute_components(rows, 4, 70)


def test_many_short_texts_and_links(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))) for i in range(300)]
    got = {r["doc_id"]: r for r in J.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 60).collect()}
    want = brute_components(rows, 3, 60)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    sets = {}
    for i, t in rows:
        w = t.split()
        k = min(3, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    for i, r in got.items():
        assert r["n_links"] == sum(s != sets[i] and 100 * len(s & sets[i]) >= 60 * len(s | sets[i]) for s in set(sets.values()))
        assert r["class_id"] == min(j for j in sets if sets[j] == sets[i])

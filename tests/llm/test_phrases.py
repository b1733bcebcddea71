import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tierwise.llm import phrases as mod

SCHEMA = "doc_id long, text string, lang string, f long, word string, k1 long"


def plain(rows, least, top, inside):
    """The contract's steps in plain Python."""
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {p for p in found for q, b in found.items() if len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= inside * found[p]}
        scored = []
        for p, a in found.items():
            if p in gone:
                continue
            s, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def rows():
    rng = np.random.default_rng(5)
    words = ["a", "B", "ab", "é", "zu", "of", "the", "end."]
    made = [(i, " ".join(rng.choice(words, rng.integers(1, 80))), ["en", "de", None][i % 3], 1, "x", 2) for i in range(60)]
    made += [made[0], (None, "New York is, new york! new\tyork\x0bnew", "en", 1, "x", 2), (1, None, "en", 1, "x", 2), (2, "", None, 1, "x", 2), (3, ".,;", "de", 1, "x", 2)]
    return [*made, (4, "red green blue " * 2000, "fr", 1, "x", 2), (5, "red green", "fr", 1, "x", 2)]


def got(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("chunk", [1 << 18, 37])
def test_equals_plain_counting(spark, monkeypatch, chunk):
    for name in ("CHUNK_WORDS", "CHUNK_DISTINCT", "TEXT_WORDS"):
        monkeypatch.setattr(mod, name, chunk)
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    assert got(mod.phrases(df, least=3, top=25, inside=50)) == plain(data, 3, 25, 50)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(mod, "FILTER_WORDS", (1, 1))
    data = rows()
    assert got(mod.phrases(spark.createDataFrame(data, SCHEMA), least=3)) == plain(data, 3, 2000, 50)


def test_shared_keys_take_another_seed(spark, monkeypatch):
    real = mod.xxhash.xxh64_intdigest
    monkeypatch.setattr(mod.Chunk, "keys", lambda self, lang, seed: np.fromiter((0 if seed == 0 else real(lang.encode() + b"\n" + w, seed) for w in self), np.uint64, len(self)).view(np.int64))
    data = rows()
    assert got(mod.phrases(spark.createDataFrame(data, SCHEMA), least=3)) == plain(data, 3, 2000, 50)


def test_empty(spark):
    assert mod.phrases(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mod.phrases(spark.createDataFrame([(1, None, None, 1, "x", 2)], SCHEMA)).collect() == []


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    df = spark.createDataFrame([(big, big + 1, big + 2)], "a long, l long, r long")
    (r,) = df.select(mod.cut_score(df.a, df.l, df.r).alias("s")).collect()
    assert r.s == 1000000 * big * big // ((big + 1) * (big + 2))

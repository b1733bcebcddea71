import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tierwise.llm import spelling as mod

SCHEMA = "doc_id long, text string, word string, n long, list long"


def plain(rows, letters=7, least=2, times=10, every=31):
    """Near words by what is left after one deletion or replacement, each word against its own neighbourhood."""
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= letters and n >= least}
    near, masked = defaultdict(set), defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            masked[w[:k], w[k + 1 :]].add(w)
            if (x := w[:k] + w[k + 1 :]) in counts:
                near[w].add(x)
                near[x].add(w)
    for same in masked.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w, n in counts.items():
        most = max((counts[x] for x in near[w]), default=0)
        if most and most >= times * n:
            form[w] = min(x for x in near[w] if counts[x] == most)
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out)


def rows():
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abé"), rng.integers(7, 11))) for _ in range(300)] + ["aaaaaaa", "aaaaaaaa", "Straße" * 3, "Überall", "überall", "x" * 300, "x" * 299, "y" + "x" * 299]
    made = [(i, " ".join(rng.choice(words, 200)) + " " + "receive " * 30 + "recieve receeve recieve receeve ", "w", 1, 2) for i in range(20)]
    return [*made, made[3], (None, "receive,receivé receivé; Receives×receives", "w", 1, 2), (9, None, "w", 1, 2), (10, "", None, None, None), (11, "short ones", "w", 1, 2)]


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.mark.parametrize("limit", [256, 4])
def test_equals_plain_search(spark, monkeypatch, limit):
    """With a limit of 4 most lists are split, down to the last letters."""
    monkeypatch.setattr(mod, "LIST", limit)
    data = rows()
    assert got(mod.spelling_variants(spark.createDataFrame(data, SCHEMA).repartition(3))) == plain(data)


def test_forms_lead_to_the_last_word(spark):
    texts = ["abcdefgh " * 2000, "abcdefgx " * 200, "abcdefxx " * 20, "abcdexxx " * 2]
    data = [(i, t, "w", 1, 2) for i, t in enumerate(texts)]
    found = {r[0]: r for r in got(mod.spelling_variants(spark.createDataFrame(data, SCHEMA), every=1 << 40))}
    assert found["abcdexxx"][1:3] == ("abcdefxx", "abcdefgh")
    assert got(mod.spelling_variants(spark.createDataFrame(data, SCHEMA), every=1 << 40)) == plain(data, every=1 << 40)


def test_tables_without_words(spark):
    assert mod.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mod.spelling_variants(spark.createDataFrame([(1, "a b c", "w", 1, 2)], SCHEMA)).collect() == []


def test_near():
    assert mod.near("abcdefg", "abcdefgh") and mod.near("abcdefg", "abxdefg") and mod.near("aab", "ab")
    assert not mod.near("abcdefg", "abcdefg") and not mod.near("abcdefg", "bacdefg") and not mod.near("abcdefg", "abcdefghi")


def test_the_count_filter_loses_no_pair():
    rng = np.random.default_rng(2)
    parts = sorted({"".join(rng.choice(list("ab"), rng.integers(1, 7))) for _ in range(200)})
    found = set(mod.candidates(parts))
    assert {(i, j) for j in range(len(parts)) for i in range(j) if mod.near(parts[i], parts[j])} <= found

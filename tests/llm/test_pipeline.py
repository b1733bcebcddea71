"""The whole pipeline against a plain version of each of its stages, and its stages on odd tables."""

import collections
import hashlib
import re

import pytest

import corpus_pipeline as C
from tests.llm.test_operators import brute_components
from tests.llm.test_quality_target import brute_rules
from tierwise.llm import bpe_trie, entry

SF = "/root/testdata/sf0.001"
SPACE = "[\x20\x09-\x0d]"


def words(t):
    return [w for w in re.split(f"{SPACE}+", t or "") if w]


def plain_rules(rows, good):
    stats, out = brute_rules(rows, good), {}
    for i, t in rows:
        w = words(t)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = collections.Counter(grams)
        repeat = len({k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(5)})
        if len(w) >= 10 and 100 * repeat <= 20 * len(w) and stats[i][3] >= -1_000_000:
            out[i] = t
    return out


def plain_cut(docs, window=50):
    low, out = {}, {}
    for i in sorted(docs):
        w = words(docs[i])
        for k in range(len(w) - window + 1):
            low.setdefault(tuple(w[k : k + window]), i)
    for i, t in docs.items():
        w = words(t)
        gone = {k + j for k in range(len(w) - window + 1) if low[tuple(w[k : k + window])] < i for j in range(window)}
        if len(gone) < len(w) or not gone:
            pieces = re.findall(f"[^\x20\x09-\x0d]+{SPACE}*", t)
            lead = t[: len(t) - sum(map(len, pieces))]
            out[i] = lead + "".join(p for k, p in enumerate(pieces) if k not in gone) if gone else t
    return out


def plain_clean(docs, items, size=13):
    fold = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for t in items:
        w = fold(t)
        windows |= {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    sizes, out = {len(x) for x in windows}, {}
    for i, t in docs.items():
        w = fold(t)
        hit = {k + j for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for j in range(n)}
        if not (hit and 20 * len(hit) >= len(w)):
            out[i] = t
    return out


def test_run_equals_plain_stages(spark):
    rows = [(r["doc_id"], r["text"]) for r in entry.table(spark, SF, "documents").collect()]
    good = {r["doc_id"] for r in entry.table(spark, SF, "labels").where("quality = 1").collect()}
    docs = plain_rules(rows, good)
    root = brute_components(list(docs.items()), 5, 80)
    docs = {i: t for i, t in docs.items() if root[i][1] == i}
    assert len(docs) < len(rows)
    docs = plain_clean(plain_cut(docs), [r["text"] for r in entry.table(spark, SF, "benchmark").collect()])
    tok = bpe_trie.WordCodec(entry.vocabulary("word_bpe_49k.json")).tok
    want = {i: tok.encode(t, add_special_tokens=False).ids for i, t in docs.items()}
    got = {r["doc_id"]: r for r in C.run(spark, SF).collect()}
    assert set(got) == set(want)
    for i, ids in want.items():
        joined = " ".join(map(str, ids))
        assert (got[i]["n_tokens"], got[i]["ids"], got[i]["ids_sha256"]) == (len(ids), joined, hashlib.sha256(joined.encode()).hexdigest())


ODD = [(None, "no id but plain words that are long enough to be kept by every rule of this pipeline", "en", "s", 1), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "the same plain words that stand in two rows of this table so that one goes away", "en", "s", 9), (4, "the same plain words that stand in two rows of this table so that one goes away", "en", "s", 9)]


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_tables(spark, stage):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    name, run = C.STAGES[stage]
    got = sorted((r["doc_id"] for r in run(spark, docs, SF).collect()), key=str)
    assert got == {"quality_rules": [3, 4, None], "near_duplicates": [1, 2, 3, None], "passages": [1, 2, 3, 4, None], "decontamination": [1, 2, 3, 4, None], "tokens": [1, 2, 3, 4, None]}[name]
    empty = run(spark, docs.where("false"), SF)
    assert empty.count() == 0 and (stage == 4 or empty.columns == C.COLUMNS)


def test_contaminated_rows_go_one_by_one(spark):
    item = entry.table(spark, SF, "benchmark").first()["text"]
    clean = "nothing here that any benchmark holds " * 3
    docs = spark.createDataFrame([(None, item, "en", "s", 1), (None, clean, "en", "s", 1), (7, item, "en", "s", 1), (7, clean, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [(r["doc_id"], r["text"]) for r in C.decontamination_stage(spark, docs, SF).orderBy("doc_id").collect()] == [(None, clean), (7, clean)]

"""The training-data operators against brute force, the tokenizer library and planted cases."""

import collections
import hashlib
import random

import numpy as np
import pytest

from tierwise.llm import bpe_trie, chat_format, entry, ngram_join, substring_dedup, token_count
from tierwise.llm.decontaminate import Phrases, Shard, decontaminate, terms_of
from tierwise.llm.quality_classifier import quality_classifier
from tierwise.llm.quality_rules import quality_rules
from tierwise.llm.toxicity import toxicity
from tierwise.llm.url_filter import filter_urls

SCHEMA = "doc_id long, text string, n string, root long"  # extra columns with names the operators use


def texts():
    rng = random.Random(3)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randint(0, 30))
    base = [word() for _ in range(120)]
    out = [" ".join(word() for _ in range(rng.randint(1, 200))) for _ in range(15)]
    for _ in range(12):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    out += [out[0], " ".join(base[20:90] + [word() for _ in range(60)]), "", None, "One", "one", "x\ty\x0bz w", "x " * 3000]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "n", 1) for i, t in texts()] + [(None, "nameless text", "n", 2)], SCHEMA)


def brute_components(rows, n, t):
    sets = {}
    for i, x in rows:
        w = (x or "").encode().lower().split()
        k = min(n, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "t"), [(4, 85), (5, 80)])
def test_ngram_join(spark, docs, n, t):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(docs, n, t).collect()}
    assert got.pop(None)[1] is None
    assert got == brute_components(texts(), n, t)


def test_ngram_join_tiles_agree(spark, docs, monkeypatch):
    want = brute_components(texts(), 4, 60)
    monkeypatch.setattr(ngram_join, "TILE_DOCS", 3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(docs.where("doc_id is not null"), 4, 60).collect()}
    assert got == want


def test_repeated_ids_and_empty_table(spark):
    d = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(d).collect()) == [(1, 1), (1, 1), (2, 1)]
    assert ngram_join.ngram_jaccard_join(d.where("false")).count() == 0


def fuzz(k=300):
    rng = random.Random(5)
    parts = ["a", "B", " ", "  ", "\n", "\t", "'s", "é", "é", "<|endoftext|>", "<|startoftext|>", "12", "!!", "Σ", "日本", "\r\n", "don't", "\x85"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(k)]


def test_token_counts_equal_the_library():
    path = entry.vocabulary("byte_bpe_50k.json")
    tok = token_count._tokenizer(path)
    want = [len(tok.encode(t, add_special_tokens=False).ids) for t in fuzz()]
    assert token_count.count_tokens(path, fuzz(), 10**6, 100, 8) == want
    assert token_count.count_tokens(path, fuzz(), 0, 64, 8) == want  # every text in overlapping chunks
    long = "word " * 300 + "x" * 500 + " end" * 50
    assert token_count.encode_huge(path, long, 64, 4) == tok.encode(long, add_special_tokens=False).ids


def test_bpe_equals_the_library():
    c = bpe_trie.codec(entry.vocabulary("word_bpe_49k.json"))
    for t in fuzz():
        c.fill(set(bpe_trie.units_of(t)))
        ids, decoded = c.encode(bpe_trie.units_of(t))
        want = c.tok.encode(t, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and decoded == c.tok.decode(want, skip_special_tokens=False)


def test_chat_folds_and_round_trips(spark):
    m = chat_format.Conversation()
    for kind, turn, role, text in [("message", 0, "user", "hi"), ("delta", 1, "assistant", "a"), ("delta", 1, "assistant", "b"), ("message", 2, "user", "late"), ("regenerate", 1, "assistant", ""), ("delta", 1, "assistant", "c"), ("edit", 0, "user", "ho")]:
        m.apply(kind, turn, role, text)
    assert m.messages() == [("user", "ho"), ("assistant", "c")] and m.turns == [0, 1]
    turns = [("us:er", "\\### Assistant: </turn> ok"), ("assistant", "#<\\\n"), ("assistant", "")]
    text, a, b = chat_format.render(turns)
    assert chat_format.parse(text) == turns
    assert "".join(chat_format.unescape(text[x:y]) for x, y in zip(a, b, strict=True)) == "#<\\\n"
    rows = spark.createDataFrame([(1, 1, "assistant", "yes"), (1, 0, "user", None), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(chat_format.conversation_events(rows), chat_format.EVENT_ORDER)).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nyes\n").hexdigest() and got[1]["loss_chars"] == 3 and got[None]["n_turns"] == 1


def test_substring_dedup(spark, docs):
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs, 20).collect()}
    rows = [(i, (t or "").split()) for i, t in texts()]
    low = {}
    for i, w in rows:
        for k in range(len(w) - 19):
            low.setdefault(tuple(w[k : k + 20]), i)
    for i, w in rows:
        gone = set()
        for k in range(len(w) - 19):
            if low[tuple(w[k : k + 20])] < i:
                gone |= set(range(k, k + 20))
        kept = [x for k, x in enumerate(w) if k not in gone]
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(w), len(gone))
        assert got[i]["kept_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        assert (got[i]["text"] or "").split() == kept
    assert got[None]["n_removed"] == 0


def test_difference_covers_bring_any_pair_together():
    for v, cover in substring_dedup.COVERS:
        for i in range(v):
            assert any(k in cover and (i + k) % v in cover for k in range(v))


def test_decontamination(spark):
    item = "the quick brown fox jumps over the lazy dog and then it runs far away home"
    d = spark.createDataFrame([(1, f"intro {item.upper()} outro"), (2, "the quick brown fox sleeps"), (3, None), (4, "short item here " * 2), (5, item[: item.rindex(" ")])], "doc_id long, text string")
    b = spark.createDataFrame([(10, item), (9, "short, item!"), (8, None), (7, "")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate(d, b).collect()}
    assert (got[1]["n_hit"], got[1]["items"], got[1]["contaminated"]) == (16, [10], True)
    assert (got[2]["n_hit"], got[3]["n_words"], got[4]["n_hit"], got[4]["items"], got[5]["n_hit"]) == (0, 0, 4, [9], 15)
    assert got[2]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert decontaminate(d, b.where("false")).where("n_hit > 0").count() == 0
    p = Phrases([(1, b"a b c")], 13)
    s = Shard.build([terms_of(t) for t in (b"x c b a", b"a y b c", b"a b c")])
    s.number(p.terms)
    assert s.phrase(p.windows[0]).tolist() == [8] and s.near(p.windows[0], 3).tolist() == [0, 2]


def test_quality_rules_base(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_rules(docs, labels).collect()}
    for i, t in texts():
        w = (t or "").replace("\x0b", " ").split()
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = collections.Counter(grams)
        repeat = len({k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(5)})
        assert (got[i]["n_words"], got[i]["n_repeat_words"], got[i]["word_chars"]) == (len(w), repeat, sum(map(len, w)))
        assert got[i]["base_failed"] == (len(w) < 10 or 100 * repeat > 20 * len(w))
    assert quality_rules(docs.where("false"), labels).count() == 0


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"  # the smaller ones have a few dozen bad documents to learn from
    labels = {r["doc_id"]: r for r in entry.table(spark, sf, "labels").collect()}
    for name, column in (("op6_quality_classifier", "quality"), ("op8_toxicity", "toxic")):
        got = [r for r in entry.queries()[name](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
        assert np.mean([r["predicted"] == labels[r["doc_id"]][column] for r in got]) > 0.9
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame([(1, None), (None, "x")], "doc_id long, text string")
    assert [r["score"] for r in quality_classifier(d, empty).collect()] == [0.5, 0.5]
    assert toxicity(d.where("false"), empty).count() == 0


def test_url_filter(spark):
    urls = ["http://a.example.net/en/1", "http://x.net", "http://x.net/", "HTTP://Sub.ORG/fr/", "http://casino.com/", "http://casinos.com/", "http://free-bet.com", "http://free.com", None, "no scheme", "http://example.com/de/?q"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(d, entry.URL_RULES).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[1][2:] == (None, "allow") and got[2][2:] == ("net/", "block")
    assert got[3] == ("sub.org", "/fr/", "org/fr/", "allow") and [got[i][3] for i in (4, 5, 6, 7)] == ["block", "allow", "block", "allow"]
    assert got[8] == ("", "", None, "allow") and got[9] == ("", "", None, "allow") and got[10][2:] == ("example.com/de/", "block")

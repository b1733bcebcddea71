"""Operators on crafted tables: nulls, null ids, empty and long texts, repeated rows, empty tables, clashing columns."""

import random

import pytest

from tests.llm.test_operators import fuzz
from tierwise.llm import bpe_trie, chat_format, decontaminate, entry, substring_dedup, token_count, url_filter

LONG = "x" * 70_000 + " end " + "word " * 20_000
ROWS = [(1, None), (2, ""), (3, "One two"), (3, "One two"), (None, "no id"), (4, LONG), (4, "other text"), (5, " \n\t "), (None, None), *[(100 + i, t) for i, t in enumerate(fuzz(60))]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 7, "n", [1]) for i, t in ROWS], "doc_id long, text string, n_tokens int, ids string, items array<int>")


def keyed(rows, *names):
    return sorted([tuple(r[n] for n in names) for r in rows], key=str)


def test_token_counts_on_frames(spark, docs):
    path = entry.vocabulary("byte_bpe_50k.json")
    tok = token_count._tokenizer(path)
    want = [(i, len((t or "").encode()), n, n > 1024) for i, t in ROWS for n in [len(tok.encode(t or "", add_special_tokens=False).ids)]]
    for size in (65_536, 50):  # few texts in overlapping chunks, or nearly all
        got = token_count.token_counts(docs, path, huge=size, chunk=64 if size == 50 else 32_768, overlap=8)
        assert keyed(got.collect(), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=str)
    assert token_count.token_counts(docs.where("false"), path).collect() == []


def test_bpe_on_frames(spark, docs):
    path = entry.vocabulary("word_bpe_49k.json")
    tok = bpe_trie.WordCodec(path).tok
    want = []
    for i, t in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), " ".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False)))
    got = bpe_trie.bpe_encode_decode(docs, path, kept=16)
    assert keyed(got.collect(), "doc_id", "n_tokens", "ids", "decoded") == sorted(want, key=str)
    whole, digests = got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), bpe_trie.bpe_digests(docs, path)
    assert keyed(whole.collect(), *digests.columns) == keyed(digests.collect(), *digests.columns)
    assert bpe_trie.bpe_encode_decode(docs.where("false"), path).collect() == []


def test_long_words_take_linear_time():
    codec = bpe_trie.WordCodec(entry.vocabulary("word_bpe_49k.json"))
    word = "ab" * 30_000
    codec.fill({word})
    assert codec.encode([word])[0] == " ".join(map(str, codec.tok.encode(word, add_special_tokens=False).ids))


def test_substring_dedup_on_frames(spark):
    passage = " ".join(f"w{k}" for k in range(30))
    rows = [(1, f"a {passage} b"), (1, f"c {passage}"), (2, f"d  {passage}\n e"), (2, "short"), (None, passage), (3, None), (3, ""), (4, "x " * 60_000)]
    d = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, pos int, h string")
    got = substring_dedup.substring_dedup(d, 20, passthrough=["h"])
    assert keyed(got.collect(), "doc_id", "text", "n_words", "n_removed", "h") == sorted([(1, f"a {passage} b", 32, 0, "k"), (1, f"c {passage}", 31, 0, "k"), (2, "d  e", 32, 30, "k"), (2, "short", 1, 0, "k"), (None, passage, 30, 0, "k"), (3, None, 0, 0, "k"), (3, "", 0, 0, "k"), (4, "x " * 60_000, 60_000, 0, "k")], key=str)
    assert substring_dedup.substring_dedup(d.where("false"), 20).count() == 0


def test_chat_on_frames(spark):
    schema = "conv_id long, kind string, turn long, role string, text string, seq long, formatted string"
    events = [
        (1, "message", 0, "user", "hi", 0, "x"), (1, "message", 1, "assistant", "a", 1, "x"), (1, "message", 2, "user", "more", 2, "x"),
        (1, "regenerate", 1, "assistant", "b", 3, "x"), (1, "delta", 1, "assistant", "!", 4, "x"), (1, "edit", 0, "user", "ho", 5, "x"), (1, "delta", 5, "tool", "new", 6, "x"),
        (None, "message", None, None, None, 0, "x"), (2, "other", 0, "user", "b", 0, "x"), (2, "other", 0, "user", "a", 0, "x"), (2, "other", 0, "user", "a", 0, "x"), (3, "message", 0, "assistant", "#" * 50_000, 0, "x"),
    ]
    d = spark.createDataFrame(events, schema).repartition(3)
    got = {r["conv_id"]: chat_format.parse(r["formatted"]) for r in chat_format.format_conversations(d, ["seq"]).collect()}
    assert got[1] == [("user", "ho"), ("assistant", "b!"), ("tool", "new")]
    assert got[None] == [("", "")] and got[2] == [("user", "a"), ("user", "a"), ("user", "b")] and got[3] == [("assistant", "#" * 50_000)]
    assert chat_format.format_conversations(d.where("false"), ["seq"]).count() == 0


def test_many_regenerations():
    c = chat_format.Conversation()
    for turn in range(2000):
        c.apply("message", turn, "user", "x")
    for turn in range(1999, 0, -1):
        c.apply("regenerate", turn, "assistant", str(turn))
    assert c.messages() == [("user", "x"), ("user", "1")]


def test_urls_on_frames(spark):
    rows = [(None, "http://casino.com"), (1, None), (1, None), (2, "http://a.org/" + "free-" * 5000 + "loan"), (3, "http://x.com/buy/now/cash"), (4, "http://x.com/buy/now"), (5, "http://xn.com/é-casino")]
    d = spark.createDataFrame([(i, u, "p", 0) for i, u in rows], "page_id long, url string, path string, weight int")
    got = url_filter.filter_urls(d, [])
    assert keyed(got.collect(), "page_id", "verdict") == sorted([(None, "block"), (1, "allow"), (1, "allow"), (2, "block"), (3, "block"), (4, "allow"), (5, "block")], key=str)
    assert url_filter.filter_urls(d.where("false"), []).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(d, [], vocabulary={}).collect()} == {"allow"}
    assert not set(url_filter.STRICT) & set(url_filter.SOFT) and not set(url_filter.SOFT) & set(url_filter.WEAK)


def plain_near(docs, items, rarest, span):
    counts = {}
    for _, t in docs:
        for w in decontaminate.words_of((t or "").encode()):
            counts[w] = counts.get(w, 0) + 1
    out = []
    for i, t in docs:
        w = decontaminate.words_of((t or "").encode())
        near = set()
        for item, text in items:
            terms = sorted(set(decontaminate.words_of((text or "").encode())), key=lambda x: (counts.get(x, 0), x))[:rarest]
            if len(terms) == rarest and any(set(terms) <= set(w[k : k + span]) for k in range(len(w))):
                near.add(item)
        out.append((i, sorted(near)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [10**6, 5])
def test_proximity_matches(spark, monkeypatch, block):
    rng = random.Random(8)
    vocabulary = [f"t{k}" for k in range(30)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, some(rng.randint(0, 60))) for i in range(40)] + [(None, some(30)), (3, None), (3, some(20))]
    items = [(i, some(rng.randint(1, 12))) for i in range(12)] + [(50, "t1 t2 t3 never"), (51, None), (None, "t1 t2 t3 t4")]
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), span=8)
    known = [x for x in items if x[0] is not None and x[1]]
    assert keyed(got.collect(), "doc_id", "near_items") == plain_near(docs, known, 4, 8)


def test_long_items_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(1, "a " + " ".join(words[10:40]) + " b"), (2, " ".join(words[5:17])), (3, " ".join(words))], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.decontaminate(docs, spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")).collect()}
    assert got == {1: (30, [9]), 2: (0, []), 3: (60, [9])}

"""BPE encoding by traversing a trie of distinct words, and decoding.

The encoding of a word's prefix ends in one token, and taking that token away leaves the encoding of a
shorter prefix. So one token per trie node describes the encodings of all prefixes: the last token t of
a path s is the vocabulary entry that ends s and may follow the last token of s without t. Two tokens
may follow each other when merging the symbols of both gives exactly these two. Words are visited in
sorted order, which is the depth-first order of their trie; the states of a prefix shared with the word
before stand on the stack and are not computed again.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import give_back, ids_of, prepare, texts_with_key, to_batch

#: Units and words after which a worker starts new memories; the ones before stay for one more turn.
KEPT = 1 << 18
#: Pairs of tokens of which a worker remembers whether one may follow the other.
PAIRS = 1 << 18

_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


class Trie:
    """Encodes words, as tuples of symbols; the last symbol carries the end-of-word suffix."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.rank = {tuple(m): i for i, m in enumerate(merges)}
        self.longest = max(map(len, vocab))
        #: When a token comes into being, and from what; single symbols were there before all merges.
        self.born = {a + b: i for (a, b), i in self.rank.items()}
        self.halves = {a + b: (a, b) for a, b in self.rank}
        self.whole: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """Symbols joined by rank, the lowest and leftmost first."""
        rank = self.rank.get
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: rank((symbols[i], symbols[i + 1]), 1 << 40))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    def symbols(self, token: str) -> list[str]:
        """The single symbols of a token."""
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def may_follow(self, left: str, right: str) -> bool:
        """As merges_apart, remembered."""
        key = left, right
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merges_apart(left, right)
        return known

    def merges_apart(self, left: str, right: str) -> bool:
        """Whether merging the symbols of both leaves exactly these two tokens.

        Goes back in time: the neighbours at the boundary are undone, the youngest first. The pair must
        not have merged before the younger one's successor came into being; a merge of the same rank wins
        from the left.
        """
        rank, born, halves, until = self.rank.get, self.born.get, self.halves, 1 << 40
        while True:
            if rank((left, right), until) < until:
                return False
            a, b = born(left, -1), born(right, -1)
            if a > b:
                until, left = a, halves[left][1]
            elif b >= 0:
                until, right = b + 1, halves[right][0]
            else:
                return True

    def stands(self, token: str) -> bool:
        """Whether a token is the encoding of its own symbols."""
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = self.merge(self.symbols(token)) == [token]
        return known

    def last(self, path: str, depth: int, end: bool, states: list[str]) -> str:
        """Last token of the first ``depth`` symbols of a path, with the suffix if it ends there."""
        vocab, pairs, low = self.vocab, self.pairs, max(0, depth - self.longest)
        path = path[low:depth] + (self.suffix if end else "")
        for start in range(low, depth):
            if (token := path[start - low :]) in vocab:
                if not start:
                    if self.stands(token):
                        return token
                elif pairs.get((states[start], token)) or self.may_follow(states[start], token):
                    return token
        raise KeyError(path)

    def encode(self, words: list[str]) -> dict[str, list[str]]:
        """Tokens of each word. A word whose symbols the vocabulary lacks gets the merged symbols it has."""
        out: dict[str, list[str]] = {}
        states, before = [""], ""
        for word in sorted(set(words)):
            n = min(len(before), len(word) - 1, len(states) - 1)
            common = 0
            while common < n and before[common] == word[common]:
                common += 1
            del states[common + 1 :]
            try:
                for depth in range(common + 1, len(word)):
                    states.append(self.last(word, depth, False, states))
                token = self.last(word, len(word), True, states)
                tokens, at = [token], len(word) - (len(token) - len(self.suffix))
                while at:
                    tokens.append(states[at])
                    at -= len(states[at])
                out[word] = tokens[::-1]
            except KeyError:
                out[word] = [t for t in self.merge(self.symbols(word + self.suffix)) if t in self.vocab]
            before = word
        return out


class WordCodec:
    """Ids and decoded form of space-free units of a text, remembered by worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.trie = Trie(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.words: dict[str, tuple[str, str]] = {}
        self.units: dict[str, tuple[str, str]] = {}
        #: What was remembered before the last turn; entries in use come back from here.
        self.old_words: dict[str, tuple[str, str]] = {}
        self.old_units: dict[str, tuple[str, str]] = {}

    def pretokens(self, unit: str) -> list[str]:
        """Words of a unit in the library's byte alphabet."""
        if unit.isascii() and unit.isprintable():
            return _ASCII.findall(unit.lower())
        return [w for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(unit))]

    def fill(self, units: set[str], kept: int = KEPT) -> None:
        if len(self.units) > kept:
            self.old_units, self.units = self.units, {}
        if len(self.words) > kept:
            self.old_words, self.words = self.words, {}
        new: dict[str, list[str]] = {}
        for u in units - self.units.keys():
            if (known := self.old_units.get(u)) is not None:
                self.units[u] = known
            elif "<|" in u and self.cut.search(u):
                new[u] = [w for i, x in enumerate(self.cut.split(u)) for w in ([x] if i % 2 else self.pretokens(x) if x else [])]
            else:
                new[u] = self.pretokens(u) if u else []
        vocab = self.trie.vocab
        missing = {w for ws in new.values() for w in ws if w not in self.words and w not in self.special}
        for w in [w for w in missing if w in self.old_words]:
            self.words[w] = self.old_words[w]
            missing.discard(w)
        for w, tokens in self.trie.encode(list(missing)).items():
            self.words[w] = " ".join(str(vocab[t]) for t in tokens), " ".join(tokens)
        for w, i in self.special.items():
            self.words[w] = str(i), w
        for u, ws in new.items():
            if len(ws) == 1:  # most units: the pair is held once
                self.units[u] = self.words[ws[0]]
                continue
            got = [x for w in ws if (x := self.words[w])[0]]
            self.units[u] = " ".join(x[0] for x in got), " ".join(x[1] for x in got)

    def encode(self, units: list[str]) -> tuple[str, str]:
        """Ids as decimals and the decoded text, both joined by a space. The units of the text must be filled."""
        found = [x for x in map(self.units.__getitem__, units) if x[0]]
        return " ".join([x[0] for x in found]), " ".join([x[1] for x in found])


def units_of(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


@lru_cache(1)
def codec(path: str) -> WordCodec:
    return WordCodec(path)


def bpe_encode_decode(docs: DataFrame, vocabulary: str, kept: int = KEPT) -> DataFrame:
    """Encodes whole texts with a word-end BPE vocabulary file (tokenizers JSON) and decodes the ids.

    docs: doc_id, text; other columns are ignored. Returns doc_id, n_tokens, ids (decimals joined by one
    space), decoded (as the library's decode without dropping special tokens), ids_sha256,
    decoded_sha256; one row per input row. kept: units and words a worker remembers; fewer take less memory and
    more time where other operators ran in the same workers, and the result is the same.

    Null or empty text: no tokens, empty strings. Null ids and repeated rows are kept. Empty table: empty result.
    """
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.string()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return texts_with_key(docs).mapInArrow(_encoder(vocabulary, schema, kept), "doc_id long, n_tokens long, ids string, decoded string, ids_sha256 string, decoded_sha256 string")


def bpe_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """As bpe_encode_decode, without the ids and the decoded text themselves."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return texts_with_key(docs).mapInArrow(_encoder(vocabulary, schema), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoder(vocabulary: str, schema: pa.Schema, kept: int = KEPT):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        gc.disable()  # the remembered strings hold no cycles; scanning them again and again costs more than the work
        try:
            yield from encoded(batches, codec(vocabulary))
        finally:  # an idle worker holds no codec
            codec.cache_clear()
            gc.enable()
            give_back()

    def encoded(batches: Iterator[pa.RecordBatch], c: WordCodec) -> Iterator[pa.RecordBatch]:
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            names, column = ids_of(b), b.column(1)
            for i in range(0, b.num_rows, 256):
                out = {k: [] for k in schema.names}
                out["doc_id"] = names[i : i + 256]
                cut = [units_of(t or "") for t in column.slice(i, 256).to_pylist()]
                c.fill(set().union(*cut), kept)
                for units in cut:
                    ids, decoded = c.encode(units)
                    row = {"n_tokens": ids.count(" ") + 1 if ids else 0, "ids": ids, "decoded": decoded, "ids_sha256": digest(ids), "decoded_sha256": digest(decoded)}
                    for k in schema.names[1:]:
                        out[k].append(row[k])
                yield to_batch(out, schema)

    return run

"""Token counts of a byte-level BPE, with huge documents encoded in overlapping chunks.

Ordinary documents: a position between a character that is no white space and a space is always a
boundary of the pre-tokeniser, so a text is cut there into units that the library encodes one by one;
a worker remembers how many tokens a unit has.

Huge documents: chunks that overlap are encoded with offsets. A position is a proven boundary of the
whole text when the left chunk's pre-tokeniser stops there, far enough from the chunk's end that no
look-ahead or special string can reach past it: matches run left to right, so what the left chunk
decided before that position is final. When the right chunk stops at the same position too, both
parses agree from there on, and the chunks are spliced at it. When no common boundary lies in the
overlap, the overlap is doubled, up to joining both chunks.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_LIMIT, give_back, ids_of, prepare, texts_with_key, to_batch

#: Texts with white space before a space need the library's own cuts.
_RUN = re.compile(r"\s ")
#: Cut before each white space that follows another character.
_CUT = re.compile(r"\s*\S+|\s+")


@lru_cache(1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(1)
def _margin(path: str) -> int:
    """Characters before a chunk's end in which a boundary may still change."""
    specials = [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]
    return 4 + max(map(len, specials), default=0)


class Units(dict):
    """Number of tokens of a unit; filled in batches by the library."""

    def __init__(self, path: str):
        super().__init__()
        self.path = path

    def fill(self, units: set[str]) -> None:
        if len(self) > CACHE_LIMIT:
            self.clear()
        new = [u for u in units if u not in self]
        tok = _tokenizer(self.path)
        # Units that begin with a space and another character are encoded side by side: no token spans two.
        alone = [u for u in new if u[:1] != " " or u[1:2].isspace() or u[-1:].isspace()]
        new = sorted(set(new).difference(alone))
        for i in range(0, len(new), 1024):
            part = new[i : i + 1024]
            ends = np.cumsum([len(u) for u in part])
            e = tok.encode("".join(part), add_special_tokens=False)
            at = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids))
            self.update(zip(part, np.bincount(np.searchsorted(ends, at, "right"), minlength=len(part)).tolist(), strict=True))
        self.update(zip(alone, map(len, tok.encode_batch_fast(alone, add_special_tokens=False)), strict=True))


@lru_cache(1)
def _units(path: str) -> Units:
    return Units(path)


def units_of(text: str) -> list[str]:
    """Pieces of a text that the pre-tokeniser never joins."""
    if _RUN.search(text):
        return _CUT.findall(text)
    first, *rest = text.split(" ")
    return [first, *[f" {x}" for x in rest]]


def encode_chunk(path: str, text: str, start: int, end: int) -> tuple[list[int], list[tuple[int, int]], set[int]]:
    """Token ids, offsets in the whole text, and the boundaries at which the pre-tokeniser stopped."""
    e = _tokenizer(path).encode(text[start:end], add_special_tokens=False)
    spans = [(a + start, b + start) for a, b in e.offsets]
    words, stops = e.word_ids, set()
    for k in range(1, len(spans)):
        if words[k] != words[k - 1] or words[k] is None:
            stops.add(spans[k][0])
    return e.ids, spans, stops


def encode_huge(path: str, text: str, chunk: int = 32_768, overlap: int = 512) -> list[int]:
    """Ids of a whole text from overlapping chunks; equal to encoding it at once."""
    margin, ids = _margin(path), []
    begin = 0  # a proven boundary: everything before it is in ids
    while begin < len(text):
        end = min(len(text), begin + chunk)
        got, spans, stops = encode_chunk(path, text, begin, end)
        if end == len(text):
            return ids + got
        lap = overlap
        while True:
            right = max(begin, end - lap)
            _, _, other = encode_chunk(path, text, right, min(len(text), end + lap))
            common = [p for p in stops & other if right < p <= end - margin]
            if common:
                at = max(common)
                ids += [t for t, (a, _) in zip(got, spans, strict=True) if a < at]
                begin = at
                break
            if right == begin:  # widened over the whole chunk: take in more of the text
                end = min(len(text), begin + 2 * (end - begin))  # doubled, so a text without boundaries costs a few encodings
                got, spans, stops = encode_chunk(path, text, begin, end)
                if end == len(text):
                    return ids + got
            lap *= 2
    return ids


def count_tokens(path: str, texts: list[str], huge: int, chunk: int, overlap: int) -> list[int]:
    cache = _units(path)
    cut = [units_of(t) if len(t) <= huge else None for t in texts]
    cache.fill(set().union(*[c for c in cut if c]))
    return [sum(map(cache.__getitem__, c)) if c is not None else len(encode_huge(path, t, chunk, overlap)) for c, t in zip(cut, texts, strict=True)]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, huge: int = 65_536, chunk: int = 32_768, overlap: int = 512) -> DataFrame:
    """Bytes and tokens of whole texts under a byte-level BPE vocabulary file (tokenizers JSON).

    docs: doc_id, text; other columns are ignored. Special strings inside a text count as the library
    counts them by default. Texts over ``huge`` characters are encoded in chunks of ``chunk`` with
    ``overlap``. Returns doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), one row per row.

    Null or empty text: 0 bytes, 0 tokens. Null ids and repeated rows are kept. Empty table: empty result.
    """
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # remembered units hold no cycles
        try:
            for b in batches:
                texts = [t or "" for t in b.column(1).to_pylist()]
                n = []
                for i in range(0, len(texts), 64):
                    n += count_tokens(vocabulary, texts[i : i + 64], huge, chunk, overlap)
                yield to_batch({"doc_id": ids_of(b), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n}, schema)
        finally:  # an idle worker holds neither units nor a tokenizer
            _units.cache_clear()
            _tokenizer.cache_clear()
            gc.enable()
            give_back()

    counted = texts_with_key(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.select("*", (F.col("n_tokens") > limit).alias("over_limit"))

"""Benchmark decontamination by a positional inverted index that is sharded by document.

Index: built once and written to the shared folder. Each shard holds some documents' token postings, sorted by
term and position, for the terms that a bounded bit set of the benchmark's terms lets through. Search: a
window of benchmark words starts with the shard's rarest of its terms; the postings lists, shifted back by
their offsets in the window, are intersected from the rarest on, and what is left are exact phrase
occurrences. Windows of which some term has no posting cost nothing but a lookup. Proximity matches bring
the terms of an item that are rarest in all documents together within a span. The benchmark is cut into pieces of
PIECE_WORDS words that overlap by a window, and worked through in blocks of BLOCK_WORDS words, so what
goes to the tasks has a fixed bound however long it or one of its items is. Hits of all blocks are
brought together by the number of the indexed row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, binary_texts, ids_of, prepare, releasing, texts_with_key, to_batch

#: Benchmark words that one search block sends to the tasks, at most 50 MB or so, and words of a piece of an item.
BLOCK_WORDS, PIECE_WORDS = 400_000, 100_000
#: Bits of the set of benchmark terms (2 MB).
TERM_BITS = 1 << 24
#: Text bytes of a shard.
SHARD_BYTES, SHARD_ROWS = 8_000_000, 1 << 20

#: A-Z lower-cased; other ASCII but digits and letters parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class TermHash(dict):
    """63-bit hash of a term, remembered."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, 10) >> 1
        return h


_hashes = TermHash()


def _forget() -> None:
    _hashes.clear()


def terms_of(text: bytes) -> np.ndarray:
    """Hashes of a text's words, in order."""
    words = words_of(text)
    return np.fromiter(map(_hashes.__getitem__, words), np.int64, len(words))


class Phrases:
    """A block of benchmark pieces as distinct windows of terms."""

    def __init__(self, items: list[tuple[int, bytes]], window: int):
        #: Terms in order, so that a number in ``terms`` stands for each; and their words.
        words = {int(h): w for _, text in items for h, w in zip(terms_of(text).tolist(), words_of(text), strict=True)}
        self.terms = np.array(sorted(words), np.int64)
        self.words = [words[h] for h in self.terms.tolist()]
        owners: dict[tuple[int, ...], list[int]] = {}
        self.sequences: list[tuple[int, np.ndarray]] = []
        for item, text in items:
            ws = tuple(np.searchsorted(self.terms, terms_of(text)).tolist())
            if not ws:
                continue
            self.sequences.append((item, np.unique(ws)))
            for i in range(max(1, len(ws) - window + 1)):
                owners.setdefault(ws[i : i + window], []).append(item)
        self.windows = list(owners)
        self.owners = [sorted(set(x)) for x in owners.values()]
        by: dict[int, list[int]] = {}
        for k, w in enumerate(self.windows):
            by.setdefault(len(w), []).append(k)
        #: By length: numbers of the windows, and their terms as a matrix.
        self.matrices = [(np.array(ks), np.array([self.windows[k] for k in ks], np.int64)) for ks in by.values()]
        #: Terms (numbers) that stand for an item in proximity matches, with the item.
        self.near: list[tuple[int, list[int]]] = []

    def rarest(self, counts: dict[int, int], few: int) -> None:
        """Chooses each item's ``few`` rarest terms, by their counts in all documents and then by word; items of fewer terms,
        and those of which a chosen one occurs nowhere, get none."""
        often = [counts.get(h, 0) for h in self.terms.tolist()]
        for item, terms in self.sequences:
            chosen = sorted(terms.tolist(), key=lambda t: (often[t], self.words[t]))[:few]
            if len(chosen) == few and often[chosen[0]]:
                self.near.append((item, chosen))


class Shard:
    """Postings of some documents: for each term, sorted positions in the shard's run of words."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, ends: np.ndarray, positions: np.ndarray):
        #: First position of each document and the position after the last; indexed terms; where each one's list ends.
        self.starts, self.terms, self.ends, self.positions = starts, terms, ends, positions
        self.numbers = terms

    @classmethod
    def build(cls, texts: list[np.ndarray], wanted: np.ndarray | None = None) -> Shard:
        """texts: terms of each document's words. wanted: bit set of the terms to index; without it, all of them."""
        starts = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        flat = np.concatenate(texts) if texts else np.empty(0, np.int64)
        at = np.arange(len(flat)) if wanted is None else np.flatnonzero(has_bits(wanted, flat))
        order = np.argsort(flat[at], kind="stable")
        terms, counts = np.unique(flat[at], return_counts=True)
        return cls(starts, terms, np.cumsum(counts), at[order].astype(np.int32))

    def number(self, terms: np.ndarray) -> None:
        """From now on terms are named by their numbers in a sorted array; others cannot be asked for."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        self.numbers = np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)

    def postings(self, term: int) -> np.ndarray:
        k = self.numbers[term]
        return self.positions[:0] if k < 0 else self.positions[self.ends[k - 1] if k else 0 : self.ends[k]]

    def phrase(self, window: tuple[int, ...]) -> np.ndarray:
        """Positions at which all terms of a window stand in order in one document."""
        lists = sorted(((self.postings(t), o) for o, t in enumerate(window)), key=lambda x: len(x[0]))
        found = lists[0][0].astype(np.int64) - lists[0][1]
        for posted, offset in lists[1:]:
            if not len(found):
                return found
            want = found + offset
            k = np.searchsorted(posted, want)
            k[k == len(posted)] = 0
            found = found[posted[k] == want]
        found = found[found >= 0]
        doc = np.searchsorted(self.starts, found, "right") - 1
        return found[found + len(window) <= self.starts[doc + 1]]

    def near(self, terms: tuple[int, ...], span: int) -> np.ndarray:
        """Documents (numbers in the shard) in which all terms stand within ``span`` words."""
        lists = sorted((self.postings(t).astype(np.int64) for t in set(terms)), key=len)
        if not lists or not len(lists[0]):
            return np.empty(0, np.int64)
        found = []
        # One of the terms is the leftmost: try each as it, the others must follow within the span.
        for lead in lists:
            doc = np.searchsorted(self.starts, lead, "right") - 1
            last = np.minimum(lead + span, self.starts[doc + 1])
            good = np.ones(len(lead), bool)
            for other in lists:
                k = np.searchsorted(other, lead)
                good &= np.r_[other, np.iinfo(np.int64).max][k] < last
            found.append(doc[good])
        return np.unique(np.concatenate(found))


def bit_at(terms: np.ndarray) -> np.ndarray:
    return terms & (TERM_BITS - 1)


def has_bits(bits: np.ndarray, terms: np.ndarray) -> np.ndarray:
    at = bit_at(terms)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def benchmark_pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, piece, n, words): items cut into PIECE_WORDS words and the window - 1 words that follow, joined by blanks."""
    schema = pa.schema([("item_id", pa.int64()), ("piece", pa.int32()), ("n", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(ids_of(b, "item_id"), binary_texts(b), strict=True):
                words = words_of(text)
                starts = range(0, max(1, len(words) - window + 1), PIECE_WORDS) if words else ()
                cut = [words[i : i + PIECE_WORDS + window - 1] for i in starts]
                if cut:
                    yield to_batch({"item_id": [item] * len(cut), "piece": list(range(len(cut))), "n": [len(c) for c in cut], "words": [b" ".join(c) for c in cut]}, schema)

    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(run, "item_id long, piece int, n long, words binary")


def term_bits(pieces: DataFrame) -> np.ndarray:
    """Bit set of all terms of the benchmark; TERM_BITS / 8 bytes reach the driver from each of at most 8 tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(TERM_BITS >> 3, np.uint8)
        for b in batches:
            for words in ids_of(b, "words"):
                at = bit_at(terms_of(words))
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
            _hashes.clear()
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    found = pieces.select("words").coalesce(8).mapInArrow(run, "bits binary")
    bits = np.zeros(TERM_BITS >> 3, np.uint8)
    for r in found.toLocalIterator():
        bits |= np.frombuffer(r["bits"], np.uint8)
    return bits


_INDEX = "shard long, doc_ids array<long>, starts binary, terms binary, ends binary, positions binary"


def build_index(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """Shards of the positional index of the terms in a bit set, a row each."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    schema = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *[(k, pa.binary()) for k in ("starts", "terms", "ends", "positions")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        ids, texts, size = [], [], 0
        name = TaskContext.get().partitionId() << 40  # rows of a partition are numbered on from here

        def shard() -> pa.RecordBatch:
            s = Shard.build(texts, bits)
            return to_batch({"shard": [name], "doc_ids": [ids], "starts": [s.starts.tobytes()], "terms": [s.terms.tobytes()], "ends": [s.ends.tobytes()], "positions": [s.positions.tobytes()]}, schema)

        for b in batches:
            for d, t in zip(ids_of(b), binary_texts(b), strict=True):
                ids.append(d)
                texts.append(terms_of(t))
                size += len(t)
                if size >= SHARD_BYTES or len(ids) >= SHARD_ROWS:
                    yield shard()
                    ids, texts, size, name = [], [], 0, name + len(ids)
            if len(_hashes) > 1 << 18:
                _hashes.clear()
        if ids:
            yield shard()

    return texts_with_key(docs).mapInArrow(releasing(run, _forget), _INDEX)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, Shard]]:
    for b in batches:
        for name, ids, starts, terms, ends, positions in zip(*[b.column(i).to_pylist() for i in range(6)], strict=True):
            yield name, ids, Shard(np.frombuffer(starts, np.int64), np.frombuffer(terms, np.int64), np.frombuffer(ends, np.int64), np.frombuffer(positions, np.int32))


def term_counts(index: DataFrame, phrases: Phrases) -> dict[int, int]:
    """How often each term of a block stands in all documents; a block has BLOCK_WORDS terms at most."""
    shared = index.sparkSession.sparkContext.broadcast(phrases.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(shared.value), np.int64)
        for b in batches:
            for terms, ends in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                terms, counts = np.frombuffer(terms, np.int64), np.diff(np.frombuffer(ends, np.int64), prepend=0)
                at = np.searchsorted(shared.value, terms)
                at[at == len(sums)] = 0
                there = shared.value[at] == terms if len(sums) else np.zeros(len(terms), bool)
                sums[at[there]] += counts[there]
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(shared.value[at], pa.int64()), pa.array(sums[at], pa.int64())], ["term", "n"])

    found = index.select("terms", "ends").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(found["term"].to_pylist(), found["n"].to_pylist(), strict=True))


_HITS = "row long, doc_id long, n_words long, items array<long>, near array<long>, spans array<struct<start:int,end:int>>"


def search(index: DataFrame, phrases: Phrases, span: int, every: bool) -> DataFrame:
    """A row per indexed document (with a match, unless ``every``): its number, doc_id, n_words, items with an
    occurring window, items near by, and spans of words hit.

    An item is near when its chosen terms stand within ``span`` words of the document.
    """
    shared = index.sparkSession.sparkContext.broadcast(phrases)
    ids = pa.list_(pa.int64())
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("items", ids), ("near", ids), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for name, doc_ids, shard in _shards(batches):
            shard.number(p.terms)
            there = shard.numbers >= 0
            items: dict[int, set[int]] = {}
            near: dict[int, set[int]] = {}
            hit = np.zeros(int(shard.starts[-1]) + 1, np.int32)
            for numbers, matrix in p.matrices:
                for k in numbers[there[matrix].all(axis=1)]:
                    at = shard.phrase(p.windows[k])
                    if len(at):
                        np.add.at(hit, at, 1)
                        np.add.at(hit, at + len(p.windows[k]), -1)
                        for d in np.unique(np.searchsorted(shard.starts, at, "right") - 1).tolist():
                            items.setdefault(d, set()).update(p.owners[k])
            for item, terms in p.near:
                if there[terms].all():
                    for d in shard.near(tuple(terms), span).tolist():
                        near.setdefault(d, set()).add(item)
            covered = np.cumsum(hit)[:-1] > 0
            spans: dict[int, list[dict]] = {}
            for d in items:
                a, z = shard.starts[d], shard.starts[d + 1]
                edge = np.flatnonzero(np.diff(np.r_[False, covered[a:z], False].astype(np.int8)))
                spans[d] = [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)]
            at = range(len(doc_ids)) if every else sorted(items.keys() | near.keys())
            n = np.diff(shard.starts)
            yield to_batch({"row": [name + d for d in at], "doc_id": [doc_ids[d] for d in at], "n_words": [int(n[d]) for d in at], "items": [sorted(items.get(d, ())) for d in at], "near": [sorted(near.get(d, ())) for d in at], "spans": [spans.get(d, []) for d in at]}, schema)

    return index.mapInArrow(releasing(run), _HITS)


def phrase_blocks(pieces: DataFrame, window: int) -> Iterator[Phrases]:
    """The benchmark in blocks of at most BLOCK_WORDS words, or of one piece."""
    block, size = [], 0
    for r in pieces.orderBy("item_id", "piece", "words").toLocalIterator():
        if block and size + r["n"] > BLOCK_WORDS:
            yield Phrases(block, window)
            block, size = [], 0
        block.append((r["item_id"], bytes(r["words"])))
        size += r["n"]
    yield Phrases(block, window)


def united_spans(spans: Column) -> Column:
    """Spans of words in order, those that overlap or touch made one."""

    def step(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(last["end"] >= s["start"], F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:int,end:int>>"), step)


def merged(found: list[DataFrame]) -> DataFrame:
    """Hits of all blocks, one row per indexed row."""
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    one = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), union("items"), union("near"), F.flatten(F.collect_list("spans")).alias("spans"))
    return one.withColumn("spans", united_spans(F.col("spans")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, rarest: int = 4, span: int = 30) -> DataFrame:
    """Words of documents that stand in an occurrence of a benchmark window, and proximity matches.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. A window is ``window``
    consecutive words of an item, or a shorter item as a whole. Returns doc_id, n_words, n_hit, n_items,
    items (ids), spans (of words, start to end), items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words) and
    near_items (ids of items whose ``rarest`` rarest distinct words, by their counts in all documents and then
    in byte order, all stand within ``span`` consecutive words; an item with fewer distinct words has no proximity
    match, and an item over PIECE_WORDS words has one where a piece of it has), one row per input row.

    Null and wordless texts: no words, no hits. Null doc_id: judged all the same. Null item_id or item
    text: no item. Repeated items: their windows count once, for each of their ids; of items that share an id
    any may be near. Repeated ids and rows: each row is judged by its own text, however many blocks the
    benchmark takes. Empty tables: no hits, or an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    stored, found = Stored(spark), []
    pieces = stored.keep(benchmark_pieces(benchmark, window))
    index = stored.keep(build_index(docs, term_bits(pieces)))
    for phrases in phrase_blocks(pieces, window):
        phrases.rarest(term_counts(index, phrases), rarest)
        found.append(search(index, phrases, span, every=not found))
    result = found[0] if len(found) == 1 else merged(found)
    covered = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    names = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    hit = result.withColumn("n_hit", F.coalesce(covered, F.lit(0)).cast("long"))
    return hit.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        "spans",
        F.sha2(names, 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.col("near").alias("near_items"),
    )

"""Phrase collocation mining: Apriori passes by length, then scores of cuts from the tables of each length.

A text is lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at spaces and tabs into words; everything is counted per
language. Pass k counts phrases of k words within pieces, and only those whose both overlapping phrases of k - 1 words are frequent. What is
broadcast is a bit set of the frequent ones' keys, of bounded size: where it fills up more phrases pass, none is missed, and as a phrase with
an infrequent part is infrequent itself, the counts that are kept are the same. Tasks count chunks of bounded size, whose rows Spark adds up.

Words are carried as 64-bit keys. Where two words share one, the passes start again with another seed, so the counts are exact.
Null texts are empty, a null language is ``und``; texts without words count nothing; repeated rows count each; an empty table gives no rows.
Other columns of the table are not read. Ties in a language's ranking go by count, then by the phrase's UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FILTER_WORDS, Stored, binary_texts, ids_of, prepare, releasing, to_batch

#: Words, and distinct words, of the chunk that a task counts at once. A text adds TEXT_WORDS at a time; local ids take 21 bits.
CHUNK_WORDS, CHUNK_DISTINCT, TEXT_WORDS = 1 << 20, 1 << 18, 1 << 18

#: Rows of a batch handed to Spark.
ROWS = 1 << 16

#: Shares in which a language's candidates are ranked before those that they leave are ranked together.
SHARES = 32

#: Seeds tried until no two words share a key.
SEEDS = range(8)

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_MARKED = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b"." * len(_SEPARATORS) + bytes(range(97, 123)))


class Chunk(dict):
    """Words of one language to local ids; id 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b".": 0})
        self.parts: list[np.ndarray] = []

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        return k

    def add(self, words: list[bytes]) -> None:
        ids = np.zeros(len(words) + 1, np.int64)
        ids[:-1] = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        self.parts.append(ids)

    def ids(self) -> np.ndarray:
        return np.concatenate(self.parts)

    def keys(self, lang: str, seed: int) -> np.ndarray:
        """Keys of the local words: hashes of language and word."""
        head = lang.encode() + b"\n"
        return np.fromiter((xxhash.xxh64_intdigest(head + w, seed) for w in self), np.uint64, len(self)).view(np.int64)


def chunks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[str, Chunk]]:
    """Chunks of each language for phrases of k words. A long text is added in parts that share k - 1 words, so each of its phrases is in one part."""
    now: dict[str, Chunk] = {}
    n = distinct = 0
    for b in batches:
        for lang, text in zip(ids_of(b, "lang"), binary_texts(b), strict=True):
            words = text.translate(_MARKED).replace(b".", b" . ").split()
            for i in range(0, len(words), TEXT_WORDS):
                part = words[max(0, i - k + 1) : i + TEXT_WORDS]
                chunk = now.setdefault(lang, Chunk())
                n, distinct = n + len(part), distinct - len(chunk)
                chunk.add(part)
                distinct += len(chunk)
                if n >= CHUNK_WORDS or distinct >= CHUNK_DISTINCT:
                    yield from now.items()
                    now, n, distinct = {}, 0, 0
    yield from now.items()


def _sliced(columns: dict[str, np.ndarray | list], n: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for i in range(0, n, ROWS):
        yield to_batch({k: v[i : i + ROWS] for k, v in columns.items()}, schema)


def pair_key(a, b):
    """One key of two, alike in Spark and numpy: a xor b turned left by one bit."""
    if isinstance(a, Column):
        return a.bitwiseXOR(F.shiftleft(b, 1).bitwiseOR(F.shiftrightunsigned(b, 63)))
    return a ^ ((b << 1) | ((b >> 63) & 1))


class KeyFilter:
    """Bit set of keys that are hashes, about 16 bits a key up to the largest size: none is missed; beyond, more others pass."""

    def __init__(self, keys: DataFrame):
        least, most = FILTER_WORDS
        self.words = min(most, max(least, 1 << (keys.count() // 4).bit_length()))
        key = F.col(keys.columns[0])
        rows = (
            keys.select(F.pmod(key, F.lit(self.words)).cast("int").alias("w"), F.shiftright(key, 32).bitwiseAND(F.lit(63)).cast("int").alias("b"))
            .groupBy("w")
            .agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
            .toArrow()  # self.words rows at most, whatever the number of keys
        )
        self.bits = np.zeros(self.words, np.int64)
        self.bits[rows["w"].to_numpy()] = rows["bits"].to_numpy()

    def has(self, key: np.ndarray) -> np.ndarray:
        return (self.bits[np.mod(key, self.words)] >> ((key >> 32) & 63)) & 1 == 1


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, key, f) of every word."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, chunk in chunks(batches, 1):
            n = np.bincount(chunk.ids(), minlength=len(chunk))
            yield from _sliced({"lang": [lang] * (len(chunk) - 1), "word": list(chunk)[1:], "key": chunk.keys(lang, seed)[1:], "n": n[1:]}, len(chunk) - 1, schema)

    counted = _texts(docs).mapInArrow(releasing(run), "lang string, word binary, key long, n long")
    return counted.groupBy("lang", "word", "key").agg(F.sum("n").alias("f"))


def gram_counts(docs: DataFrame, k: int, frequent: KeyFilter, seed: int, least: int) -> DataFrame:
    """(k1, .., kk, f) of the phrases of k words, k = 2 or 3, that occur at least ``least`` times; frequent: what has the frequent phrases of k - 1."""
    names = [f"k{i + 1}" for i in range(k)]
    schema = pa.schema([(x, pa.int64()) for x in [*names, "n"]])
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = shared.value.has
        for lang, chunk in chunks(batches, k):
            ids, keys = chunk.ids(), chunk.keys(lang, seed)
            if k == 2:
                known = has(keys)
                known[0] = False  # the end of a piece
                known = known[ids]
            else:
                known = has(pair_key(keys[ids[:-1]], keys[ids[1:]])) & (ids[:-1] > 0) & (ids[1:] > 0)
            at = np.flatnonzero(known[:-1] & known[1:])
            packed = ids[at]
            for i in range(1, k):
                packed = packed << 21 | ids[at + i]
            packed, n = np.unique(packed, return_counts=True)
            found = {x: keys[(packed >> 21 * (k - 1 - i)) & ((1 << 21) - 1)] for i, x in enumerate(names)}
            yield from _sliced(found | {"n": n}, len(n), schema)

    counted = _texts(docs).mapInArrow(releasing(run), ", ".join(f"{x} long" for x in schema.names))
    return counted.groupBy(*names).agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)) in exact integers of up to 38 digits."""
    d = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (d(a) * d(a)), d(left) * d(right))


def phrases(docs: DataFrame, least: int = 10, top: int = 2000, inside: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` phrases of two or three words.

    least: occurrences of a candidate; inside: a candidate goes where a longer one that holds it has at least so many hundredths of its count.
    """
    prepare(docs.sparkSession)
    stored = Stored(docs.sparkSession)
    for seed in SEEDS:
        words = stored.keep(word_counts(docs, seed))
        if words.groupBy("key").count().where("count > 1").isEmpty():
            break
        stored.drop(words)
    else:
        raise RuntimeError("two words share a key with every seed")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    ones = stored.keep(words.where(F.col("f") >= least).select("key", "lang", F.col("word").cast("string").alias("w"), "f"))
    twos = stored.keep(gram_counts(docs, 2, KeyFilter(ones.select("key")), seed, least))
    threes = stored.keep(gram_counts(docs, 3, KeyFilter(twos.select(pair_key(F.col("k1"), F.col("k2")))), seed, least))

    one = lambda k, *more: ones.select(F.col("key").alias(f"k{k}"), F.col("w").alias(f"w{k}"), F.col("f").alias(f"f{k}"), *more)
    pairs = stored.keep(twos.join(one(1, "lang"), "k1").join(one(2), "k2"))
    head = pairs.select("k1", "k2", "lang", "f1", F.col("f").alias("f12"), F.concat_ws(" ", "w1", "w2").alias("w12"))
    tail = pairs.select(F.col("k1").alias("k2"), F.col("k2").alias("k3"), F.col("f2").alias("f3"), F.col("f").alias("f23"), F.col("w2").alias("w3"))
    triples = threes.join(head, ["k1", "k2"]).join(tail, ["k2", "k3"])
    s1, s2 = cut_score(F.col("f"), F.col("f1"), F.col("f23")), cut_score(F.col("f"), F.col("f12"), F.col("f3"))
    by_cut = triples.select("lang", F.concat_ws(" ", "w12", "w3").alias("phrase"), F.col("f").alias("a"), s1.alias("s1"), s2.alias("s2"), "f1", "f12", "f3", "f23")
    second = F.col("s2") < F.col("s1")
    of_three = by_cut.select("lang", "phrase", "a", F.when(second, F.col("f12")).otherwise(F.col("f1")).alias("l"), F.when(second, F.col("f3")).otherwise(F.col("f23")).alias("r"), F.least("s1", "s2").alias("score"))

    holders = threes.select("k1", "k2", "f").union(threes.select("k2", "k3", "f")).groupBy("k1", "k2").agg(F.max("f").alias("longer"))
    free = pairs.join(holders, ["k1", "k2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("f")))
    of_two = free.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), cut_score(F.col("f"), F.col("f1"), F.col("f2")).alias("score"))

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    found = of_two.union(of_three).withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    shares = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top).drop("rank")
    best = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

"""Language-model scoring: a gated recurrent model learned from all training documents, and a smoothed unigram score beside it.

A text is lower-cased (A-Z) and cut at white space; its tokens are its words and one end. Training documents are those outside the held-out fold.

1. Counts of every token of the training documents, whatever their number, in a written table.
2. Texts as the model's ids, two bytes a token, and with the sums of their words' counts, in a written table. Counts of the most frequent words (at
   most ``KNOWN``) are broadcast; other words of a text are joined to the table of counts.
3. Training in rounds over all training documents, each in one round: every task runs truncated backpropagation over its own documents, and the
   weights' changes are averaged by tokens in Spark. Their number is fixed, so what the driver gathers and broadcasts is bounded.
4. Scoring of every whole text, states carried from window to window. Words outside the model's vocabulary have the class ``other`` and share its
   probability by their smoothed counts, so probabilities of all tokens, and of one unseen token, sum to one.

One row per input row. Null texts are empty (the end alone is scored), a null id is held out; repeated rows are scored, and trained on, each; an empty
table gives no rows; other columns are not read. Ties between counts go by the word. Without training tokens every token is the unseen one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gated_lm
from .common import Stored, binary_texts, ids_of, prepare, releasing, reusing, texts_with_key, to_batch
from .linear import held_out

#: Words of the recurrent model; words whose counts are broadcast, at most, and the parts of an octave that counts are told apart by when those are chosen.
WORDS, KNOWN, PARTS = 2048, 1 << 18, 32

#: Shares of the training documents in each round, in 16ths of their hashes.
ROUNDS = (2, 14)

#: Tokens of the texts that a task trains on or scores at once; distinct words it counts before it hands them on, rows of a batch.
BUFFER, DISTINCT, ROWS = 1 << 21, 1 << 18, 1 << 15


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, c) of the documents' words."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def out(counts: Counter) -> Iterator[pa.RecordBatch]:
        words, n = list(counts), list(counts.values())
        for i in range(0, len(words), ROWS):
            yield to_batch({"word": words[i : i + ROWS], "n": n[i : i + ROWS]}, schema)
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for text in binary_texts(b):
                counts.update(words_of(text))
                if len(counts) >= DISTINCT:
                    yield from out(counts)
        yield from out(counts)

    return docs.select("text").mapInArrow(releasing(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def most_frequent(counts: DataFrame, bound: int) -> tuple[list[bytes], np.ndarray, int]:
    """Words from the most frequent one on, at most ``bound``, their counts, and the least count of those taken: all words of at least this count are taken."""
    part = F.floor(F.log2("c") * PARTS).cast("int")
    sizes = counts.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("part")).toArrow().to_pylist()  # 64 * PARTS rows at most
    room, least = bound, 1 << 62
    for x in sizes:
        room -= x["n"]
        if room < 0:
            break
        least = x["least"]
    rows = counts.where(F.col("c") >= least).toArrow()
    order = np.lexsort((np.array(rows["word"].to_pylist(), object), -rows["c"].to_numpy())) if rows.num_rows else []
    return rows["word"].take(pa.array(order, pa.int64())).to_pylist(), rows["c"].to_numpy()[order].astype(np.int64) if rows.num_rows else np.zeros(0, np.int64), least


def encoded(docs: DataFrame, known: list[bytes], c: np.ndarray, ends: int, size: int) -> DataFrame:
    """A row a document: its model ids as bytes, sums over its words that are among ``known`` (and its end), and its other words with their numbers.

    n_known, base: number and log counts of the tokens seen in training; n_other, other: number of words outside the model's, and log counts of them.
    """
    shared = docs.sparkSession.sparkContext.broadcast((known, np.r_[np.log10(c + 0.1), 0.0], float(np.log10(ends + 0.1)), int(ends > 0)))
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("n_known", pa.int64()), ("n_other", pa.int64()), ("base", pa.float64()), ("other", pa.float64()), ("rare", rare_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, log, end_log, end_known = shared.value
        index, beyond = {w: i for i, w in enumerate(words)}, len(words)
        for b in batches:
            rows = []
            for doc_id, text in zip(ids_of(b), binary_texts(b), strict=True):
                own = words_of(text)
                x = np.fromiter(map(index.get, own, repeat(beyond)), np.int32, len(own))
                rare = Counter(own[i] for i in np.flatnonzero(x == beyond).tolist())
                outside, logs = x >= size, log[x]
                ids = np.where(outside, size + 1, x).astype(np.uint16).tobytes()
                n = len(own)
                rows.append((doc_id, n + 1, ids, n - rare.total() + end_known, int(outside.sum()), float(logs.sum()) + end_log, float(logs[outside].sum()), [{"word": w, "n": k} for w, k in rare.items()]))
            if rows:
                yield to_batch(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)), schema)

    return texts_with_key(docs).mapInArrow(releasing(run), "doc_id long, n_tokens long, ids binary, n_known long, n_other long, base double, other double, rare array<struct<word: binary, n: long>>")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Keys and ids of about BUFFER tokens at a time."""
    keys, held, n = [], [], 0
    for b in batches:
        for key, ids in zip(ids_of(b, "row"), binary_texts(b, "ids"), strict=True):
            keys.append(key)
            held.append(np.frombuffer(ids, np.uint16).astype(np.int32))
            n += len(held[-1]) + 1
            if n >= BUFFER:
                yield keys, held
                keys, held, n = [], [], 0
    if held:
        yield keys, held


def trained(rows: DataFrame, vocabulary: gated_lm.Vocabulary) -> dict[str, np.ndarray]:
    """Weights after all rounds over the training documents. rows: (row, doc_id, ids)."""
    p = gated_lm.start(vocabulary)
    names = list(p)
    edges = np.cumsum([0, *(p[x].size for x in names)])
    schema = pa.schema([("i", pa.int32()), ("v", pa.float64())])
    share = F.pmod(F.xxhash64("doc_id"), F.lit(sum(ROUNDS)))
    below = 0
    for size in ROUNDS:
        shared = rows.sparkSession.sparkContext.broadcast((vocabulary, p))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            v, begun = shared.value
            now, squares, tokens = {k: x.copy() for k, x in begun.items()}, gated_lm.fresh_squares(begun), 0
            for _, held in _documents(batches):
                gated_lm.train(now, v, held, squares)
                tokens += sum(map(len, held)) + len(held)
            if not tokens:
                return
            change = np.concatenate([(now[k].astype(np.float64) - begun[k]).ravel() for k in names]) * tokens
            at = np.flatnonzero(change)
            yield to_batch({"i": np.r_[np.int32(-1), at.astype(np.int32)], "v": np.r_[float(tokens), change[at]]}, schema)

        part = rows.where((share >= below) & (share < below + size)).select("row", "ids")
        below += size
        got = part.mapInArrow(releasing(reusing(run)), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # a row a weight
        i, v = got["i"].to_numpy(), got["v"].to_numpy()
        if len(i):
            change = np.zeros(edges[-1])
            change[i[i >= 0]] = v[i >= 0] / v[i < 0][0]
            p = {k: (p[k] + change[edges[j] : edges[j + 1]].reshape(p[k].shape)).astype(np.float32) for j, k in enumerate(names)}
    return p


def modelled(rows: DataFrame, vocabulary: gated_lm.Vocabulary, p: dict[str, np.ndarray]) -> DataFrame:
    """(row, model): the model's log10 probability of each whole document, where other words count with their class alone."""
    shared = rows.sparkSession.sparkContext.broadcast((vocabulary, p))
    schema = pa.schema([("row", pa.int64()), ("model", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, weights = shared.value
        for keys, held in _documents(batches):
            yield to_batch({"row": keys, "model": gated_lm.score(weights, v, held) / np.log(10)}, schema)

    return rows.select("row", "ids").mapInArrow(releasing(reusing(run)), "row long, model double")


def lm_scores(docs: DataFrame, modulus: int = 10, fold: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; the held-out fold is crc32 of the id mod ``modulus``."""
    spark = docs.sparkSession
    prepare(spark)
    stored = Stored(spark)
    learn = docs.where(~held_out(modulus, fold)).select("doc_id", "text")
    counts = stored.keep(token_counts(learn))
    ends, (n_words, n_distinct) = learn.count(), counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = n_words + ends, n_distinct + (ends > 0)
    known, c, least = most_frequent(counts, KNOWN)
    size = min(WORDS, len(known))
    n_model = int(c[:size].sum())
    vocabulary = gated_lm.Vocabulary(c[:size], ends, n_words - n_model)
    base_low = float(np.log10(total + 0.1 * (distinct + 1)))
    other_low = float(np.log10(n_words - n_model + 0.1 * (n_distinct - size + 1)))

    rows = stored.keep(encoded(docs, known, c, ends, size).select(F.monotonically_increasing_id().alias("row"), "*"))
    p = trained(rows.where(~held_out(modulus, fold)), vocabulary)
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    looked_up = rare.join(counts.where(F.col("c") < least), "word", "left")
    sums = looked_up.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("rare_log"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known")
    )
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    kept = rows.select("row", "doc_id", "n_tokens", "n_known", "n_other", "base", "other").join(modelled(rows, vocabulary, p), "row")
    return kept.join(sums, "row", "left").select(
        "doc_id",
        held_out(modulus, fold).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + rare_log - F.col("n_tokens") * base_low).alias("base_score"),
        (F.col("model") + F.col("other") + rare_log - F.col("n_other") * other_low).alias("score"),
    )

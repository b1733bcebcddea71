"""Spelling variant grouping: words within one edit of each other, by a positional q-gram index with a count filter.

Words are the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased; a stated share of the occurrences loses one letter, by a hash of
document and word. Words of few letters or occurrences are left out.

Index. Pairs are sought by the length m of their shorter word, so a word is posted under its own length and under one less. Its posts are
positional q-grams of half that length, one at each end: they do not overlap, so one edit leaves one of them whole. A list of posts longer than
``LIST`` is split by a further gram: what is not shared yet is cut in half again, and one of the halves is whole too. So a list is short, or its
words differ in a letter or two. Within a list the open parts of the words are posted by positional 2-grams; a word's lists are heap-merged under
the limits of length and position, pairs that share fewer grams than one edit leaves are dropped, and what is left is verified. A pair that two
lists hold counts in the first of them only. Lists give one row a word, so no pair leaves a task.

Null texts have no words and a null id counts as empty in the hash; repeated rows count each; an empty table gives no rows; other columns are not read.
Words of any length take part. Ties between forms go to the smallest word by code points.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, binary_texts, ids_of, prepare, releasing, to_batch

#: Posts beyond which a list is split, and open letters of the shorter word at which none is any more.
LIST, OPEN = 256, 2

#: Distinct words a task counts before it hands them on, and rows of a batch.
DISTINCT, ROWS = 1 << 18, 1 << 14

_NEVER = 1 << 30


def damaged(run: str, raw: bytes, start: int, every: int) -> str:
    """The run, without one letter where the hash that goes on from ``start`` says so."""
    h = zlib.crc32(raw, start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, letters: int = 7, every: int = 31) -> DataFrame:
    """(word, n) of the words of at least ``letters`` letters; one occurrence in ``every`` lost a letter."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    runs = re.compile(f"[a-zÀ-ÿ]{{{letters},}}")

    def out(counts: dict[str, int]) -> Iterator[pa.RecordBatch]:
        words = list(counts)
        for i in range(0, len(words), ROWS):
            part = words[i : i + ROWS]
            yield to_batch({"word": part, "n": [counts[w] for w in part]}, schema)
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = defaultdict(int)
        for b in batches:
            for doc_id, text in zip(ids_of(b), binary_texts(b), strict=True):
                start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                once: dict[str, str | None] = {}
                for w in runs.findall(text.lower().decode("utf-8", "replace")):
                    if (made := once.get(w)) is None:
                        made = once[w] = damaged(w, w.encode(), start, every)
                    counts[made] += 1
                if len(counts) >= DISTINCT:
                    yield from out(counts)
        yield from out(counts)

    counted = docs.select("doc_id", "text").mapInArrow(releasing(run), "word string, n long")
    return counted.where(F.length("word") >= letters).groupBy("word").agg(F.sum("n").alias("n"))


def near(a: str, b: str) -> bool:
    """Whether one insertion, deletion or replacement turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def grams(part: str) -> list[tuple[int, str]]:
    """Positional 2-grams of a part whose ends are marked."""
    marked = f"^{part}$"
    return [(i, marked[i : i + 2]) for i in range(len(part) + 1)]


def candidates(parts: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs i < j of parts that one edit may part: enough common 2-grams at places that differ by one at most.

    A part of r letters has r + 1 grams and an edit touches two, so the longer one's r - 1 must be left, each matched at the same place or one further.
    """
    index: dict[tuple[int, str], list[int]] = defaultdict(list)
    free: list[int] = []  # parts so short that no gram need be common
    for j, part in enumerate(parts):
        own = grams(part)
        lists = [index[k] for p, g in own for k in ((p, g), (p - 1, g), (p + 1, g)) if k in index]
        for i, same in groupby(heapq.merge(*lists)):
            if abs(len(parts[i]) - len(part)) <= 1 and sum(1 for _ in same) >= max(len(parts[i]), len(part)) - 1 > 0:
                yield i, j
        if len(part) <= 1:
            yield from ((i, j) for i in free)
        for k in own:
            index[k].append(j)
        if len(part) <= 1:
            free.append(j)


def matched(m: int, left: int, right: int, below: int, rows: list[tuple[str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, largest count among them, its word) of one list.

    m: length of the shorter word; left, right: letters known to be shared at the ends; below: pairs that share so many at the start are another list's.
    """
    by_ends = defaultdict(list)  # of one, unless keys collide
    for w, n in rows:
        by_ends[w[:left], w[len(w) - right :]].append((w, n))
    for same in by_ends.values():
        if len(same) < 2:
            continue
        found: dict[int, tuple[int, int, str]] = {}
        for i, j in candidates([w[left : len(w) - right] for w, _ in same]):
            (a, na), (b, nb) = same[i], same[j]
            if min(len(a), len(b)) != m or a[:below] == b[:below] or not near(a, b):
                continue
            for k, w, n in ((i, b, nb), (j, a, na)):
                count, most, best = found.get(k, (0, -1, ""))
                found[k] = (count + 1, *((n, w) if n > most or n == most and w < best else (most, best)))
        yield from ((same[k][0], *v) for k, v in found.items())


def _placed(rows: DataFrame) -> DataFrame:
    """Posts with the key of their list."""
    ends = F.concat_ws("\n", F.expr("substring(word, 1, `left`)"), F.expr("substring(word, length(word) - `right` + 1, `right`)"))
    return rows.withColumn("list", F.xxhash64("m", "left", "right", ends))


def posts(words: DataFrame) -> DataFrame:
    """(word, n, m, left, right, below, list): the first two posts of each word and length."""
    lengths = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m"))
    half = F.floor(F.col("m") / 2).cast("int")
    zero = F.lit(0)
    ends = F.array(F.struct(half.alias("left"), zero.alias("right"), F.lit(_NEVER).alias("below")), F.struct(zero.alias("left"), (F.col("m") - half).alias("right"), half.alias("below")))
    return _placed(lengths.select("word", "n", "m", F.explode(ends).alias("p")).select("word", "n", "m", "p.*"))


def halved(rows: DataFrame) -> DataFrame:
    """The two posts that follow each post of a list that is split."""
    open_ = F.col("m") - F.col("left") - F.col("right")
    half = F.floor(open_ / 2).cast("int")
    to = F.array(
        F.struct((F.col("left") + half).alias("left"), F.col("right"), F.col("below")),
        F.struct(F.col("left"), (F.col("right") + open_ - half).alias("right"), F.least("below", F.col("left") + half).alias("below")),
    )
    return _placed(rows.select("word", "n", "m", F.explode(to).alias("p")).select("word", "n", "m", "p.*"))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of lists that arrive sorted."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("most", pa.int64()), ("best", pa.string())])

    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    out: list[tuple] = []
    for (_, m, left, right, below), same in groupby(rows(), key=lambda r: r[:5]):
        first, second = next(same), next(same, None)
        if second is not None:
            out += matched(m, left, right, below, [first[5:], second[5:], *(r[5:] for r in same)])
            if len(out) >= ROWS:
                yield to_batch(dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)), schema)
                out = []
    if out:
        yield to_batch(dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)), schema)


def near_words(words: DataFrame, stored: Stored) -> DataFrame:
    """(word, n_near, most, best) of the words that have near words: their number, the largest count among them and its word."""
    now, done = posts(words), None
    while True:
        sizes = now.groupBy("list").count().where(F.col("count") > 1)
        open_ = F.col("m") - F.col("left") - F.col("right")
        tagged = stored.keep(now.join(sizes, "list").withColumn("split", (F.col("count") > LIST) & (open_ > OPEN)).drop("count"))
        whole = tagged.where("not split")
        done = whole if done is None else done.unionByName(whole)
        now = tagged.where("split")
        if now.isEmpty():
            break
        now = halved(now)
    keys = ["list", "m", "left", "right", "below"]
    dealt = done.select(*keys, "word", "n").repartition("list").sortWithinPartitions(*keys, "word")
    found = dealt.mapInArrow(releasing(_lists), "word string, n_near long, most long, best string")
    best = F.min(F.struct((-F.col("most")).alias("less"), F.col("best").alias("best"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.less")).alias("most"), F.col("b.best").alias("best"))


def roots(forms: DataFrame, stored: Stored) -> DataFrame:
    """(word, root) of (word, form): the last word that the forms lead to. Each round follows twice as many; counts that grow by steps leave no circle."""
    now = stored.keep(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored.keep(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ended = after.where("moved").isEmpty()
        stored.drop(now)
        now = after.select("word", "root")
        now._tierwise_path = after._tierwise_path
        if ended:
            return now


def spelling_variants(docs: DataFrame, letters: int = 7, least: int = 2, times: int = 10, every: int = 31) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row for each word of ``letters`` letters and ``least`` occurrences or more.

    form: the near word that occurs most, if ``times`` as often as the word; root: where forms lead from the word, itself without one.
    """
    prepare(docs.sparkSession)
    stored = Stored(docs.sparkSession)
    words = stored.keep(word_counts(docs, letters, every).where(F.col("n") >= least))
    found = stored.keep(words.join(near_words(words, stored), "word", "left"))
    has: Column = F.col("most") >= times * F.col("n")
    judged = found.select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("most")).alias("form_n"))
    ended = roots(judged.where("form is not null"), stored)
    return judged.join(ended, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

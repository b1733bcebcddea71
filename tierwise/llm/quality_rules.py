"""Quality rules: base statistics, then a length-normalised log-likelihood ratio of hashed n-grams.

Native DataFrame functions only. The words of a text are hashed into BUCKETS buckets, and so are the unigrams and bigrams
of their shapes (runs of capitals, small letters and digits become A, a and 0), which say something of words never seen, too. Two multinomials over the buckets, of the trusted target (documents labelled good) and of the
raw corpus, give each bucket a log ratio, rounded to a millionth so that sums do not depend on their
order. A document is kept when its mean log ratio reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the hashed n-grams: the size of both multinomials.
BUCKETS = 1 << 14
#: Mean log ratio (in millionths) from which a document is kept. Fixed value.
THRESHOLD = -1_000_000
#: 64-bit words of the bit set of good ids, by their number: 32 KB at least, 8 MB at most.
MARK_WORDS = 1 << 12, 1 << 20
SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def repeat_words(hashes: Column) -> Column:
    """Words inside 5-word windows that the text holds twice or more. hashes: of the words, in order."""
    n = F.size(hashes)
    grams = F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(*[F.element_at(hashes, i + k) for k in range(5)]))
    none = F.lit(0).cast("long")

    def places(pairs: Column) -> Column:
        same = lambda a, b: F.get(pairs, a)["h"] == F.get(pairs, b)["h"]
        twice = lambda p, k: F.when(((k > 0) & same(k - 1, k)) | ((k < F.size(pairs) - 1) & same(k, k + 1)), p["i"])
        return F.array_sort(F.filter(F.transform(pairs, twice), lambda i: i.isNotNull()))

    def covered(g: Column) -> Column:
        at = bound(F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), places)
        zero = F.struct(none.alias("n"), F.lit(-5).alias("last"))
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(5), i - acc["last"])).cast("long").alias("n"), i.alias("last"))
        return F.aggregate(at, zero, step)["n"]

    found = bound(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), none).otherwise(covered(g)))
    return F.when(n < 6, none).otherwise(found)


def base_rules(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and _hashes (of the words) to docs (column text)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"_words": words_of(F.col("text"))})
    out = out.withColumns({"_lines": lines, "_hashes": F.transform("_words", lambda w: F.xxhash64(w))})
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    chars = F.length(F.translate(text, " \t\n\x0b\f\r", ""))
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": chars.cast("long"),
            "n_symbols": symbols.cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeat_words(F.col("_hashes")),
        }
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_words", "_lines")


def hashes_of(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def buckets_of(text: Column, hashes: Column) -> Column:
    """Hashed words (given by their hashes), and hashed unigrams and bigrams of the words' shapes."""
    shape = F.coalesce(text, F.lit(""))
    # Small letters first: what is left for the other patterns is short.
    for pattern, mark in ((r"[\p{Ll}\p{Lo}]+", "a"), (r"\p{Lu}+", "A"), (r"\p{N}+", "0")):
        shape = F.regexp_replace(shape, pattern, mark)
    shapes = F.filter(F.split(shape, SPACE), lambda w: w != "")
    one = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    two = lambda hs: F.transform(F.sequence(F.lit(1), F.size(hs) - 1), lambda i: one(F.xxhash64(F.element_at(hs, i), F.element_at(hs, i + 1))))
    none = F.array().cast("array<int>")
    both = lambda hs: F.concat(F.transform(hs, one), F.when(F.size(hs) > 1, two(hs)).otherwise(none))
    return F.concat(F.transform(hashes, one), bound(F.transform(shapes, lambda w: F.xxhash64(w)), both))


def in_order(numbered: DataFrame, size: int, *sums: str) -> DataFrame:
    """One row: an array ``held`` of the rows (i, ...) in order, a row of nulls for each missing i below size; and the sums of columns."""
    rows = numbered.sparkSession.range(size).select(F.col("id").cast("int").alias("i")).join(numbered.hint("merge"), "i", "left")
    # Of a fixed size, so one task may gather them.
    return rows.agg(F.sort_array(F.collect_list(F.struct("i", *numbered.columns[1:]))).alias("held"), *[F.sum(c).alias(f"sum_{c}") for c in sums])


def marked(ids: DataFrame, words: int) -> DataFrame:
    """One row with the array ``marks``: bits set at the hashes of ids (column doc_id), 64 * words in all."""
    h = F.xxhash64("doc_id")
    bits = ids.select(F.pmod(h, F.lit(words)).cast("int").alias("i"), F.shiftright(h, 32).bitwiseAND(F.lit(63)).cast("int").alias("b"))
    bits = bits.groupBy("i").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
    return in_order(bits, words).select(F.transform("held", lambda x: F.coalesce(x["bits"], F.lit(0).cast("long"))).alias("marks"))


def log_ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row with the array ``ratios``: of each bucket, log target over raw, in millionths.

    Raw counts cover all documents, target counts all that are labelled good. Labels are joined by a shuffle at every size, of the documents only
    that a bounded bit set of the good ids lets through; all others are surely not labelled good. The raw counts are scaled to the
    size of the target, so without labels all ratios are 0.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    least, most = MARK_WORDS
    words = min(most, max(least, 1 << (good.count() // 4).bit_length()))
    h = F.xxhash64("doc_id")
    word = F.get(marked(good, words).scalar(), F.pmod(h, F.lit(words)).cast("int"))
    there = F.call_function("shiftright", word, F.shiftright(h, 32).bitwiseAND(F.lit(63)).cast("int"))
    texts = docs.select("doc_id", "text").withColumn("_there", there.bitwiseAND(F.lit(1)) == 1)
    asked = texts.where("_there").join(good.select("doc_id", F.lit(1).alias("good")).hint("merge"), "doc_id", "left").select("good", "text")
    others = texts.where("not _there").select(F.lit(None).cast("int").alias("good"), "text")
    counts = (
        asked.unionByName(others).select("good", F.explode(bound(hashes_of(F.col("text")), lambda hs: buckets_of(F.col("text"), hs))).alias("i"))
        .groupBy("i")
        .agg(F.count("*").alias("raw"), F.count("good").alias("target"))
    )
    both = in_order(counts, BUCKETS, "raw", "target")
    # Both multinomials have the target's size and the same smoothing, so a bucket says the less the rarer it is.
    size = F.coalesce(F.try_divide(F.col("sum_target").cast("double"), F.col("sum_raw").cast("double")), F.lit(0.0))
    ratio = lambda x: F.round(1e6 * F.log((F.coalesce(x["target"], F.lit(0)) + 1.0) / (F.coalesce(x["raw"], F.lit(0)) * F.col("size") + 1.0))).cast("long")
    both = both.withColumn("size", size)
    return both.select(F.transform("held", ratio).alias("ratios"))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Base rules and the log-likelihood verdict on every document.

    docs: doc_id, text and any others; all are returned, with n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, llr (mean log ratio in millionths; 0 without words) and
    kept. Columns of docs with one of these names are replaced.

    labels: doc_id, quality. Null and empty texts: no words, so the base rules fail. Null ids, repeated
    rows and ids: each row is judged by itself. Null labels count for nothing. Empty table: empty result.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    docs = docs.drop(*made)
    out = base_rules(docs)
    ratios = log_ratios(docs, labels)
    out = out.withColumn("_r", ratios.scalar()).withColumn("_b", buckets_of(F.col("text"), F.col("_hashes")))
    total = F.aggregate("_b", F.lit(0).cast("long"), lambda s, b: s + F.get(F.col("_r"), b))
    out = out.withColumn("llr", F.coalesce(F.try_divide(total, F.size("_b")).cast("long"), F.lit(0).cast("long"))).drop("_r", "_b", "_hashes")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))

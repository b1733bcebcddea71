"""Lexical ratios of prompts, the split into context and query, and BM25 of the query over the context's sentences.

Tokens are runs of letters, digits, marks and underscores, and single other characters; sentences end with ``.``, ``!`` or ``?``. A tagger's
features (parts of speech, entities, dependencies) need a model that is not available here and are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keyword lists and marks.
FORMAT_WORDS = ("json", "yaml", "xml", "table", "bullet", "list", "format", "schema", "markdown", "csv")
ALGORITHM_WORDS = ("algorithm", "complexity", "sort", "search", "binary", "graph", "tree", "dynamic", "programming", "hash", "stack", "queue", "dfs", "bfs")
CONSTRAINT_WORDS = ("must", "should", "exactly", "only", "at least", "at most", "required", "format", "return")
RELATION_WORDS = ("from", "to", "by", "with", "in", "on", "for", "between", "belongs", "contains")
CREATIVITY_WORDS = ("creative", "story", "poem", "imagine", "fiction", "narrative", "style", "tone")
TOPIC_WORDS = ("about", "topic", "theme", "subject", "domain")
DISCOURSE_WORDS = ("however", "therefore", "moreover", "meanwhile", "thus", "overall", "in conclusion")
POSITIVE_WORDS = ("good", "great", "excellent", "amazing", "love", "positive", "best", "happy")
NEGATIVE_WORDS = ("bad", "terrible", "awful", "hate", "negative", "worst", "sad", "angry")
NEGATIONS = ("no", "not", "never", "none", "nothing", "neither", "nor", "without", "cannot", "can't", "won't")
MODALS = ("can", "could", "may", "might", "must", "shall", "should", "will", "would")
LISTS = (FORMAT_WORDS, ALGORITHM_WORDS, RELATION_WORDS, CREATIVITY_WORDS, TOPIC_WORDS, DISCOURSE_WORDS, POSITIVE_WORDS, NEGATIVE_WORDS, NEGATIONS, MODALS)
MATH_MARKS, CODE_MARKS = "+-*/=<>^%", "+-*/=<>^%(){}[]:;_"
QUERY_MARKERS, SUMMARY_MARKERS = ("question:", "query:", "instruction:", "task:"), ("summary:", "summarize", "write a summary")

TOKEN, WORD, SENTENCE = r"[\p{L}\p{N}\p{M}_]+|[^\s\p{L}\p{N}\p{M}_]", r"^[\p{L}\p{M}]+$", r"[^.!?]+[.!?]*"
# A token with a letter or number in it, and white space.
SPOKEN, SPACE = r"(?<![\p{M}_])[\p{M}_]*+[\p{L}\p{N}][\p{L}\p{N}\p{M}_]*+", " \t\n\x0b\f\r"


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def tokens_of(text: Column) -> Column:
    return found(F.lower(text), TOKEN)


def sentences_of(text: Column) -> Column:
    return F.filter(F.transform(found(text, SENTENCE), stripped), lambda s: s != "")


def occurrences(text: Column, part: str) -> Column:
    """How often a string occurs, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def characters(text: Column, marks: str) -> Column:
    """How many of the characters are marks."""
    return F.length(text) - F.length(F.translate(text, marks, ""))


def split_query(df: DataFrame, text: str, task: str) -> DataFrame:
    """Adds context and query: cut at the first marker; else the last sentence is the query; else, from 8 tokens on, the last three tenths of them; else there is none."""
    t, low = F.coalesce(F.col(text), F.lit("")), F.lower(F.coalesce(F.col(text), F.lit("")))
    first = lambda ms: F.least(*[F.nullif(F.locate(m, low), F.lit(0)) for m in ms])
    at = F.when(F.col(task) == "summarization", first(SUMMARY_MARKERS)).otherwise(first(QUERY_MARKERS))
    out = df.withColumns({"_t": t, "_at": at})
    out = out.withColumns({"_b": stripped(F.substring("_t", F.lit(1), F.col("_at") - 1)), "_a": stripped(F.substring("_t", F.col("_at"), F.length("_t")))})
    before, after = F.col("_b"), F.col("_a")
    marked = F.col("_at").isNotNull() & (before != "") & (after != "")
    out = out.withColumn("_s", F.when(~marked, sentences_of(F.col("_t"))))
    several = F.size("_s") >= 2
    words = found(F.col("_t"), TOKEN)
    out = out.withColumn("_w", F.when(~marked & ~several, words))
    cut = F.greatest(F.lit(1), F.floor(F.size("_w") * 0.7).cast("int"))
    many = F.size("_w") >= 8
    context = F.when(marked, before).when(several, F.concat_ws(" ", F.slice("_s", 1, F.size("_s") - 1))).when(many, F.concat_ws(" ", F.slice("_w", 1, cut))).otherwise(F.col("_t"))
    query = F.when(marked, after).when(several, F.element_at("_s", -1)).when(many, F.concat_ws(" ", F.slice("_w", cut + 1, F.size("_w") - cut))).otherwise(F.lit(""))
    return out.withColumns({"context": F.coalesce(context, F.col("_t")), "query": F.coalesce(query, F.lit(""))}).drop("_t", "_at", "_b", "_a", "_s", "_w")


def lexical_features(df: DataFrame, text: str, task: str) -> DataFrame:
    """Adds the lexical ratios of a prompt as columns. Null text counts as empty.

    Markers of several words never equal one token, and ``==`` counts as ``=`` twice and as ``==``; both as the features are defined.
    """
    df = split_query(df, text, task)
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"_x": t, "_low": F.lower(t), "_tok": tokens_of(t), "_ct": tokens_of(F.col("context")), "_sn": F.greatest(F.lit(1), F.size(sentences_of(t))).cast("double")})
    df = df.withColumns({"_qt": F.when(F.col("query") != "", tokens_of(F.col("query"))).otherwise(F.col("_tok")), "_word": F.filter("_tok", lambda w: w.rlike(WORD))})
    n, words, chars, sents = F.size("_tok").cast("double"), F.greatest(F.lit(1.0), F.size("_word").cast("double")), F.greatest(F.lit(1.0), F.length("_x").cast("double")), F.col("_sn")
    # One pass keeps the tokens of any list; the counts by list read only those.
    listed = sorted({w for ws in LISTS for w in ws})
    df = df.withColumn("_hit", F.filter("_tok", lambda w: w.isin(*listed)))
    hits = lambda ws: F.size(F.filter("_hit", lambda w: w.isin(*ws))).cast("double")
    inside = lambda ws: sum((F.contains("_low", F.lit(w)).cast("int") for w in ws), F.lit(0))
    count = lambda col, *parts: sum((occurrences(F.col(col), p) for p in parts), F.lit(0))
    query, context = F.array_distinct("_qt"), F.array_distinct("_ct")
    source = F.when((F.col(task) == "summarization") & (F.size("_ct") > 0), F.size("_ct").cast("double")).otherwise(n)
    made = {
        "token_count": n,
        "type_token_ratio": F.size(F.array_distinct("_word")) / words,
        "avg_word_length": F.when(F.size("_word") > 0, F.aggregate("_word", F.lit(0), lambda a, w: a + F.length(w)) / F.size("_word")).otherwise(0.0),
        "sentence_count": sents,
        "avg_sentence_length": n / sents,
        "negation_count": hits(NEGATIONS),
        "sentiment_lexicon_score": (hits(POSITIVE_WORDS) - hits(NEGATIVE_WORDS)) / words,
        "modal_verb_ratio": hits(MODALS) / words,
        "format_keyword_density": hits(FORMAT_WORDS) / words,
        "algorithm_keyword_density": hits(ALGORITHM_WORDS) / words,
        "constraint_keyword_density": inside(CONSTRAINT_WORDS) / words,
        "relation_keyword_density": hits(RELATION_WORDS) / words,
        "creativity_keyword_density": hits(CREATIVITY_WORDS) / words,
        "topic_keyword_density": hits(TOPIC_WORDS) / words,
        "discourse_marker_density": hits(DISCOURSE_WORDS) / words,
        "digit_ratio": characters(F.col("_x"), "0123456789") / chars,
        "math_symbol_density": characters(F.col("_x"), MATH_MARKS) / chars,
        "code_symbol_density": characters(F.col("_x"), CODE_MARKS) / chars,
        "equation_marker_density": count("_x", "=", "==") / chars,
        "quantity_mention_density": F.size(F.filter("_tok", lambda w: w.rlike("[0-9]"))) / words,
        "slot_marker_density": count("_x", ":", "->") / chars,
        "list_marker_density": count("_x", "- ", "* ") / sents,
        "step_marker_density": count("_low", "step ", "first", "then") / sents,
        "question_mark_density": count("_x", "?") / sents,
        "citation_marker_density": (count("_x", "[", "]") + count("_low", "source")) / sents,
        "summary_instruction_density": count("_low", "summarize", "summary") / sents,
        "context_token_count": F.size("_ct").cast("double"),
        "query_token_count": F.size("_qt").cast("double"),
        "source_token_count": source,
        "compression_ratio_proxy": F.size("_qt") / F.greatest(F.lit(1.0), source),
        "context_query_overlap_ratio": F.when((F.size("_qt") > 0) & (F.size("_ct") > 0), F.size(F.array_intersect(query, context)) / F.size(query)).otherwise(0.0),
    }
    return df.withColumns(made).drop("_x", "_low", "_tok", "_hit", "_ct", "_qt", "_word", "_sn", "context", "query")


def okapi(sentences: list[list[str]], query: list[str], k1: float, b: float, epsilon: float) -> tuple[float, float]:
    """Greatest and mean score of a query over sentences of at least one word."""
    if not sentences or not query:
        return 0.0, 0.0
    n, mean_length = len(sentences), sum(map(len, sentences)) / len(sentences)
    held = Counter()
    for words in sentences:
        held.update(set(words))
    weight = lambda k: math.log((n - k + 0.5) / (k + 0.5))
    mean = sum(weight(k) * c for k, c in Counter(held.values()).items()) / len(held)
    asked = {t: c * (weight(held[t]) if weight(held[t]) >= 0 else epsilon * mean) for t, c in Counter(query).items() if t in held}
    scores = []
    for words in sentences:
        norm = k1 * (1 - b + b * len(words) / mean_length)
        scores.append(sum(asked[t] * f * (k1 + 1) / (f + norm) for t, f in Counter(w for w in words if w in asked).items()))
    return max(scores), sum(scores) / n


def bm25(df: DataFrame, key: str, context: str, query: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(key, bm25_max, bm25_mean): Okapi scores of the query over the sentences of its own context; 0 without words on a side.

    The corpus of a score is its own row, so rows are scored where they are, in Arrow batches and in time linear in the text; repeated keys have a row each.
    Terms in more than half of the sentences have ``epsilon`` times the mean weight of all terms of the context. A term of the query counts as often as it stands there.
    """
    words = lambda c: found(F.lower(c), SPOKEN)
    sentences = F.filter(F.transform(found(F.coalesce(F.col(context), F.lit("")), SENTENCE), words), lambda s: F.size(s) > 0)
    rows = df.select(key, sentences.alias("_s"), words(F.coalesce(F.col(query), F.lit(""))).alias("_q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scored = [okapi(s, q, k1, b, epsilon) for s, q in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in scored], pa.float64()), pa.array([x for _, x in scored], pa.float64())], [key, "bm25_max", "bm25_mean"])

    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, bm25_max double, bm25_mean double")

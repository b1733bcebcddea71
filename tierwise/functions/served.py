"""Features of a query as it is served, from its words and sentences alone.

The features that a placeholder fills at random (parts of speech, depth of the parse, BM25 and embedding scores of the first set) are left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import overlap, tokens

# Stop words of either set, words of a sentiment, and for each marker feature its words and whether it is a share of the words or of the sentences.
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "is", "are")
MORE_STOP_WORDS = (*STOP_WORDS, "be")
NICE, NASTY = ("good", "great", "excellent", "positive"), ("bad", "poor", "terrible", "negative")
NEGATIONS = ("not", "no", "never")
MARKERS = {
    "algorithm_keyword_density": ("words", ("loop", "function", "sort", "search", "tree")),
    "constraint_keyword_density": ("words", ("must", "cannot", "only", "always", "never")),
    "modal_verb_ratio": ("sentences", ("can", "could", "should", "would")),
    "relation_keyword_density": ("words", ("between", "after", "before", "during")),
    "slot_marker_density": ("words", ("field", "value", "slot", "key")),
    "imperative_root_ratio": ("sentences", ("do", "make", "check", "verify")),
    "format_keyword_density": ("words", ("format", "schema", "structure")),
    "list_marker_density": ("words", ("list", "bullet", "number", "step")),
    "step_marker_density": ("sentences", ("step", "then", "next", "finally")),
    "equation_marker_density": ("words", ("equation", "solve", "calculate")),
    "quantity_mention_density": ("words", ("how many", "how much", "count", "number")),
    "summary_instruction_density": ("words", ("summarize", "summary", "brief", "short")),
    "discourse_marker_density": ("words", ("however", "therefore", "because", "also")),
    "creativity_keyword_density": ("words", ("creative", "imagine", "story", "unique")),
    "topic_keyword_density": ("words", ("about", "regarding", "concerning")),
    "citation_marker_density": ("words", ("source", "cite", "reference", "quote")),
}
OVERLAP, COMPRESSION = 0.7, 0.5
#: Of the second set: (characters or words, tasks) of the features that only one task has.
FAMILY_ALGORITHMS = ("loop", "function", "sort", "search", "tree", "graph")
FAMILY_IMPERATIVES = ("please", "must", "should", "do", "check", "verify", "ensure")
FAMILY_CONSTRAINTS = ("must", "cannot", "not", "always", "never", "only")
MEAN_OF_MAX = 0.7


def _bound(values: dict[str, Column], body) -> Column:
    """body of a struct of values that is computed once, however often the body names them."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(n) for n, v in values.items()])), body), 1)


def _parts(text: Column) -> dict[str, Column]:
    sentences = F.filter(F.split(text, r"\."), lambda s: s.rlike(r"(?U)\S"))
    return {"x": text, "low": F.lower(text), "w": tokens(text), "s": F.size(sentences).cast("double")}


def _named(low: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur anywhere in the text, inside of others too."""
    out = F.lit(0)
    for w in words:
        out = out + low.contains(w).cast("int")
    return out.cast("double")


def _common(b: Column, stop_words: tuple[str, ...]) -> dict[str, Column]:
    n, w = F.size(b["w"]).cast("double"), b["w"]
    words, sentences = F.greatest(F.lit(1.0), n), F.greatest(F.lit(1.0), b["s"])
    empty = (n == 0) | (b["s"] == 0)
    letters = F.aggregate(w, F.lit(0), lambda a, t: a + F.length(t))
    capital = F.size(F.filter(w, lambda t: t.rlike(r"^\p{Lu}.")))
    long_words, vowels = F.size(F.filter(w, lambda t: F.length(t) > 6)), F.regexp_count(b["x"], F.lit("[aeiou]"))
    return {
        "token_count": n,
        "sentence_count": b["s"],
        "avg_sentence_length": n / sentences,
        "avg_word_length": letters / words,
        "type_token_ratio": F.size(F.array_distinct(w)) / words,
        "stopword_ratio": F.size(F.filter(w, lambda t: F.lower(t).isin(*stop_words))) / words,
        "entity_density": capital / words,
        "flesch_kincaid_grade": F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), 0.39 * (n / sentences) + 11.8 * (vowels / words) - 15.59)),
        "gunning_fog": F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), 0.4 * (n / sentences + 100 * (long_words / words)))),
    }


def _share(w: Column, pattern: str) -> Column:
    return F.size(F.filter(w, lambda t: t.rlike(pattern))) / F.greatest(F.lit(1), F.size(w))


def served_features(prompt: Column, reference: Column | None = None) -> Column:
    """Struct of the features of a prompt and its reference output; null texts are empty."""
    text = F.concat(F.coalesce(prompt, F.lit("")), F.lit(" "), F.lit("") if reference is None else F.coalesce(reference, F.lit("")))

    def body(b: Column) -> Column:
        n, w = F.size(b["w"]).cast("double"), b["w"]
        per = {"words": F.greatest(F.lit(1.0), n), "sentences": F.greatest(F.lit(1.0), b["s"])}
        hits = lambda words: sum((F.regexp_count(b["low"], F.lit(v)) for v in words), F.lit(0)).cast("double")
        entities = F.filter(w, lambda t: t.rlike(r"^\p{Lu}."))
        out = _common(b, MORE_STOP_WORDS) | {
            "negation_count": _named(b["low"], NEGATIONS),
            "sentiment_lexicon_score": F.coalesce(F.try_divide(hits(NICE), hits(NICE) + hits(NASTY)), F.lit(0.5)),
            "code_symbol_density": _share(w, r"[{}()]"),
            "digit_ratio": _share(w, r"\p{Nd}"),
            "math_symbol_density": _share(w, r"[=+\-*/]"),
            "entity_count": F.size(entities).cast("double"),
            "entity_type_count": F.size(F.array_distinct(entities)).cast("double"),
            "question_mark_density": F.regexp_count(b["x"], F.lit(r"\?")) / per["sentences"],
            "context_token_count": n, "query_token_count": n, "source_token_count": n,
            "context_query_overlap_ratio": F.lit(OVERLAP), "compression_ratio_proxy": F.lit(COMPRESSION),
        }
        out |= {name: _named(b["low"], words) / per[of] for name, (of, words) in MARKERS.items()}
        return F.struct(*[c.cast("double").alias(name) for name, c in out.items()])

    return _bound(_parts(text), body)


def query_features(task: Column, query: Column, context: Column) -> Column:
    """Struct of the features of a query of a task family; those of other families, and of a context where it is null or empty, are null."""
    text, beside = F.coalesce(query, F.lit("")), F.nullif(context, F.lit(""))

    def body(b: Column) -> Column:
        w = b["w"]
        words, sentences = F.greatest(F.lit(1), F.size(w)), F.greatest(F.lit(1.0), b["s"])
        held = F.size(F.filter(tokens(b["low"]), lambda t: F.lower(b["c"]).contains(t))) / words
        best = F.least(held, F.lit(1.0))
        of = lambda family, value: F.when(b["t"] == family, value)
        near = lambda value: F.when(b["c"].isNotNull(), value)
        out = _common(b, STOP_WORDS) | {
            "digit_ratio": of("maths", _share(w, r"\p{Nd}")),
            "math_symbol_density": of("maths", _share(w, r"[=+\-*/]")),
            "code_symbol_density": of("code_generation", _share(w, r"[{}()\[\];]")),
            "algorithm_keyword_density": of("code_generation", _named(b["low"], FAMILY_ALGORITHMS) / words),
            "imperative_root_ratio": of("instruction_following", _named(b["low"], FAMILY_IMPERATIVES) / sentences),
            "constraint_keyword_density": of("instruction_following", _named(b["low"], FAMILY_CONSTRAINTS) / words),
            "context_token_count": near(F.size(tokens(b["c"]))),
            "context_query_overlap_ratio": near(overlap(b["x"], b["c"], "context")),
            "bm25_query_context_max": near(best),
            "bm25_query_context_mean": near(best * MEAN_OF_MAX),
        }
        return F.struct(*[c.cast("double").alias(name) for name, c in out.items()])

    return _bound(_parts(text) | {"t": task, "c": beside}, body)

"""Text features as Column builders; one projection computes any set of them in one scan."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .nullsafe import clamp01, num, once

# Cue lists and patterns.
CONTRAST = r"\b(but|however|although|though|yet|whereas|despite)\b"
HEDGES = r"\b(maybe|perhaps|possibly|seems|appears|likely|unclear|ambiguous)\b"
NEGATION = r"\b(no|not|never|none|without|can't|cannot|won't|isn't|don't|didn't)\b"
PROHIBITIONS = r"\b(do not|don't|never|without|avoid|must not|cannot)\b"
STEPS = r"\b(first|second|third|step|then|after that|finally|in order)\b"
CONFLICTS = r"\b(but|however|except|unless|instead|only if|otherwise)\b"
PRECISION_CUES = ("exact", "exactly", "decimal", "nearest", "round", "significant figure", "precision", "simplify", "fraction", "integer")
FORMAT_CUES = ("json", "yaml", "xml", "markdown", "csv", "table", "bullet", "schema", "exact format", "output format", "valid json")
DOMINANT = {"classification": "H", "text_generation": "n_in", "summarization": "n_in", "instruction_following": "|Gamma|", "code_generation": "R_hat", "maths": "R_hat", "retrieval_grounded": "n_in", "information_extraction": "|Gamma|"}
REASONING_CUES = ("because", "therefore", "hence", "if", "then", "after", "before", "compare", "prove", "derive", "compute", "calculate", "reason", "first", "second", "third", "multi-step", "step by step")
KNOWLEDGE_CUES = ("who", "when", "where", "which country", "capital", "president", "prime minister", "year", "date", "historical", "according to", "latest", "current", "fact", "evidence")
CLAUSES = r"[;,:]|\band\b|\bor\b|\bwhile\b|\bwhich\b|\bthat\b"
BREAKS = ("that", "which", "while", "because", "although", "if", "when")
YEARS = r"\b(19|20)\d{2}\b"
CONSTRAINT_PATTERNS = (
    r"\bmust\b", r"\bshould\b", r"\brequired\b", r"\bexactly\b", r"\bat least\b", r"\bat most\b", r"\bno more than\b", r"\bno less than\b", r"\binclude\b",
    r"\bdo not\b|\bdon't\b|\bwithout\b", r"\bonly\b", r"\bformat\b|\bjson\b|\bxml\b|\bmarkdown\b|\bcsv\b", r"\bbullet\b|\btable\b|\blist\b",
    r"\bword(s)?\b|\bcharacter(s)?\b|\blength\b", r"\bcite\b|\bsource\b",
)
CLASSIFICATION = ("classification",)
MATHS = ("maths",)


def total(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cs)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    """Words between white space; null or empty: 0."""
    return F.coalesce(F.size(tokens(text)), F.lit(0)).cast("long")


def alnum_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[A-Za-z0-9_]+")), F.lit(0))


def word_count(text: Column) -> Column:
    """Unicode words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\w+")), F.lit(0))


def cue_count(text: Column, cues: tuple[str, ...]) -> Column:
    """Number of distinct cues present as substrings; the text is lower-cased once."""
    return once(F.lower(text), lambda low: total([F.contains(low, F.lit(c)).cast("int") for c in cues]))


def early(pattern: str) -> str:
    """The same pattern, which fails sooner where each of its alternatives begins with a word end and a letter or digit.

    Only where one of the first characters follows none of ASCII's word characters are the alternatives tried: that is cheap to tell, Unicode's word ends are not.
    """
    listed = re.fullmatch(r"\\b\(([^()]*)\)(?:\\d\{2\})?\\b", pattern)
    words = [rf"\b{w}" for w in listed[1].split("|")] if listed else pattern.split("|")
    if not all(re.match(r"\\b[a-z0-9]", w) for w in words):
        return pattern
    return f"(?=[{''.join(sorted({w[2] for w in words}))}])(?<![A-Za-z0-9_])(?:{pattern})"


def pattern_count(text: Column, pattern: str) -> Column:
    """Matches, whatever their case; word ends, digits and case are those of Unicode on every Java version."""
    return F.regexp_count(text, F.lit(f"(?iU){early(pattern)}" if re.search("[A-Za-z]", pattern) else pattern))


def clamped(c: Column) -> Column:
    """clamp01 of a value that scans the text, which is done once."""
    return once(c, clamp01)


def classification_features(text: Column) -> dict[str, Column]:
    n = F.greatest(F.lit(1), alnum_count(text))
    unsure = pattern_count(text, CONTRAST) + pattern_count(text, HEDGES) + F.greatest(F.lit(0), pattern_count(text, r"\bor\b") - 1)
    shift = pattern_count(text, YEARS) + 0.7 * pattern_count(text, r"\b[A-Z]{2,}\b") + 0.15 * pattern_count(text, r"\b[A-Z][a-z]{2,}\b")
    return {
        "classification_ambiguity": clamped(unsure / 8.0),
        "classification_negation_density": clamped(pattern_count(text, NEGATION) / F.greatest(F.lit(1.0), n / 6.0)),
        "classification_domain_shift": clamped(shift / 10.0),
    }


def math_features(text: Column) -> dict[str, Column]:
    n = F.greatest(F.lit(1), alnum_count(text))
    return {
        "math_numeric_density": clamped(pattern_count(text, r"\b\d+(\.\d+)?\b") / F.greatest(F.lit(1.0), n / 3.0)),
        "math_symbol_density": clamped(pattern_count(text, r"[\=\+\-\*/\^%<>]|≤|≥|≠|√|∑|∫") / F.greatest(F.lit(1.0), n / 4.0)),
        "math_precision_cues": clamped(cue_count(text, PRECISION_CUES) / 4.0),
    }


def instruction_features(text: Column) -> dict[str, Column]:
    n = F.greatest(F.lit(1), alnum_count(text))
    return {
        "instruction_format_strictness": clamped(cue_count(text, FORMAT_CUES) / 4.0),
        "instruction_prohibition_count": clamped(pattern_count(text, PROHIBITIONS) / 3.0),
        "instruction_step_count": clamped(pattern_count(text, STEPS) / F.greatest(F.lit(2.0), n / 12.0)),
        "instruction_conflict_cues": clamped(pattern_count(text, CONFLICTS) / 3.0),
    }


def gated(task: Column, tasks: tuple[str, ...], features: dict[str, Column]) -> dict[str, Column]:
    """Features of a task family, 0 for the others."""
    return {k: F.when(task.isin(*tasks), v).otherwise(F.lit(0.0)) for k, v in features.items()}


def stated_constraints(text: Column) -> Column:
    """Occurrences of the 15 constraint patterns in a text; null or empty: 0. They share no word, so one pass counts them all."""
    return F.coalesce(pattern_count(text, "|".join(CONSTRAINT_PATTERNS)), F.lit(0))


def constraint_count(text: Column, *lists: Column) -> Column:
    """Sizes of the lists of constraints; where they sum to 0, what the text states."""
    listed = total([F.size(F.coalesce(c, F.array().cast("array<string>"))) for c in lists]) if lists else F.lit(0)
    return F.when(listed > 0, listed).otherwise(stated_constraints(text)).cast("double")


def readability_of(words: Column, text: Column, low: Column) -> dict[str, Column]:
    """readability of a text whose words and lower-cased form are there."""
    w = F.greatest(F.lit(1), F.coalesce(F.size(words), F.lit(0)).cast("long"))
    s = F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"[.!?]+")))
    syllables = F.regexp_count(low, F.lit("[aeiou]"))
    long_words = F.size(F.filter(words, lambda x: F.length(x) > 6))
    return {"flesch_kincaid": F.greatest(F.lit(0.0), 0.39 * w / s + 11.8 * syllables / w - 15.59), "fog": F.greatest(F.lit(0.0), 0.4 * (w / s + 100.0 * long_words / w))}


def readability(text: Column) -> dict[str, Column]:
    """Closed forms of Flesch-Kincaid and Fog; floor 0."""
    return readability_of(tokens(text), text, F.lower(text))


def overlap(query: Column, context: Column, over: str = "query") -> Column:
    """Share of the distinct words of the query, or of the context, that the other side holds."""
    q, c = F.array_distinct(tokens(F.lower(query))), F.array_distinct(tokens(F.lower(context)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, c)).cast("double"), F.size(q if over == "query" else c).cast("double")), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of the normalised vectors; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def stable_unit(seed: str, key: Column) -> Column:
    """First 8 bytes of sha256("seed:key") over 2^64."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)
    return F.conv(F.substring(h, 1, 16), 16, 10).cast("double") / F.lit(18446744073709551616.0)


def split_name(u: Column) -> Column:
    return F.when(u < 0.6, "train").when(u < 0.8, "val").otherwise("test")


def canonical_id(task: Column, sample: Column, prefixed: bool) -> Column:
    """task:prefix+number, or task:number; without trailing digits the id as it is."""
    n = F.regexp_extract(sample, r"(\d+)$", 1)
    head = F.regexp_extract(sample, r"^(.*?)\d+$", 1) if prefixed else F.lit("")
    return F.concat(task, F.lit(":"), F.when(n == "", sample).otherwise(F.concat(head, n.try_cast("long").cast("string"))))


def model_family(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.rlike("gpt|claude|gemini|llama-3.3-70b|llama_llama"), "LLM").otherwise("SLM")


def dominant_dimension(task: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in DOMINANT.items() for x in kv])
    return F.coalesce(F.try_element_at(table, task), F.lit("n_in"))


_FACTS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("entropy", "distance", "reasoning", "knowledge", "names")])
_ENDS = tuple(c.encode() for c in (".", "!", "?"))
#: ``$`` of the patterns may stand before one of these at the end of a word.
_TERMINATORS = tuple(c.encode() for c in ("\u0085", "\u2028", "\u2029"))


def _names(words: list[bytes]) -> int:
    """Capitalised words behind one that ends no sentence."""
    found = 0
    for before, w in zip(words, words[1:], strict=False):
        if w[0] < 91 and re.match(b"[A-Z][a-z]", w):
            before = next((before[: -len(c)] for c in _TERMINATORS if before.endswith(c)), before)
            found += not before.endswith(_ENDS)
    return found


@F.arrow_udf(_FACTS)
def _word_facts(texts: pa.Array, low: pa.Array) -> pa.Array:
    """Entropy and clause distance of the words of each text, its cues and its names. Bytes split at ASCII's white space, as the patterns' ``\\s`` does."""
    breaks, cues = {w.encode() for w in BREAKS}, [[c.encode() for c in cs] for cs in (REASONING_CUES, KNOWLEDGE_CUES)]
    out = []
    for text, lowered in zip(texts.cast(pa.binary()).to_pylist(), low.cast(pa.binary()).to_pylist(), strict=True):
        words = lowered.split()
        n = len(words)
        entropy = abs(math.log2(n) - sum(c * math.log2(c) for c in Counter(words).values()) / n) if n else 0.0
        at = [max(i, n - i - 1) for i, w in enumerate(words) if w.strip(b",;:.") in breaks]
        distance = 0.0 if n < 2 else sum(at) / len(at) if at else max(1.0, n / 8)
        out.append((entropy, distance, *[float(sum(c in lowered for c in cs)) for cs in cues], float(_names(text.split()))))
    columns = zip(*out, strict=True) if out else [()] * 5
    return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns], names=_FACTS.names)


def word_facts(text: Column) -> Column:
    """Struct of what the words of a text tell; several of its fields are one call. Null counts as empty."""
    x = F.coalesce(text, F.lit(""))
    return _word_facts(x, F.lower(x))


def reasoning_proxy(text: Column, default: float = 0.0) -> Column:
    """Estimated reasoning steps from cues and clauses; the default where there are none."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    marks, words = CLAUSES.split("|", 1)
    steps = 0.6 * word_facts(text)["reasoning"] + 0.25 * F.regexp_count(low, F.lit(f"(?U){marks}|{early(words)}"))
    return steps if default == 0 else once(steps, lambda n: F.when(n > 0, n).otherwise(F.lit(float(default))))


def knowledge_dependence(text: Column) -> Column:
    """Share from 0 to 1: cues, capitalised words inside sentences, and years."""
    years = F.coalesce(F.regexp_count(text, F.lit(f"(?U){early(YEARS)}")), F.lit(0))
    raw = word_facts(text)["knowledge"] + F.least(F.lit(2.0), word_facts(text)["names"] / 3.0) + F.least(F.lit(1.5), years / 2.0)
    return F.least(F.lit(1.0), raw / 6.0)


def clause_distance(text: Column) -> Column:
    """Proxy of the mean dependency distance: the longer side of each clause word, else an eighth of the words (1 at least)."""
    return word_facts(text)["distance"]


def first_of(*candidates: Column) -> Column:
    """The first candidate that is there."""
    return F.coalesce(*candidates)


def reasoning_steps(text: Column, lists: tuple[Column, ...] = (), numbers: tuple[Column, ...] = (), default: float = 0.0) -> Column:
    """Annotated steps (the length of a list, else a number, at least 0), else what the text tells."""
    sizes = [F.when(c.isNotNull(), F.size(c).cast("double")) for c in lists]
    given = [F.when(num(c).isNotNull(), F.greatest(F.lit(0.0), num(c))) for c in numbers]
    return first_of(*sizes, *given, reasoning_proxy(text, default))


def parametric_dependence(text: Column, with_context: Column, without: Column, given: Column) -> Column:
    """What retrieval gains over the model alone, else a given value over 0, else what the text tells."""
    gain = num(with_context) - num(without)
    return first_of(F.when(gain.isNotNull(), F.greatest(F.lit(0.0), gain)), F.when(num(given) > 0, num(given)), knowledge_dependence(text))


def dependency_distance(text: Column, arcs: Column) -> Column:
    """Mean distance of annotated arcs (array of structs head, dep), else the clause proxy of the text."""
    spans = F.transform(arcs, lambda a: F.abs(a["head"] - a["dep"]).cast("double"))
    mean = F.when(F.size(spans) > 0, F.try_divide(F.aggregate(spans, F.lit(0.0), lambda s, x: s + x), F.size(spans)))
    return first_of(mean, clause_distance(text))


def feature_text(task: Column, text: Column, context: Column) -> Column:
    """The text, with its context where a retrieval task has one."""
    return F.when((F.lower(F.trim(task)) == "retrieval_grounded") & (F.coalesce(context, F.lit("")) != ""), F.concat(text, F.lit(" "), context)).otherwise(text)


def interactions(reasoning: Column, constraints: Column, length: Column, entropy: Column, knowledge: Column) -> dict[str, Column]:
    """Products of features that are only high when both are."""
    return {"reasoning_x_constraint": reasoning * constraints, "length_x_entropy": length * entropy, "knowledge_x_reasoning": knowledge * reasoning}


def text_entropy(text: Column) -> Column:
    """Bits a word of the words of one text, as an expression; 0 without words."""
    return word_facts(text)["entropy"]


# Words whose share among themselves is the feature of a family.
FAMILY_CUES = {
    "classification": ("sentiment_lexicon_score", ("good", "bad", "positive", "negative", "best", "worst")),
    "code_generation": ("code_keyword_density", ("function", "code", "python", "javascript", "java", "write", "implement")),
    "maths": ("math_symbol_density", ("x", "=", "+", "-", "*", "/", "^", "solve")),
    "retrieval_grounded": ("retrieval_marker_count", ("based", "document", "according", "provided", "from")),
    "instruction_following": ("instruction_marker_count", ("follow", "step", "format", "output", "require")),
    "information_extraction": ("extraction_marker_count", ("extract", "find", "identify", "entity", "name")),
    "text_generation": ("generation_marker_count", ("write", "create", "compose", "story", "creative")),
}


def simple_features(task: Column, text: Column) -> dict[str, Column]:
    """Counts of a query, and one cue ratio of its family; null for other families."""
    x, words = F.coalesce(text, F.lit("")), tokens(F.coalesce(text, F.lit("")))
    letters = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    out = {
        "token_count": F.size(words).cast("double"),
        "char_count": F.length(x).cast("double"),
        "avg_token_length": letters / F.greatest(F.lit(1), F.size(words)),
        "punctuation_count": (F.length(x) - F.length(F.translate(x, ".,!?;:", ""))).cast("double"),
        "question_mark": F.contains(x, F.lit("?")).cast("double"),
        "uppercase_ratio": F.length(F.regexp_replace(x, r"[^\p{Lu}]", "")) / F.greatest(F.lit(1), F.length(x)),
    }
    for family, (name, cues) in FAMILY_CUES.items():
        out[name] = F.when(task == family, cue_count(x, cues) / float(len(cues)))
    return out | {"length_indicator": F.when(task == "summarization", F.least(F.lit(1.0), F.size(words) / 100.0))}


# Negations and sentiment of the use-case features.
USE_CASE_NEGATION = r"\b(not|no|never|neither|nobody|nothing|nowhere|n't|cannot|can't|won't|wouldn't|shouldn't|couldn't)\b"
POSITIVE, NEGATIVE = ("good", "great", "excellent", "amazing", "love", "positive", "best", "happy"), ("bad", "terrible", "awful", "hate", "negative", "worst", "sad", "angry")


def use_case_struct(text: Column) -> Column:
    """Struct of the features of a use case's text that need no tagger, whose tokens are found once; all 0 for texts under five characters."""

    def body(b: Column) -> Column:
        x, found, words = b["x"], b["found"], b["words"]
        n = F.greatest(F.lit(1), F.size(words))
        hits = lambda ws: F.size(F.filter(words, lambda w: w.isin(*ws)))
        read = readability_of(b["split"], x, b["low"])
        out = {
            "token_count": F.size(found).cast("double"),
            "type_token_ratio": F.coalesce(F.try_divide(F.size(F.array_distinct(found)).cast("double"), F.size(found).cast("double")), F.lit(0.0)),
            "avg_word_length": F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)) / n,
            "sentence_count": F.regexp_count(x, F.lit(r"[^.!?]+[.!?]*")).cast("double"),
            "flesch_kincaid_grade": read["flesch_kincaid"],
            "gunning_fog": read["fog"],
            "negation_count": F.regexp_count(x, F.lit(f"(?U){early(USE_CASE_NEGATION)}")).cast("double"),
            "sentiment_lexicon_score": (hits(POSITIVE) - hits(NEGATIVE)) / n,
        }
        return F.struct(*[F.when(F.length(x) >= 5, v).otherwise(0.0).alias(k) for k, v in out.items()])

    def parts(b: Column) -> Column:
        found = F.regexp_extract_all(b["low"], F.lit(r"[\p{L}\p{N}\p{M}_]+|[^\s\p{L}\p{N}\p{M}_]"), F.lit(0))
        return F.struct(b["x"].alias("x"), b["low"].alias("low"), tokens(b["x"]).alias("split"), found.alias("found"))

    def worded(b: Column) -> Column:
        words = F.filter(b["found"], lambda w: w.rlike(r"^[\p{L}\p{M}]+$"))
        return F.struct(b["x"].alias("x"), b["low"].alias("low"), b["split"].alias("split"), b["found"].alias("found"), words.alias("words"))

    x = F.trim(F.coalesce(text, F.lit("")))
    return once(once(once(F.struct(x.alias("x"), F.lower(x).alias("low")), parts), worded), body)


# The features' names, in their order.
USE_CASE = ("token_count", "type_token_ratio", "avg_word_length", "sentence_count", "flesch_kincaid_grade", "gunning_fog", "negation_count", "sentiment_lexicon_score")


def use_case_features(text: Column) -> dict[str, Column]:
    """The fields of use_case_struct; where more than one is wanted, name the struct in a projection of its own first."""
    made = use_case_struct(text)
    return {n: made[n] for n in USE_CASE}


def all_features(task: Column, text: Column, context: Column) -> dict[str, Column]:
    """What one text tells of its difficulty, by the names of the annotation; interactions follow from these."""
    x = feature_text(task, text, context)
    base = {"n_in": token_count(x).cast("double"), "entropy": text_entropy(x), "reasoning_proxy": reasoning_proxy(text), "constraint_count": constraint_count(text)}
    return base | {"parametric_dependence": knowledge_dependence(text), "dependency_distance": clause_distance(text)}


def annotate(df: DataFrame, task: str, text: str, context: str) -> DataFrame:
    """Adds difficulty_dim, difficulty_score (the task's dominant dimension) and the features as difficulty_feature_*, each computed once."""
    made = df.withColumns({f"difficulty_feature_{n}": c for n, c in all_features(F.col(task), F.col(text), F.col(context)).items()})
    pairs = interactions(*[F.col(f"difficulty_feature_{n}") for n in ("reasoning_proxy", "constraint_count", "n_in", "entropy", "parametric_dependence")])
    made = made.withColumns({f"difficulty_feature_{n}": c for n, c in pairs.items()})
    dim, of = dominant_dimension(F.col(task)), lambda n: F.col(f"difficulty_feature_{n}")
    score = F.when(dim == "H", of("entropy")).when(dim == "|Gamma|", of("constraint_count")).when(dim == "R_hat", of("reasoning_proxy")).otherwise(of("n_in"))
    return made.withColumns({"difficulty_dim": dim, "difficulty_score": score})

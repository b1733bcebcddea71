"""Queries of the text features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from .tables import t



def _text():
    """Needs a session, so it is made when a query runs."""
    return F.col("text")


_WORDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')"


def token_features(s, d):
    d_ = t(s, d, "documents")
    return d_.select("doc_id", X.token_count(_text()).alias("n_in"), X.alnum_count(_text()).cast("long").alias("n_alnum"), X.cue_count(_text(), ("the", "and", "que")).cast("long").alias("cues"))


def block(features):
    return lambda s, d: t(s, d, "documents").select("doc_id", *[F.round(v, 6).alias(k) for k, v in features(_text()).items()])


def _n(pattern, text="text"):
    return f"len(regexp_extract_all({text}, '(?i){pattern}'))".replace("can't", "can''t").replace("won't", "won''t").replace("isn't", "isn''t").replace("don't", "don''t").replace("didn't", "didn''t")


def _clamp(x):
    return f"round(least(greatest({x}, 0.0::DOUBLE), 1.0::DOUBLE), 6)"


#: Documents with a word character of ASCII for each other letter, digit and mark, as DuckDB knows word ends of ASCII only.
_MARKED = r"(SELECT doc_id, regexp_replace(text, '[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}]|[^\x00-\x7F\P{M}]', '_', 'g') AS text, text AS raw FROM documents)"
_ALNUM = "greatest(1, len(regexp_extract_all(text, '[A-Za-z0-9_]+')))"
_cues = lambda cs: " + ".join(f"CAST(contains(lower(text), '{c}') AS INT)" for c in cs)


def splits(s, d):
    u = X.stable_unit("42", F.col("doc_id").cast("string"))
    return t(s, d, "documents").select("doc_id", u.alias("u"), X.split_name(u).alias("split"))


def embeddings(s, d):
    e = t(s, d, "embeddings")
    centre = e.where("vec_id = 0").select(F.col("embedding").alias("c"))
    return e.withColumn("c", centre.scalar()).select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("c")), 5).alias("cos"))


def entropy(s, d):
    """Shannon entropy of a document's words, by counts of (document, word)."""
    w = t(s, d, "documents").select("doc_id", F.explode(X.tokens(_text())).alias("w")).groupBy("doc_id", "w").count()
    h = F.log2(F.sum("count")) - F.sum(F.col("count") * F.log2("count")) / F.sum("count")
    return w.groupBy("doc_id").agg(F.round(F.abs(h), 6).alias("h"))


def constraints(s, d):
    return t(s, d, "documents").select("doc_id", X.constraint_count(_text()).alias("constraint_count"))


QUERIES = {
    "constraint_count": (constraints, "SELECT doc_id, (" + " + ".join("coalesce(len(regexp_extract_all(text, '(?i){}')), 0)".format(p.replace("'", "''")) for p in X.CONSTRAINT_PATTERNS) + ")::DOUBLE AS constraint_count FROM documents"),
    "token_features": (token_features, f"SELECT doc_id, CAST(len({_WORDS.format('text')}) AS BIGINT) AS n_in, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS n_alnum, CAST({_cues(('the', 'and', 'que'))} AS BIGINT) AS cues FROM documents"),
    "token_entropy": (entropy, f"SELECT doc_id, round(abs(log2(sum(c)) - sum(c * log2(c)) / sum(c)), 6) AS h FROM (SELECT doc_id, w, count(*)::DOUBLE AS c FROM (SELECT doc_id, unnest({_WORDS.format('text')}) AS w FROM documents) GROUP BY 1, 2) GROUP BY 1"),
    "classification_features": (
        block(X.classification_features),
        f"SELECT doc_id, {_clamp(f'({_n(X.CONTRAST)} + {_n(X.HEDGES)} + greatest(0, {_n(chr(92) + 'bor' + chr(92) + 'b')} - 1)) / 8.0::DOUBLE')} AS classification_ambiguity, {_clamp(f'{_n(X.NEGATION)} / greatest(1.0::DOUBLE, {_ALNUM.replace(chr(40) + 'text', chr(40) + 'raw')} / 6.0::DOUBLE)')} AS classification_negation_density, "
        + _clamp("(" + _n(r"\b(19|20)\d{2}\b") + " + 0.7::DOUBLE * " + _n(r"\b[A-Z]{2,}\b") + " + 0.15::DOUBLE * " + _n(r"\b[A-Z][a-z]{2,}\b") + ") / 10.0::DOUBLE")
        + f" AS classification_domain_shift FROM {_MARKED}",
    ),
    "math_features": (
        block(X.math_features),
        "SELECT doc_id, " + _clamp(_n(r"\b\d+(\.\d+)?\b") + f" / greatest(1.0::DOUBLE, {_ALNUM} / 3.0::DOUBLE)") + " AS math_numeric_density, " + _clamp(_n(r"[\=\+\-\*/\^%<>]|≤|≥|≠|√|∑|∫") + f" / greatest(1.0::DOUBLE, {_ALNUM} / 4.0::DOUBLE)") + f" AS math_symbol_density, {_clamp(f'({_cues(X.PRECISION_CUES)}) / 4.0::DOUBLE')} AS math_precision_cues FROM documents",
    ),
    "instruction_features": (
        block(X.instruction_features),
        f"SELECT doc_id, {_clamp(f'({_cues(X.FORMAT_CUES)}) / 4.0::DOUBLE')} AS instruction_format_strictness, {_clamp(f'{_n(X.PROHIBITIONS)} / 3.0::DOUBLE')} AS instruction_prohibition_count, {_clamp(f'{_n(X.STEPS)} / greatest(2.0::DOUBLE, {_ALNUM} / 12.0::DOUBLE)')} AS instruction_step_count, {_clamp(f'{_n(X.CONFLICTS)} / 3.0::DOUBLE')} AS instruction_conflict_cues FROM documents",
    ),
    "readability": (
        lambda s, d: t(s, d, "documents").select("doc_id", *[F.round(v, 5).alias(k) for k, v in X.readability(_text()).items()]),
        f"WITH r AS (SELECT doc_id, greatest(1, len({_WORDS.format('text')}))::DOUBLE AS w, greatest(1, len(regexp_extract_all(text, '[.!?]+')))::DOUBLE AS s, len(regexp_extract_all(lower(text), '[aeiou]')) AS y, len(list_filter({_WORDS.format('text')}, lambda x: length(x) > 6)) AS l FROM documents) SELECT doc_id, round(greatest(0.0::DOUBLE, 0.39::DOUBLE * w / s + 11.8::DOUBLE * y / w - 15.59::DOUBLE), 5) AS flesch_kincaid, round(greatest(0.0::DOUBLE, 0.4::DOUBLE * (w / s + 100.0::DOUBLE * l / w)), 5) AS fog FROM r",
    ),
    "stable_splits": (splits, "SELECT doc_id, u, CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, ('0x' || substr(sha256('42:' || doc_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS u FROM documents)"),
    "embedding_cosine": (embeddings, "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], c) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(c, c))), 5) AS cos FROM embeddings, (SELECT embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id = 0)"),
    "overlap_ratio": (
        lambda s, d: t(s, d, "conversations").where("turn = 0").select("conv_id", _text().alias("q")).join(t(s, d, "conversations").where("turn = 1").select("conv_id", _text().alias("c")), "conv_id").select("conv_id", F.round(X.overlap(F.col("q"), F.col("c")), 6).alias("overlap")),
        f"SELECT conv_id, round(coalesce(len(list_intersect(qs, cs)) / nullif(len(qs), 0)::DOUBLE, 0.0), 6) AS overlap FROM (SELECT q.conv_id, list_distinct({_WORDS.format('lower(q.text)')}) AS qs, list_distinct({_WORDS.format('lower(c.text)')}) AS cs FROM conversations q JOIN conversations c ON q.conv_id = c.conv_id AND q.turn = 0 AND c.turn = 1)",
    ),
}

"""Queries of the lexical features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexical as L
from ..operators.routing import FAMILIES
from .tables import t


def prompts(s, d):
    """Documents as prompts of a family, with a marker in some."""
    k = F.col("doc_id")
    task = F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), (k % 8 + 1).cast("int"))
    mark = F.when(k % 5 == 0, F.concat(F.lit("Some == text -> here: [1]. Question: "), F.col("text"))).when(k % 7 == 0, F.lit("one two three four five six seven eight nine must")).otherwise(F.col("text"))
    return t(s, d, "documents").select("doc_id", task.alias("task"), mark.alias("prompt"))


def _sent(x):
    return f"list_filter(list_transform(regexp_extract_all({x}, '{L.SENTENCE}'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


def _tok(x):
    return f"regexp_extract_all(lower({x}), '{L.TOKEN}')"


_first = lambda ms: "least(" + ", ".join(f"nullif(strpos(lower(x), '{m}'), 0)" for m in ms) + ")"
_strip = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_PROMPTS = f"""pr AS (SELECT doc_id, [{", ".join(f"'{f}'" for f in FAMILIES)}][doc_id % 8 + 1] AS task, CASE WHEN doc_id % 5 = 0 THEN 'Some == text -> here: [1]. Question: ' || text WHEN doc_id % 7 = 0 THEN 'one two three four five six seven eight nine must' ELSE text END AS prompt FROM documents),
 p0 AS (SELECT doc_id, task, coalesce(prompt, '') AS x FROM pr),
 p1 AS (SELECT *, CASE WHEN task = 'summarization' THEN {_first(L.SUMMARY_MARKERS)} ELSE {_first(L.QUERY_MARKERS)} END AS pos, {_sent("x")} AS ss, regexp_extract_all(x, '{L.TOKEN}') AS ws FROM p0),
 p2 AS (SELECT *, {_strip("substr(x, 1, pos - 1)")} AS b, {_strip("substr(x, pos)")} AS a, greatest(1, floor(len(ws) * 0.7::DOUBLE)::INT) AS cut FROM p1),
 p3 AS (SELECT doc_id, task, x, ss, CASE WHEN pos IS NOT NULL AND b <> '' AND a <> '' THEN b WHEN len(ss) >= 2 THEN array_to_string(ss[1:len(ss) - 1], ' ') WHEN len(ws) >= 8 THEN array_to_string(ws[1:cut], ' ') ELSE x END AS context,
   CASE WHEN pos IS NOT NULL AND b <> '' AND a <> '' THEN a WHEN len(ss) >= 2 THEN ss[len(ss)] WHEN len(ws) >= 8 THEN array_to_string(ws[cut + 1:], ' ') ELSE '' END AS query FROM p2)"""
_hits = lambda ws: "len(list_filter(tok, lambda w: list_contains([" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + "], w)))"
_count = lambda col, *parts: "(" + " + ".join(f"(length({col}) - length(replace({col}, '{p}', ''))) // {len(p)}" for p in parts) + ")"
_marks = lambda ms: f"(length(x) - length(translate(x, '{ms}', '')))"
_SQL = {
    "token_count": "len(tok)::DOUBLE", "type_token_ratio": "len(list_distinct(word)) / words", "avg_word_length": "CASE WHEN len(word) > 0 THEN list_sum(list_transform(word, lambda w: length(w))) / len(word) ELSE 0 END",
    "sentence_count": "sents", "avg_sentence_length": "len(tok) / sents", "negation_count": f"{_hits(L.NEGATIONS)}::DOUBLE", "sentiment_lexicon_score": f"({_hits(L.POSITIVE_WORDS)} - {_hits(L.NEGATIVE_WORDS)}) / words",
    "modal_verb_ratio": f"{_hits(L.MODALS)} / words", "format_keyword_density": f"{_hits(L.FORMAT_WORDS)} / words", "algorithm_keyword_density": f"{_hits(L.ALGORITHM_WORDS)} / words",
    "constraint_keyword_density": "(" + " + ".join(f"contains(lower(x), '{w}')::INT" for w in L.CONSTRAINT_WORDS) + ") / words", "relation_keyword_density": f"{_hits(L.RELATION_WORDS)} / words",
    "creativity_keyword_density": f"{_hits(L.CREATIVITY_WORDS)} / words", "topic_keyword_density": f"{_hits(L.TOPIC_WORDS)} / words", "discourse_marker_density": f"{_hits(L.DISCOURSE_WORDS)} / words",
    "digit_ratio": f"{_marks('0123456789')} / chars", "math_symbol_density": f"{_marks(L.MATH_MARKS)} / chars", "code_symbol_density": f"{_marks(L.CODE_MARKS)} / chars", "equation_marker_density": f"{_count('x', '=', '==')} / chars",
    "quantity_mention_density": "len(list_filter(tok, lambda w: regexp_matches(w, '[0-9]'))) / words", "slot_marker_density": f"{_count('x', ':', '->')} / chars", "list_marker_density": f"{_count('x', '- ', '* ')} / sents",
    "step_marker_density": f"{_count('lower(x)', 'step ', 'first', 'then')} / sents", "question_mark_density": f"{_count('x', '?')} / sents", "citation_marker_density": f"({_count('x', '[', ']')} + {_count('lower(x)', 'source')}) / sents",
    "summary_instruction_density": f"{_count('lower(x)', 'summarize', 'summary')} / sents", "context_token_count": "len(ct)::DOUBLE", "query_token_count": "len(qt)::DOUBLE", "source_token_count": "src", "compression_ratio_proxy": "len(qt) / greatest(1, src)",
    "context_query_overlap_ratio": "CASE WHEN len(qt) > 0 AND len(ct) > 0 THEN len(list_intersect(list_distinct(qt), list_distinct(ct))) / len(list_distinct(qt)) ELSE 0 END",
}
_FEATURES = f"""WITH {_PROMPTS}, q0 AS (SELECT *, {_tok("x")} AS tok, {_tok("context")} AS ct FROM p3), q1 AS (SELECT *, CASE WHEN query <> '' THEN {_tok("query")} ELSE tok END AS qt, list_filter(tok, lambda w: regexp_matches(w, '{L.WORD}')) AS word FROM q0),
 q2 AS (SELECT *, greatest(1, len(word))::DOUBLE AS words, greatest(1, length(x))::DOUBLE AS chars, greatest(1, len(ss))::DOUBLE AS sents, CASE WHEN task = 'summarization' AND len(ct) > 0 THEN len(ct) ELSE len(tok) END::DOUBLE AS src FROM q1)
SELECT doc_id, {", ".join(f"round({e}, 6) AS {k}" for k, e in _SQL.items())} FROM q2"""
_words = lambda x: f"list_filter({_tok(x)}, lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))"
_BM25 = f"""WITH {_PROMPTS}, r AS (SELECT doc_id, list_filter(list_transform({_sent("context")}, lambda s: {_words("s")}), lambda s: len(s) > 0) AS s, {_words("query")} AS q FROM p3),
 size AS (SELECT doc_id, len(s) AS n, len(flatten(s)) / len(s) AS av FROM r), e AS (SELECT doc_id, unnest(s) AS w, generate_subscripts(s, 1) AS i FROM r), ex AS (SELECT doc_id, i, len(w) AS l, unnest(w) AS t FROM e),
 tf AS (SELECT doc_id, i, t, count(*) AS tf, max(l) AS l FROM ex GROUP BY 1, 2, 3), idf AS (SELECT doc_id, t, ln((any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf, any_value(av) AS av FROM tf JOIN size USING (doc_id) GROUP BY 1, 2),
 mean AS (SELECT doc_id, avg(idf) AS m FROM idf GROUP BY 1), ask AS (SELECT doc_id, t, count(*) AS qtf FROM (SELECT doc_id, unnest(q) AS t FROM r) GROUP BY 1, 2),
 wt AS (SELECT doc_id, t, av, qtf * CASE WHEN idf < 0 THEN 0.25::DOUBLE * m ELSE idf END AS w FROM idf JOIN ask USING (doc_id, t) JOIN mean USING (doc_id)),
 sc AS (SELECT doc_id, i, sum(w * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / av))) AS s FROM tf JOIN wt USING (doc_id, t) GROUP BY 1, 2), best AS (SELECT doc_id, max(s) AS mx, sum(s) AS sm, count(*) AS hit FROM sc GROUP BY 1)
SELECT doc_id, round(coalesce(CASE WHEN hit < n THEN greatest(0, mx) ELSE mx END, 0), 6) AS bm25_max, round(coalesce(sm / n, 0), 6) AS bm25_mean FROM size LEFT JOIN best USING (doc_id)"""


def features(s, d):
    out = L.lexical_features(prompts(s, d), "prompt", "task")
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in _SQL])


def scores(s, d):
    out = L.bm25(L.split_query(prompts(s, d), "prompt", "task"), "doc_id", "context", "query")
    return out.select("doc_id", F.round("bm25_max", 6).alias("bm25_max"), F.round("bm25_mean", 6).alias("bm25_mean"))


QUERIES = {
    "context_query_split": (lambda s, d: L.split_query(prompts(s, d), "prompt", "task").select("doc_id", F.md5("context").alias("context"), F.md5("query").alias("query")), f"WITH {_PROMPTS} SELECT doc_id, md5(context) AS context, md5(query) AS query FROM p3"),
    "lexical_features": (features, _FEATURES),
    "bm25_scores": (scores, _BM25),
}

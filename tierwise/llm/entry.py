"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_trie import bpe_digests
from .chat_format import EVENT_ORDER, conversation_events, format_conversations, read_back
from .decontaminate import decontaminate
from .lm_scoring import lm_scores
from .ngram_join import ngram_jaccard_join
from .phrases import phrases
from .quality_classifier import quality_classifier
from .quality_rules import quality_rules
from .spelling import spelling_variants
from .substring_dedup import substring_dedup
from .token_count import token_counts
from .toxicity import toxicity
from .url_filter import LIMIT, STRICT, VOCABULARY, filter_urls

#: Rules of the url query: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), n=4, threshold=85)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=1024)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(format_conversations(conversation_events(rows), EVENT_ORDER))


def op4_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), window=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", F.size("near_items").cast("long").alias("n_near"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), modulus=10, fold=0)


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"), least=10, top=2000, inside=50)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), letters=7, least=2, times=10, every=31)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_ngram_jaccard_join, op2_token_counts, op3_chat_formatting, op4_bpe_encode_decode, op5_substring_dedup]
    ops += [op6_quality_classifier, op7_quality_rules, op8_toxicity, op9_url_filters, op10_decontamination]
    ops += [op11_lm_scoring, op12_phrase_mining, op13_spelling_variants]
    return {f.__name__: f for f in ops}


_ESCAPED = r"regexp_replace({}, '([\\#<])', '\\\1', 'g')"
_ROLE = r"regexp_replace({}, '([\\#<:])', '\\\1', 'g')"

OP3_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(15 + length({_ROLE.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

_BOUND = "regexp_matches(low, '(^|[^a-z0-9])({})($|[^a-z0-9])')"

OP9_SQL = f"""
WITH low AS (SELECT page_id, url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
                    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM low),
fit AS (SELECT *, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
  {_BOUND.format("|".join(STRICT))} AS strict, {" + ".join(f"{w} * CAST({_BOUND.format(t)} AS INT)" for t, w in VOCABULARY.items() if w < LIMIT)} AS soft FROM parts)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
            ELSE CASE WHEN strict OR soft >= {LIMIT} THEN 'block' ELSE 'allow' END END AS verdict
FROM fit
"""

_SPACES = r"'[\x20\x09-\x0D]+'"

OP5_SQL = f"""
WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), {_SPACES}), lambda w: w <> '') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM docs WHERE len(w) >= 50),
hashed AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM windows),
firsts AS (SELECT h, min(doc_id) AS low FROM hashed GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS cut FROM hashed JOIN firsts USING (h) WHERE low < doc_id GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(w) AS n, coalesce(len(cut), 0) AS r, CASE WHEN cut IS NULL THEN w ELSE
           list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: NOT list_contains(cut, p[2])), lambda p: p[1]) END AS k
         FROM docs d LEFT JOIN gone g ON d.doc_id = g.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

_ALNUM = r"'[^a-z0-9\x{80}-\x{10FFFF}]+'"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10_SQL = f"""
WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOW}, {_ALNUM}), lambda w: w <> '') AS w FROM documents),
items AS (SELECT item_id, list_filter(regexp_split_to_array({_LOW}, {_ALNUM}), lambda w: w <> '') AS w FROM benchmark),
item_windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS s
                 FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM item_windows),
places AS (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size),
hits AS (SELECT doc_id, i, p.size AS size, item_id FROM (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS s FROM places) p JOIN item_windows v ON p.s = v.s AND p.size = v.size),
summed AS (SELECT doc_id, len(list_distinct(flatten(list(range(i, i + size))))) AS n_hit, list_distinct(list(item_id)) AS ids FROM hits GROUP BY doc_id),
said AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM docs),
counts AS (SELECT t, count(*) AS n FROM said GROUP BY t),
terms AS (SELECT DISTINCT item_id, unnest(w) AS t FROM items),
ranked AS (SELECT item_id, terms.t AS t, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(n, 0), terms.t) AS r FROM terms LEFT JOIN counts ON counts.t = terms.t),
chosen AS (SELECT item_id, t FROM ranked WHERE r <= 4 QUALIFY count(*) OVER (PARTITION BY item_id) = 4 AND min(n) OVER (PARTITION BY item_id) > 0),
occurs AS (SELECT doc_id, item_id, said.t AS t, p FROM said JOIN chosen ON chosen.t = said.t),
spans AS (SELECT a.doc_id, a.item_id FROM occurs a JOIN occurs b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.p >= a.p AND b.p < a.p + 30 GROUP BY a.doc_id, a.item_id, a.p HAVING count(DISTINCT b.t) = 4),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM spans GROUP BY doc_id)
SELECT CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(list_sort(list_transform(ids, lambda x: CAST(x AS VARCHAR))), ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs d LEFT JOIN summed s ON d.doc_id = s.doc_id LEFT JOIN near ON near.doc_id = d.doc_id
"""

OP12_SQL = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split WHERE len(w) > 0),
one AS (SELECT lang, w[i] AS p, count(*) AS f FROM places GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY lang),
two AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM places WHERE i < len(w) GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM places WHERE i + 1 < len(w) GROUP BY ALL HAVING count(*) >= 10),
holders AS (SELECT lang, x, y, max(f) AS longer FROM (SELECT lang, x, y, f FROM three UNION ALL SELECT lang, y, z, f FROM three) GROUP BY ALL),
pairs AS (SELECT t.lang, t.x || ' ' || t.y AS phrase, t.f AS a, p.f AS l, q.f AS r FROM two t JOIN one p ON p.lang = t.lang AND p.p = t.x JOIN one q ON q.lang = t.lang AND q.p = t.y
          LEFT JOIN holders h ON h.lang = t.lang AND h.x = t.x AND h.y = t.y WHERE h.longer IS NULL OR 100 * h.longer < 50 * t.f),
cuts AS (SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z AS phrase, t.f AS a, p.f AS l1, yz.f AS r1, xy.f AS l2, q.f AS r2,
           CAST(1000000 AS HUGEINT) * t.f * t.f // (CAST(p.f AS HUGEINT) * yz.f) AS s1, CAST(1000000 AS HUGEINT) * t.f * t.f // (CAST(xy.f AS HUGEINT) * q.f) AS s2
         FROM three t JOIN one p ON p.lang = t.lang AND p.p = t.x JOIN one q ON q.lang = t.lang AND q.p = t.z
         JOIN two xy ON xy.lang = t.lang AND xy.x = t.x AND xy.y = t.y JOIN two yz ON yz.lang = t.lang AND yz.x = t.y AND yz.y = t.z),
found AS (SELECT lang, phrase, a, l, r, CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS score FROM pairs
          UNION ALL SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, least(s1, s2) FROM cuts)
SELECT f.lang AS lang, row_number() OVER (PARTITION BY f.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM found f JOIN total t ON t.lang = f.lang
QUALIFY row_number() OVER (PARTITION BY f.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; the others are held against brute force in tests/llm."""
    return {"op3_chat_formatting": OP3_SQL, "op5_substring_dedup": OP5_SQL, "op9_url_filters": OP9_SQL, "op10_decontamination": OP10_SQL, "op12_phrase_mining": OP12_SQL}

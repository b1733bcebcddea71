"""Queries of scalar and row operators, annotated proxies, family features and stored scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nullsafe as N
from ..functions import served as V
from ..functions import text as X
from ..operators import curves as C
from ..operators import fit as T
from ..operators import governance as GV
from ..operators import relational as R
from ..operators import search as S
from ..operators import splits as P
from ..operators.routing import FAMILIES
from ..plans.archive import write_archive
from ..sources.files import scratch
from .analytics import _SCORED, pooled_sql, rounded, scored
from .analytics import QUERIES as CURVES
from .governed import _SCORES
from .tables import t
from .texts import _WORDS


def k():
    return F.col("event_id")


def cells(s, d):
    e = t(s, d, "events").select("event_id", "event_type", F.when(k() % 4 == 0, float("nan")).when(k() % 4 == 1, None).otherwise(F.col("value")).alias("v"), F.when(k() % 5 == 0, "x").when(k() % 5 == 1, "7.9").otherwise(k().cast("string")).alias("text"))
    e = R.assign(R.assign(e, "three", [10, 20, 30], "event_id"), "same", "c")
    e = e.withColumns({"absent": R.get(e, "nothing", "none"), "there": R.get(e, "event_type"), "as_int": R.as_type(F.col("text"), "Int64"), "as_float": R.as_type(F.col("text"), "float"), "as_bool": R.as_type(F.col("v"), "bool"), "as_is": R.as_type(F.col("text"), "category")})
    return R.fill_missing(e, "v", -1.0).drop("event_type", "text")


def doubled(s, d):
    return R.row_apply(t(s, d, "nation").select("n_nationkey", "n_name"), lambda r: {"n_nationkey": r["n_nationkey"] * 2, "initial": r["n_name"][:1]}, "n_nationkey long, initial string")


def places(s, d):
    o = t(s, d, "orders")
    return R.row_at(o, "o_orderkey", 3).unionByName(R.row_at(o, "o_orderkey", -2)).select("o_orderkey", "o_custkey")


def quantile_bins(s, d):
    e = scored(s, d)
    both = R.difficulty_bins(e, "d", ["model"], 5, "quantile", "q").join(R.difficulty_bins(e, "d", ["model"], 4, "uniform", "u").select("event_id", "u"), "event_id")
    return both.groupBy("model", "q", "u").count()


def annotated(s, d):
    x, i = t(s, d, "documents"), F.col("doc_id")
    facts = F.when(i % 4 == 0, F.sequence(F.lit(1), (i % 3 + 1).cast("int")))
    arcs = F.when(i % 5 == 0, F.array(F.struct((i % 9).cast("int").alias("head"), F.lit(2).alias("dep")), F.struct(F.lit(1).alias("head"), F.lit(5).alias("dep"))))
    steps = X.reasoning_steps(F.col("text"), (facts,), (F.when(i % 4 == 1, F.lit(-2.0)),), 0.5)
    knows = X.parametric_dependence(F.col("text"), F.when(i % 3 == 0, 0.9), F.when(i % 3 == 0, 0.4), F.when(i % 3 == 1, 0.7))
    distance = X.dependency_distance(F.col("text"), arcs)
    of = X.feature_text(F.when(i % 2 == 0, "retrieval_grounded").otherwise("maths"), F.col("text"), F.when(i % 4 != 0, F.col("source")))
    # Named before they are used more than once.
    x = x.select("doc_id", steps.alias("steps"), knows.alias("knows"), distance.alias("distance"), X.token_count(F.col("text")).alias("n"), X.text_entropy(F.col("text")).alias("h"), F.md5(of).alias("feature_text"))
    more = X.interactions(F.col("steps"), F.lit(2), F.col("n"), F.col("h"), F.col("knows"))
    return x.select("doc_id", *[F.round(c, 6).alias(c) for c in ("steps", "knows", "distance")], *[F.round(c, 4).alias(n) for n, c in more.items()], "feature_text")


_CUED = lambda cs: " + ".join(f"CAST(contains(lower(text), '{c}') AS INT)" for c in cs)


def family(s, d):
    x = t(s, d, "documents")
    task = F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), (F.col("doc_id") % 8 + 1).cast("int"))
    return x.select("doc_id", *[F.round(c, 6).alias(n) for n, c in X.simple_features(task, F.col("text")).items()])


_TASK = "[" + ", ".join(f"'{f}'" for f in FAMILIES) + "][doc_id % 8 + 1]"
_FAMILY = f"""WITH w AS (SELECT doc_id, text, {_TASK} AS task, {_WORDS.format("text")} AS w FROM documents)
SELECT doc_id, len(w)::DOUBLE AS token_count, length(text)::DOUBLE AS char_count, round(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / greatest(1, len(w)), 6) AS avg_token_length, (length(text) - length(translate(text, '.,!?;:', '')))::DOUBLE AS punctuation_count, contains(text, '?')::INT::DOUBLE AS question_mark,
 round(length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) / greatest(1, length(text)), 6) AS uppercase_ratio, {", ".join(f"CASE WHEN task = '{f}' THEN round(({_CUED(cues)}) / {len(cues)}.0::DOUBLE, 6) END AS {n}" for f, (n, cues) in X.FAMILY_CUES.items())}, CASE WHEN task = 'summarization' THEN round(least(1, len(w) / 100.0::DOUBLE), 6) END AS length_indicator FROM w"""

_WEIGHTS, _MEAN, _SCALE = {"d": 0.03, "risk": -1.5, "flat": 2.0, "p": 0.4}, {"d": 20.0, "risk": 0.1, "flat": 3.0, "p": 0.0}, {"d": 10.0, "risk": 0.5, "flat": 0.0, "p": 1e-13}


def stored_scores(s, d):
    e = scored(s, d).withColumn("flat", F.lit(4.0))
    return e.select("event_id", *[F.round(T.linear_score(_WEIGHTS, 0.2, _MEAN, _SCALE, z), 6).alias(z) for z in T.ZERO_SCALE])


def _score(z):
    parts = [f"{w!r}::DOUBLE * ({n} - {_MEAN[n]!r}::DOUBLE) / {T.ZERO_SCALE[z](_SCALE[n])!r}::DOUBLE" for n, w in _WEIGHTS.items() if T.ZERO_SCALE[z](_SCALE[n]) is not None]
    return f"round(1 / (1 + exp(-greatest(-35, least(35, 0.2::DOUBLE + {' + '.join(parts)})))), 6) AS {z}"


def selected(s, d):
    e = scored(s, d).withColumns({"flat": F.lit(1.0), "y": F.col("ok").cast("int"), "id": k() % 10})
    return rounded(T.select_by_correlation(e, ["model"], ["d", "risk", "flat", "id"], "y", 0.05), "r", n=4)


_SELECTED = f"""WITH {_SCORED}, c AS (SELECT model, round(corr(d, ok::INT), 9) AS d, round(corr(risk, ok::INT), 9) AS risk, 0.0::DOUBLE AS flat, round(corr(event_id % 10, ok::INT), 9) AS id FROM e GROUP BY 1),
 u AS (SELECT model, unnest(['d', 'risk', 'flat', 'id']) AS feature, unnest([d, risk, flat, id]) AS r, unnest([0, 1, 2, 3]) AS i FROM c), n AS (SELECT *, count(*) FILTER (abs(r) >= 0.05) OVER (PARTITION BY model) >= 2 AS enough, row_number() OVER (PARTITION BY model ORDER BY abs(r) DESC, i) AS rn FROM u)
SELECT model, feature, round(r, 4) AS r, CASE WHEN enough THEN abs(r) >= 0.05 ELSE rn <= 2 END AS active FROM n"""

def learned(s, d):
    """Weights by user group: the features of all events, each group a few thousand rows."""
    e = scored(s, d).join(t(s, d, "events").select("event_id", "user_id"), "event_id")
    e = e.withColumns({"y": ((F.col("d") > 60) & F.col("ok")).cast("double"), "id": (k() % 10).cast("double"), "g": F.col("user_id") % 16})
    return T.learn_weights(e, ["g"], ["d", "risk", "id"], "y", ["event_id"]).select("g", F.transform("weights", lambda w: F.round(w, 6)).alias("weights"), "entropy_reg")


def annotations(s, d):
    x = t(s, d, "documents").withColumn("task", F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), (F.col("doc_id") % 8 + 1).cast("int")))
    out = X.annotate(x, "task", "text", "source")
    return out.select("doc_id", "difficulty_dim", *[F.round(c, 4).alias(c) for c in out.columns if c.startswith("difficulty_") and c != "difficulty_dim"])


def of_use_cases(s, d):
    x = t(s, d, "documents").select("doc_id", X.use_case_struct(F.col("text")).alias("f"))
    return x.select("doc_id", *[F.round(F.col("f")[n], 6).alias(n) for n in X.USE_CASE])


def decided(s, d):
    from ..operators import governance as G

    i = F.col("doc_id")
    x = t(s, d, "documents").select(
        "doc_id", F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), (i % 8 + 1).cast("int")).alias("task"), F.col("text").alias("prompt"), F.lit("json").alias("expected_format"),
        F.element_at(F.array(*[F.lit(v) for v in ("public", "internal", "confidential", "restricted")]), (i % 4 + 1).cast("int")).alias("data_classification"),
        (i % 3 == 0).alias("business_critical"), (i % 5 == 0).alias("requires_human_approval"), (i % 7 == 0).alias("contains_pii"), (i % 11 == 0).alias("contains_phi"),
        F.when(i % 6 != 0, (i % 6) * 900).alias("target_p99_ms"), (i % 2 == 0).alias("real_time"), (i % 700).cast("double").alias("qps"), F.lit(None).cast("long").alias("daily_requests"), (i % 9 == 0).alias("bursty"),
        F.lit(None).cast("map<string,int>").alias("overrides"), F.lit(0.5).alias("tau_cap"), (i % 10 / 10).alias("tau_risk"), F.lit(3.2).alias("tau1"), F.lit(4.0).alias("tau2"),
    )
    return G.decide(x).select("doc_id", "gate", F.round("s3_score", 6).alias("s3"), "tier", "tau_route")


def graded(balanced):
    """Failure models of each model's events, learned from four fifths of them and graded on the others."""

    def run(s, d):
        e = scored(s, d).withColumn("failed", ~F.col("ok") | (F.col("p") > 0.7))
        part = F.pmod("event_id", F.lit(5))
        got = T.train_grid(e.where(part < 4), e.where(part == 4), ["model"], ["p", "risk"], "failed", balanced=balanced)
        return got.select("model", "c", F.transform("weights", lambda w: F.round(w, 6)).alias("weights"), F.round("bias", 6).alias("bias"), F.round("f1", 6).alias("f1"), "tau")

    return run


def validation_modes(s, d):
    """Thresholds of each model in the modes of validation."""
    runs = [S.run_validation(scored(s, d), ["model"], "d", "ok", "risk", "ok", m).select(F.lit(m).alias("mode"), "model", "tau") for m in ("fixed", "adaptive")]
    return runs[0].unionByName(runs[1])


def deployed(s, d):
    """Route that a tier deploys, a gated feature and a squashed one, of each event."""
    k = F.col("event_id")
    final = F.element_at(F.array(*[F.lit(x) for x in GV.TIERS]), (k % 4 + 1).cast("int"))
    route = GV.deploy(final, F.when(k % 3 == 0, "SLM").otherwise("HYBRID_ABSTAIN"))
    only = X.gated(F.col("event_type"), ("view", "click"), {"gated": F.col("value")})
    return t(s, d, "events").select("event_id", route.alias("route"), F.round(N.sigmoid(F.col("value") - 50), 9).alias("squashed"), only["gated"].alias("gated"), N.differ(F.when(k % 3 == 0, k), F.when(k % 2 == 0, k)).alias("differ"))


def extremes(s, d):
    """Least and greatest number of each event type, and whether all that is there is a number."""
    k = F.col("event_id")
    e = t(s, d, "events").withColumn("v", F.when(k % 4 == 0, float("nan")).when(k % 4 != 1, F.col("value"))).withColumn("w", F.when((k % 97 == 0) & (F.col("event_type") == "view"), "x").otherwise(F.col("value").cast("string")))
    return e.groupBy("event_type").agg(N.min_valid(F.col("v")).alias("least"), N.max_valid(F.col("v")).alias("most"), N.is_numeric(F.col("w")).alias("numeric"))


def bin_proxies(s, d):
    k = F.col("event_id")
    return scored(s, d).select("event_id", F.round(R.bin_proxy(F.when(k % 5 != 0, k % 10)), 9).alias("proxy"), R.bin_of_difficulty(F.when(k % 7 != 0, F.col("p"))).alias("bin"))


def _calls(s, d):
    """Calls of three models on the ids of each task: every row of lineitem is a call, of which few fail."""
    x = t(s, d, "lineitem")
    return x.select(F.concat(F.lit("n"), F.col("l_linenumber")).alias("task"), F.col("l_returnflag").alias("model"), F.col("l_suppkey").cast("string").alias("canonical_id"), F.col("l_linestatus").alias("file"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), (F.col("l_quantity") >= 50).alias("failed"))


def clean_splits(s, d):
    return P.build_clean_splits(_calls(s, d), {"F": 0, "O": 1}, cap=None)[0]


def clean_counts(s, d):
    return P.build_clean_splits(_calls(s, d), {"F": 0, "O": 1}, cap=None)[1]


def _visits(passes, models):
    """SQL of the visits of a repair: each model's, in each pass."""
    at, out = 0, []
    for _ in range(passes):
        for m in range(1, models + 1):
            ends = ", ".join(f"{f}(sample) FILTER ({'split' if i else 'NOT split'} AND {'' if y else 'NOT '}failed) AS {f[1]}{int(y)}" for f, i in (("max", True), ("min", False)) for y in (True, False))
            out.append(f"""s{at + 1} AS MATERIALIZED (SELECT s.task, s.sample, CASE WHEN s.sample = enter THEN 'train' WHEN s.sample = leave THEN 'val' ELSE split END AS split FROM s{at} s LEFT JOIN (
 SELECT task, CASE WHEN a1 IS NULL AND a0 IS NOT NULL THEN i1 WHEN a1 IS NOT NULL AND a0 IS NULL THEN i0 END AS enter, coalesce(a1, a0) AS leave FROM (
  SELECT task, {ends} FROM (SELECT r.task, r.sample, failed, split = 'train' AS split FROM r JOIN s{at} USING (task, sample) WHERE model_order = {m}) GROUP BY 1)) m ON m.task = s.task AND enter IS NOT NULL)""")
            at += 1
    return ", ".join(out), f"s{at}"


_VISITS, _REPAIRED = _visits(3, 3)
_SPLITS = f"""c AS (SELECT 'n' || l_linenumber AS task, l_returnflag AS model, l_suppkey::VARCHAR AS sample, l_quantity >= 50 AS failed FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_linenumber, l_returnflag, l_suppkey ORDER BY CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, l_orderkey * 8 + l_linenumber) = 1),
 ids AS (SELECT task, sample FROM c JOIN (SELECT task, count(DISTINCT model) AS models FROM c GROUP BY 1) USING (task) WHERE models >= 2 GROUP BY 1, 2, models HAVING count(*) = models),
 s0 AS MATERIALIZED (SELECT task, sample, CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, ('0x' || substr(sha256('42:' || task || ':' || sample), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS u FROM ids)),
 r AS MATERIALIZED (SELECT c.*, dense_rank() OVER (PARTITION BY task ORDER BY model) AS model_order FROM c JOIN ids USING (task, sample)), {_VISITS}"""


def served(s, d):
    return t(s, d, "documents").select("doc_id", V.served_features(F.col("text"), F.col("source")).alias("f")).select("doc_id", *[F.round(F.col("f")[n], 6).alias(n) for n in _SERVED])


def asked(s, d):
    """Features of each user turn, with the assistant's answer as its context."""
    c = t(s, d, "conversations")
    user, answer = c.where("role = 'user'"), c.where("role = 'assistant'").groupBy("conv_id", (F.col("turn") - 1).alias("turn")).agg(F.min("text").alias("context"))
    task = F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), (F.pmod("conv_id", F.lit(8)) + 1).cast("int"))
    f = user.join(answer, ["conv_id", "turn"], "left").select("conv_id", "turn", V.query_features(task, F.col("text"), F.col("context")).alias("f"))
    return f.select("conv_id", "turn", *[F.round(F.col("f")[n], 6).alias(n) for n in _ASKED])


_SENTENCES = r"len(list_filter(string_split({}, '.'), lambda p: regexp_matches(p, '\S')))"
_LEAST = lambda c: f"greatest(1, {c})::DOUBLE"
_IN = lambda low, words: "(" + " + ".join(f"contains({low}, '{w}')::INT" for w in words) + ")::DOUBLE"
_KEPT = lambda pattern: f"len(list_filter(w, lambda p: regexp_matches(p, '{pattern}')))"


def _common_sql(stop_words):
    n, s = _LEAST("len(w)"), _LEAST("s")
    return {
        "token_count": "len(w)", "sentence_count": "s", "avg_sentence_length": f"len(w) / {s}", "avg_word_length": f"coalesce(list_sum(list_transform(w, lambda p: length(p))), 0) / {n}",
        "type_token_ratio": f"len(list_distinct(w)) / {n}", "stopword_ratio": f"len(list_filter(w, lambda p: lower(p) IN ({', '.join(repr(x) for x in stop_words)}))) / {n}", "entity_density": _KEPT(r"^\p{Lu}.") + f" / {n}",
        "flesch_kincaid_grade": f"CASE WHEN len(w) = 0 OR s = 0 THEN 0 ELSE greatest(0.0::DOUBLE, 0.39::DOUBLE * (len(w) / {s}) + 11.8::DOUBLE * (len(regexp_extract_all(x, '[aeiou]')) / {n}) - 15.59::DOUBLE) END",
        "gunning_fog": f"CASE WHEN len(w) = 0 OR s = 0 THEN 0 ELSE 0.4::DOUBLE * (len(w) / {s} + 100 * (len(list_filter(w, lambda p: length(p) > 6)) / {n})) END",
    }


_HITS = lambda words: "(" + " + ".join(f"len(regexp_extract_all(low, '{w}'))" for w in words) + ")"
_SERVED = _common_sql(V.MORE_STOP_WORDS) | {
    "negation_count": _IN("low", V.NEGATIONS), "sentiment_lexicon_score": f"coalesce({_HITS(V.NICE)} / nullif({_HITS(V.NICE)} + {_HITS(V.NASTY)}, 0)::DOUBLE, 0.5)",
    "code_symbol_density": _KEPT("[{}()]") + f" / {_LEAST('len(w)')}", "digit_ratio": _KEPT(r"\p{Nd}") + f" / {_LEAST('len(w)')}", "math_symbol_density": _KEPT(r"[=+\-*/]") + f" / {_LEAST('len(w)')}",
    "entity_count": _KEPT(r"^\p{Lu}."), "entity_type_count": r"len(list_distinct(list_filter(w, lambda p: regexp_matches(p, '^\p{Lu}.'))))", "question_mark_density": f"len(regexp_extract_all(x, '\\?')) / {_LEAST('s')}",
    "context_token_count": "len(w)", "query_token_count": "len(w)", "source_token_count": "len(w)", "context_query_overlap_ratio": "0.7", "compression_ratio_proxy": "0.5",
} | {n: f"{_IN('low', words)} / {_LEAST('len(w)' if of == 'words' else 's')}" for n, (of, words) in V.MARKERS.items()}
_OF = lambda family, value: f"CASE WHEN task = '{family}' THEN {value} END"
_NEAR = lambda value: f"CASE WHEN c IS NOT NULL THEN {value} END"
_HELD = f"least(len(list_filter(lw, lambda p: contains(lower(c), p))) / {_LEAST('len(w)')}, 1.0::DOUBLE)"
_ASKED = _common_sql(V.STOP_WORDS) | {
    "digit_ratio": _OF("maths", _SERVED["digit_ratio"]), "math_symbol_density": _OF("maths", _SERVED["math_symbol_density"]), "code_symbol_density": _OF("code_generation", _KEPT(r"[{}()\[\];]") + f" / {_LEAST('len(w)')}"),
    "algorithm_keyword_density": _OF("code_generation", f"{_IN('low', V.FAMILY_ALGORITHMS)} / {_LEAST('len(w)')}"), "imperative_root_ratio": _OF("instruction_following", f"{_IN('low', V.FAMILY_IMPERATIVES)} / {_LEAST('s')}"),
    "constraint_keyword_density": _OF("instruction_following", f"{_IN('low', V.FAMILY_CONSTRAINTS)} / {_LEAST('len(w)')}"), "context_token_count": _NEAR("len(cw)"),
    "context_query_overlap_ratio": _NEAR("coalesce(len(list_intersect(list_distinct(lw), list_distinct(lcw))) / nullif(len(list_distinct(lcw)), 0)::DOUBLE, 0)"), "bm25_query_context_max": _NEAR(_HELD), "bm25_query_context_mean": _NEAR(f"{_HELD} * 0.7::DOUBLE"),
}
_ROUND = lambda of: ", ".join(f"round(({sql})::DOUBLE, 6) AS {n}" for n, sql in of.items())
_SERVED_SQL = f"WITH x AS (SELECT doc_id, coalesce(text, '') || ' ' || coalesce(source, '') AS x FROM documents), p AS (SELECT *, lower(x) AS low, {_WORDS.format('x')} AS w, {_SENTENCES.format('x')} AS s FROM x) SELECT doc_id, {_ROUND(_SERVED)} FROM p"
_ASKED_SQL = f"""WITH a AS (SELECT conv_id, turn - 1 AS turn, min(text) AS c FROM conversations WHERE role = 'assistant' GROUP BY 1, 2), x AS (SELECT u.conv_id, u.turn, coalesce(text, '') AS x, nullif(c, '') AS c, [{', '.join(repr(f) for f in FAMILIES)}][u.conv_id % 8 + 1] AS task FROM conversations u LEFT JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn WHERE role = 'user'),
 p AS (SELECT *, lower(x) AS low, {_WORDS.format('x')} AS w, {_WORDS.format('lower(x)')} AS lw, {_WORDS.format('c')} AS cw, {_WORDS.format('lower(c)')} AS lcw, {_SENTENCES.format('x')} AS s FROM x) SELECT conv_id, turn, {_ROUND(_ASKED)} FROM p"""


def ablations(s, d):
    """Models of bad quality of the labelled documents for each ablation of their features, learned from four fifths of them and graded on the others."""
    x = t(s, d, "documents").join(t(s, d, "labels").select("doc_id", (F.col("quality") == 0).alias("failed")), "doc_id")
    names = ["token_count", "type_token_ratio", "stopword_ratio", "digit_ratio", "entity_density", "flesch_kincaid_grade", "imperative_root_ratio", "question_mark_density"]
    f = x.select("doc_id", "failed", V.served_features(F.col("text")).alias("f")).select("doc_id", "failed", *[F.col("f")[n].alias(n) for n in names])
    part = F.pmod("doc_id", F.lit(5))
    got = P.ablation_models(f.where(part < 4), f.where(part == 4), [], names, "failed")
    return got.select("ablation", F.transform("weights", lambda w: F.round(w, 4)).alias("weights"), F.round("f1", 6).alias("f1"))


def archive(s, d):
    """Rows of the archive of all documents, written and counted by task."""
    x = t(s, d, "documents").select("doc_id", "text", "source", F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), (F.pmod("doc_id", F.lit(8)) + 1).cast("int")).alias("task"))
    root = scratch(s)
    write_archive(x, "task", "text", "source", root)
    rows = s.read.schema("task string, difficulty_dim string, difficulty_bin int, difficulty_score double").json(root)
    return rows.groupBy("task", "difficulty_dim", F.col("difficulty_bin").alias("bin")).agg(F.count("*").alias("n"), F.round(F.min("difficulty_score"), 6).alias("least"), F.round(F.max("difficulty_score"), 6).alias("most"))


QUERIES = {
    "served_features": (served, _SERVED_SQL),
    "query_features": (asked, _ASKED_SQL),
    "ablations": (ablations, None),
    "archived_rows": (archive, None),
    "clean_splits": (clean_splits, f"WITH {_SPLITS} SELECT * FROM {_REPAIRED}"),
    "clean_split_counts": (clean_counts, f"WITH {_SPLITS} SELECT task, model, split, count(*) FILTER (NOT failed) AS fail_0, count(*) FILTER (failed) AS fail_1 FROM r JOIN {_REPAIRED} USING (task, sample) GROUP BY 1, 2, 3"),
    "bin_proxies": (bin_proxies, f"WITH {_SCORED} SELECT event_id, round(coalesce(CASE WHEN event_id % 5 <> 0 THEN event_id % 10 END, 5) / 9.0::DOUBLE, 9) AS proxy, CAST(trunc(CASE WHEN event_id % 7 <> 0 THEN p END * 4) AS INT) AS bin FROM e"),
    "deployed_routes": (deployed, "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'SLM' WHEN 1 THEN CASE WHEN event_id % 3 = 0 THEN 'SLM' ELSE 'HYBRID_ABSTAIN' END ELSE 'LLM' END AS route, round(1 / (1 + exp(-greatest(-35.0::DOUBLE, least(35.0::DOUBLE, value - 50)))), 9) AS squashed, CASE WHEN event_type IN ('view', 'click') THEN value ELSE 0.0::DOUBLE END AS gated, CASE WHEN event_id % 3 = 0 THEN event_id END IS DISTINCT FROM CASE WHEN event_id % 2 = 0 THEN event_id END AS differ FROM events"),
    "valid_extremes": (extremes, "SELECT event_type, min(value) FILTER (event_id % 4 > 1) AS least, max(value) FILTER (event_id % 4 > 1) AS most, NOT bool_or(event_id % 97 = 0 AND event_type = 'view') AS numeric FROM events GROUP BY 1"),
    "logistic_grid": (graded(False), None),
    "balanced_grid": (graded(True), None),
    "validation_modes": (validation_modes, f"SELECT 'fixed' AS mode, model, tau FROM ({CURVES['tau_fixed'][1]}) UNION ALL SELECT 'adaptive', model, tau FROM ({CURVES['tau_adaptive'][1]})"),
    "cell_operators": (cells, "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN -1.0::DOUBLE ELSE value END AS v, CASE WHEN event_id < 3 THEN [10, 20, 30][event_id + 1] END AS three, 'c' AS same, 'none' AS absent, event_type AS there, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 7 ELSE event_id END AS as_int, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 7.9::DOUBLE ELSE event_id::DOUBLE END AS as_float, CASE WHEN event_id % 4 = 0 THEN true WHEN event_id % 4 = 1 THEN false ELSE value <> 0 END AS as_bool, CASE WHEN event_id % 5 = 0 THEN 'x' WHEN event_id % 5 = 1 THEN '7.9' ELSE event_id::VARCHAR END AS as_is FROM events"),
    "row_apply": (doubled, "SELECT n_nationkey::BIGINT * 2 AS n_nationkey, n_name[1] AS initial FROM nation"),
    "row_at": (places, "(SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 3) UNION ALL (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 1 OFFSET 1)"),
    "difficulty_bins": (quantile_bins, f"WITH {_SCORED}, q AS (SELECT model, quantile_cont(d, [0.2::DOUBLE, 0.4::DOUBLE, 0.6::DOUBLE, 0.8::DOUBLE]) AS c, min(d) AS lo, max(d) AS hi FROM e GROUP BY 1) SELECT model, CAST(len(list_filter(c, lambda x: x < d)) AS INT) AS q, CAST(least(floor((d - lo) / ((hi - lo) / 4.0::DOUBLE)), 3) AS INT) AS u, count(*) AS count FROM e JOIN q USING (model) GROUP BY 1, 2, 3"),
    "annotated_proxies": (annotated, None),
    "difficulty_annotation": (annotations, None),
    "use_case_features": (of_use_cases, None),
    "task_decisions": (decided, f"""WITH {_SCORES}, g AS (SELECT *, CASE WHEN "SK" = 5 OR ("TC" = 5 AND "SK" >= 4) THEN 'disqualified' WHEN "SK" >= 4 THEN 'hybrid' ELSE 'none' END AS gate, (3 * "TC" + 2 * "OS" + 4 * "SK" + 2 * "DS" + 3 * "LT" + "VL") / 75.0::DOUBLE * 5 AS s3 FROM sc)
        SELECT doc_id, gate, round(s3, 6) AS s3, CASE WHEN gate = 'disqualified' THEN gate WHEN s3 <= 3.2::DOUBLE THEN CASE WHEN gate = 'hybrid' THEN 'hybrid' ELSE 'pure_slm' END WHEN s3 <= 4.0 THEN 'hybrid' ELSE 'llm_only' END AS tier, CASE WHEN gate = 'disqualified' THEN -1.0::DOUBLE ELSE least((doc_id % 10) / 10.0::DOUBLE, 0.5::DOUBLE) END AS tau_route FROM g"""),
    "simple_features": (family, _FAMILY),
    "stored_scores": (stored_scores, f"WITH {_SCORED}, f AS (SELECT *, 4.0::DOUBLE AS flat FROM e) SELECT event_id, {', '.join(map(_score, T.ZERO_SCALE))} FROM f"),
    "correlated_features": (selected, _SELECTED),
    "smoothed_curve": (lambda s, d: rounded(S.smoothed_curve(scored(s, d), ["model"], "p", "ok", "risk"), "cap", "risk", "mean_risk", "center"), f"WITH {_SCORED}, w AS (SELECT model, greatest(0, len(list_filter([{', '.join(f'{x!r}::DOUBLE' for x in C.edges())}], lambda x: x <= p)) - 1) AS bin, avg(ok::INT) AS cap, avg(risk) AS risk FROM e GROUP BY 1, 2), b AS (SELECT f.model, f.bin, coalesce(cap, 0.5) AS cap, coalesce(risk, 0.5) AS risk FROM (SELECT DISTINCT model, unnest(range(10)) AS bin FROM e) f LEFT JOIN w ON w.model = f.model AND w.bin = f.bin), {pooled_sql('b', 'model', 'bin', 'cap', 'cap', 'up')}, {pooled_sql('b', 'model', 'bin', 'risk', 'risk', 'down', '-')} SELECT model, bin::DOUBLE AS bin, round(cap, 6) AS cap, round(risk, 6) AS risk, round(mean_risk, 6) AS mean_risk, round((bin + 0.5) / 10, 6) AS center FROM up JOIN down USING (model, bin) JOIN (SELECT model, avg(risk) AS mean_risk FROM e GROUP BY 1) USING (model)"),
    "learned_weights": (learned, None),
}

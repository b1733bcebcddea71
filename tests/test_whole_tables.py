"""Queries cover whole tables: every row of the input, whatever its language or id, against brute force."""

import math
import re

import numpy as np
import pytest

from tierwise.functions import text as X
from tierwise.operators.routing import FAMILIES
from tierwise.queries import governed, queries

SF = "/root/testdata/sf0.001"
TRICKY = [
    ("fr", "Trésor d'ÉCOLE, or éor ORÉ or: l'été 1999, après 2001é. Ça ne va pas, NO nó not; où étudier? JSON, Étape STEPé step then"),
    ("de", "Größe über 3.5 Äpfel = müßig; ÖNOR noR nor never ÄNEVER do not tun, FIRST zürst First. Straße 1850ß und 1850"),
    ("es", "Año 2024: niño o NIÑO, but ñbut butñ however; según él, when WHEN who because porque, exactly 10 ≤ 20 ∑ must password"),
    ("fr", ""),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The documents of SF and some with letters beyond ASCII at word ends."""
    d = str(tmp_path_factory.mktemp("docs"))
    own = spark.createDataFrame([(10**6 + i, x, lang) for i, (lang, x) in enumerate(TRICKY)], "doc_id long, text string, lang string")
    spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").unionByName(own).write.parquet(f"{d}/documents.parquet")
    return d, {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}


def hits(pattern, text):
    return len(re.findall(pattern, text, re.IGNORECASE))


def cues(text, words):
    return sum(c in text.lower() for c in words)


def clamp(x):
    return max(0.0, min(1.0, x))


def classification(x):
    n = max(1, len(re.findall("[A-Za-z0-9_]+", x)))
    return (
        clamp((hits(X.CONTRAST, x) + hits(X.HEDGES, x) + max(0, hits(r"\bor\b", x) - 1)) / 8),
        clamp(hits(X.NEGATION, x) / max(1.0, n / 6)),
        clamp((hits(r"\b(19|20)\d{2}\b", x) + 0.7 * hits(r"\b[A-Z]{2,}\b", x) + 0.15 * hits(r"\b[A-Z][a-z]{2,}\b", x)) / 10),
    )


def maths(x):
    n = max(1, len(re.findall("[A-Za-z0-9_]+", x)))
    return clamp(hits(r"\b\d+(\.\d+)?\b", x) / max(1.0, n / 3)), clamp(hits(r"[\=\+\-\*/\^%<>]|≤|≥|≠|√|∑|∫", x) / max(1.0, n / 4)), clamp(cues(x, X.PRECISION_CUES) / 4)


def instruction(x):
    n = max(1, len(re.findall("[A-Za-z0-9_]+", x)))
    return clamp(cues(x, X.FORMAT_CUES) / 4), clamp(hits(X.PROHIBITIONS, x) / 3), clamp(hits(X.STEPS, x) / max(2.0, n / 12)), clamp(hits(X.CONFLICTS, x) / 3)


def readability(x):
    words = x.split()
    w, s = max(1, len(words)), max(1, len(re.findall("[.!?]+", x)))
    return max(0.0, 0.39 * w / s + 11.8 * len(re.findall("[aeiou]", x.lower())) / w - 15.59), max(0.0, 0.4 * (w / s + 100 * sum(len(v) > 6 for v in words) / w))


def proxies(x):
    w = x.split()
    names = sum(bool(re.match("[A-Z][a-z]", b)) and a[-1] not in ".!?" for a, b in zip(w, w[1:]))
    years = len(re.findall(r"\b(19|20)\d{2}\b", x))
    at = [max(i, len(w) - i - 1) for i, v in enumerate(w) if v.lower().strip(",;:.") in X.BREAKS]
    distance = 0.0 if len(w) < 2 else sum(at) / len(at) if at else max(1.0, len(w) / 8)
    return 0.6 * cues(x, X.REASONING_CUES) + 0.25 * len(re.findall(X.CLAUSES, x.lower())), min(1.0, (cues(x, X.KNOWLEDGE_CUES) + min(2.0, names / 3) + min(1.5, years / 2)) / 6), distance


BRUTE = {"classification_features": classification, "math_features": maths, "instruction_features": instruction, "readability": readability, "difficulty_proxies": proxies}


@pytest.mark.parametrize("name", BRUTE)
def test_text_features_of_all_languages(spark, tables, name):
    d, texts = tables
    got = {r[0]: tuple(r)[1:] for r in queries()[name](spark, d).collect()}
    assert set(got) == set(texts)
    for i, x in texts.items():
        assert got[i] == pytest.approx(BRUTE[name](x), abs=2e-5), (i, x[:200])


def test_governance_of_all_languages(spark, tables):
    d, texts = tables
    got = {r["doc_id"]: r for r in queries()["governance_scores"](spark, d).collect()}
    assert set(got) == set(texts) == {r["doc_id"] for r in queries()["governance_decisions"](spark, d).collect()}
    five = lambda x: max(1, min(5, round(x)))
    for i, x in texts.items():
        task = FAMILIES[i % 8]
        prior = 0.4 if task in ("maths", "code_generation", "retrieval_grounded") else -0.2 if task in ("classification", "summarization") else 0.0
        tc = 1 + min(2.0, len(re.findall(r"\w+", x)) / 120) + min(1.0, cues(x, governed.CONSTRAINTS) / 4)
        tc += min(1.0, hits(r"\b(algorithm|proof|optimi[sz]e|derive|complexity|multi-step)\b", x) / 3) + min(1.0, hits(r"[\=\+\-\*/\^%<>]", x) / 20)
        y = f"{x} json"
        os = 1 + min(2.2, cues(y, governed.FORMATS) / 2) + min(1.0, hits(r"[\{\}\[\],:|]", y) / 40) + min(1.0, hits(r"\b(first|second|third|step|ordered|sorted)\b", y) / 3)
        sk = 1 + min(2.0, cues(x, governed.STAKES) / 2) + 0.4 * (task in ("maths", "code_generation")) + 1.2 * (i % 3 == 0) + 0.6 * (i % 5 == 0)
        ds = (1.0, 2.0, 3.2, 4.2)[i % 4] + min(1.0, cues(x, governed.SENSITIVE) / 2) + 0.8 * (i % 7 == 0) + 1.0 * (i % 11 == 0)
        assert (got[i]["TC"], got[i]["OS"], got[i]["SK"], got[i]["DS"]) == (five(tc + prior), five(os), five(sk), five(ds)), i


def test_ewm_of_all_users(spark):
    sf = "/root/testdata/sf0.01"  # the smallest with more than 20 users
    want, state = {}, {}
    for user, _, event, v in sorted(tuple(r) for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "event_id", "value").collect()):
        want[event] = state[user] = v if user not in state else 0.3 * v + 0.7 * state[user]
    assert len(state) > 20
    assert dict(tuple(r) for r in queries()["ewm_mean"](spark, sf).collect()) == pytest.approx(want, abs=1e-6)


def test_holm_of_all_events(spark):
    families = {}
    for event, kind in (tuple(r) for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id", "event_type").collect()):
        families.setdefault(kind, []).append((event * 37 % 1000 / 20000, event))
    want = {}
    for family in families.values():
        high = 0.0
        for rank, (p, event) in enumerate(sorted(family)):
            want[event] = high = max(high, min(1.0, p * (len(family) - rank)))
    assert len(want) > 400
    assert dict(tuple(r) for r in queries()["holm_correction"](spark, SF).collect()) == pytest.approx(want, abs=1e-9)


def test_kernel_smoothing_at_each_score(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "event_type", "value").collect()
    groups = {}
    for event, kind, value in rows:
        groups.setdefault(kind, []).append((math.floor(value * 10) / 10, (event * 7 + math.floor(value)) % 10 < 6))
    got = {(r["model"], float(r["d"])): (r["n"], float(r["value"])) for r in queries()["kernel_smoothing"](spark, SF).collect()}
    assert set(got) == {(k, x) for k, g in groups.items() for x, _ in g}
    for kind, g in groups.items():
        xs, ys = np.array([x for x, _ in g]), np.array([y for _, y in g], float)
        h = 1.06 * (xs.std() or 1.0) * len(xs) ** -0.2
        for x in set(xs):
            w = np.exp(-0.5 * ((x - xs) / h) ** 2)
            n, value = got[kind, x]
            assert n == (xs == x).sum() and value == pytest.approx((w * ys).sum() / w.sum(), abs=2e-6)

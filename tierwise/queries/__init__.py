"""Registered queries by family, each with the SQL that checks it."""

from __future__ import annotations

from . import analytics, extras, governed, ingested, lexical, profiled, served, smoothed, tables, texts

_MODULES = (tables, texts, analytics, governed, smoothed, served, profiled, lexical, ingested, extras)


def queries():
    return {k: q for m in _MODULES for k, (q, _) in m.QUERIES.items()}


def oracle_sql():
    return {k: sql for m in _MODULES for k, (_, sql) in m.QUERIES.items() if sql}

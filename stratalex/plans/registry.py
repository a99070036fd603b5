"""Every registered query and the SQL that must return the same rows."""

from __future__ import annotations

from . import composition_queries, function_queries, lookup_queries, phrase_queries, reading_queries, relation_queries, table_queries, text_queries, word_queries

_FAMILIES = (text_queries, table_queries, phrase_queries, reading_queries, relation_queries, composition_queries, lookup_queries, word_queries, function_queries)


def queries() -> dict:
    return {k: f for m in _FAMILIES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _FAMILIES for k, s in m.ORACLES.items()}

"""All registered queries of the library and their SQL."""

from __future__ import annotations

from trustlake.plans import further_queries, model_queries, result_queries, source_queries, text_queries


def queries() -> dict:
    return text_queries.Q | model_queries.Q | result_queries.Q | source_queries.Q | further_queries.Q


def oracle_sql() -> dict:
    return text_queries.O | model_queries.O | result_queries.O | source_queries.O | further_queries.O

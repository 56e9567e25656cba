"""The registered queries: operators applied to whole tables, and the same in SQL."""

from __future__ import annotations


def queries() -> dict:
    from . import code_queries, graph_queries, report_queries, text_queries, turn_queries

    return {**turn_queries.QUERIES, **graph_queries.QUERIES, **text_queries.QUERIES, **report_queries.QUERIES, **code_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    from . import code_queries, graph_queries, report_queries, text_queries, turn_queries

    return {**turn_queries.SQL, **graph_queries.SQL, **text_queries.SQL, **report_queries.SQL, **code_queries.SQL}

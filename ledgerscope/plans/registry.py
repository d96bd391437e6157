"""All registered queries: name -> callable(spark, sf_dir) and name -> DuckDB SQL."""

from __future__ import annotations


def _modules():
    from ledgerscope.plans import rules_queries, feature_queries, eval_queries, generic_queries
    return [rules_queries, feature_queries, eval_queries, generic_queries]


def queries() -> dict:
    out = {}
    for m in _modules():
        out.update(m.Q)
    return out


def oracle_sql() -> dict:
    out = {}
    for m in _modules():
        out.update(m.SQL)
    return out

"""A small collector for query modules: name -> function, and name -> DuckDB SQL where there is one."""

from __future__ import annotations


def collector():
    queries: dict = {}
    oracles: dict = {}

    def query(name: str, sql: str | None = None):
        def add(fn):
            if name in queries:
                raise ValueError(f"query name used twice: {name}")
            queries[name] = fn
            if sql is not None:
                oracles[name] = sql
            return fn
        return add

    return queries, oracles, query

"""All registered queries and their checks, gathered from the query modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ["text_queries", "analytics_queries", "resolve_queries", "mapping_queries", "derive_queries", "rule_queries", "layout_queries", "stream_queries", "lookup_queries",
           "scored_queries"]


def _gather(attr: str) -> dict:
    out: dict = {}
    for m in MODULES:
        part = getattr(import_module(f"{__package__}.{m}"), attr)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"query names used twice: {clash}")
        out.update(part)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracles() -> dict:
    return _gather("ORACLES")

"""Loads every query module so that their ``@register`` calls run."""

from __future__ import annotations

from papyrus.plans import registry


def _load() -> None:
    from papyrus.plans import graph_queries, report_queries, text_queries  # noqa: F401


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return dict(registry.ORACLES)

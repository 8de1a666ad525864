"""All registered queries, grouped by the kind of operator they exercise."""

from __future__ import annotations

import importlib

from almanack.catalog.registry import ORACLES, QUERIES

MODULES = [
    "filters", "aggregates", "ordering", "joins", "resolve", "dates", "text", "enrich", "sources",
]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"almanack.catalog.{m}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)

"""Registered queries over the given tables, one module per operator family."""

from __future__ import annotations

import importlib

FAMILIES: list[str] = [
    "text",
    "geometry",
    "sources",
    "pools",
    "ledger",
    "reconcile",
    "citations",
    "decisions",
    "captures",
    "compare",
    "requests",
]


def all_queries():
    from foliary.plans import registry

    for family in FAMILIES:
        importlib.import_module(f"foliary.plans.{family}")
    return registry.QUERIES, registry.ORACLES

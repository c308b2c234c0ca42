"""Registered queries: each binds an operator to the driver tables."""

from __future__ import annotations

from importlib import import_module

from tidemark.plans.registry import REGISTRY, Query

MODULES = ("intervals", "scoring", "curves", "compare", "readings", "speech", "vectors", "choose", "rules", "explain", "storage", "streams")


def load_all() -> dict[str, Query]:
    for name in MODULES:
        import_module(f"tidemark.plans.{name}")
    return REGISTRY

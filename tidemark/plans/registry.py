"""The query registry behind ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    survey: tuple[str, ...]
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, survey: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register *fn* under *name*; *survey* lists the inventory rows it covers."""

    def register(fn: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, tuple(survey.split()), fn, sql)
        return fn

    return register

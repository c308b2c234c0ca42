"""Event rules: dictionaries (or YAML/JSON text) to typed records and a DataFrame."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tidemark.model import RULE

UNBOUNDED = 999


@dataclass(frozen=True)
class Spatial:
    source: str
    region: str
    min_count: int = 1
    max_count: int = UNBOUNDED


@dataclass(frozen=True)
class Condition:
    signal: str
    min: float | None = None
    max: float | None = None
    any_of: tuple[str, ...] = ()
    sustained: int = 0
    within: int = 0


@dataclass(frozen=True)
class Event:
    event: str
    label: str
    enabled: bool = True
    rules: tuple[Spatial, ...] = field(default=())
    signals: tuple[Condition, ...] = field(default=())
    window_secs: float = 0.75
    persist_secs: float = 0.5
    min_duration: float = 0.0
    max_duration: float = 0.0
    ignore_start: float = 0.0
    ignore_end: float = 0.0


def parse(source: str | Mapping | Iterable[Mapping]) -> list[Event]:
    """Rules from text (YAML or JSON), a mapping with ``events``, or a list of events."""
    if isinstance(source, str):
        try:
            doc = json.loads(source)
        except ValueError:
            import yaml

            doc = yaml.safe_load(source)
    else:
        doc = source
    events = doc.get("events", []) if isinstance(doc, Mapping) else list(doc)
    out = []
    for e in events or []:
        rules = tuple(
            Spatial(
                str(r["source"]),
                str(r["region"]),
                int(r.get("min_count", 1)),
                int(r.get("max_count", UNBOUNDED)),
            )
            for r in e.get("rules") or []
        )
        signals = tuple(
            Condition(
                str(s["signal"]),
                None if s.get("min") is None else float(s["min"]),
                None if s.get("max") is None else float(s["max"]),
                tuple(sorted(str(x).strip().lower() for x in s.get("any_of") or [])),
                int(s.get("sustained_secs") or 0),
                int(s.get("within_secs") or 0),
            )
            for s in e.get("signals") or []
        )
        if not rules and not signals:
            continue
        out.append(
            Event(
                event=str(e["name"]),
                label=str(e.get("label") or e["name"]),
                enabled=bool(e.get("enabled", True)),
                rules=rules,
                signals=signals,
                **{
                    k: float(e[src])
                    for k, src in (
                        ("window_secs", "window_secs"),
                        ("persist_secs", "persist_secs"),
                        ("min_duration", "min_duration_secs"),
                        ("max_duration", "max_duration_secs"),
                        ("ignore_start", "ignore_start_secs"),
                        ("ignore_end", "ignore_end_secs"),
                    )
                    if e.get(src) is not None
                },
            )
        )
    return out


def signal_names(events: Iterable[Event]) -> list[str]:
    """Signals the enabled rules read, for ``signal IN (...)`` pushdown."""
    return sorted({c.signal for e in events if e.enabled for c in e.signals})


def class_names(events: Iterable[Event]) -> list[str]:
    """Classes the enabled spatial rules read."""
    return sorted({n for e in events if e.enabled for r in e.rules for n in (r.source, r.region)})


def table(spark: SparkSession, events: Iterable[Event]) -> DataFrame:
    """The rules as a DataFrame with the explicit rule schema."""
    rows = [
        (
            e.event,
            e.label,
            e.enabled,
            [(r.source, r.region, r.min_count, r.max_count) for r in e.rules],
            [(c.signal, c.min, c.max, list(c.any_of), c.sustained, c.within) for c in e.signals],
            e.window_secs,
            e.persist_secs,
            e.min_duration,
            e.max_duration,
            e.ignore_start,
            e.ignore_end,
        )
        for e in events
    ]
    return spark.createDataFrame(rows, RULE)

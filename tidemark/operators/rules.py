"""Event rules over boxes and signals.

What depends on the order of frames (boxes that persist after they were last
seen, sources claimed by one rule and gone for the next) is a small per-frame
step streamed over stretches of frames; everything after it (signal conditions,
majority vote, guards, runs, per-second output) is DataFrame work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.axis import drop_halo, run_ids, with_halo
from tidemark.operators.curves import widened_runs
from tidemark.operators.tracking import overlap
from tidemark.sources.rules_table import Condition, Event

RUN_GAP = 1.5
REFRESH_IOU = 0.3
VOTE_SHARE = 0.5


# --- the per-frame step -----------------------------------------------------


class Lingering:
    """Boxes of one event that still count: array rows of class number, time last seen, x, y, w, h, confidence.

    Only classes that a rule names are held. Whether rules match is decided on masks over
    these rows.
    """

    SEEN, BOX, CONF = 1, slice(2, 6), 6

    def __init__(self, spec: Event, held: list | None = None):
        self.spec = spec
        names = dict.fromkeys(n for r in spec.rules for n in (r.region, r.source))
        self.number = {name: k for k, name in enumerate(names)}
        self.held = np.array(held or [], float).reshape(-1, 7)

    def frame(self, ts: float, seen: dict[str, list]) -> tuple[bool, float | None, list | None]:
        """Take one frame's boxes; whether the rules match, least confidence, union box."""
        self.held = self.held[ts - self.held[:, self.SEEN] <= self.spec.persist_secs]
        for name, number in self.number.items():
            for box, conf in seen.get(name, ()):
                self._take(np.array([number, ts, *box, conf], float))
        used = self._used()
        if used is None or not used.any():
            return used is not None, None, None
        boxes = self.held[used, self.BOX]
        low, high = boxes[:, :2].min(axis=0), (boxes[:, :2] + boxes[:, 2:]).max(axis=0)
        return True, float(self.held[used, self.CONF].min()), [*map(float, low), *map(float, high - low)]

    def _take(self, row: np.ndarray) -> None:
        """A box renews the first held one of its class that it overlaps, or is held anew."""
        same = np.flatnonzero(self.held[:, 0] == row[0])
        met = [k for k in same if overlap(self.held[k, self.BOX], row[self.BOX]) > REFRESH_IOU]
        if met:
            self.held[met[0]] = row
        else:
            self.held = np.vstack([self.held, row])

    def _used(self) -> np.ndarray | None:
        """Rows that the rules claim or name as regions; None where a rule does not hold.

        A row claimed as a source by one rule is gone for the sources of the next.
        """
        x, y, w, h = self.held[:, self.BOX].T
        cx, cy = x + w / 2, y + h / 2
        claimed, used = np.zeros(len(x), bool), np.zeros(len(x), bool)
        for rule in self.spec.rules:
            region = self.held[:, 0] == self.number[rule.region]
            if not region.any():
                if rule.min_count > 0:
                    return None
                continue
            across = (cx[:, None] >= x[region]) & (cx[:, None] <= (x + w)[region])
            along = (cy[:, None] >= y[region]) & (cy[:, None] <= (y + h)[region])
            source = (self.held[:, 0] == self.number[rule.source]) & ~claimed & (across & along).any(axis=1)
            if not rule.min_count <= source.sum() <= rule.max_count:
                return None
            claimed |= source
            used |= source | region
        return used


def spatial_matches(boxes: DataFrame, keys: Sequence[str], specs: Sequence[Event]) -> DataFrame:
    """Per frame and event: whether its spatial rules match, with confidence and union box.

    Frames further apart than the longest persistence share nothing, so the frames
    are cut into stretches there and stretches spread over tasks; within one, frames
    stream through in time order and only the lingering boxes are held. A frame
    without boxes is a row with a NULL label. A missing confidence counts as 1.
    """
    active = [s for s in specs if s.enabled and s.rules]
    reach = max((s.persist_secs for s in active), default=0.0)
    frames = boxes.select(*keys, "ts").distinct()
    cut = run_ids(
        frames, keys, ["ts"], F.struct(F.col("ts").alias("t")), lambda p: F.col("ts") - p["t"] > reach, "_part", "ts"
    )
    x = boxes.join(cut, [*keys, "ts"]).select(
        *keys, "_part", "ts", "idx", "label", "x", "y", "w", "h", F.coalesce("conf", F.lit(1.0)).alias("conf")
    )
    nk = len(keys)
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.select(*keys).schema)
    schema = (
        f"{head}, ts DOUBLE, event STRING, fired BOOLEAN, conf DOUBLE, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE"
    )
    names = [*keys, "ts", "event", "fired", "conf", "x", "y", "w", "h"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at, held = None, None, []
        lingering: list[Lingering] = []

        def flush() -> list:
            if at is None:
                return []
            seen: dict[str, list] = {}
            for r in held:
                if isinstance(r[nk + 3], str):
                    seen.setdefault(r[nk + 3], []).append((list(r[nk + 4 : nk + 8]), r[nk + 8]))
            rows = []
            for g in lingering:
                fired, conf, box = g.frame(at, seen)
                rows.append((*part[:nk], at, g.spec.event, fired, conf, *(box or [None] * 4)))
            held.clear()
            return rows

        for pdf in batches:
            out: list = []
            for row in pdf.itertuples(index=False):
                key, ts = tuple(row[: nk + 1]), row[nk + 1]
                if key != part or ts != at:
                    out += flush()
                    if key != part:
                        part, lingering = key, [Lingering(s) for s in active]
                    at = ts
                held.append(tuple(row))
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(flush(), columns=names)

    return (
        x.repartition(*keys, "_part")
        .sortWithinPartitions(*keys, "_part", "ts", "idx")
        .mapInPandas(run, schema)
    )


# --- signals ------------------------------------------------------------------


def condition(c: Condition, value: Column, text: Column) -> Column:
    """One rule condition as a column; a missing value never satisfies it."""
    if c.any_of:
        met = F.lower(F.trim(text)).isin(*c.any_of)
    else:
        met = value.isNotNull()
        if c.min is not None:
            met = met & (value >= c.min)
        if c.max is not None:
            met = met & (value <= c.max)
    return F.coalesce(met, F.lit(False))


def signal_masks(
    signals: DataFrame, videos: DataFrame, keys: Sequence[str], specs: Sequence[Event], *, total: str = "duration"
) -> DataFrame:
    """Seconds in which every signal condition of an event holds.

    *signals* is long (``signal, sec, value, text``); only the signals the rules
    read are touched.
    """
    listed = [(e.event, c) for e in specs if e.enabled for c in e.signals]
    if not listed:
        return videos.limit(0).select(*keys, F.lit(0).alias("sec"), F.lit("").alias("event"))
    tested = F.array(
        *[
            F.when(
                (F.col("signal") == c.signal) & condition(c, F.col("value"), F.col("text")), F.lit(i)
            )
            for i, (_, c) in enumerate(listed)
        ]
    )
    on = (
        signals.filter(F.col("signal").isin(*sorted({c.signal for _, c in listed})))
        .select(*keys, "sec", F.explode(F.array_compact(tested)).alias("_c"))
        .distinct()
    )

    def of(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_c") + 1)

    met = widened_runs(
        on,
        [*keys, "_c"],
        tick="sec",
        sustained=of([max(1, c.sustained) for _, c in listed]),
        within=of([max(0, c.within) for _, c in listed]),
    )
    need = {e.event: len(e.signals) for e in specs if e.enabled and e.signals}
    wanted = F.create_map(*[F.lit(x) for kv in need.items() for x in kv])[F.col("event")]
    return (
        met.groupBy(*keys, "sec", of([e for e, _ in listed]).alias("event"))
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") == wanted)
        .join(videos.select(*keys, total), list(keys))
        .filter(F.col("sec") < F.col(total))
        .drop("_n", total)
    )


# --- vote, guards, runs -------------------------------------------------------


def _window_groups(windows: set[int], most: int = 1_000_000) -> list[set[int]]:
    """Window lengths in groups whose least common multiple stays small."""
    groups: list[set[int]] = []
    for w in sorted(windows):
        home = next((g for g in groups if math.lcm(w, *g) <= most * min(w, *g)), None)
        if home is None:
            groups.append({w})
        else:
            home.add(w)
    return groups


def majority_vote(
    fired: DataFrame, keys: Sequence[str], windows_ms: dict[str, int], *, chunk: float = 3600.0
) -> DataFrame:
    """Frames whose trailing window fired at least half of the time, with the newest
    fired match of that window.

    Windows differ by event: times are scaled by whole numbers so that every
    event's window has the same length, and one frame specification serves all.
    Lengths without a small common multiple are scaled in separate groups, so a
    scaled time always fits its type.
    """
    parts = []
    for group in _window_groups(set(windows_ms.values())):
        own = {e: w for e, w in windows_ms.items() if w in group}
        parts.append(_vote(fired.filter(F.col("event").isin(*own)), keys, own, chunk))
    return reduce(DataFrame.unionByName, parts)


def _vote(fired: DataFrame, keys: Sequence[str], windows_ms: dict[str, int], chunk: float) -> DataFrame:
    one = math.lcm(*windows_ms.values())
    factor = F.create_map(*[F.lit(x) for n, w in windows_ms.items() for x in (n, one // w)])[F.col("event")]
    halo = with_halo(fired, "ts", max(windows_ms.values()) / 1000.0, 0.0, chunk).withColumn(
        "_ms", F.rint(F.col("ts") * 1000).cast("long") * factor
    )
    w = Window.partitionBy(*keys, "event", "_chunk").orderBy("_ms").rangeBetween(-one, 0)
    share = F.avg(F.col("fired").cast("double")).over(w)
    match = F.struct("conf", "x", "y", "w", "h")
    last = F.max_by(match, F.when(F.col("fired"), F.col("_ms"))).over(w)
    voted = drop_halo(halo.withColumn("_share", share).withColumn("_last", last))
    return voted.filter(F.col("_share") >= VOTE_SHARE).select(*keys, "ts", "event", "_last.*")


def guarded(
    raw: DataFrame, videos: DataFrame, keys: Sequence[str], specs: Sequence[Event], *, total: str = "duration"
) -> DataFrame:
    """Drop what falls in the ignored ends, then runs outside the allowed length."""
    table = {e.event: (e.ignore_start, e.ignore_end, e.min_duration, e.max_duration) for e in specs if e.enabled}

    def per_event(i: int) -> Column:
        return F.create_map(*[F.lit(x) for n, v in table.items() for x in (n, float(v[i]))])[F.col("event")]

    x = raw.join(videos.select(*keys, F.col(total).cast("double").alias("_span")), list(keys))
    inside = (F.col("ts") >= per_event(0)) & (
        (per_event(1) <= 0) | (F.col("ts") <= F.col("_span") - per_event(1))
    )
    x = x.filter(inside).drop("_span")
    k = [*keys, "event"]
    ran = run_ids(
        x, k, ["ts"], F.struct(F.col("ts").alias("t")), lambda p: F.col("ts") - p["t"] > RUN_GAP, "_run", "ts"
    )
    run = Window.partitionBy(*k, "_run")
    sized = ran.withColumn("_len", F.max("ts").over(run) - F.min("ts").over(run) + 1.0)
    ok = (F.col("_len") >= per_event(2)) & ((per_event(3) <= 0) | (F.col("_len") <= per_event(3)))
    return sized.filter(ok).drop("_run", "_len")


def apply_rules(
    boxes: DataFrame,
    signals: DataFrame,
    videos: DataFrame,
    keys: Sequence[str],
    specs: Sequence[Event],
    *,
    total: str = "duration",
) -> DataFrame:
    """Every marked time of every event: ``ts, event, conf, x, y, w, h``.

    A spatial event carries the union of its matched boxes and their least
    confidence; a signal-only event covers the frame and has no confidence.
    """
    masks = signal_masks(signals, videos, keys, specs, total=total)
    spatial = [e for e in specs if e.enabled and e.rules]
    only = [e.event for e in specs if e.enabled and not e.rules]
    raw: DataFrame | None = None
    if spatial:
        fired = spatial_matches(boxes, keys, specs)
        gated = [e.event for e in spatial if e.signals]
        if gated:
            at = masks.withColumn("_ok", F.lit(True))
            fired = (
                fired.withColumn("sec", F.floor("ts").cast("int"))
                .join(at, [*keys, "sec", "event"], "left")
                .withColumn(
                    "fired", F.col("fired") & (F.col("_ok").isNotNull() | ~F.col("event").isin(*gated))
                )
                .drop("_ok", "sec")
            )
        raw = majority_vote(fired, keys, {e.event: max(1, round(e.window_secs * 1000)) for e in spatial})
    if only:
        whole = masks.filter(F.col("event").isin(*only)).select(
            *keys,
            F.col("sec").cast("double").alias("ts"),
            "event",
            F.lit(None).cast("double").alias("conf"),
            F.lit(0.0).alias("x"),
            F.lit(0.0).alias("y"),
            F.lit(1.0).alias("w"),
            F.lit(1.0).alias("h"),
        )
        raw = whole if raw is None else raw.unionByName(whole)
    if raw is None:
        raise ValueError("no enabled rule")
    return guarded(raw, videos, keys, specs, total=total)


def event_seconds(marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events per whole second."""
    return marked.select(*keys, F.floor("ts").cast("int").alias("sec"), "event").distinct()


def compose(labels: DataFrame, events: DataFrame, keys: Sequence[str], every_event: Sequence[str]) -> DataFrame:
    """Detected and composed labels of each second, sorted and unique.

    The names of all events, disabled ones too, are stripped first, so a second
    pass over its own output changes nothing.
    """
    clean = labels.filter(~F.col("label").isin(*every_event)).select(*keys, "sec", "label")
    both = clean.unionByName(events.select(*keys, "sec", F.col("event").alias("label"))).distinct()
    return both.groupBy(*keys, "sec").agg(F.array_sort(F.collect_set("label")).alias("labels"))


# --- checks over rules --------------------------------------------------------


def invalid_rules(rules: DataFrame, classes: DataFrame) -> DataFrame:
    """Reasons to refuse a rule: unseen class, bad or repeated name, max < min, empty."""
    r = rules.select("event", "rules", "signals")
    spatial = r.select("event", F.explode("rules").alias("r"))
    named = spatial.select("event", F.explode(F.array("r.source", "r.region")).alias("label")).distinct()
    unseen = named.join(classes.select("label"), "label", "left_anti").select(
        "event", F.concat(F.lit("class never observed: "), "label").alias("reason")
    )
    swapped = spatial.filter("r.max_count < r.min_count").select(
        "event", F.lit("max_count below min_count").alias("reason")
    )
    bounds = (
        r.select("event", F.explode("signals").alias("s"))
        .filter("s.max < s.min")
        .select("event", F.lit("max below min").alias("reason"))
    )
    shape = r.filter(~F.col("event").rlike(r"^[a-z][a-z0-9_]*$")).select(
        "event", F.lit("ill-formed name").alias("reason")
    )
    twice = (
        r.groupBy("event").agg(F.count("*").alias("n")).filter("n > 1").select("event", F.lit("duplicate name").alias("reason"))
    )
    empty = r.filter((F.size("rules") == 0) & (F.size("signals") == 0)).select(
        "event", F.lit("no conditions").alias("reason")
    )
    out = unseen
    for part in (swapped, bounds, shape, twice, empty):
        out = out.unionByName(part)
    return out.distinct()


def settle_checks(checks: DataFrame, rule_names: Sequence[str], fired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outcome of each outstanding check: not_in_rules, fired or never_fired.

    *fired* has the event's seconds; *rule_names* the loaded rules.
    """
    seen = fired.groupBy(*keys, F.col("event").alias("rule")).agg(
        F.count("*").alias("seconds"), F.min("sec").alias("first"), F.max("sec").alias("last")
    )
    x = checks.join(seen, [*keys, "rule"], "left")
    loaded = F.col("rule").isin(*rule_names)
    return x.select(
        *checks.columns,
        F.when(~loaded, "not_in_rules").when(F.col("seconds") > 0, "fired").otherwise("never_fired").alias("state"),
        F.when(loaded, F.col("seconds")).alias("seconds"),
        F.when(loaded, F.col("first")).alias("first"),
        F.when(loaded, F.col("last")).alias("last"),
    )

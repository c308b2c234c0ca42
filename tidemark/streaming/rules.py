"""The rule engine over endless input: frames and signals wait in state until their time has come.

Boxes, signals and closing markers are one stream keyed by video. Nothing is judged when it
arrives: a row waits in map state under its time until the watermark says that all rows it
depends on have come, so neither the cutting into micro-batches nor the order within the
bound of lateness changes a result. Timers on the watermark release what is due when a video
has no rows of its own in a batch, and close a video that has been silent.

A second depends on the signals within the rules' reach (``within`` and ``sustained`` of
their conditions), so frames are released that much later. Marks wait further where a guard
needs the future: the ignored end, until something later has been seen; runs with a least
length, until they have it; runs with a greatest length, until they are over.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.rules import RUN_GAP, VOTE_SHARE, Lingering
from tidemark.operators.tracking import Tracker
from tidemark.sources.rules_table import Condition, Event

#: One stream for all inputs of the engine; what a kind of row lacks is NULL.
INPUT = (
    "kind STRING, ts DOUBLE, idx INT, label STRING, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, conf DOUBLE, "
    "signal STRING, value DOUBLE, text STRING, duration DOUBLE, rows LONG"
)
COLUMNS = ["ts", "event", "conf", "x", "y", "w", "h"]
EVER = float("inf")
#: Event times lie this much after row times: what is at or before the first watermark, 0, counts as late.
SHIFT_MS = 1000


def _aligned(df: DataFrame, kind: str, **given: Column) -> DataFrame:
    columns = {"kind": F.lit(kind)} | given
    typed = [field.strip().split(" ") for field in INPUT.split(",")]
    return df.select("video_id", *(columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in typed))


def box_rows(boxes: DataFrame) -> DataFrame:
    """(video_id, ts, idx, label, x, y, w, h, conf) as input; a frame without boxes has a NULL label."""
    return _aligned(boxes, "box", **{c: F.col(c) for c in ("ts", "idx", "label", "x", "y", "w", "h", "conf")})


def signal_rows(signals: DataFrame) -> DataFrame:
    """(video_id, signal, sec, value, text) as input."""
    return _aligned(signals, "signal", ts=F.col("sec"), signal=F.col("signal"), value=F.col("value"), text=F.col("text"))


def end_rows(ends: DataFrame) -> DataFrame:
    """(video_id, duration, rows) as input: the video ends there, once *rows* rows of it have come.

    With a NULL count it ends at once.
    """
    return _aligned(ends, "end", ts=F.col("duration"), duration=F.col("duration"), rows=F.col("rows"))


def holds(c: Condition, value: float | None, text: str | None) -> bool:
    """One condition on one signal row; a missing value never satisfies it."""
    if c.any_of:
        return text is not None and text.strip(" ").lower() in c.any_of
    return value is not None and (c.min is None or value >= c.min) and (c.max is None or value <= c.max)


def reach(specs: Iterable[Event]) -> int:
    """Seconds of the future that a second depends on."""
    return max((max(0, c.within) + max(1, c.sustained) - 1 for s in specs for c in s.signals), default=0)


class Runs:
    """The guards of one event: marks go in by time, those that may be emitted come out.

    ``body`` is plain data, kept between batches: marks that wait for the ignored end, and
    the open run with the marks that wait for its length.
    """

    def __init__(self, spec: Event, body: dict | None):
        self.spec = spec
        self.body = body or {"queue": [], "first": None, "last": None, "held": []}

    def _length_ok(self) -> bool:
        b, s = self.body, self.spec
        length = b["last"] - b["first"] + 1.0
        return length >= s.min_duration and (s.max_duration <= 0 or length <= s.max_duration)

    def close(self) -> list:
        out = self.body["held"] if self.body["first"] is not None and self._length_ok() else []
        self.body |= {"first": None, "last": None, "held": []}
        return out

    def _mark(self, row: list) -> list:
        b, out = self.body, []
        if b["first"] is not None and row[0] - b["last"] > RUN_GAP:
            out = self.close()
        if b["first"] is None:
            b["first"] = row[0]
        b["last"] = row[0]
        b["held"].append(row)
        if self.spec.max_duration > 0:
            if b["last"] - b["first"] + 1.0 > self.spec.max_duration:
                b["held"] = []  # too long whatever comes
            return out
        if self._length_ok():
            out, b["held"] = out + b["held"], []
        return out

    def take(self, rows: list, seen: float, total: float | None) -> list:
        """Add marks; *seen* is a time that the video surely reaches, *total* its end if known."""
        s, b = self.spec, self.body
        b["queue"] += [r for r in rows if r[0] >= s.ignore_start]
        out, n = [], 0
        for row in b["queue"]:
            if s.ignore_end > 0 and total is None and row[0] + s.ignore_end > seen:
                break
            n += 1
            if s.ignore_end <= 0 or total is None or row[0] <= total - s.ignore_end:
                out += self._mark(row)
        b["queue"] = b["queue"][n:]
        return out


class VideoRules:
    """All events of one video; times are released in order and only once."""

    def __init__(self, specs: Sequence[Event], body: dict | None):
        self.specs, self.reach = specs, reach(specs)
        body = body or {}
        self.released = -EVER if body.get("released") is None else body["released"]
        self.ticked = -EVER if body.get("ticked") is None else body["ticked"]
        self.seen = -EVER if body.get("seen") is None else body["seen"]
        self.held = {s.event: Lingering(s, body.get("held", {}).get(s.event)) for s in specs if s.rules}
        self.votes = {s.event: body.get("votes", {}).get(s.event, []) for s in specs if s.rules}
        self.runs = {s.event: Runs(s, body.get("runs", {}).get(s.event)) for s in specs}

    def body(self) -> dict:
        plain = lambda t: None if math.isinf(t) else t
        return {
            "released": plain(self.released),
            "ticked": plain(self.ticked),
            "seen": plain(self.seen),
            "held": {e: g.held.tolist() for e, g in self.held.items()},
            "votes": self.votes,
            "runs": {e: r.body for e, r in self.runs.items()},
        }

    def _met(self, spec: Event, sec: int, on: dict[str, set[int]], total: float | None) -> bool:
        """Whether every condition of an event holds at a second."""
        if sec < 0 or (total is not None and sec >= total):
            return False
        for k, c in enumerate(spec.signals):
            ticks = on.get(f"{spec.event}/{k}", set())
            if not any(self._runs_long(ticks, t, max(1, c.sustained)) for t in range(sec - max(0, c.within), sec + max(0, c.within) + 1)):
                return False
        return True

    @staticmethod
    def _runs_long(ticks: set[int], at: int, least: int) -> bool:
        if at not in ticks:
            return False
        length, lo, hi = 1, at - 1, at + 1
        while length < least and lo in ticks:
            length, lo = length + 1, lo - 1
        while length < least and hi in ticks:
            length, hi = length + 1, hi + 1
        return length >= least

    def release(self, upto: float, frames: dict[float, list], on: dict[str, set[int]], total: float | None, close: bool) -> list[tuple]:
        """Marks that become certain once all rows up to *upto* (and the reach after it) are there."""
        marks: dict[str, list] = {s.event: [] for s in self.specs}
        for ts in sorted(t for t in frames if self.released < t <= upto):
            seen: dict[str, list] = {}
            for _, label, box, conf in sorted(frames[ts], key=lambda r: r[0]):
                if label is not None:
                    seen.setdefault(label, []).append((box, 1.0 if conf is None else conf))
            for s in self.specs:
                if s.rules:
                    marks[s.event] += self._frame(s, ts, seen, not s.signals or self._met(s, math.floor(ts), on, total))
        self.released = max(self.released, upto)
        limit = upto if total is not None else min(upto, self.seen)  # the video surely has seconds up to what was seen
        for s in self.specs:
            if s.rules:
                continue
            first = s.signals[0]
            near = {t + o for t in on.get(f"{s.event}/0", ()) for o in range(-max(0, first.within), max(0, first.within) + 1)}
            for sec in sorted(t for t in near if self.ticked < t <= limit):
                if self._met(s, sec, on, total):
                    marks[s.event].append([float(sec), None, 0.0, 0.0, 1.0, 1.0])
        self.ticked = max(self.ticked, limit)
        out = []
        for event, rows in marks.items():
            kept = self.runs[event].take(rows, self.seen, total)
            kept += self.runs[event].close() if close else []
            out += [(r[0], event, *r[1:]) for r in kept]
        return out

    def _frame(self, spec: Event, ts: float, seen: dict, gate: bool) -> list:
        fired, conf, box = self.held[spec.event].frame(ts, seen)
        fired = bool(fired and gate)
        ms, width = round(ts * 1000), max(1, round(spec.window_secs * 1000))
        window = [v for v in self.votes[spec.event] if ms - v[0] <= width] + [[ms, fired, conf, box]]
        self.votes[spec.event] = window
        if sum(v[1] for v in window) / len(window) < VOTE_SHARE:
            return []
        newest = next((v for v in reversed(window) if v[1]), None)
        return [[ts, newest[2], *(newest[3] or [None] * 4)]]


class RuleProcessor(StatefulProcessor):
    """State of one video: waiting frames and seconds of met conditions as maps, the rest as one small value.

    Rows at or before the last released time are late and ignored; so is what follows a
    closed video until it has been silent for *idle_ms*.
    """

    def __init__(self, specs: Sequence[Event], idle_ms: int):
        self.specs = [s for s in specs if s.enabled]
        self.conditions = [(f"{s.event}/{k}", c) for s in self.specs for k, c in enumerate(s.signals)]
        self.idle_ms = idle_ms
        self.hold = reach(self.specs) + 1

    columns = COLUMNS

    def _engine(self, body: dict | None):
        return VideoRules(self.specs, body)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.small = handle.getValueState("video", "body STRING")
        self.frames = handle.getMapState("frames", "ts DOUBLE", "body STRING")
        self.ticks = handle.getMapState("ticks", "condition STRING, sec LONG", "on BOOLEAN")

    def _load(self) -> dict:
        return json.loads(self.small.get()[0]) if self.small.exists() else {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        body = self._load()
        if not body.get("closed"):
            video = self._engine(body.get("rules"))
            fresh: dict[float, list] = {}
            for batch in rows:
                batch = batch.astype(object).where(batch.notna(), None)
                for r in batch.itertuples(index=False):
                    self._take(r, body, video, fresh)
            for ts, boxes in fresh.items():
                old = json.loads(self.frames.getValue((ts,))[0]) if self.frames.containsKey((ts,)) else []
                self.frames.updateValue((ts,), (json.dumps(old + boxes),))
            body["rules"] = video.body()
        yield from self._advance(key, body, timerValues.getCurrentWatermarkInMs() - SHIFT_MS, False)

    def _take(self, r, body: dict, video, fresh: dict) -> None:
        if r.kind == "end":
            body["total"], body["due"] = r.duration, r.rows
            body["ending"] = True
            return
        body["rows"] = body.get("rows", 0) + 1
        if r.ts <= video.released:
            return
        video.seen = max(video.seen, r.ts)
        if r.kind == "box":
            fresh.setdefault(r.ts, []).append([r.idx, r.label, [r.x, r.y, r.w, r.h], r.conf])
            return
        for name, c in self.conditions:
            if c.signal == r.signal and holds(c, r.value, r.text):
                self.ticks.updateValue((name, int(r.ts)), (True,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, self._load(), timerValues.getCurrentWatermarkInMs() - SHIFT_MS, True)

    def _advance(self, key, body: dict, mark: int, timer: bool) -> Iterator[pd.DataFrame]:
        """Release what is due at the watermark, close the video if it has ended, set the next timer."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        out: list = []
        if body.get("closed"):
            if timer:
                self._clear()
            else:
                self._wake(mark + self.idle_ms)
            yield pd.DataFrame(out, columns=["video_id", *self.columns])
            return
        video = self._engine(body.get("rules"))
        quiet = video.seen * 1000 + self.hold * 1000 + self.idle_ms if video.seen > -EVER else mark + self.idle_ms
        ending = body.get("ending") and (body["due"] is None or body.get("rows", 0) >= body["due"])
        close = bool(ending or mark >= quiet)
        upto = EVER if close else mark / 1000 - self.hold
        frames = {k[0]: json.loads(v[0]) for k, v in self.frames.iterator()}
        on: dict[str, set[int]] = {}
        for (name, sec), _ in self.ticks.iterator():
            on.setdefault(name, set()).add(sec)
        total = body.get("total") if ending else (math.floor(video.seen) + 1.0 if close and video.seen > -EVER else None)
        if close or upto > video.released:
            out = [(key[0], *r) for r in video.release(upto, frames, on, total, close)]
        if close:
            self._clear()
            if ending:
                self.small.update((json.dumps({"closed": True}),))
                self._wake(mark + self.idle_ms)
        else:
            for ts in frames:
                if ts <= video.released:
                    self.frames.removeKey((ts,))
            for name, ticks in on.items():
                for sec in ticks:
                    if sec < video.ticked - 2 * self.hold:
                        self.ticks.removeKey((name, sec))
            body["rules"] = video.body()
            self.small.update((json.dumps(body),))
            waiting = [t for t in frames if t > video.released]
            due = (min(waiting) + self.hold) * 1000 if waiting else quiet
            self._wake(max(mark + 1, math.ceil(min(due, quiet))))
        yield pd.DataFrame(out, columns=["video_id", *self.columns])

    def _wake(self, at_ms: float) -> None:
        self.handle.registerTimer(int(at_ms) + SHIFT_MS)

    def _clear(self) -> None:
        self.small.clear()
        self.frames.clear()
        self.ticks.clear()

    def close(self) -> None:
        pass


class VideoTracks:
    """The tracker of one video; frames are released in order and only once."""

    def __init__(self, threshold: float, max_lost: int, body: dict | None):
        body = body or {"released": None, "seen": None, "frame": None, "live": [], "made": 0}
        self.released = -EVER if body["released"] is None else body["released"]
        self.seen = -EVER if body["seen"] is None else body["seen"]
        self.tracker = Tracker(threshold, max_lost, body["frame"], body["live"], body["made"])

    def body(self) -> dict:
        t = self.tracker
        plain = lambda x: None if math.isinf(x) else x
        return {"released": plain(self.released), "seen": plain(self.seen), "frame": t.frame, "live": t.live, "made": t.made}

    def release(self, upto: float, frames: dict[float, list], on: dict, total: float | None, close: bool) -> list[tuple]:
        out = []
        for ts in sorted(t for t in frames if self.released < t <= upto):
            boxes = sorted((r[0], r[2]) for r in frames[ts])
            out += [(int(ts), i, k) for (i, _), k in zip(boxes, self.tracker.update(int(ts), [b for _, b in boxes]))]
        self.released = max(self.released, upto)
        return out


class TrackProcessor(RuleProcessor):
    """Frames wait for the watermark as in :class:`RuleProcessor`; then they are tracked in order."""

    columns = ["frame", "idx", "track"]

    def __init__(self, threshold: float, max_lost: int, idle_ms: int):
        super().__init__([], idle_ms)
        self.threshold, self.max_lost = threshold, max_lost

    def _engine(self, body: dict | None):
        return VideoTracks(self.threshold, self.max_lost, body)


def _by_video(rows: DataFrame, processor: StatefulProcessor, out: str, late: str) -> DataFrame:
    key = rows.schema["video_id"].dataType.simpleString()
    # an end row has no event time: it is neither late nor does it move the watermark
    at = F.when(F.col("kind") != "end", F.timestamp_millis(F.rint(F.col("ts") * 1000).cast("long") + SHIFT_MS))
    return (
        rows.withColumn("at", at)
        .withWatermark("at", late)
        .groupBy("video_id")
        .transformWithStateInPandas(statefulProcessor=processor, outputStructType=f"video_id {key}, {out}", outputMode="Append", timeMode="EventTime")
    )


def track_stream(rows: DataFrame, *, threshold: float = 0.3, max_lost: int = 10, late: str = "5 seconds", idle_ms: int = 60_000) -> DataFrame:
    """(video_id, frame, idx, track) of a stream of :func:`box_rows`, whose times are frame numbers, and :func:`end_rows`.

    The ids of :func:`tidemark.operators.tracking.track_boxes`, as long as no row comes later
    than *late*, a frame counting as a second. The state of a video is its live tracks and
    the frames that wait. Needs the RocksDB state store.
    """
    return _by_video(rows, TrackProcessor(threshold, max_lost, idle_ms), "frame INT, idx INT, track LONG", late)


def rule_stream(rows: DataFrame, specs: Sequence[Event], *, late: str = "5 seconds", idle_ms: int = 60_000) -> DataFrame:
    """Every marked time of every event of a stream of :func:`box_rows`, :func:`signal_rows` and :func:`end_rows`.

    The same rows as :func:`tidemark.operators.rules.apply_rules` gives for the whole input,
    as long as no row comes later than *late*. A video without an end row ends a second after
    its last row, once it has been silent for *idle_ms*. Times are 0 or more, frames at least a
    millisecond apart. Needs the RocksDB state store.
    """
    return _by_video(rows, RuleProcessor(specs, idle_ms), "ts DOUBLE, event STRING, conf DOUBLE, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE", late)

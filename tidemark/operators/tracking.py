"""Box tracking in parallel along time, equal to one pass over the frames.

A stretch of frames is cut into chunks. Each chunk is first tracked on its own, after a
warm-up over the frames before it: the live tracks at its start are a guess at what the
chunk before it hands over. A pass over one small row per chunk compares the guess with what
was handed over and stitches track ids; chunks that started from another state are tracked
again from the right one, until none is left. Live tracks only remember their last box and
how long they have been lost, so the guess is right unless tracks older than the warm-up
matter, and a round settles at least the first wrong chunk of every stretch.

The order of live tracks decides only between equal overlaps. A chunk in which that
happened says so, and then the order of its first tracks is checked as well.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.axis import run_ids, with_halo
from tidemark.session import cut_lineage


def overlap(a, b) -> float:
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    inter = max(0.0, w) * max(0.0, h)
    union = a[2] * a[3] + b[2] * b[3] - inter
    return inter / union if union > 0 else 0.0


class Tracker:
    """Greedy IoU tracking: live tracks as rows [box, frames lost, name], in order of creation.

    Tracks that were there at the start have the names -1, -2, ...; new ones 0, 1, ...
    """

    def __init__(self, threshold: float, max_lost: int, frame: int | None = None, live: Sequence = (), made: int = 0):
        self.threshold, self.max_lost, self.frame, self.made = threshold, max_lost, frame, made
        self.live = [list(t) for t in live]
        self.ties = False

    def begin(self) -> list:
        """Rename the live tracks as those of the start; their boxes and frames lost."""
        self.made, self.ties = 0, False
        self.live = [[box, lost, -1 - k] for k, (box, lost, _) in enumerate(self.live)]
        return [[box, lost] for box, lost, _ in self.live]

    def skip_to(self, frame: int) -> None:
        """Count the empty frames before *frame*."""
        if self.frame is not None and frame - self.frame > 1:
            gone = frame - self.frame - 1
            self.live = [[b, n + gone, k] for b, n, k in self.live if n + gone <= self.max_lost]
            self.frame = frame - 1

    def update(self, frame: int, boxes: Sequence) -> list[int]:
        """The track name of each box of a frame."""
        self.skip_to(frame)
        self.frame = frame
        taken: set[int] = set()
        names = []
        for box in boxes:
            scored = [(overlap(box, t[0]), k) for k, t in enumerate(self.live) if k not in taken]
            top = max((s for s, _ in scored), default=0.0)
            if top > self.threshold:
                equal = [k for s, k in scored if s == top]
                self.ties |= len(equal) > 1
                at = equal[0]
                self.live[at][:2] = [box, 0]
            else:
                at = len(self.live)
                self.live.append([box, 0, self.made])
                self.made += 1
            taken.add(at)
            names.append(self.live[at][2])
        for k, t in enumerate(self.live):
            if k not in taken:
                t[1] += 1
        self.live = [t for t in self.live if t[1] <= self.max_lost]
        return names


def _track_chunks(frames: DataFrame, keys: Sequence[str], frame: str, width: int, threshold: float, max_lost: int) -> DataFrame:
    """Assignments (``idx``, ``_name``) and one row with a ``_body`` for each chunk.

    *frames* has a row per frame with its boxes as an array, and the chunk's first tracks as
    ``_entry`` or, where that is NULL, rows that are not ``_own`` to warm up on.
    """
    ids = [*keys, "_part", "_chunk"]
    names = [*ids, frame, "idx", "_name", "_body"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.select(*ids, frame).schema)
    n = len(ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tracker, entry = None, None, None

        def start() -> None:
            nonlocal entry
            tracker.skip_to(at[-1] * width)
            tracker.frame = at[-1] * width - 1
            entry = tracker.begin()

        def end() -> list:
            if at is None:
                return []
            if entry is None:  # warm-up rows only
                return []
            tracker.skip_to((at[-1] + 1) * width)
            body = {"entry": entry, "exit": tracker.live, "made": tracker.made, "ties": tracker.ties}
            return [(*at, None, None, None, json.dumps(body))]

        for pdf in batches:
            out: list = []
            for row in pdf[[*ids, frame, "_own", "_entry", "_boxes"]].itertuples(index=False):
                if tuple(row[:n]) != at:
                    out += end()
                    at, entry = tuple(row[:n]), None
                    given = json.loads(row[n + 2]) if row[n + 2] is not None else []
                    tracker = Tracker(threshold, max_lost, at[-1] * width - 1 if row[n + 2] is not None else None, [[b, lost, 0] for b, lost in given])
                boxes = [(b["idx"], [b["x"], b["y"], b["w"], b["h"]]) for b in row[n + 3]]
                if row[n + 1] and entry is None:
                    start()
                got = tracker.update(int(row[n]), [b for _, b in boxes])
                if row[n + 1]:
                    out += [(*at, row[n], i, k, None) for (i, _), k in zip(boxes, got)]
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(end(), columns=names)

    placed = frames.repartition(*ids).sortWithinPartitions(*ids, frame)
    idx = frames.schema["_boxes"].dataType.elementType["idx"].dataType.simpleString()
    return placed.mapInPandas(run, f"{schema}, idx {idx}, _name INT, _body STRING")


def _stitch(summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per chunk: number of earlier tracks, the ids of its first tracks, and ``_again``.

    ``_again`` is the state that a chunk has to start from where it started from another.
    One small row per chunk streams through in order.
    """
    ids = [*keys, "_part", "_chunk"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in summaries.select(*ids).schema)
    n = len(ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made, handed = None, 0, []
        for pdf in batches:
            out = []
            for row in pdf[[*ids, "_body"]].itertuples(index=False):
                if tuple(row[: n - 1]) != part:
                    part, made, handed = tuple(row[: n - 1]), 0, []
                body = json.loads(row[n])
                entry = body["entry"]
                have = sorted(range(len(entry)), key=lambda k: (entry[k], k))
                owed = sorted(range(len(handed)), key=lambda k: (handed[k][0], k))
                first: list = [None] * len(entry)
                same = [entry[k] for k in have] == [handed[k][0] for k in owed]
                if same:
                    for k, o in zip(have, owed):
                        first[k] = handed[o][1]
                known = None not in first
                bad = not same or (body["ties"] and known and first != sorted(first))
                again = json.dumps([state for state, _ in handed]) if bad else None
                out.append((*row[:n], made, first, again))
                name = lambda k: made + k if k >= 0 else first[-1 - k]
                handed = [([box, lost], name(k)) for box, lost, k in body["exit"]]
                if all(i is not None for _, i in handed):
                    handed.sort(key=lambda t: t[1])
                made += body["made"]
            yield pd.DataFrame(out, columns=[*ids, "_made", "_first", "_again"])

    placed = summaries.repartition(*keys, "_part").sortWithinPartitions(*ids)
    return placed.mapInPandas(run, f"{schema}, _made LONG, _first ARRAY<LONG>, _again STRING")


def track_boxes(
    boxes: DataFrame, keys: Sequence[str], *, frame: str = "frame", threshold: float = 0.3, max_lost: int = 10, chunk: int = 3600, warm_up: int | None = None
) -> DataFrame:
    """Track ids by greedy overlap; a track survives *max_lost* frames unseen.

    After more empty frames than that nothing survives: there the frames are cut into
    independent stretches, and these into chunks of *chunk* frames that are tracked in
    parallel (see the module). Ids count from 0 per video, in the order in which one pass
    over all frames would make them.
    """
    width = max(chunk, max_lost + 1)  # so that no chunk inside a stretch is empty
    before = 4 * max_lost if warm_up is None else warm_up
    seen = boxes.select(*keys, frame).distinct()
    cut = run_ids(seen, keys, [frame], F.struct(F.col(frame).alias("f")), lambda p: F.col(frame) - p["f"] - 1 > max_lost, "_part", frame)
    box = F.struct("idx", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")])
    rows = boxes.groupBy(*keys, frame).agg(F.array_sort(F.collect_list(box)).alias("_boxes")).join(cut, [*keys, frame])
    rows = cut_lineage(rows)
    ids = [*keys, "_part", "_chunk"]
    warm = with_halo(rows, frame, before, 0, width).withColumn("_entry", F.lit(None).cast("string"))
    plain = rows.withColumn("_chunk", F.floor(F.col(frame) / width).cast(warm.schema["_chunk"].dataType)).withColumn("_own", F.lit(True))
    found = cut_lineage(_track_chunks(warm, keys, frame, width, threshold, max_lost))
    while True:
        stitched = cut_lineage(_stitch(found.filter("_body IS NOT NULL"), keys))
        wrong = stitched.filter("_again IS NOT NULL").select(*ids, F.col("_again").alias("_entry"))
        if wrong.isEmpty():
            break
        redone = _track_chunks(plain.join(wrong, ids), keys, frame, width, threshold, max_lost)
        found = cut_lineage(found.join(wrong, ids, "left_anti").unionByName(redone))
    made = found.filter("_body IS NOT NULL").groupBy(*keys, "_part").agg(F.sum(F.get_json_object("_body", "$.made").cast("long")).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = made.select(*keys, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    own = F.when(F.col("_name") >= 0, F.col("_made") + F.col("_name")).otherwise(F.get("_first", -1 - F.col("_name")))
    out = found.filter("_body IS NULL").join(stitched, ids).join(offset, [*keys, "_part"])
    return out.select(*keys, frame, "idx", (own + F.col("_off")).cast("long").alias("track"))

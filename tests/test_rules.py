"""The rule engine against a frame-by-frame loop, idempotence, and stream = batch."""

import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import rules as rl
from tidemark.sources import rules_table as rt

BOX = "v INT, ts DOUBLE, idx INT, label STRING, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, conf DOUBLE"
SIG = "v INT, signal STRING, sec INT, value DOUBLE, text STRING"


def engine(boxes, signals, spec, length):
    """One event over one video, straight from the definition."""

    def iou(a, b):
        w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
        h = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)

    masks = []
    for c in spec.signals:
        vals = {s: (x, t) for n, s, x, t in signals if n == c.signal}
        on = []
        for s in range(length):
            x, t = vals.get(s, (None, None))
            if c.any_of:
                on.append(t is not None and t.lower() in c.any_of)
            else:
                on.append(x is not None and (c.min is None or x >= c.min) and (c.max is None or x <= c.max))
        if c.sustained > 1:
            on = [
                v and sum(1 for _ in iter_run(on, i)) >= c.sustained for i, v in enumerate(on)
            ]
        if c.within:
            on = [any(on[max(0, i - c.within) : i + c.within + 1]) for i in range(length)]
        masks.append(on)
    hold = [all(m[s] for m in masks) for s in range(length)]
    raw = []
    if spec.rules:
        ghosts, votes = {}, []
        for ts in sorted({b[0] for b in boxes}):
            for k in ghosts:
                ghosts[k] = [g for g in ghosts[k] if ts - g[0] <= spec.persist_secs]
            for _, _, label, *rest in sorted(b for b in boxes if b[0] == ts):
                box, conf = tuple(rest[:4]), rest[4]
                for g in ghosts.setdefault(label, []):
                    if iou(g[1], box) > 0.3:
                        g[:] = [ts, box, conf]
                        break
                else:
                    ghosts[label].append([ts, box, conf])
            used, ok = [], True
            for r in spec.rules:
                regions = ghosts.get(r.region, [])
                inside = [
                    g
                    for g in ghosts.get(r.source, [])
                    if not any(g is u for u in used)
                    and any(q[1][0] <= g[1][0] + g[1][2] / 2 <= q[1][0] + q[1][2] and q[1][1] <= g[1][1] + g[1][3] / 2 <= q[1][1] + q[1][3] for q in regions)
                ]
                ok = ok and bool(regions) and r.min_count <= len(inside) <= r.max_count
                used += inside
            ok = ok and (not spec.signals or hold[int(ts)])
            votes = [v for v in votes if ts - v[0] <= spec.window_secs + 1e-9] + [(ts, ok)]
            if sum(v for _, v in votes) / len(votes) >= 0.5:
                raw.append(ts)
    else:
        raw = [float(s) for s in range(length) if hold[s]]
    hi = length - spec.ignore_end if spec.ignore_end > 0 else math.inf
    raw = [t for t in raw if spec.ignore_start <= t <= hi]
    out, run = [], []
    for t in raw + [math.inf]:
        if run and t - run[-1] > 1.5:
            size = run[-1] - run[0] + 1
            if size >= spec.min_duration and not (0 < spec.max_duration < size):
                out += run
            run = []
        run.append(t)
    return out


def iter_run(on, i):
    a = i
    while a > 0 and on[a - 1]:
        a -= 1
    while a < len(on) and on[a]:
        yield a
        a += 1


def random_case(seed):
    rnd = random.Random(seed)
    boxes, ts = [], 0.0
    for _ in range(50):
        ts = round(ts + rnd.choice([0.25, 0.25, 0.5, 2.0]), 2)
        for i in range(rnd.randint(1, 4)):
            label = rnd.choice("abc")
            size = 0.6 if label == "c" else 0.1
            boxes.append((ts, i, label, rnd.choice([0.1, 0.3, 0.6]), rnd.choice([0.1, 0.3, 0.6]), size, size, round(rnd.random(), 2)))
    length = int(ts) + 1
    signals = [("lvl", s, rnd.random(), None) for s in range(length) if rnd.random() < 0.8]
    signals += [("kind", s, None, rnd.choice(["Up", "down"])) for s in range(length) if rnd.random() < 0.7]
    return boxes, signals, length


SPECS = rt.parse(
    {
        "events": [
            {"name": "both", "rules": [{"source": "a", "region": "c"}, {"source": "b", "region": "c", "max_count": 3}], "window_secs": 0.75},
            {"name": "two", "rules": [{"source": "a", "region": "c", "min_count": 2}], "persist_secs": 2.0, "window_secs": 2.0, "min_duration_secs": 2.0},
            {"name": "loud", "rules": [{"source": "a", "region": "c"}], "signals": [{"signal": "lvl", "min": 0.4, "within_secs": 1}], "ignore_start_secs": 3, "ignore_end_secs": 4},
            {"name": "held", "signals": [{"signal": "lvl", "max": 0.8, "sustained_secs": 3}, {"signal": "kind", "any_of": ["UP"], "within_secs": 1}], "max_duration_secs": 6},
            {"name": "off", "enabled": False, "signals": [{"signal": "lvl", "min": 0.0}]},
        ]
    }
)


@pytest.mark.parametrize("seed", [1, 2])
def test_engine_equals_the_loop(spark, seed):
    boxes, signals, length = random_case(seed)
    b = spark.createDataFrame([(1, *x) for x in boxes], BOX)
    s = spark.createDataFrame([(1, *x) for x in signals], SIG)
    v = spark.createDataFrame([(1, length)], "v INT, duration INT")
    marked = rl.apply_rules(b, s, v, ["v"], SPECS).collect()
    for spec in SPECS:
        got = sorted(r.ts for r in marked if r.event == spec.event)
        assert got == (engine(boxes, signals, spec, length) if spec.enabled else []), spec.event
    assert {r.event for r in marked if r.conf is None} <= {"held"}


def test_running_twice_changes_nothing(spark):
    labels = spark.createDataFrame([(1, 0, "a"), (1, 0, "held"), (1, 1, "off"), (1, 2, "b")], "v INT, sec INT, label STRING")
    events = spark.createDataFrame([(1, 2, "held")], "v INT, sec INT, event STRING")
    names = [e.event for e in SPECS]
    once = rl.compose(labels, events, ["v"], names)
    again = rl.compose(once.select("v", "sec", F.explode("labels").alias("label")), events, ["v"], names)
    want = [(1, 0, ["a"]), (1, 2, ["b", "held"])]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, again.collect()))


def test_missing_confidence_counts_as_one(spark):
    b = spark.createDataFrame([(1, 0.0, 0, "a", 0.3, 0.3, 0.1, 0.1, None), (1, 0.0, 1, "c", 0.0, 0.0, 1.0, 1.0, None)], BOX)
    v = spark.createDataFrame([(1, 1)], "v INT, duration INT")
    s = spark.createDataFrame([], SIG)
    spec = rt.parse([{"name": "one", "rules": [{"source": "a", "region": "c"}]}])
    row = rl.apply_rules(b, s, v, ["v"], spec).collect()[0]
    assert row.conf == 1.0 and (row.x, row.y, row.w, row.h) == (0.0, 0.0, 1.0, 1.0)


def test_yaml_json_and_dictionaries_are_the_same():
    text = "events:\n- {name: e, rules: [{source: a, region: b, min_count: 2}], persist_secs: 0.25}\n"
    doc = {"events": [{"name": "e", "rules": [{"source": "a", "region": "b", "min_count": 2}], "persist_secs": 0.25}]}
    assert rt.parse(text) == rt.parse(json.dumps(doc)) == rt.parse(doc)
    assert rt.class_names(SPECS) == ["a", "b", "c"] and rt.signal_names(SPECS) == ["kind", "lvl"]


STREAMED = rt.parse(
    {
        "events": [
            {"name": "pair", "rules": [{"source": "a", "region": "c"}], "window_secs": 1.0, "persist_secs": 1.0},
            {"name": "gated", "rules": [{"source": "b", "region": "c"}], "signals": [{"signal": "lvl", "min": 0.4, "within_secs": 1}], "persist_secs": 2.0, "min_duration_secs": 2.0},
            {"name": "short", "rules": [{"source": "a", "region": "c"}], "persist_secs": 1.5, "max_duration_secs": 4.0, "ignore_end_secs": 3.0},
            {"name": "held", "signals": [{"signal": "lvl", "min": 0.3, "sustained_secs": 2}, {"signal": "kind", "any_of": ["even"], "within_secs": 1}], "ignore_start_secs": 1.0},
            {"name": "off", "enabled": False, "rules": [{"source": "a", "region": "c"}]},
        ]
    }
)


@pytest.mark.parametrize("seed,batches", [(3, 1), (4, 5), (5, 12)])
def test_stream_equals_batch(spark, tmp_path, seed, batches):
    """Any cutting into micro-batches: frames split over batches, rows late within the bound, unknown confidences."""
    from tidemark.streaming import engine as se
    from tidemark.streaming import rules as sr

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", se.ROCKSDB)
    rnd = random.Random(seed)
    boxes, signals, length, rows = [], [], {}, {}
    for v in (1, 2, 3):
        b, s, n = random_case(seed * 10 + v)
        b = [(v, *x[:-1], None if rnd.random() < 0.2 else x[-1]) for x in b]
        boxes, signals, length[v], rows[v] = boxes + b, signals + [(v, *x) for x in s], n, len(b) + len(s)
    box = spark.createDataFrame(boxes, BOX).withColumnRenamed("v", "video_id")
    sig = spark.createDataFrame(signals, SIG).withColumnRenamed("v", "video_id")
    ends = spark.createDataFrame([(v, float(length[v]), rows[v]) for v in length], "video_id INT, duration DOUBLE, rows LONG")
    every = sr.box_rows(box).unionByName(sr.signal_rows(sig)).unionByName(sr.end_rows(ends)).collect()
    late = 4.0
    key = lambda r: -1e9 if r.kind == "end" and rnd.random() < 0.5 else r.ts + rnd.uniform(0, late * 0.9)
    every.sort(key=key)
    schema = sr.box_rows(box).schema
    for i in range(batches):
        part = every[len(every) * i // batches : len(every) * (i + 1) // batches]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = se.run_available(sr.rule_stream(raw, STREAMED, late="4 seconds"), "t").collect()
    videos = spark.createDataFrame(list(length.items()), "video_id INT, duration INT")
    want = rl.apply_rules(box, sig, videos, ["video_id"], STREAMED).collect()
    as_row = lambda r: (r.video_id, r.ts, r.event, *(None if c is None else round(c, 9) for c in (r.conf, r.x, r.y, r.w, r.h)))
    assert sorted(map(as_row, got), key=str) == sorted(map(as_row, want), key=str)
    assert len({r.event for r in got}) >= 3


def test_silent_video_is_closed_by_a_timer(spark, tmp_path):
    from tidemark.streaming import engine as se
    from tidemark.streaming import rules as sr

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", se.ROCKSDB)
    specs = rt.parse([{"name": "long", "rules": [{"source": "a", "region": "c"}], "min_duration_secs": 2.0, "max_duration_secs": 9.0}])
    pair = lambda v, t: [(v, float(t), 0, "a", 0.3, 0.3, 0.1, 0.1, 0.5), (v, float(t), 1, "c", 0.0, 0.0, 1.0, 1.0, None)]
    files = [pair(1, 0) + pair(1, 1), pair(2, 100), pair(2, 200)]
    for i, rows in enumerate(files):
        df = sr.box_rows(spark.createDataFrame(rows, BOX).withColumnRenamed("v", "video_id"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    raw = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = se.run_available(sr.rule_stream(raw, specs, late="1 second", idle_ms=10_000), "t").collect()
    assert sorted((r.video_id, r.ts, r.conf) for r in got) == [(1, 0.0, 0.5), (1, 1.0, 0.5)]

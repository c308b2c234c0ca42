"""Chapters, identities, trackers and box merges against plain loops."""

import random
import statistics

import numpy as np
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import boxes as bx
from tidemark.operators import chapters as ch
from tidemark.operators import nearpairs, tracking
from tidemark.operators import vectors as vec


def chapters_by_hand(novelty, starts, end, min_gap, max_run, z=1.5, target=None):
    n = len(novelty)
    order = sorted(range(1, n), key=lambda i: (-novelty[i], -i))
    if target is None:
        m = statistics.median(novelty[1:])
        bar = m + z * max(1.4826 * statistics.median(abs(x - m) for x in novelty[1:]), 1e-6)
        order = [i for i in order if novelty[i] >= bar]
    chosen = []
    for i in order:
        if target is not None and len(chosen) >= target - 1:
            break
        near_end = starts[i] - starts[0] < min_gap or end - starts[i] < min_gap
        if not near_end and all(abs(starts[i] - starts[j]) >= min_gap for j in chosen):
            chosen.append(i)
    while max_run > 0:
        edges = [starts[0], *sorted(starts[i] for i in chosen), end]
        more = []
        for a, b in zip(edges, edges[1:]):
            if b - a > max_run:
                inner = [i for i in range(1, n) if a + min_gap <= starts[i] <= b - min_gap and i not in chosen]
                if inner:
                    more.append(max(inner, key=lambda i: (novelty[i], -i)))
        if not more:
            break
        chosen += more
    return sorted(starts[i] for i in chosen)


@pytest.mark.parametrize("seed,target", [(1, None), (2, None), (3, 4), (4, None)])
def test_boundaries_equal_the_loop(spark, seed, target):
    rnd = random.Random(seed)
    starts, t = [], 0.0
    for _ in range(60):
        starts.append(t)
        t += rnd.choice([2.0, 3.5, 6.0])
    novelty = [0.0] + [round(rnd.random() * (3 if rnd.random() < 0.15 else 1), 3) for _ in starts[1:]]
    shots = spark.createDataFrame([(1, i, s, x) for i, (s, x) in enumerate(zip(starts, novelty))], "v INT, shot INT, start DOUBLE, novelty DOUBLE")
    video = spark.createDataFrame([(1, t)], "v INT, duration DOUBLE")
    cuts = ch.pick_boundaries(shots, video, ["v"], min_gap=12.0, max_run=40.0, target=target)
    assert sorted(r.start for r in cuts.collect()) == chapters_by_hand(novelty, starts, t, 12.0, 40.0, target=target)
    parts = ch.chapters_from_cuts(cuts, shots, shots, video, ["v"]).orderBy("number").collect()
    assert parts[0].start == 0.0 and parts[-1].end == t
    assert all(a.end == b.start for a, b in zip(parts, parts[1:]))
    assert sum(p.shots for p in parts) == len(starts)


def test_method_follows_from_the_shots(spark):
    rnd = random.Random(5)
    starts = [4.0 * i for i in range(30)]
    scenes = [(v, t) for v in (1, 2) for t in starts] + [(3, 0.0), (3, 50.0), (3, 60.0)]
    looks = [(1, i, t, rnd.random()) for i, t in enumerate(starts)] + [(2, i, 4.0 * i, 0.5) for i in range(3)]
    videos = spark.createDataFrame([(v, 120.0) for v in (1, 2, 3, 4)] + [(5, 0.0)], "v INT, duration DOUBLE")
    s = spark.createDataFrame(scenes, "v INT, start DOUBLE")
    n = spark.createDataFrame(looks, "v INT, shot INT, start DOUBLE, novelty DOUBLE")
    got = ch.chapterize(s, n, videos, ["v"], min_gap=10.0, max_run=40.0).collect()
    assert {(r.v, r.method) for r in got} == {(1, "visual"), (2, "shot-length"), (3, "single"), (4, "single")}
    assert [(r.number, r.start, r.end, r.shots, r.boundary_score) for r in got if r.v == 3] == [(1, 0.0, 120.0, 3, 0.0)]
    want = chapters_by_hand([x[3] for x in looks[:30]], starts, 120.0, 10.0, 40.0, target=None)
    assert sorted(r.start for r in got if r.v == 1) == [0.0, *want]
    assert sorted(r.start for r in got if r.v == 2) == [0.0, 28.0, 60.0, 88.0]  # four parts, marks at 30, 60 and 90


def test_even_boundaries_land_on_cuts(spark):
    starts = [0.0, 7.0, 19.0, 31.0, 44.0, 58.0, 71.0, 90.0]
    shots = spark.createDataFrame([(1, s) for s in starts], "v INT, start DOUBLE")
    video = spark.createDataFrame([(1, 100.0)], "v INT, duration DOUBLE")
    got = [r.start for r in ch.even_boundaries(shots, video, ["v"], min_gap=10.0, max_run=0.0, target=4).collect()]
    assert sorted(got) == [19.0, 44.0, 71.0]  # 19 and 31 are equally near to 25


def test_gallery_blocks_do_not_change_the_answer(spark):
    rnd = random.Random(2)
    v = lambda: [rnd.gauss(0, 1) for _ in range(8)]
    faces = spark.createDataFrame([(i, v()) for i in range(40)], "id INT, vec ARRAY<DOUBLE>")
    gallery = spark.createDataFrame([(f"p{i % 7}", i, v(), i % 7 == 3) for i in range(50)], "identity_id STRING, seq INT, vec ARRAY<DOUBLE>, avoid BOOLEAN")
    kw = dict(threshold=0.6, watch_threshold=0.38)
    one = vec.nearest_identity(faces, gallery, ["id"], **kw)
    many = vec.nearest_identity(faces, gallery, ["id"], block=6, **kw)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_nearest_identity_of_ties_copies_and_faces_without_a_vector(spark):
    rnd = random.Random(3)
    v = lambda: [rnd.gauss(0, 1) for _ in range(4)]
    twin = v()
    pictures = [(f"p{i % 5}", i, v(), False) for i in range(20)] + [(f"p{i}", 20 + i, twin, i == 3) for i in (1, 3, 2, 3)] + [("p9", 30, None, False)]
    people = [(i, v()) for i in range(15)] + [(15, [2 * x for x in twin]), (16, None), (None, twin)]
    faces = spark.createDataFrame(people, "id LONG, vec ARRAY<DOUBLE>")
    gallery = spark.createDataFrame(pictures, "identity_id STRING, seq INT, vec ARRAY<DOUBLE>, avoid BOOLEAN")
    out = vec.nearest_identity(faces, gallery, ["id"], threshold=0.6, watch_threshold=0.38, block=4)
    assert "zip_with" not in out._jdf.queryExecution().optimizedPlan().toString()  # products of blocks, not pair by pair
    got = {r.id: r for r in out.collect()}

    def cos(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 9)

    for i, own in people:
        sim, best = max((cos(own, x[2]), x[0]) for x in pictures if x[2]) if own else (None, "p9")
        assert got[i].best_id == best and (got[i].similarity == sim if sim is None else abs(got[i].similarity - sim) < 1e-8)
        assert got[i].identity == (best if sim is not None and sim >= (0.38 if best == "p3" else 0.6) else None)
    assert got[15].best_id == "p3" and len(got) == len(people)
    assert vec.nearest_identity(faces, gallery.limit(0), ["id"], threshold=0.6).collect() == []


def test_merged_ids_follow_a_chain(spark):
    pairs = [(f"a{i:02d}", f"a{i + 1:02d}") for i in range(20)] + [("z1", "z2"), ("z2", "z3")]
    got = {r.id: r.merged_id for r in vec.merged_ids(spark.createDataFrame(pairs, "keep STRING, gone STRING")).collect()}
    assert set(got.values()) == {"a00", "z1"}
    assert all(got[f"a{i:02d}"] == "a00" for i in range(21)) and got["z3"] == "z1"


def test_identities_open_and_match_in_order(spark):
    e1, e2 = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    near = [0.9, 0.1, 0.0]
    df = spark.createDataFrame([(1, 0, e1), (1, 1, e2), (1, 2, near), (2, 0, e2)], "v INT, t INT, vec ARRAY<DOUBLE>")
    got = {(r.v, r.t): r.identity for r in vec.assign_identities(df, ["v"], order="t", threshold=0.6).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 0, (2, 0): 0}


def iou(a, b):
    w = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)


def one_long_pass(data, max_lost):
    """Track of each (frame, idx), frame by frame."""
    live, made, want = {}, 0, {}
    for frame in range(max(r[1] for r in data) + 1):
        hit = set()
        for _, _, i, *b in sorted(r for r in data if r[1] == frame):
            best = max(((iou(b, o), -k) for k, (o, _) in live.items() if k not in hit), default=(0, 0))
            k = -best[1] if best[0] > 0.3 else made
            made += k == made
            live[k] = (b, 0)
            hit.add(k)
            want[frame, i] = k
        live = {k: (o, n if k in hit else n + 1) for k, (o, n) in live.items() if k in hit or n < max_lost}
    return want


TRACKED = "v INT, frame INT, idx INT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE"


@pytest.mark.parametrize("seed,steps,ties", [(1, [1, 1, 1, 2, 5, 9], False), (2, [1], False), (3, [1, 1, 2, 3], True)])
def test_tracks_equal_one_long_pass(spark, seed, steps, ties):
    """Stretches over eight chunks and more; also where equal overlaps make the order of tracks count."""
    rnd = random.Random(seed)
    data, f = [], 0
    for _ in range(90):
        f += rnd.choice(steps)
        for i in range(rnd.randint(1, 4)):
            x = rnd.choice([0.1, 0.15, 0.2]) if ties else rnd.choice([0.1, 0.4, 0.7]) + rnd.uniform(-0.05, 0.05)
            data.append((1, f, i, x, 0.3, 0.25, 0.25))
    df = spark.createDataFrame(data, TRACKED)
    want = one_long_pass(data, 3)
    for warm_up in (None, 0):
        got = {(r.frame, r.idx): r.track for r in tracking.track_boxes(df, ["v"], max_lost=3, chunk=10, warm_up=warm_up).collect()}
        assert got == want


def test_tracks_of_a_stream(spark, tmp_path):
    from tidemark.streaming import engine as se
    from tidemark.streaming import rules as sr

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", se.ROCKSDB)
    rnd = random.Random(8)
    data = [(v, f, i, rnd.choice([0.1, 0.4, 0.7]) + rnd.uniform(-0.05, 0.05), 0.3, 0.25, 0.25) for v in (1, 2) for f in range(0, 40, v) for i in range(rnd.randint(1, 3))]
    rows = [(v, float(f), i, "a", *b, 0.5) for v, f, i, *b in data]
    box = spark.createDataFrame(rows, "video_id INT, ts DOUBLE, idx INT, label STRING, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, conf DOUBLE")
    ends = spark.createDataFrame([(v, 40.0, sum(r[0] == v for r in data)) for v in (1, 2)], "video_id INT, duration DOUBLE, rows LONG")
    every = sr.box_rows(box).unionByName(sr.end_rows(ends)).collect()
    every.sort(key=lambda r: r.ts + rnd.uniform(0, 3.5))
    for i in range(6):
        df = spark.createDataFrame(every[len(every) * i // 6 : len(every) * (i + 1) // 6], sr.box_rows(box).schema)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    raw = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = se.run_available(sr.track_stream(raw, max_lost=3, late="4 seconds"), "t").collect()
    for v in (1, 2):
        assert {(r.frame, r.idx): r.track for r in got if r.video_id == v} == one_long_pass([r for r in data if r[0] == v], 3)


def test_merged_boxes_equal_the_loop(spark):
    rnd = random.Random(6)
    data = [(1, fr, i, rnd.uniform(0, 0.5), rnd.uniform(0, 0.5), 0.4, 0.4, rnd.random(), rnd.random() < 0.3) for fr in range(6) for i in range(7)]
    df = spark.createDataFrame(data, "v INT, frame INT, idx INT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, conf DOUBLE, corner BOOLEAN")
    got = sorted((r.frame, *(round(v, 6) for v in (r.x1, r.y1, r.x2, r.y2)), r.corner, r.merged) for r in bx.merge_boxes(df, ["v", "frame"], threshold=0.3).collect())
    want = []
    for fr in range(6):
        left = sorted((r for r in data if r[1] == fr), key=lambda r: -r[7])
        while left:
            seed, rest = left[0], left[1:]
            group = [seed] + [r for r in rest if iou(seed[3:7], r[3:7]) > 0.3]
            left = [r for r in rest if r not in group]
            want.append((fr, *(round(v, 6) for v in (min(g[3] for g in group), min(g[4] for g in group), max(g[3] + g[5] for g in group), max(g[4] + g[6] for g in group))), any(g[8] for g in group), len(group)))
    assert got == sorted(want)


def test_synchrony_of_equal_and_of_few_moves(spark):
    rnd = random.Random(3)
    xs = [rnd.random() for _ in range(12)]
    data = [(1, f, t, x + t, 2 * x, 0.1, 0.1) for f, x in enumerate(xs) for t in (0, 1)]
    data += [(2, f, t, 0.5, 0.5, 0.1, 0.1) for f in range(3) for t in (0, 1)]
    df = spark.createDataFrame(data, "v INT, frame INT, track INT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE")
    got = {r.v: r.synchrony for r in bx.synchrony(df, ["v"], frame="frame").collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == 0.5


@pytest.mark.parametrize("seed,least,block", [(1, 0.8, 7), (2, 0.5, 50), (3, 0.95, 2048)])
def test_near_pairs_connect_what_all_pairs_connect(spark, seed, least, block):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    data = [(f"id{rnd.randrange(60):02d}", [x + rnd.gauss(0, 0.25) for x in rnd.choice(centres)]) for _ in range(180)]
    data += [(f"copy{i:02d}", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(40)] + [("zero", [0.0] * 6)]
    df = spark.createDataFrame(data, "id STRING, vec ARRAY<DOUBLE>")
    root = {i: i for i, _ in data}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    length = lambda v: sum(x * x for x in v) ** 0.5
    for a, v in data:
        for b, w in data:
            if a < b and length(v) and length(w) and sum(x * y for x, y in zip(v, w)) / length(v) / length(w) >= least and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    members = {}
    for i in root:
        members.setdefault(find(i), []).append(i)
    want = {i: r for r, m in members.items() for i in m if len(m) > 1}
    edges = nearpairs.near_edges(df, least=least, cells=5, sample=40, block=block)
    assert {r.id: r.merged_id for r in vec.merged_ids(edges).collect()} == want
    assert nearpairs.near_edges(df.limit(0), least=least).collect() == []


def test_near_pairs_keep_a_row_per_vector_until_the_join(spark, monkeypatch):
    rnd = random.Random(4)
    data = [(f"id{i:03d}", [rnd.gauss(0, 1) for _ in range(12)]) for i in range(150)]
    counts, cut = [], nearpairs.cut_lineage

    def counted(df):
        out = cut(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(nearpairs, "cut_lineage", counted)
    nearpairs.near_edges(spark.createDataFrame(data, "id STRING, vec ARRAY<DOUBLE>"), least=0.3, cells=6, sample=40, block=40).collect()
    assert counts and max(counts) <= len(data)


def rows_shuffled(spark):
    """Rows written to shuffles by all stages of the session so far."""
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_near_pairs_of_one_group_are_not_sent_block_by_block(spark):
    rnd = random.Random(6)
    data = [(f"id{i:04d}", [1.0 + rnd.gauss(0, 0.5) for _ in range(8)]) for i in range(1500)]
    before = rows_shuffled(spark)
    edges = nearpairs.near_edges(spark.createDataFrame(data, "id STRING, vec ARRAY<DOUBLE>"), least=0.5, cells=4, sample=40, block=50)
    merged = {r.id: r.merged_id for r in vec.merged_ids(edges).collect()}
    assert len(merged) == 1500 and set(merged.values()) == {"id0000"}
    sent = sum(n for k, n in rows_shuffled(spark).items() if k not in before)
    # all blocks meeting all: 2 * 1500 * 1500 / 50 rows
    assert 0 < sent < 60_000


def test_near_pairs_beside_a_vector_that_is_not_finite(spark):
    rnd = random.Random(8)
    data = [(f"id{i:03d}", [1.0 + rnd.gauss(0, 0.1) for _ in range(4)]) for i in range(30)]
    data += [("nan", [float("nan"), 1.0, 1.0, 1.0]), ("inf", [float("inf"), 1.0, 1.0, 1.0]), ("none", None)]
    edges = nearpairs.near_edges(spark.createDataFrame(data, "id STRING, vec ARRAY<DOUBLE>"), least=0.5, cells=3, sample=40, block=5)
    merged = {r.id: r.merged_id for r in vec.merged_ids(edges).collect()}
    assert merged == {f"id{i:03d}": "id000" for i in range(30)}


def test_forest_joins_what_is_near_in_dense_and_sparse_slices(monkeypatch):
    monkeypatch.setattr(nearpairs, "COSINES", 90)
    rng = np.random.default_rng(3)
    for spread, least in ((0.2, 0.9), (0.6, 0.9), (3.0, 0.95)):
        v = rng.normal(size=(6, 5))[rng.integers(6, size=70)] + rng.normal(size=(70, 5)) * spread
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        ids = np.array([f"v{rng.integers(50):02d}" for _ in range(70)], dtype=object)
        left, right = v[:40], v[30:]
        near = {(a, b) for i, a in enumerate(ids[:40]) for k, b in enumerate(ids[30:]) if left[i] @ right[k] >= least}
        label = {i: i for i in ids}
        for _ in range(70):
            for a, b in near:
                label[a] = label[b] = min(label[a], label[b])
        got = nearpairs.forest(left, right, ids[:40], ids[30:], least)
        assert sorted(got) == sorted((r, i) for i, r in label.items() if r != i)

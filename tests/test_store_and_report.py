"""Stores, sinks, splits and diagnosis on hand-made tables."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import explain as ex
from tidemark.operators import sampling
from tidemark.sources import records, sinks, store


def test_merging_one_signal_leaves_the_rest(spark, tmp_path):
    path = str(tmp_path / "t")
    sch = "video_id STRING, signal STRING, sec INT, value DOUBLE"
    first = [(f"v{i}", s, 0, 1.0) for i in range(30) for s in ("audio", "motion")]
    store.merge_signal(spark, path, spark.createDataFrame(first, sch))
    store.merge_signal(spark, path, spark.createDataFrame([("v3", "audio", 5, 9.0), ("new", "audio", 1, 2.0)], sch))
    got = {(r.video_id, r.signal): (r.sec, r.value) for r in spark.read.parquet(path).collect()}
    assert len(got) == 61 and got["v3", "audio"] == (5, 9.0) and got["v3", "motion"] == (0, 1.0)
    assert got["new", "audio"] == (1, 2.0) and got["v4", "audio"] == (0, 1.0)


def test_signature_depends_on_values_not_on_order(spark, tmp_path):
    df = spark.createDataFrame([("v", 1, "x"), ("v", 2, "x")], "video_id STRING, a INT, b STRING")
    sig = [tuple(r) for r in df.select(store.signature("a", "b").alias("p"), store.signature("b", "a").alias("q")).collect()]
    assert sig[0][0] == sig[0][1] != sig[1][0] and len(sig[0][0]) == 16
    store.save_signed(df, str(tmp_path / "s"), ["a", "b"])
    assert store.load_signed(spark, str(tmp_path / "s"), sig[1][0]).collect()[0].a == 2


def test_records_round_trip(spark, tmp_path):
    doc = {
        "video_id": "v", "duration": 9.0,
        "transcript": {"segments": [{"start": 1.0, "end": 2.0, "text": "hi", "speaker": "A"}]},
        "objects": [{"sec": 3, "labels": ["cat", "cat", "dog"]}],
        "actions": [{"ts": 1.5, "frame_id": 4, "label_id": 1, "conf": 0.5, "label": "run"}],
        "scenes": [{"start": 0.0, "end": 4.0}], "audio_peaks": [2.5], "levels": [0.1, 0.2],
        "waveform": [{"lo": -1.0, "hi": 1.0, "rms": 0.5}],
        "boxes": [{"ts": 0.0, "objects": ["cat", "dog"], "bboxes": [[0.1, 0.2, 0.3, 0.4], [0, 0, 1, 1]], "confidences": [0.9]}],
    }
    (tmp_path / "r.json").write_text(json.dumps(doc))
    r = records.read(spark, str(tmp_path))
    assert sorted(x.label for x in records.labels(r).collect()) == ["cat", "cat", "dog"]
    assert records.points(r).collect()[0].asDict() == {"video_id": "v", "signal": "audio_peaks", "t": 2.5}
    assert [(b.label, b.h, b.conf) for b in records.boxes(r).orderBy("idx").collect()] == [("cat", 0.4, 0.9), ("dog", 1.0, 1.0)]
    assert records.boxes(r, 0.0).orderBy("idx").collect()[1].conf == 0.0
    assert records.segments(r).count() == records.scenes(r).count() == records.detections(r).count() == 1
    assert [x.value for x in records.levels(r).orderBy("sec").collect()] == [0.1, 0.2] and records.wave(r).count() == 1


def test_writers(spark, tmp_path):
    cues = spark.createDataFrame([("v", 1, 0.0, 1.5, "One"), ("v", 2, 61.25, 3723.75, "Two")], "video_id STRING, cue LONG, start DOUBLE, end DOUBLE, text STRING")
    sinks.write_text(sinks.subtitle_blocks(cues, ["video_id"]), str(tmp_path / "srt"), ["video_id"], "cue")
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "srt" / "video_id=v").glob("*.txt")))
    assert text == "1\n00:00:00,000 --> 00:00:01,500\nOne\n\n2\n00:01:01,250 --> 01:02:03,750\nTwo\n\n"
    clips = spark.createDataFrame([("v", 1, 10.0, 12.0), ("v", 2, 20.0, 21.5)], "video_id STRING, idx INT, start DOUBLE, end DOUBLE")
    sinks.write_project(sinks.project_clips(clips, ["video_id"]), str(tmp_path / "xml"))
    back = spark.read.option("rowTag", "clip").format("xml").load(str(tmp_path / "xml")).orderBy("_name").collect()
    assert [(b._name, b._duration, b._start) for b in back] == [("Clip 1", "6000s", "30000s"), ("Clip 2", "4500s", "60000s")]
    det = spark.createDataFrame([(75.4, 9, "cat", 0.123456)], "ts DOUBLE, frame_id LONG, label STRING, conf DOUBLE")
    sinks.write_csv(sinks.detection_log(det), str(tmp_path / "csv"))
    parts = [p.read_text() for p in (tmp_path / "csv").glob("*.csv")]  # empty tasks may write a header of their own
    assert max(parts, key=len) == "timestamp,frame_id,label,confidence,second\n01:15,9,cat,0.1235,75\n"


def test_resplit_is_exact_and_repeatable(spark):
    data = [(i, "thin" if i < 40 else "fine" if i < 60 else "tiny", i >= 40 and i % 2 == 0) for i in range(63)]
    df = spark.createDataFrame(data, "id INT, label STRING, is_val BOOLEAN")
    one = sampling.resplit(df, label="label", ident="id", is_val="is_val")
    two = sampling.resplit(df.repartition(5), label="label", ident="id", is_val="is_val")
    a, b = sorted(map(tuple, one.collect())), sorted(map(tuple, two.collect()))
    assert a == b
    assert sum(r[2] for r in a if r[1] == "thin") == 8 and sum(1 for r in a if r[1] == "thin") == 40
    assert [r for r in a if r[1] == "fine"] == [d for d in data if d[1] == "fine"]
    assert not [r for r in a if r[1] == "tiny"]


def one_video(spark, **over):
    clip = "v INT, idx INT, start DOUBLE, end DOUBLE, score DOUBLE, n_signals INT, signals ARRAY<STRING>"
    parts = {
        "videos": spark.createDataFrame([(1, 600.0)], "v INT, duration DOUBLE"),
        "clips": spark.createDataFrame([(1, i, 90.0 + 10 * i, 98.0 + 10 * i, 5.0, 1, ["object"]) for i in range(4)], clip),
        "near": spark.createDataFrame([(1, ["audio", "object"])], "v INT, signals ARRAY<STRING>"),
        "totals": spark.createDataFrame([(1, "object", 20.0), (1, "beginning", 3.0)], "v INT, signal STRING, total DOUBLE"),
        "tags": spark.createDataFrame([(1, i, "cat") for i in range(4)] + [(1, 0, "dog")], "v INT, idx INT, tag STRING"),
        "activity": spark.createDataFrame([(1, "scene", 300), (1, "audio", 5)], "v INT, signal STRING, found LONG"),
        "reading_counts": spark.createDataFrame([(1, "sad", 30), (1, "happy", 10)], "v INT, label STRING, n LONG"),
        "rejected": spark.createDataFrame([(1, 90.0, 105.0)], "v INT, start DOUBLE, end DOUBLE"),
        "gaps": spark.createDataFrame([(1, "kettle")], "v INT, word STRING"),
        "claims": spark.createDataFrame([(1, 4.0)], "v INT, score DOUBLE"),
        "checks": spark.createDataFrame([(1, "r1", "fired"), (1, "r2", "never_fired"), (1, "r3", "not_in_rules")], "v INT, rule STRING, state STRING"),
    }
    parts.update(over)
    return ex.video_facts(**parts, keys=["v"])


SETTINGS = {"weights": {"object": 1.0, "action": 4.0, "face": 1.0}, "coverage": 0.1, "target": 60.0, "boost": 1.5, "min_signals": 3, "face_labels": []}


def test_every_diagnosis_rule_fires(spark):
    got = {r.finding: (r.severity, r.evidence) for r in ex.diagnose(one_video(spark), ["v"], SETTINGS, concern="repetitive").collect()}
    assert got == {
        "single_signal": ("high", "object"),
        "flat_score": ("medium", "4"),
        "concentrated": ("medium", "0.0633"),
        "boost_never_fired": ("low", "1"),
        "near_miss_gap": ("medium", "audio"),
        "dominant_tag": ("low", "cat"),
        "short_of_target": ("medium", "32.0"),
        "expressions_unselected": ("medium", "1.0"),
        "expression_lopsided": ("medium", "sad"),
        "unchecked_vocabulary": ("medium", "1"),
        "unmeasured_claim": ("medium", "1"),
        "rejected_share_a_tag": ("high", "cat"),
        "concern_repetitive": ("high", "object"),
        "silent_action": ("medium", "4.0"),
        "silent_face": ("medium", "1.0"),
        "unused_scene": ("high", "300"),
        "check_fired:r1": ("low", "r1"),
        "check_silent:r2": ("medium", "r2"),
        "check_missing:r3": ("high", "r3"),
    }


def test_a_healthy_video_has_no_findings(spark):
    clip = "v INT, idx INT, start DOUBLE, end DOUBLE, score DOUBLE, n_signals INT, signals ARRAY<STRING>"
    facts = one_video(
        spark,
        clips=spark.createDataFrame([(1, i, 120.0 * i, 120.0 * i + 20, 5.0 + i, 3, ["object", "action", "audio"]) for i in range(4)], clip),
        totals=spark.createDataFrame([(1, s, 9.0) for s in ("object", "action", "face")], "v INT, signal STRING, total DOUBLE"),
        tags=spark.createDataFrame([(1, i, f"t{i}") for i in range(4)], "v INT, idx INT, tag STRING"),
        activity=spark.createDataFrame([(1, "scene", 3)], "v INT, signal STRING, found LONG"),
        reading_counts=spark.createDataFrame([(1, "sad", 10), (1, "happy", 15), (1, "anger", 12)], "v INT, label STRING, n LONG"),
        rejected=spark.createDataFrame([], "v INT, start DOUBLE, end DOUBLE"),
        gaps=spark.createDataFrame([], "v INT, word STRING"),
        claims=spark.createDataFrame([], "v INT, score DOUBLE"),
        checks=spark.createDataFrame([], "v INT, rule STRING, state STRING"),
    )
    assert ex.diagnose(facts, ["v"], {**SETTINGS, "face_labels": ["happy"]}).collect() == []


def test_paired_levels_under_the_noise_are_refused(spark):
    from math import comb

    from tidemark.operators.compare import paired_comparison

    noisy = [(1, float(x)) for x in (5, -4, 6, -7, 3, -2)]
    clear = [(2, 3.0 + i / 10) for i in range(12)]
    df = spark.createDataFrame(noisy + clear, "v INT, difference DOUBLE")
    got = {r.v: r for r in paired_comparison(df, ["v"]).collect()}
    assert not got[1].resolvable and got[2].resolvable
    assert got[1].p_value == pytest.approx(min(1.0, 2 * sum(comb(6, i) for i in range(3, 7)) / 64), abs=1e-4)
    assert got[2].p_value == pytest.approx(2 / 2**12, abs=1e-4)


def test_index_grows_by_unseen_keys_only(spark, tmp_path):
    from tidemark.streaming import engine as se

    src, out = str(tmp_path / "in"), str(tmp_path / "index")
    for lo in (0, 5):
        df = spark.range(lo, lo + 10).select(F.format_string("v%d", F.col("id") % 3).alias("video_id"), F.col("id").alias("ts_ms"), F.lit(lo).alias("lo"))
        df.unionByName(df).coalesce(1).write.mode("append").parquet(src)
    raw = spark.readStream.schema("video_id STRING, ts_ms LONG, lo INT").option("maxFilesPerTrigger", 1).parquet(src)
    for run in (1, 2):  # the second run, with a checkpoint of its own, brings every batch again
        q = se.grow_index(raw, out, ["video_id", "ts_ms"], buckets=4).option("checkpointLocation", str(tmp_path / f"c{run}")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = spark.read.parquet(out).collect()
        assert sorted(r.ts_ms for r in got) == list(range(15))
        assert {r.ts_ms: r.lo for r in got}[7] == 0  # the first one stays
    plan = spark.read.parquet(out).filter("_bucket = 1").select("ts_ms")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan


def test_page_durations_of_large_ids(spark, tmp_path):
    from tidemark.plans import load_all
    from tidemark.sources import pages

    rows = [(n, "https://a.example/x", "<html></html>") for n in (86093, 86100, 86102, 700_000_001, 700_000_000, 700_000_002)]
    spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.source, r.seconds) for r in load_all()["s17_page_durations"].run(spark, str(tmp_path)).collect()}
    want = {0: lambda n: ("meta", n + 300.0), 1: lambda n: ("structured", 3600.0 + n % 60), 2: lambda n: ("script", n + 100.0)}
    assert got == {n: want[n % 7](n) for n, _, _ in rows}
    page = spark.createDataFrame([(1, '<meta name="duration" content="90000">', "u")], "page_id LONG, html STRING, url STRING")
    assert [r.seconds for r in pages.page_durations(page).collect()] == [90.0]

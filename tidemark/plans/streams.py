"""Streaming forms over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.plans.registry import query
from tidemark.streaming import engine

SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _events(spark, sf):
    """The event table as a stream; times as UTC timestamps."""
    raw = spark.readStream.schema(SCHEMA).parquet(f"{sf}/event*.parquet")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return raw.select("event_id", F.timestamp_micros(micros).alias("at"), F.col("user_id").alias("video_id"), "event_type", "value")


_MICROS = "epoch_us(ts)"


@query(
    "r5_stream_sessions",
    "R5 W8",
    f"""WITH e AS (SELECT user_id AS video_id, {_MICROS} AS t FROM events), f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY video_id ORDER BY t) <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM e),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM f), c AS (SELECT video_id, s, count(*) AS points, min(t) AS a, max(t) AS b FROM g GROUP BY ALL)
    SELECT video_id, points, a AS start_us, b AS end_us FROM c""",
)
def stream_sessions(spark, sf):
    """Six-hour sessions of all events, closed by the watermark or by the end of the input."""

    def query(rows):
        s = engine.sessions(rows, ["video_id"], at="at", gap="6 hours", late="1 hour")
        return s.select("video_id", "points", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"))

    return engine.run_to_end(_events(spark, sf), "at", query, "sessions")


@query(
    "r4_stream_features",
    "R4",
    f"""WITH e AS (SELECT user_id AS video_id, {_MICROS} AS t, value FROM events)
    SELECT video_id, t // 21600000000 * 21600000000 AS start_us, count(*) AS samples, min(value) AS lo, max(value) AS hi, round(sqrt(avg(value * value)), 6) AS rms FROM e
    GROUP BY video_id, t // 21600000000""",
)
def stream_features(spark, sf):
    """Level features of every six-hour window, closed by the watermark or by the end of the input."""

    def query(rows):
        f = engine.second_features(rows, ["video_id"], at="at", value="value", width="6 hours", late="1 hour")
        return f.select("video_id", F.unix_micros("start").alias("start_us"), "samples", "lo", "hi", F.round("rms", 6).alias("rms"))

    return engine.run_to_end(_events(spark, sf), "at", query, "features")


@query("r6_stream_first_arrivals", "R6", "SELECT event_id, user_id AS video_id FROM events")
def stream_first_arrivals(spark, sf):
    """Every event once, though each arrives twice."""
    e = _events(spark, sf)
    twice = e.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_copy"))
    d = engine.first_arrivals(twice, ["event_id"], at="at", late="1 hour")
    return engine.run_available(d.select("event_id", "video_id"), "arrivals")


@query("r1_stream_rule_events", "R1 A42 W11 W16")
def stream_rule_events(spark, sf):
    """All rules as a stream over the boxes and signals of every video, each closed by an end row."""
    from tidemark.plans.rules import RULES, inputs
    from tidemark.streaming import rules as stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", engine.ROCKSDB)
    raw = spark.readStream.schema("vec_id BIGINT, embedding ARRAY<FLOAT>, label INT").parquet(f"{sf}/embedding*.parquet")
    boxes = stream.box_rows(fx.box_columns(raw).withColumn("ts", F.col("frame").cast("double")))
    b, signals, videos = inputs(spark, sf)
    counts = b.select("video_id").unionByName(signals.select("video_id")).groupBy("video_id").agg(F.count("*").alias("rows"))
    side = stream.signal_rows(signals).unionByName(stream.end_rows(videos.join(counts, "video_id")))
    folder = engine.shared_folder(spark, "signals")
    side.write.parquet(folder)
    rows = boxes.unionByName(spark.readStream.schema(side.schema).parquet(folder))
    m = engine.run_available(stream.rule_stream(rows, RULES), "rules")
    return m.select("video_id", "ts", "event", *[F.round(c, 6).alias(c) for c in ("conf", "x", "y", "w", "h")])

"""Nested analysis records (one JSON document per video) to the long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import RECORD


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records with the explicit schema; nothing is inferred."""
    return spark.read.schema(RECORD).json(path)


def parse(texts: DataFrame, column: str = "record") -> DataFrame:
    """Records held as JSON text in a table."""
    return texts.select(F.from_json(column, RECORD).alias("_r")).select("_r.*")


def video(records: DataFrame) -> DataFrame:
    return records.select("video_id", "duration", "fps", "total_frames")


def segments(records: DataFrame) -> DataFrame:
    return records.select("video_id", F.inline("transcript.segments"))


def labels(records: DataFrame) -> DataFrame:
    return records.select("video_id", F.inline("objects")).select("video_id", "sec", F.explode("labels").alias("label"))


def detections(records: DataFrame) -> DataFrame:
    return records.select("video_id", F.inline("actions"))


def scenes(records: DataFrame) -> DataFrame:
    return records.select("video_id", F.inline("scenes"))


def points(records: DataFrame) -> DataFrame:
    """Motion and audio points of a record in one pass."""

    def named(signal: str):
        times = F.coalesce(F.col(signal), F.array().cast("array<double>"))
        return F.transform(times, lambda t: F.struct(F.lit(signal).alias("signal"), t.alias("t")))

    signals = ("motion_events", "motion_peaks", "audio_peaks")
    return records.select("video_id", F.inline(F.concat(*[named(s) for s in signals])))


def wave(records: DataFrame) -> DataFrame:
    return records.select("video_id", F.posexplode("waveform").alias("bin", "_w")).select("video_id", "bin", "_w.*")


def levels(records: DataFrame) -> DataFrame:
    return records.select("video_id", F.posexplode("levels").alias("sec", "value"))


def boxes(records: DataFrame, missing_conf: float = 1.0) -> DataFrame:
    """Frame boxes; a missing confidence reads as *missing_conf* (1 in rules, 0 in reports)."""
    f = records.select("video_id", F.inline("boxes"))
    return f.select("video_id", "ts", "bboxes", "confidences", F.posexplode("objects").alias("idx", "label")).select(
        "video_id",
        "ts",
        "idx",
        "label",
        *[F.get(F.get("bboxes", F.col("idx")), F.lit(i)).alias(c) for i, c in enumerate("xywh")],
        F.coalesce(F.get("confidences", F.col("idx")), F.lit(missing_conf)).alias("conf"),
    )

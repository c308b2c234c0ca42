"""Text forms of results: logs, subtitles, edit lists and chapter lists.

Each function builds the lines as rows; the writers put one folder per call, in
order within a video.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timefmt import long_clock, srt_time, timecode


def detection_log(detections: DataFrame, *, ts: str = "ts") -> DataFrame:
    """Rows of the detection log (timestamp as MM:SS)."""
    s = F.floor(ts).cast("int")
    return detections.select(
        F.format_string("%02d:%02d", F.floor(s / 60).cast("int"), s % 60).alias("timestamp"),
        "frame_id",
        "label",
        F.round("conf", 4).alias("confidence"),
        s.alias("second"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def subtitle_blocks(cues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One SRT block per cue."""
    block = F.concat(
        F.col("cue").cast("string"),
        F.lit("\n"),
        srt_time(F.col("start")),
        F.lit(" --> "),
        srt_time(F.col("end")),
        F.lit("\n"),
        F.col("text"),
        F.lit("\n"),
    )
    return cues.select(*keys, "cue", block.alias("value"))


def edit_list(clips: DataFrame, keys: Sequence[str], *, reel: Column, fps: float = 30.0) -> DataFrame:
    """CMX3600 entries: source in/out and record in/out of each clip in order."""
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    length = F.col("end") - F.col("start")
    before = F.coalesce(F.sum(length).over(w), F.lit(0.0))
    x = clips.withColumn("_rec", before)
    line = F.concat(
        F.format_string("%03d  %-8s V     C        ", F.col("idx"), F.upper(F.substring(reel, 1, 8))),
        timecode(F.col("start"), fps),
        F.lit(" "),
        timecode(F.col("end"), fps),
        F.lit(" "),
        timecode(F.col("_rec"), fps),
        F.lit(" "),
        timecode(F.col("_rec") + length, fps),
    )
    return x.select(*keys, "idx", line.alias("value"))


def project_clips(clips: DataFrame, keys: Sequence[str], *, fps: float = 30.0) -> DataFrame:
    """Clips as XML rows of an editing project (attributes start with an underscore)."""
    unit = fps * 100
    ticks = lambda c: F.concat(F.floor(c * unit).cast("long").cast("string"), F.lit("s"))
    at = F.struct(F.struct(F.lit("start").alias("_relative"), ticks(F.col("start")).alias("_value")).alias("offset"))
    return clips.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.concat(F.lit("Clip "), F.col("idx").cast("string")).alias("_name"),
        ticks(F.col("end") - F.col("start")).alias("_duration"),
        ticks(F.col("start")).alias("_start"),
        at.alias("video"),
        at.alias("audio"),
    )


def write_project(clips: DataFrame, path: str) -> None:
    clips.write.mode("overwrite").option("rootTag", "spine").option("rowTag", "clip").format("xml").save(path)


def chapter_metadata(chapters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ffmetadata blocks with whole milliseconds and escaped titles; empty chapters left out."""
    a = F.rint(F.col("start") * 1000).cast("long")
    b = F.rint(F.col("end") * 1000).cast("long")
    title = F.regexp_replace(F.regexp_replace("title", r"\\", r"\\\\"), r"([=;#\n])", r"\\$1")
    block = F.concat(
        F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="),
        a.cast("string"),
        F.lit("\nEND="),
        b.cast("string"),
        F.lit("\ntitle="),
        title,
    )
    return chapters.filter(b > a).select(*keys, "number", block.alias("value"))


def chapter_lines(chapters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``H:MM:SS title`` lines."""
    return chapters.select(
        *keys, "number", F.rtrim(F.concat(long_clock(F.col("start")), F.lit(" "), F.col("title"))).alias("value")
    )


def write_text(lines: DataFrame, path: str, keys: Sequence[str], order: str) -> None:
    """One folder per entity, lines in order."""
    (
        lines.repartition(*keys)
        .sortWithinPartitions(*keys, order)
        .select(*keys, "value")
        .write.mode("overwrite")
        .partitionBy(*keys)
        .text(path)
    )

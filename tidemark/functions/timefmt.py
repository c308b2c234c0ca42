"""Time as text and text as time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _i(c: Column) -> Column:
    return c.cast("int")


def srt_time(seconds: Column) -> Column:
    """``HH:MM:SS,mmm``; milliseconds are cut off, not rounded."""
    s = F.greatest(F.lit(0.0), seconds.cast("double"))
    whole = F.floor(s)
    return F.format_string(
        "%02d:%02d:%02d,%03d",
        _i(F.floor(whole / 3600)),
        _i(F.floor(whole % 3600 / 60)),
        _i(whole % 60),
        F.least(F.lit(999), _i(F.floor((s - whole) * 1000))),
    )


def clock(seconds: Column) -> Column:
    """``M:SS``, or ``H:MM:SS`` from an hour on."""
    t = F.floor(seconds)
    h, m, s = _i(F.floor(t / 3600)), _i(F.floor(t % 3600 / 60)), _i(t % 60)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def long_clock(seconds: Column) -> Column:
    """``H:MM:SS`` of the nearest second (half to even)."""
    t = F.greatest(F.lit(0.0), F.rint(seconds))
    return F.format_string("%d:%02d:%02d", _i(F.floor(t / 3600)), _i(F.floor(t % 3600 / 60)), _i(t % 60))


def timecode(seconds: Column, fps: float) -> Column:
    """``HH:MM:SS:FF`` at a frame rate."""
    base = int(round(fps))
    frames = F.rint(seconds * fps).cast("long")
    total = F.floor(frames / base)
    return F.format_string(
        "%02d:%02d:%02d:%02d",
        _i(F.floor(total / 3600)),
        _i(F.floor(total % 3600 / 60)),
        _i(total % 60),
        _i(frames % base),
    )


# Fixed value: plain seconds, or [HH:]MM:SS, with an optional fraction.
_TOKEN = r"^\d+(\.\d+)?$|^(\d+:)?\d+:\d+(\.\d+)?$"
_RANGE = r"^(.*?)(-|→|—|to)(.*)$"


def parse_time(token: Column) -> Column:
    """``[HH:]MM:SS[.f]`` or plain seconds to seconds; anything else is NULL."""
    t = F.trim(token)
    total = F.aggregate(
        F.split(t, ":"), F.lit(0.0), lambda acc, part: acc * 60 + part.try_cast("double")
    )
    return F.when(t.rlike(_TOKEN), total)


def parse_range(text: Column) -> Column:
    """``a-b`` to ``struct(start, end)``: start clamped at 0, NULL unless end > start."""
    ends = F.array(*[parse_time(F.regexp_extract(text, _RANGE, i)) for i in (1, 3)])
    kept = F.transform(
        F.array(ends),
        lambda e: F.when(
            e[1] > F.greatest(F.lit(0.0), e[0]),
            F.struct(F.greatest(F.lit(0.0), e[0]).alias("start"), e[1].alias("end")),
        ),
    )
    return kept[0]

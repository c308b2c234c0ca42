"""Chapters, classes and levels measured against the whole video."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assign_chapters(clips: DataFrame, chapters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chapter number of each clip by its start; 0 where there is none.

    A video's chapters partition its axis, so they are few and travel as one
    array per video; the search stays in one expression.
    """
    table = chapters.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "number"))).alias("_ch")
    )
    at = F.col("start")
    inside = F.filter("_ch", lambda c: (c["start"] <= at) & (at < c["end"]))
    last = F.element_at("_ch", -1)
    number = F.coalesce(
        F.get(inside, F.lit(0))["number"],
        F.when(at >= last["end"], last["number"]),
        F.lit(0),
    )
    return clips.join(table, list(keys), "left").withColumn("chapter", number).drop("_ch")


def observed_classes(labels: DataFrame, composed: DataFrame) -> DataFrame:
    """Distinct classes seen, less the composed ones."""
    return labels.select("label").distinct().join(composed.select("label"), "label", "left_anti")


def peak_in_range(
    curve: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    *,
    ident: Sequence[str],
    value: str,
    tick: str = "sec",
) -> DataFrame:
    """First loudest second of each span (end included) and its distance to the
    video's median."""
    from tidemark.operators.joins import points_in_spans

    med = curve.groupBy(*keys).agg(F.median(value).alias("_med"))
    wide = spans.select(*keys, *ident, F.floor("start").alias("_lo"), F.ceil("end").alias("_hi"))
    hits = points_in_spans(curve, wide, keys, t=tick, start="_lo", end="_hi", closed_end=True)
    best = hits.groupBy(*keys, *ident).agg(
        F.max_by(tick, F.struct(F.col(value), -F.col(tick))).alias("second"), F.max(value).alias("_v")
    )
    return best.join(med, list(keys)).select(
        *keys,
        *ident,
        "second",
        F.round("_v", 2).alias("level"),
        F.round(F.col("_v") - F.col("_med"), 2).alias("vs_video"),
    )


# Sample and effect bars.
MIN_SECONDS_FOR_LIFT = 8
NOTABLE_LIFT = 1.4
CHANGE_POINTS = 12.0
DOMINANT_SHARE = 45.0
MDE_FACTOR = 2.8


def _r(c, places: int, digits: int | None):
    """Round for reporting: the usual *places* unless the caller asks for *digits*."""
    return F.round(c, places if digits is None else digits)


def box_area(w: str = "w", h: str = "h"):
    """Share of the frame a normalised box covers."""
    return F.greatest(F.lit(0.0), F.col(w)) * F.greatest(F.lit(0.0), F.col(h))


def largest_instances(boxes: DataFrame, keys: Sequence[str], *, tick: str, order: str = "idx") -> DataFrame:
    """The biggest box of each class and second, the first one on ties."""
    b = boxes.withColumn("area", box_area()).filter((F.col("area") > 0) & (F.col("label") != ""))
    best = F.max_by(F.struct("area", "conf"), F.struct(F.col("area"), -F.col(order)))
    return b.groupBy(*keys, tick, "label").agg(best.alias("_b")).select(*keys, tick, "label", "_b.*")


def presence(marks: DataFrame, keys: Sequence[str], *, tick: str = "sec") -> DataFrame:
    """Seconds per class with the video's detected seconds and span."""
    m = marks.select(*keys, tick, "label").distinct()
    per = m.groupBy(*keys, "label").agg(F.count("*").alias("seconds_with"))
    whole = (
        m.groupBy(*keys, tick)
        .agg(F.lit(1).alias("_1"))
        .groupBy(*keys)
        .agg(F.count("*").alias("detected_seconds"), (F.max(tick) + 1).alias("span"))
    )
    return per.join(whole, list(keys))


def pair_seconds(marks: DataFrame, keys: Sequence[str], *, tick: str = "sec") -> DataFrame:
    """Seconds each ordered pair of classes shares.

    Seconds are folded to their distinct set of classes and identical sets are
    counted before any pair is formed, so the work follows the number of
    different sets and not of seconds.
    """
    sets = (
        marks.groupBy(*keys, tick)
        .agg(F.array_sort(F.collect_set("label")).alias("_set"))
        .groupBy(*keys, "_set")
        .agg(F.count("*").alias("_n"))
    )
    pairs = sets.select(*keys, "_n", "_set", F.explode("_set").alias("label")).select(
        *keys, "_n", "label", F.explode("_set").alias("other")
    )
    return (
        pairs.filter("label <> other").groupBy(*keys, "label", "other").agg(F.sum("_n").alias("seconds"))
    )


def level_by_class(
    marks: DataFrame, levels: DataFrame, keys: Sequence[str], *, value: str, min_seconds: int = 8, digits: int | None = None
) -> DataFrame:
    """Seconds, median and quartiles of the level per class with enough seconds."""
    m = marks.select(*keys, "sec", "label").distinct().join(levels, [*keys, "sec"])
    return (
        m.groupBy(*keys, "label")
        .agg(
            F.count("*").alias("seconds"),
            F.percentile(value, F.array(*[F.lit(p) for p in (0.5, 0.25, 0.75)])).alias("_p"),
        )
        .filter(F.col("seconds") >= min_seconds)
        .select(
            *keys,
            "label",
            "seconds",
            _r(F.col("_p")[0], 2, digits).alias("median_level"),
            _r(F.col("_p")[1], 2, digits).alias("p25_level"),
            _r(F.col("_p")[2], 2, digits).alias("p75_level"),
        )
    )


def matched_controls(
    marks: DataFrame,
    levels: DataFrame,
    pairs: DataFrame,
    keys: Sequence[str],
    *,
    value: str,
    window: int = 120,
    stretch_gap: int = 30,
    min_each: int = 3, digits: int | None = None
) -> DataFrame:
    """Median level of each stretch of class A less that of nearby class-B seconds.

    *pairs* has ``a`` and ``b`` per video. B-seconds that also carry A do not
    count, nor do those inside the stretch; both sides need *min_each* seconds.
    """
    from tidemark.operators.islands import point_islands
    from tidemark.operators.joins import points_in_spans

    m = marks.select(*keys, "sec", "label").distinct().join(pairs, list(keys))
    a = m.filter("label = a").select(*keys, "sec")
    b = m.filter("label = b").select(*keys, "sec").join(a, [*keys, "sec"], "left_anti")
    stretches = point_islands(a, keys, "sec", stretch_gap).select(
        *keys,
        F.col("start").alias("lo"),
        F.col("end").alias("hi"),
        (F.col("start") - window).alias("wlo"),
        (F.col("end") + window).alias("whi"),
    )
    ident = [*keys, "lo", "hi"]
    inside = points_in_spans(
        a.join(levels, [*keys, "sec"]), stretches, keys, t="sec", start="lo", end="hi", closed_end=True
    )
    near = points_in_spans(
        b.join(levels, [*keys, "sec"]), stretches, keys, t="sec", start="wlo", end="whi", closed_end=True
    ).filter((F.col("sec") < F.col("lo")) | (F.col("sec") > F.col("hi")))
    sides = (
        inside.select(*ident, value, F.lit(True).alias("_in"))
        .unionByName(near.select(*ident, value, F.lit(False).alias("_in")))
        .groupBy(*ident)
        .agg(
            F.count(F.when(F.col("_in"), 1)).alias("n_class"),
            F.count(F.when(~F.col("_in"), 1)).alias("n_control"),
            F.median(F.when(F.col("_in"), F.col(value))).alias("_a"),
            F.median(F.when(~F.col("_in"), F.col(value))).alias("_b"),
        )
    )
    return sides.filter((F.col("n_class") >= min_each) & (F.col("n_control") >= min_each)).select(
        *keys,
        F.col("lo").alias("start"),
        F.col("hi").alias("end"),
        "n_class",
        "n_control",
        _r(F.col("_a") - F.col("_b"), 2, digits).alias("difference"),
    )


def sign_test(n, k):
    """Two-sided exact sign test for *k* >= n/2 of *n* signs, term by term from the tail."""
    start = F.struct((-n * F.log(F.lit(2.0))).alias("lt"), F.lit(0.0).alias("sum"))
    fold = F.aggregate(
        F.sequence(n, k, F.lit(-1).cast("long")),
        start,
        lambda s, i: F.struct(
            (s["lt"] + F.log(i.cast("double")) - F.log((n - i + 1).cast("double"))).alias("lt"),
            (s["sum"] + F.exp(s["lt"])).alias("sum"),
        ),
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * fold["sum"]))


def paired_comparison(diffs: DataFrame, keys: Sequence[str], *, digits: int | None = None
) -> DataFrame:
    """Median of paired differences, what the sample could resolve, and the sign test."""
    pos = F.count(F.when(F.col("difference") > 0, 1))
    neg = F.count(F.when(F.col("difference") < 0, 1))
    s = diffs.groupBy(*keys).agg(
        F.count("*").alias("pairs"),
        F.median("difference").alias("_obs"),
        F.coalesce(F.stddev_samp("difference"), F.lit(0.0)).alias("_sd"),
        (pos + neg).alias("_n"),
        F.greatest(pos, neg).alias("_k"),
    )
    mde = F.when(F.col("_sd") > 0, F.lit(MDE_FACTOR) * F.col("_sd") / F.sqrt("pairs")).otherwise(0.0)
    x = s.withColumn("_mde", mde).withColumn("_p", sign_test(F.col("_n"), F.col("_k")))
    return x.select(
        *keys,
        "pairs",
        _r("_obs", 2, digits).alias("median_difference"),
        _r("_sd", 2, digits).alias("spread"),
        _r("_mde", 2, digits).alias("min_detectable"),
        _r("_p", 4, digits).alias("p_value"),
        ((F.abs("_obs") >= F.col("_mde")) & (F.col("_p") < 0.05)).alias("resolvable"),
    )


def seconds_in_chapters(seconds: DataFrame, chapters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per-second rows with the number of each chapter whose whole seconds hold them."""
    from tidemark.operators.joins import points_in_spans

    ch = chapters.select(
        *keys, "number", F.floor("start").alias("_lo"), F.ceil("end").alias("_hi")
    )
    return points_in_spans(seconds, ch, keys, t="sec", start="_lo", end="_hi", bin_width=600).drop("_lo", "_hi")


def prevalence_lift(marks: DataFrame, chapters: DataFrame, keys: Sequence[str], *, digits: int | None = None
) -> DataFrame:
    """How much more of a chapter carries a class than of the whole video.

    Both shares are over *detected* seconds.
    """
    sets = marks.groupBy(*keys, "sec").agg(F.collect_set("label").alias("_l"))
    inch = seconds_in_chapters(sets, chapters, keys)
    here = inch.groupBy(*keys, "number").agg(F.count("*").alias("_det"))
    count = (
        inch.select(*keys, "number", F.explode("_l").alias("label"))
        .groupBy(*keys, "number", "label")
        .agg(F.count("*").alias("seconds"))
    )
    video = sets.groupBy(*keys).agg(F.count("*").alias("_vdet"))
    total = (
        sets.select(*keys, F.explode("_l").alias("label"))
        .groupBy(*keys, "label")
        .agg(F.count("*").alias("_vsec"))
    )
    x = (
        count.join(here, [*keys, "number"])
        .join(total, [*keys, "label"])
        .join(video, list(keys))
        .withColumn("_here", F.col("seconds") / F.col("_det"))
        .withColumn("_all", F.col("_vsec") / F.col("_vdet"))
    )
    lift = _r(F.col("_here") / F.col("_all"), 2, digits)
    return x.select(
        *keys,
        "number",
        "label",
        "seconds",
        _r(F.col("_here") * 100.0, 1, digits).alias("chapter_share_pct"),
        _r(F.col("_all") * 100.0, 1, digits).alias("video_share_pct"),
        lift.alias("lift"),
        (F.col("seconds") >= MIN_SECONDS_FOR_LIFT).alias("enough_samples"),
        ((lift > 0) & ((lift >= NOTABLE_LIFT) | (lift <= 1.0 / NOTABLE_LIFT))).alias("notable"),
        F.round(F.abs(F.log(F.greatest(lift, F.lit(1e-3)))), 6).alias("distance"),
    )


def share_changes(shares: DataFrame, keys: Sequence[str], *, top: int = 2) -> DataFrame:
    """Class shares that moved at least 12 points from one chapter to the next.

    *shares* has ``number, label, chapter_share_pct``. Each share is sent to its
    own chapter and to the next, so the comparison is one aggregation; a class
    absent on one side counts as 0 there.
    """
    side = F.explode(
        F.array(
            F.struct(F.col("number").alias("n"), F.lit(True).alias("now")),
            F.struct((F.col("number") + 1).alias("n"), F.lit(False).alias("now")),
        )
    )
    x = shares.select("*", side.alias("_s"))
    moved = x.groupBy(*keys, F.col("_s.n").alias("number"), "label").agg(
        F.coalesce(F.max(F.when(F.col("_s.now"), F.col("chapter_share_pct"))), F.lit(0.0)).alias("to_pct"),
        F.coalesce(F.max(F.when(~F.col("_s.now"), F.col("chapter_share_pct"))), F.lit(0.0)).alias("from_pct"),
    )
    gap = F.abs(F.col("to_pct") - F.col("from_pct"))
    w = Window.partitionBy(*keys, "number").orderBy(F.desc(F.round(gap, 6)), "label")
    return (
        moved.filter(F.col("number") > 1)
        .filter(gap >= CHANGE_POINTS)
        .withColumn("pos", F.row_number().over(w))
        .filter(F.col("pos") <= top)
        .withColumn("direction", F.when(F.col("to_pct") > F.col("from_pct"), "rose").otherwise("fell"))
    )


def densest_chapter(shares: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per class the chapter where its share is highest (the first on ties)."""
    best = F.max_by(
        F.struct("number", "chapter_share_pct"), F.struct(F.col("chapter_share_pct"), -F.col("number"))
    )
    return shares.groupBy(*keys, "label").agg(best.alias("_b")).select(*keys, "label", "_b.*")


def chapter_summary(
    chapters: DataFrame,
    clips: DataFrame,
    curve: DataFrame,
    videos: DataFrame,
    keys: Sequence[str],
    *,
    value: str,
    total: str = "duration", digits: int | None = None
) -> DataFrame:
    """Each chapter against the whole video: cut share, score, pace and level."""
    placed = assign_chapters(clips, chapters, keys).filter(F.col("chapter") > 0)
    length = F.col("end") - F.col("start")
    cut = placed.groupBy(*keys, F.col("chapter").alias("number")).agg(
        F.count("*").alias("clips"), F.sum(length).alias("_clip_s")
    )
    kept = clips.groupBy(*keys).agg(F.sum(length).alias("_kept"))
    live = F.when(F.col(value) > 0, F.col(value))
    inch = seconds_in_chapters(curve, chapters, keys)
    here = inch.groupBy(*keys, "number").agg(
        _r(F.coalesce(F.avg(live), F.lit(0.0)), 2, digits).alias("score_mean"),
        _r(F.max(value), 2, digits).alias("score_peak"),
        F.max_by("sec", F.struct(F.col(value), -F.col("sec"))).alias("score_peak_second"),
        F.median(live).alias("_med"),
    )
    whole = curve.groupBy(*keys).agg(
        F.coalesce(F.avg(live), F.lit(0.0)).alias("_vmean"), F.median(live).alias("_vmed")
    )
    shots = chapters.groupBy(*keys).agg(F.sum("shots").alias("_vshots"))
    ratio = lambda a, b: F.when(b != 0, a / b).otherwise(0.0)
    secs, dur = F.col("end") - F.col("start"), F.col(total).cast("double")
    runtime, share = ratio(secs, dur), ratio(F.col("clip_seconds_raw"), F.coalesce("_kept", F.lit(0.0)))
    x = (
        chapters.join(videos.select(*keys, total), list(keys))
        .join(here, [*keys, "number"])
        .join(whole, list(keys))
        .join(shots, list(keys))
        .join(cut, [*keys, "number"], "left")
        .join(kept, list(keys), "left")
        .withColumn("clip_seconds_raw", F.coalesce("_clip_s", F.lit(0.0)))
        .withColumn("shots_per_minute", _r(ratio(F.col("shots"), secs / 60.0), 1, digits))
    )
    return x.select(
        *keys,
        "number",
        F.coalesce("clips", F.lit(0)).alias("clips"),
        _r("clip_seconds_raw", 1, digits).alias("clip_seconds"),
        _r(runtime * 100.0, 1, digits).alias("runtime_share_pct"),
        _r(share * 100.0, 1, digits).alias("cut_share_pct"),
        _r(ratio(share, runtime), 2, digits).alias("cut_share_lift"),
        "score_mean",
        _r(ratio(F.col("score_mean"), F.col("_vmean")), 2, digits).alias("score_lift"),
        "score_peak",
        "score_peak_second",
        "shots_per_minute",
        _r(ratio(F.col("shots_per_minute"), F.col("_vshots") / (dur / 60.0)), 2, digits).alias("pace_lift"),
        _r("_med", 4, digits).alias("loudness_median"),
        _r(
            F.lit(20.0) * F.log10(F.greatest(F.col("_med"), F.lit(1e-9)) / F.col("_vmed")), 1, digits).alias("loudness_delta_db"),
    )


def annotate_events(events: DataFrame, marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Classes labelled at an event's peak second and anywhere in its span (end included)."""
    from tidemark.operators.joins import points_in_spans

    m = marks.groupBy(*keys, "sec").agg(F.collect_set("label").alias("_l"))
    e = events.select(*keys, "start", "end", "peak_sec")
    hits = points_in_spans(m, e, keys, t="sec", closed_end=True)
    empty = F.array().cast("array<string>")
    tags = hits.groupBy(*keys, "start").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_l")))).alias("classes_spanning"),
        F.array_sort(
            F.flatten(F.collect_list(F.when(F.col("sec") == F.col("peak_sec"), F.col("_l"))))
        ).alias("classes_at_peak"),
    )
    return e.join(tags, [*keys, "start"], "left").select(
        *e.columns,
        F.coalesce("classes_at_peak", empty).alias("classes_at_peak"),
        F.coalesce("classes_spanning", empty).alias("classes_spanning"),
    )


def clips_carrying(marks: DataFrame, clips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per class the sorted numbers of the clips overlapping any of its seconds."""
    from tidemark.operators.joins import points_in_spans

    m = marks.select(*keys, "sec", "label").distinct()
    c = clips.select(*keys, "idx", F.floor("start").alias("_lo"), F.ceil("end").alias("_hi"))
    hits = points_in_spans(m, c, keys, t="sec", start="_lo", end="_hi")
    return hits.groupBy(*keys, "label").agg(F.array_sort(F.collect_set("idx")).alias("clips"))


def overlapping_any(spans: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spans sharing time with some range (strict overlap).

    The ranges are united first. Of the stretches that begin before a span's end the last
    one reaches furthest, so a span looks up that one's end, carried along the axis: no
    pairs are formed, and a long span or stretch is still one row.
    """
    from tidemark.operators.axis import fill_forward
    from tidemark.operators.islands import interval_islands

    cover = interval_islands(ranges.filter("end > start"), keys).select(
        *keys, F.col("start").alias("_t"), F.col("end").alias("_reach"), F.lit(1).alias("_kind")
    )
    asked = spans.filter(F.col("start").isNotNull() & F.col("end").isNotNull()).dropna(subset=list(keys))
    # a stretch that begins where a span ends comes after it
    asked = asked.withColumn("_t", F.col("end")).withColumn("_kind", F.lit(0))
    both = asked.unionByName(cover, allowMissingColumns=True)
    carried = fill_forward(both, keys, ["_t", "_kind"], "_reach", "_upto", "_t")
    return carried.filter((F.col("_kind") == 0) & (F.col("_upto") > F.col("start"))).select(*spans.columns).distinct()


def arrivals(marks: DataFrame, clips: DataFrame, keys: Sequence[str], composed: Sequence[str]) -> DataFrame:
    """First second of a class that arrives inside a clip.

    Not one present in the clip's first second, and not one seen only once.
    Composed classes win, then the longer present, then the earlier.
    """
    from tidemark.operators.joins import points_in_spans

    c = clips.select(*keys, "idx", F.floor("start").alias("_lo"), F.ceil("end").alias("_hi"))
    m = marks.groupBy(*keys, "sec", "label").agg(F.count("*").alias("_n"))
    hits = points_in_spans(m, c, keys, t="sec", start="_lo", end="_hi")
    seen = (
        hits.groupBy(*keys, "idx", "_lo", "label")
        .agg(F.min("sec").alias("second"), F.sum("_n").alias("seconds"))
        .filter((F.col("second") > F.col("_lo")) & (F.col("seconds") >= 2))
        .withColumn("composed", F.col("label").isin(*composed))
    )
    best = F.max_by(
        F.struct("second", "label", "composed", "seconds"),
        F.struct(F.col("composed").cast("int"), F.col("seconds"), -F.col("second"), "label"),
    )
    return seen.groupBy(*keys, "idx").agg(best.alias("_b")).select(*keys, "idx", "_b.*")


def measure_clips(
    signals: DataFrame, clips: DataFrame, keys: Sequence[str], *, names: Sequence[str], boost: Sequence[str]
) -> DataFrame:
    """Peak second, score percentile, signals fired and how close together they fired.

    *signals* has one row per scored second with ``score`` and a column per name.
    """
    from tidemark.operators.curves import midrank
    from tidemark.operators.joins import points_in_spans

    ranked = midrank(signals, keys, value="score", out="_pct")
    c = clips.select(*keys, "idx", F.floor("start").alias("_lo"), F.ceil("end").alias("_hi"))
    hits = points_in_spans(ranked, c, keys, t="sec", start="_lo", end="_hi")
    first = lambda n: F.max_by("sec", F.struct(F.col(n), -F.col("sec")))
    out = hits.groupBy(*keys, "idx").agg(
        first("score").alias("peak"),
        F.max_by("_pct", F.struct(F.col("score"), -F.col("sec"))).alias("score_percentile"),
        *[F.when(F.max(n) > 0, first(n)).alias(f"_at_{n}") for n in names],
        *[F.max(n).alias(f"_v_{n}") for n in names],
    )
    fired = F.array_compact(F.array(*[F.col(f"_at_{n}") for n in boost]))
    spread = F.when(F.size(fired) > 1, F.array_max(fired) - F.array_min(fired))
    per = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"_v_{n}") > 0,
                    F.struct(
                        F.lit(n).alias("signal"), F.col(f"_v_{n}").alias("value"), F.col(f"_at_{n}").alias("at")
                    ),
                )
                for n in names
            ]
        )
    )
    return out.select(
        *keys,
        "idx",
        "peak",
        "score_percentile",
        per.alias("signals"),
        spread.alias("signal_spread"),
        (spread <= 1).alias("signals_coincide"),
    )


def class_measurement(
    marks: DataFrame, levels: DataFrame, keys: Sequence[str], *, value: str, digits: int | None = None
) -> DataFrame:
    """Seconds, share, first and last, level and loudest second with its company, per class."""
    sets = marks.groupBy(*keys, "sec").agg(F.collect_set("label").alias("_l"))
    x = sets.join(levels.select(*keys, "sec", value), [*keys, "sec"])
    whole = sets.groupBy(*keys).agg(F.count("*").alias("_det"))
    med = levels.groupBy(*keys).agg(F.median(value).alias("_vmed"))
    best = F.max_by(F.struct("sec", "_l", value), F.struct(F.col(value), -F.col("sec")))
    per = (
        x.select(*keys, "sec", value, "_l", F.explode("_l").alias("label"))
        .groupBy(*keys, "label")
        .agg(
            F.count("*").alias("seconds"),
            F.min("sec").alias("first"),
            F.max("sec").alias("last"),
            F.median(value).alias("_med"),
            best.alias("_b"),
        )
        .join(whole, list(keys))
        .join(med, list(keys))
    )
    company = F.array_sort(F.array_remove(F.col("_b._l"), F.col("label")))
    return per.select(
        *keys,
        "label",
        "seconds",
        _r(F.col("seconds") * 100.0 / F.col("_det"), 1, digits).alias("video_share_pct"),
        "first",
        "last",
        _r(F.col("_med"), 2, digits).alias("median_level"),
        _r(F.col("_med") - F.col("_vmed"), 2, digits).alias("vs_video"),
        F.col("_b.sec").alias("loudest_second"),
        _r(F.col(f"_b.{value}"), 2, digits).alias("loudest_level"),
        F.array_join(company, ",").alias("loudest_with"),
    )

"""Expression readings: mix, arc, shift, dispersion, reliability, onsets.

A reading table has one row per read second (``video_id, sec, label, conf``),
so anything ordered per video is bounded by the axis.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.axis import run_ids
from tidemark.operators.joins import asof_backward, points_in_spans

# Direction of each label, and the bars of the analysis.
VALENCE = {"happy": 1.0, "neutral": 0.0, "sad": -1.0, "anger": -1.0}
UNVALENCED = ("surprise",)
MIN_BUCKET_READS = 3
ARC_CHANGE = 0.20
GOOD_FIT = 0.35
SHIFT_CHANGE = 0.22
MIN_SHIFT_BUCKETS = 2
LOW_COVERAGE = 35.0
LOW_CONFIDENCE = 0.6
UNSTABLE_RUN = 2.0
DOMINANT_SHARE = 45.0
UNIFORM_CV = 0.35
CLASS_DELTA = 0.15
MIN_PEAK_RUN = 2
TURN_GAP = 4


def valence(label: Column, conf: Column) -> Column:
    """Direction of the label times how sure the reading was; unknown labels are 0."""
    table = F.create_map(*[F.lit(x) for kv in VALENCE.items() for x in kv])
    return F.coalesce(table[F.lower(label)], F.lit(0.0)) * conf


def _mix(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reads, mean valence, dominant label (ties by name) and label counts per group."""
    per = df.groupBy(*keys, "label").agg(
        F.count("*").alias("_n"), F.sum(valence(F.col("label"), F.col("conf"))).alias("_v")
    )
    return per.groupBy(*keys).agg(
        F.sum("_n").alias("read_seconds"),
        (F.sum("_v") / F.sum("_n")).alias("valence"),
        F.min_by("label", F.struct(-F.col("_n"), F.col("label"))).alias("dominant"),
        F.array_sort(F.collect_list(F.struct("label", F.col("_n").alias("n")))).alias("counts"),
    )


def _lengths(videos: DataFrame, keys: Sequence[str], total: str) -> DataFrame:
    return videos.select(*keys, F.col(total).cast("double").alias("_d")).filter("_d > 0")


def _in_buckets(readings: DataFrame, lengths: DataFrame, keys: Sequence[str], count: int) -> DataFrame:
    bucket = F.floor(F.col("sec") / (F.col("_d") / count)).cast("int")
    return readings.join(lengths, list(keys)).withColumn("bucket", bucket).filter(F.col("bucket") < count)


def bucketed(readings: DataFrame, videos: DataFrame, keys: Sequence[str], *, total: str = "duration", count: int = 12) -> DataFrame:
    """The video cut into *count* equal spans, each with its own mix; empty ones included."""
    v = _lengths(videos, keys, total)
    mix = _mix(_in_buckets(readings, v, keys, count), [*keys, "bucket"])
    grid = v.select(*keys, "_d", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("bucket"))
    return (
        grid.join(mix, [*keys, "bucket"], "left")
        .withColumn("start", F.col("bucket") * F.col("_d") / count)
        .withColumn("read_seconds", F.coalesce("read_seconds", F.lit(0)))
        .drop("_d")
    )


def arc(buckets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A least-squares line through the usable buckets and what it amounts to."""
    ok = buckets.filter(F.col("read_seconds") >= MIN_BUCKET_READS)
    fit = ok.groupBy(*keys).agg(
        F.count("*").alias("buckets_used"),
        F.regr_slope("valence", "bucket").alias("_s"),
        F.regr_intercept("valence", "bucket").alias("_i"),
        F.coalesce(F.regr_r2("valence", "bucket"), F.lit(0.0)).alias("fit"),
        F.min("bucket").alias("_a"),
        F.max("bucket").alias("_b"),
    )
    first, last = F.col("_s") * F.col("_a") + F.col("_i"), F.col("_s") * F.col("_b") + F.col("_i")
    enough = F.col("buckets_used") >= 3
    change = F.when(enough, last - first)
    direction = (
        F.when(~enough, "unknown")
        .when(F.abs(change) < ARC_CHANGE, "flat")
        .when(change > 0, "toward positive")
        .otherwise("toward negative")
    )
    return fit.select(
        *keys,
        "buckets_used",
        direction.alias("direction"),
        change.alias("change"),
        F.when(enough, first).alias("start_valence"),
        F.when(enough, last).alias("end_valence"),
        F.when(enough, F.col("fit")).alias("fit"),
        (enough & (direction != "flat") & (F.col("fit") >= GOOD_FIT)).alias("confident"),
    )


def shift(buckets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The single split where the read-weighted mean changes most."""
    ok = buckets.filter(F.col("read_seconds") >= MIN_BUCKET_READS)
    w = Window.partitionBy(*keys).orderBy("bucket")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    mass = F.col("valence") * F.col("read_seconds")
    x = ok.select(
        *keys,
        "bucket",
        "start",
        (F.row_number().over(w) - 1).alias("_cut"),
        F.count("*").over(Window.partitionBy(*keys)).alias("_n"),
        (F.sum(mass).over(before) / F.sum("read_seconds").over(before)).alias("before"),
        (F.sum(mass).over(after) / F.sum("read_seconds").over(after)).alias("after"),
    ).filter((F.col("_cut") >= MIN_SHIFT_BUCKETS) & (F.col("_cut") <= F.col("_n") - MIN_SHIFT_BUCKETS))
    change = F.col("after") - F.col("before")
    best = F.max_by(
        F.struct("start", "before", "after"), F.struct(F.round(F.abs(change), 9), -F.col("bucket"))
    )
    return (
        x.groupBy(*keys)
        .agg(best.alias("_b"))
        .select(*keys, F.col("_b.start").alias("at"), "_b.before", "_b.after")
        .withColumn("change", F.col("after") - F.col("before"))
        .filter(F.abs("change") >= SHIFT_CHANGE)
        .withColumn("direction", F.when(F.col("change") > 0, "toward positive").otherwise("toward negative"))
    )


def _dispersion(shares: DataFrame, keys: Sequence[str]) -> DataFrame:
    """*shares* are (*keys*, label, ``_s``, ``_m``): the share in a usable bucket and how many there are."""
    per = (
        shares.groupBy(*keys, "label")
        .agg(
            F.sum("_s").alias("_sum"),
            F.sum(F.col("_s") * F.col("_s")).alias("_sq"),
            F.max("_s").alias("peak_share_pct"),
            F.min("_s").alias("_min"),
            F.count("*").alias("_k"),
            F.max("_m").alias("_m"),
        )
        .filter((F.col("_m") >= 3) & (F.col("_sum") > 0))
    )
    mean = F.col("_sum") / F.col("_m")
    sd = F.sqrt(F.greatest(F.col("_sq") / F.col("_m") - mean * mean, F.lit(0.0)))
    return per.select(
        *keys,
        "label",
        (sd / mean).alias("cv"),
        (sd / mean < UNIFORM_CV).alias("uniform"),
        "peak_share_pct",
        F.when(F.col("_k") < F.col("_m"), F.lit(0.0)).otherwise(F.col("_min")).alias("low_share_pct"),
        mean.alias("mean_share_pct"),
    )


def dispersion(readings: DataFrame, videos: DataFrame, keys: Sequence[str], *, total: str = "duration", count: int = 12) -> DataFrame:
    """Spread of each label's share over the usable buckets (population CV).

    Counted per bucket and label, with one sort for the sums of a bucket and of a video:
    no lists, and no join but that with the lengths.
    """
    per = _in_buckets(readings.select(*keys, "sec", "label"), _lengths(videos, keys, total), keys, count).filter("bucket >= 0")
    per = per.groupBy(*keys, "bucket", "label").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys, "bucket").orderBy("label")
    read = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ok = per.select(*keys, "label", "_n", read.alias("_read"), (F.row_number().over(w) == 1).cast("long").alias("_first"))
    ok = ok.filter(F.col("_read") >= MIN_BUCKET_READS)
    share = F.round(F.col("_n") * 100.0 / F.col("_read"), 1)
    return _dispersion(ok.select(*keys, "label", share.alias("_s"), F.sum("_first").over(Window.partitionBy(*keys)).alias("_m")), keys)


def reading_summary(
    readings: DataFrame, videos: DataFrame, keys: Sequence[str], *, total: str = "duration", buckets: int = 12
) -> DataFrame:
    """Coverage, valence mix, run stability and the reliability level of a video."""
    v = videos.select(*keys, F.col(total).cast("double").alias("duration"))
    val = valence(F.col("label"), F.col("conf"))
    mix = readings.withColumn("_v", val).groupBy(*keys).agg(
        F.count("*").alias("read_seconds"),
        F.avg("conf").alias("mean_confidence"),
        F.avg(F.when(F.col("_v") != 0, F.col("_v"))).alias("_mean"),
        F.avg("_v").alias("mean_all_read"),
        F.count(F.when(F.col("_v") > 0, 1)).alias("_pos"),
        F.count(F.when(F.col("_v") < 0, 1)).alias("_neg"),
        F.count(F.when(F.col("label").isin(*UNVALENCED), 1)).alias("_un"),
    )
    ran = run_ids(
        readings, keys, ["sec"], F.struct(F.col("label").alias("l")), lambda p: p["l"] != F.col("label"), "_run", "sec"
    )
    runs = (
        ran.groupBy(*keys, "_run")
        .agg((F.max("sec") - F.min("sec") + 1).alias("_len"))
        .groupBy(*keys)
        .agg(F.count("*").alias("runs"), (F.floor(F.avg("_len") * 100 + 0.5) / 100).alias("mean_run"))
    )
    shares = readings.groupBy(*keys, "label").agg(F.count("*").alias("_n"))
    spread = dispersion(readings, videos, keys, total=total, count=buckets)
    flagged = (
        shares.join(mix.select(*keys, "read_seconds"), list(keys))
        .join(spread.select(*keys, "label", "uniform"), [*keys, "label"])
        .filter(F.col("uniform") & (F.round(F.col("_n") * 100.0 / F.col("read_seconds"), 1) >= DOMINANT_SHARE))
        .groupBy(*keys)
        .agg(F.count("*").alias("_even"))
    )
    pct = lambda n: F.col(n) * 100.0 / F.col("read_seconds")
    x = mix.join(v, list(keys)).join(runs, list(keys)).join(flagged, list(keys), "left")
    coverage = F.round(F.col("read_seconds") * 100.0 / F.col("duration"), 1)
    reasons = (
        F.when(coverage < LOW_COVERAGE, 1).otherwise(0)
        + F.when(F.col("mean_confidence") < LOW_CONFIDENCE, 1).otherwise(0)
        + F.when((F.col("mean_run") > 0) & (F.col("mean_run") < UNSTABLE_RUN), 1).otherwise(0)
        + F.coalesce("_even", F.lit(0))
    )
    return x.select(
        *keys,
        "read_seconds",
        coverage.alias("coverage_pct"),
        F.coalesce("_mean", F.lit(0.0)).alias("mean_valence"),
        "mean_all_read",
        pct("_pos").alias("positive_pct"),
        pct("_neg").alias("negative_pct"),
        pct("_un").alias("unvalenced_pct"),
        "runs",
        "mean_run",
        reasons.alias("reasons"),
        F.when(reasons >= 2, "low").when(reasons >= 1, "moderate").otherwise("unflagged").alias("reliability"),
    )


def episodes(readings: DataFrame, keys: Sequence[str], *, min_seconds: float = 8.0, gap: float = 4.0) -> DataFrame:
    """Stretches reading one sign; neutral and unvalenced seconds do not interrupt."""
    val = valence(F.col("label"), F.col("conf"))
    r = readings.withColumn("_v", val).filter("_v <> 0").withColumn("sign", F.signum("_v").cast("int"))
    ran = run_ids(
        r,
        keys,
        ["sec"],
        F.struct(F.col("sign").alias("s"), F.col("sec").alias("t")),
        lambda p: (p["s"] != F.col("sign")) | (F.col("sec") - p["t"] > gap),
        "_run",
        "sec",
    )
    per = ran.groupBy(*keys, "_run", "sign", "label").agg(
        F.count("*").alias("_n"), F.sum("_v").alias("_s"), F.min("sec").alias("_a"), F.max("sec").alias("_b")
    )
    return (
        per.groupBy(*keys, "_run", "sign")
        .agg(
            F.min("_a").cast("double").alias("start"),
            (F.max("_b") + 1).cast("double").alias("end"),
            F.sum("_n").alias("read_seconds"),
            (F.sum("_s") / F.sum("_n")).alias("valence"),
            F.min_by("label", F.struct(-F.col("_n"), F.col("label"))).alias("dominant"),
        )
        .filter(F.col("end") - F.col("start") >= min_seconds)
        .drop("_run")
    )


def span_readings(readings: DataFrame, spans: DataFrame, keys: Sequence[str], *, ident: str) -> DataFrame:
    """Each span's own mix against the video's mean."""
    base = readings.groupBy(*keys).agg(F.avg(valence(F.col("label"), F.col("conf"))).alias("_base"))
    inside = points_in_spans(readings, spans.select(*keys, ident, "start", "end"), keys, t="sec")
    mix = _mix(inside, [*keys, ident])
    return mix.join(base, list(keys)).withColumn("delta", F.col("valence") - F.col("_base")).drop("_base")


def class_readings(readings: DataFrame, marks: DataFrame, keys: Sequence[str], *, min_seconds: int = 30) -> DataFrame:
    """Mean reading over the seconds carrying a class, against the video's mean."""
    val = valence(F.col("label"), F.col("conf"))
    base = readings.groupBy(*keys).agg(F.avg(val).alias("_base"))
    m = marks.select(*keys, "sec", F.col("label").alias("class")).distinct()
    mix = _mix(m.join(readings, [*keys, "sec"]), [*keys, "class"])
    return (
        mix.filter(F.col("read_seconds") >= min_seconds)
        .join(base, list(keys))
        .withColumn("delta", F.col("valence") - F.col("_base"))
        .withColumn("distinguishable", F.abs("delta") >= CLASS_DELTA)
        .drop("_base")
    )


def reading_onsets(readings: DataFrame, spans: DataFrame, keys: Sequence[str], *, ident: str) -> DataFrame:
    """Where the clearest departing reading of a span began, and what it turned from."""
    counts = readings.groupBy(*keys, "label").agg(F.count("*").alias("_n"))
    norm = counts.groupBy(*keys).agg(
        F.min_by("label", F.struct(-F.col("_n"), F.col("label"))).alias("_dom"),
        (F.max("_n") * 100.0 / F.sum("_n") >= DOMINANT_SHARE).alias("_pervasive"),
    )
    inside = points_in_spans(readings, spans.select(*keys, ident, "start", "end"), keys, t="sec").drop("start", "end")
    k = [*keys, ident]
    ran = run_ids(
        inside, k, ["sec"], F.struct(F.col("label").alias("l")), lambda p: p["l"] != F.col("label"), "_run", "sec"
    )
    runs = (
        ran.groupBy(*k, "_run", "label")
        .agg(F.min("sec").alias("second"), F.count("*").alias("seconds"), F.avg("conf").alias("confidence"))
        .join(norm, list(keys))
        .filter(
            (F.lower("label") != "neutral")
            & ~(F.col("_pervasive") & (F.col("label") == F.col("_dom")))
            & (F.col("seconds") >= MIN_PEAK_RUN)
            & (F.col("confidence") >= LOW_CONFIDENCE)
        )
    )
    best = F.max_by(
        F.struct("second", "label", "confidence", "seconds"),
        F.struct(F.round("confidence", 9), F.col("seconds"), -F.col("second")),
    )
    onset = (
        runs.groupBy(*k).agg(best.alias("_b")).select(*k, "_b.*").withColumn("_before", F.col("second") - 1)
    )
    seen = asof_backward(
        onset, readings, keys, t="_before", right_t="sec", value="label", out="_p", tolerance=TURN_GAP - 1
    )
    return seen.withColumn(
        "from_label", F.when(F.col("_p.v") != F.col("label"), F.col("_p.v")).otherwise(F.lit(""))
    ).drop("_p", "_before").withColumn("from_label", F.coalesce("from_label", F.lit("")))

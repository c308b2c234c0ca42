"""Why a result looks the way it does: co-marks, orderings, bands, the nested report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import points_in_spans

# Fixed values of the comparison bands and patterns.
MIN_WINDOWS = 8
SEQUENCE_SECONDS = 20
TOGETHER_SECONDS = 2
MIN_CLIPS_FOR_PATTERN = 4
PATTERN_AGREEMENT = 0.67
EXCEPTIONAL, NOTABLE, ORDINARY, TIED_SHARE = 90.0, 70.0, 30.0, 0.5
NEAR_MISS_SHARE = 0.9


def fixed_windows(videos: DataFrame, keys: Sequence[str], *, window: int = 30, total: str = "duration") -> DataFrame:
    """Whole windows of a video; a partial last one is left out."""
    n = F.floor(F.col(total) / window).cast("int")
    return (
        videos.filter(n > 0)
        .select(*keys, F.explode(F.sequence(F.lit(0), n - 1)).alias("idx"))
        .withColumn("start", (F.col("idx") * window).cast("double"))
        .withColumn("end", F.col("start") + window)
    )


def loud_spans(spans: DataFrame, levels: DataFrame, keys: Sequence[str], *, value: str, percentile: float = 0.9) -> DataFrame:
    """Spans with a second strictly above the video's percentile."""
    bar = levels.groupBy(*keys).agg(F.percentile(value, F.lit(percentile)).alias("_bar"))
    hot = levels.join(bar, list(keys)).filter(F.col(value) > F.col("_bar")).select(*keys, "sec")
    wide = spans.select(*keys, "idx", F.floor("start").alias("_lo"), F.ceil("end").alias("_hi"))
    return points_in_spans(hot, wide, keys, t="sec", start="_lo", end="_hi").select(*keys, "idx").distinct()


def mark_sets(spans: DataFrame, found: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """The set of marks each span carries; *found* maps a mark to its ``keys, idx`` rows."""
    rows: DataFrame | None = None
    for name, df in found.items():
        part = df.select(*keys, "idx").distinct().withColumn("_mark", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    sets = rows.groupBy(*keys, "idx").agg(F.array_sort(F.collect_set("_mark")).alias("marks"))
    return spans.join(sets, [*keys, "idx"], "left").withColumn(
        "marks", F.coalesce("marks", F.array().cast("array<string>"))
    )


def comark_rates(clips: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of the video's windows that carry at least a clip's marks.

    Windows are folded to the few different mark sets of a video first.
    """
    sets = windows.groupBy(*keys, F.col("marks").alias("_set")).agg(F.count("*").alias("_n"))
    total = windows.groupBy(*keys).agg(F.count("*").alias("windows")).filter(F.col("windows") >= MIN_WINDOWS)
    have = clips.filter(F.size("marks") > 0).select(*keys, "idx", "marks")
    x = have.join(sets, list(keys)).withColumn(
        "_m", F.when(F.size(F.array_except("marks", "_set")) == 0, F.col("_n")).otherwise(0)
    )
    return (
        x.groupBy(*keys, "idx", "marks")
        .agg(F.sum("_m").alias("matching"))
        .join(total, list(keys))
        .withColumn("pct", F.round(F.col("matching") * 100.0 / F.col("windows"), 6))
    )


def ordering_pattern(pairs: DataFrame, keys: Sequence[str], *, later: str, earlier: str) -> DataFrame:
    """Which side of one mark another tends to land on over the clips of a video."""
    gap = F.col(later) - F.col(earlier)
    g = pairs.withColumn("_gap", gap).filter(F.abs("_gap") <= SEQUENCE_SECONDS)
    kind = F.when(F.col("_gap") > TOGETHER_SECONDS, "after").when(F.col("_gap") < -TOGETHER_SECONDS, "before").otherwise("together")
    per = (
        g.withColumn("kind", kind)
        .groupBy(*keys, "kind")
        .agg(F.count("*").alias("count"), F.sort_array(F.collect_list(F.abs("_gap"))).alias("_l"))
    )
    w = Window.partitionBy(*keys)
    total = F.sum("count").over(w)
    return (
        per.withColumn("total", total)
        .filter(
            (F.col("total") >= MIN_CLIPS_FOR_PATTERN) & (F.col("count") / F.col("total") >= PATTERN_AGREEMENT)
        )
        .withColumn("lag", F.element_at("_l", F.floor(F.col("count") / 2).cast("int") + 1))
        .drop("_l")
    )


def condition_log(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Conditions in order of first appearance: first, last, windows, time since the one before.

    *windows* has a row per window and condition (``start, end, kind, name``).
    """
    seen = windows.groupBy(*keys, "kind", "name").agg(
        F.min("start").alias("first"), F.max("end").alias("last"), F.count("*").alias("windows")
    )
    w = Window.partitionBy(*keys).orderBy("first", "kind", "name")
    return seen.withColumn("order", F.row_number().over(w)).withColumn(
        "since_previous", F.round(F.col("first") - F.lag("first").over(w), 2)
    )


def standing(clips: DataFrame, keys: Sequence[str], *, score: str = "score") -> DataFrame:
    """How a clip compares with the others of its cut; a tie with most is not ranked."""
    freq = clips.groupBy(*keys, score).agg(F.count("*").alias("_tied"))
    w = Window.partitionBy(*keys)
    upto = F.sum("_tied").over(w.orderBy(score).rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum("_tied").over(w)
    values = F.count("*").over(w)
    share = (upto - F.col("_tied") + upto) / 2.0 / n * 100.0
    band = (
        F.when(n < 3, F.lit(None))
        .when(values == 1, "all equal")
        .when(F.col("_tied") / n >= TIED_SHARE, "tied")
        .when(share >= EXCEPTIONAL, "strongest")
        .when(share >= NOTABLE, "stronger")
        .when(share >= ORDINARY, "middling")
        .otherwise("weaker")
    )
    table = freq.select(*keys, score, band.alias("standing"))
    return clips.join(table, [*keys, score])


def why_not_selected(chapters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Why nothing was taken: silent, near miss, short, or lost to length.

    *chapters* has ``clips, score_peak, cut_threshold``.
    """
    peak, bar = F.col("score_peak"), F.col("cut_threshold")
    reason = (
        F.when(F.coalesce(peak, F.lit(0.0)) <= 0, "silent")
        .when(bar.isNull(), "no threshold")
        .when(peak >= bar, "lost to length")
        .when(peak >= bar * NEAR_MISS_SHARE, "near miss")
        .otherwise("short")
    )
    return (
        chapters.filter(F.coalesce("clips", F.lit(0)) == 0)
        .withColumn("reason", reason)
        .withColumn("short_by", F.when((peak > 0) & (peak < bar), bar - peak))
    )


def report_records(
    videos: DataFrame,
    clips: DataFrame,
    near: DataFrame,
    totals: DataFrame,
    curve: DataFrame,
    chapters: DataFrame,
    keys: Sequence[str],
) -> DataFrame:
    """The whole result nested in one row per video.

    Every list is bounded before it is gathered: clips by the budget, near misses
    by their count, the curve by down-sampling, chapters by the minimum length.
    """

    def gathered(df: DataFrame, name: str, *cols: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))

    parts = [
        gathered(clips, "segments", *[c for c in clips.columns if c not in keys]),
        gathered(near, "near_misses", *[c for c in near.columns if c not in keys]),
        gathered(curve, "curve", *[c for c in curve.columns if c not in keys]),
        gathered(chapters, "chapters", *[c for c in chapters.columns if c not in keys]),
        totals.groupBy(*keys).agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("signal", "total")))).alias("signal_totals")
        ),
    ]
    out = videos.withColumn("schema_version", F.lit(3))
    for p in parts:
        out = out.join(p, list(keys), "left")
    return out


# --- diagnosis ---------------------------------------------------------------

# The bars of the diagnosis rules and their severities' order.
CONCENTRATED_SPAN = 0.35
DOMINANT_TAG_SHARE = 0.8
EVIDENCE_SIGNALS = ("scene", "motion_event", "motion_peak", "audio", "keyword", "object", "action", "face")
SEVERITY = {"high": 0, "medium": 1, "low": 2}


def video_facts(
    videos: DataFrame,
    clips: DataFrame,
    near: DataFrame,
    totals: DataFrame,
    tags: DataFrame,
    activity: DataFrame,
    reading_counts: DataFrame,
    rejected: DataFrame,
    gaps: DataFrame,
    claims: DataFrame,
    checks: DataFrame,
    keys: Sequence[str],
    *,
    total: str = "duration",
) -> DataFrame:
    """One row per video with everything the diagnosis rules look at.

    Each input is aggregated once: clips (``idx, start, end, score, n_signals,
    signals``), near misses (``signals``), totals (``signal, total``), tags (``idx,
    tag``), activity (``signal, found``), reading counts (``label, n``), rejected
    ranges, vocabulary gaps (``word``), claims (``score``), checks (``rule, state``).
    """
    from tidemark.operators.compare import overlapping_any

    k = list(keys)
    c = clips.groupBy(*k).agg(
        F.count("*").alias("clips"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        F.min("start").alias("first"),
        F.max("end").alias("last"),
        F.sum(F.col("end") - F.col("start")).alias("cut_seconds"),
        F.max("n_signals").alias("best_signals"),
        F.array_distinct(F.flatten(F.collect_list("signals"))).alias("kept_signals"),
    )
    n = near.groupBy(*k).agg(
        F.count("*").alias("near_misses"), F.array_distinct(F.flatten(F.collect_list("signals"))).alias("near_signals")
    )
    t = totals.groupBy(*k).agg(F.map_from_entries(F.collect_list(F.struct("signal", "total"))).alias("totals"))
    act = activity.groupBy(*k).agg(F.map_from_entries(F.collect_list(F.struct("signal", "found"))).alias("activity"))

    def top_tag(df: DataFrame, out: str) -> DataFrame:
        per = df.select(*k, "idx", "tag").distinct().groupBy(*k, "tag").agg(F.count("*").alias("n"))
        best = F.min_by(F.struct("tag", "n"), F.struct(-F.col("n"), F.col("tag")))
        return per.groupBy(*k).agg(best.alias(out))

    turned = overlapping_any(clips.select(*k, "idx", "start", "end"), rejected, k)
    turned_tags = tags.join(turned.select(*k, "idx"), [*k, "idx"], "left_semi")
    turned_n = turned.groupBy(*k).agg(F.count("*").alias("rejected_clips"))
    label = F.min_by(F.struct("label", "n"), F.struct(-F.col("n"), F.col("label")))
    face = reading_counts.groupBy(*k).agg(F.sum("n").alias("readings"), label.alias("top_reading"))
    g = gaps.groupBy(*k).agg(F.count("*").alias("gap_words"))
    cl = claims.groupBy(*k).agg(F.count("*").alias("open_claims"))
    ck = checks.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("rule", "state"))).alias("checks"))
    out = videos.select(*k, F.col(total).alias("duration"))
    for part in (
        c, n, t, act, top_tag(tags, "tag"), top_tag(turned_tags, "rejected_tag"), turned_n, face, g, cl, ck
    ):
        out = out.join(part, k, "left")
    return out


def diagnose(facts: DataFrame, keys: Sequence[str], settings: dict, *, concern: str | None = None) -> DataFrame:
    """Every finding the record supports, most serious first.

    All rules are columns over one row per video and leave it in one explode.
    *settings*: ``weights`` by signal, ``coverage``, ``target``, ``boost``,
    ``min_signals``, ``face_labels``.
    """
    weights = {s: float(settings.get("weights", {}).get(s, 0.0)) for s in EVIDENCE_SIGNALS}
    clips = F.coalesce("clips", F.lit(0))
    totals = F.coalesce("totals", F.expr("cast(map() as map<string, double>)"))
    activity = F.coalesce("activity", F.expr("cast(map() as map<string, bigint>)"))
    listed = F.array(*[F.lit(s) for s in EVIDENCE_SIGNALS])
    scoring = F.filter(listed, lambda s: F.coalesce(totals[s], F.lit(0.0)) != 0)

    def finding(name, severity: str, evidence: Column) -> Column:
        ident = name if isinstance(name, Column) else F.lit(name)
        return F.struct(
            ident.alias("finding"), F.lit(severity).alias("severity"), evidence.cast("string").alias("evidence")
        )

    def when(cond: Column, name, severity: str, evidence: Column) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), finding(name, severity, evidence))

    span = (F.col("last") - F.col("first")) / F.col("duration")
    missed = F.array_intersect(F.array_except("near_signals", "kept_signals"), listed)
    urgent = "high" if concern in ("arbitrary", "repetitive") else "medium"
    reading_share = F.col("top_reading.n") / F.col("readings")
    rows = [
        when(F.size(scoring) == 1, "single_signal", "high", scoring[0]),
        when((clips >= 3) & (F.col("min_score") == F.col("max_score")), "flat_score", "medium", clips),
        when(
            (clips >= 2) & (F.col("duration") > 0) & (span <= CONCENTRATED_SPAN) & F.lit(settings.get("coverage", 0.0) < 0.5),
            "concentrated",
            "medium",
            F.round(span, 4),
        ),
        when(
            (clips > 0)
            & F.lit(settings.get("boost", 1.0) > 1.0 and settings.get("min_signals", 0) > 0)
            & (F.col("best_signals") < settings.get("min_signals", 0)),
            "boost_never_fired",
            "low",
            F.col("best_signals"),
        ),
        when(
            (clips > 0) & (F.col("near_misses") > 0) & (F.size(missed) > 0),
            "near_miss_gap",
            "medium",
            F.array_join(F.array_sort(missed), ","),
        ),
        when(
            (clips >= 3) & (F.col("tag.n") / clips >= DOMINANT_TAG_SHARE), "dominant_tag", "low", F.col("tag.tag")
        ),
        when(
            F.lit(settings.get("target", 0.0) > 0)
            & (F.coalesce("cut_seconds", F.lit(0.0)) < settings.get("target", 0.0) * 0.8),
            "short_of_target",
            "medium",
            F.round(F.coalesce("cut_seconds", F.lit(0.0)), 2),
        ),
        when(
            F.lit(weights["face"] > 0 and not settings.get("face_labels")), "expressions_unselected", "medium", F.lit(weights["face"])
        ),
        when(
            (F.col("readings") >= 30) & (reading_share >= 0.45), "expression_lopsided", "medium", F.col("top_reading.label")
        ),
        when(F.col("gap_words") > 0, "unchecked_vocabulary", "medium", F.col("gap_words")),
        when(F.col("open_claims") > 0, "unmeasured_claim", "medium", F.col("open_claims")),
        when(
            (F.col("rejected_clips") >= 2) & (F.col("rejected_tag.n") >= 2), "rejected_share_a_tag", "high", F.col("rejected_tag.tag")
        ),
    ]
    if concern == "repetitive":
        rows.append(
            when(F.size(scoring) <= 1, "concern_repetitive", "high", F.coalesce(F.get(scoring, F.lit(0)), F.lit("")))
        )
    for s, weight in weights.items():
        if weight > 0:
            rows.append(when(F.coalesce(totals[s], F.lit(0.0)) == 0, f"silent_{s}", "medium", F.lit(weight)))
        else:
            found = F.coalesce(activity[s], F.lit(0))
            rows.append(when(found >= F.greatest(F.lit(20), clips * 3), f"unused_{s}", urgent, found))
    kinds = {"fired": ("check_fired", "low"), "never_fired": ("check_silent", "medium"), "not_in_rules": ("check_missing", "high")}
    checked = F.transform(
        F.coalesce("checks", F.expr("cast(array() as array<struct<rule: string, state: string>>)")),
        lambda c: F.coalesce(
            *[
                F.when(
                    c["state"] == state,
                    F.struct(
                        F.concat(F.lit(f"{name}:"), c["rule"]).alias("finding"),
                        F.lit(sev).alias("severity"),
                        c["rule"].alias("evidence"),
                    ),
                )
                for state, (name, sev) in kinds.items()
            ]
        ),
    )
    every = F.array_compact(F.concat(F.array(*rows), checked))
    order = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return facts.select(*keys, F.explode(every).alias("_f")).select(
        *keys, "_f.*", order[F.col("_f.severity")].alias("rank")
    )

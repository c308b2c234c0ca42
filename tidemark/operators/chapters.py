"""Cuts, thresholds, shots and chapter boundaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

# Fixed value: fewer cuts a minute than this means detection failed.
MIN_PLAUSIBLE_CUTS = 0.5


def cut_rate(
    cuts: DataFrame, videos: DataFrame, keys: Sequence[str], *, total: str, unit: float = 60.0
) -> DataFrame:
    """Cuts per unit of time and whether that is too sparse to be an edit."""
    n = cuts.groupBy(*keys).agg(F.count("*").alias("cuts"))
    rate = F.col("cuts") / (F.col(total) / F.lit(unit))
    return (
        videos.join(n, list(keys), "left")
        .withColumn("cuts", F.coalesce("cuts", F.lit(0)))
        .withColumn("per_unit", rate)
        .withColumn("undetected", (F.col(total) > 0) & (rate < MIN_PLAUSIBLE_CUTS))
    )

MIN_SAMPLES = 120
MIN_MEDIAN_RATIO = 1.25
MAD_TO_SIGMA = 1.4826


def robust_stats(values: DataFrame, keys: Sequence[str], *, value: str) -> DataFrame:
    """Median, scaled MAD and sample count per video, from running counts of distinct values."""
    from tidemark.operators.ranks import median_and_deviation

    stats = median_and_deviation(values, keys, value)
    return stats.select(*keys, "median", (F.col("deviation") * MAD_TO_SIGMA).alias("mad"), "samples")


def robust_threshold(z: float) -> Column:
    """median + z * MAD over the columns of :func:`robust_stats`."""
    return F.col("median") + F.lit(z) * F.greatest("mad", F.lit(1e-6))


def resolve_cuts(
    diffs: DataFrame,
    keys: Sequence[str],
    *,
    value: str,
    tick: str,
    minutes: str,
    threshold: float,
    z: float = 4.0,
    min_gap: int = 1,
) -> DataFrame:
    """Cuts by a fixed threshold, or by a derived one where the fixed one failed.

    The derived threshold is tried only when the fixed cuts are implausibly few
    over enough samples; it is refused when it is under 1.25 times the median or
    finds no more cuts. Neighbouring cuts collapse to the strongest.

    Values, statistics and cuts are used several times and written once each; tables with
    a row per video are merged, not broadcast.
    """
    from tidemark.operators.choose import spaced_picks

    diffs = cut_lineage(diffs.select(*keys, tick, value, minutes))
    stats = robust_stats(diffs, keys, value=value).withColumn("derived", robust_threshold(z))
    length = diffs.groupBy(*keys).agg(F.max(minutes).alias("_min"))
    stats = cut_lineage(stats.join(length.hint("merge"), list(keys)))
    x = diffs.join(stats.hint("merge"), list(keys))
    branch = F.explode(
        F.array(
            F.struct(F.lit("fixed").alias("method"), F.lit(float(threshold)).alias("bar")),
            F.struct(F.lit("derived").alias("method"), F.col("derived").alias("bar")),
        )
    )
    over = (
        x.select("*", branch.alias("_b"))
        .select(*keys, tick, value, "_b.*")
        .filter(F.col(value) > F.col("bar"))
    )
    cuts = spaced_picks(
        over,
        [*keys, "method"],
        t=tick,
        rank=[-F.col(value), F.col(tick)],
        gap=max(min_gap, 1),
        carry=[value, "bar"],
    )
    cuts = cut_lineage(cuts)
    counts = cuts.groupBy(*keys).agg(
        F.count(F.when(F.col("method") == "fixed", 1)).alias("n_fixed"),
        F.count(F.when(F.col("method") == "derived", 1)).alias("n_derived"),
    )
    failed = (F.col("_min") > 0) & (F.col("n_fixed") / F.col("_min") < MIN_PLAUSIBLE_CUTS)
    use = F.when(
        (F.col("samples") >= MIN_SAMPLES)
        & failed
        & (F.col("derived") >= F.col("median") * MIN_MEDIAN_RATIO)
        & (F.col("n_derived") > F.col("n_fixed")),
        "derived",
    ).otherwise("fixed")
    chosen = stats.join(counts.hint("merge"), list(keys)).select(*keys, use.alias("method"))
    return cuts.join(chosen.hint("merge"), [*keys, "method"]).select(*keys, tick, value, "method", "bar")


# Fixed values of the chapter search.
SHOT_WINDOW = 6
MIN_CHAPTER = 90.0
MAX_CHAPTER = 900.0
BOUNDARY_Z = 1.5
MIN_SHOTS = 4


def pick_boundaries(
    shots: DataFrame,
    videos: DataFrame,
    keys: Sequence[str],
    *,
    total: str = "duration",
    min_gap: float = MIN_CHAPTER,
    max_run: float = MAX_CHAPTER,
    z: float = BOUNDARY_Z,
    target: int | None = None,
) -> DataFrame:
    """Cuts that become chapter boundaries.

    *shots* has ``shot, start, novelty``. Strongest first over a robust threshold
    (or up to a target count), at least *min_gap* from the ends and each other; then
    any run longer than *max_run* is split at its best inner cut until none is
    (:func:`split_long_runs`).
    """
    from tidemark.operators.choose import spaced_picks

    v = videos.select(*keys, F.col(total).cast("double").alias("_end"))
    w = Window.partitionBy(*keys).orderBy("start")
    idx = shots.withColumn("_i", F.row_number().over(w) - 1).withColumn(
        "_first", F.min("start").over(Window.partitionBy(*keys))
    )
    x = idx.join(v, list(keys))
    inner = x.filter(
        (F.col("_i") >= 1)
        & (F.col("start") - F.col("_first") >= min_gap)
        & (F.col("_end") - F.col("start") >= min_gap)
    )
    if target is None:
        stats = robust_stats(idx.filter("_i >= 1"), keys, value="novelty").select(
            *keys, robust_threshold(z).alias("_bar")
        )
        inner = inner.join(stats, list(keys)).filter(F.col("novelty") >= F.col("_bar"))
    picks = spaced_picks(
        inner,
        keys,
        t="start",
        rank=[-F.col("novelty"), -F.col("_i")],
        gap=min_gap,
        limit=None if target is None else max(0, target - 1),
    )
    cuts = picks.select(*keys, F.col("start").cast("double").alias("start"))
    if max_run <= 0:
        return cuts
    ends = x.groupBy(*keys).agg(F.min("start").cast("double").alias("_lo"), F.max("_end").alias("_hi"))
    edges = cuts.join(ends.select(*keys), [*keys]).unionByName(ends.select(*keys, F.col("_lo").alias("start")))
    w = Window.partitionBy(*keys).orderBy("start")
    runs = edges.join(ends.select(*keys, "_hi"), [*keys]).select(*keys, F.col("start").alias("a"), F.coalesce(F.lead("start").over(w), F.col("_hi")).alias("b"))
    return split_long_runs(cut_lineage(cuts), runs, cut_lineage(x.filter("_i >= 1").select(*keys, "start", "novelty", "_i")), keys, min_gap=min_gap, max_run=max_run)


def split_long_runs(cuts: DataFrame, runs: DataFrame, shots: DataFrame, keys: Sequence[str], *, min_gap: float, max_run: float) -> DataFrame:
    """Cuts with those that divide runs (a, b) longer than *max_run*.

    Divide and conquer as a list of rows: in each round every run that is too long is joined
    with the shots inside it and divided at the most novel one (ties: the first), *min_gap*
    from its ends at least; the halves are the next round's runs. Runs without such a shot
    stay as they are. A round is one join for all videos, so rounds are as many as the
    deepest division has levels.
    """
    from tidemark.operators.joins import points_in_spans

    todo = cut_lineage(runs.filter(F.col("b") - F.col("a") > max_run))
    while not todo.isEmpty():
        room = todo.select(*keys, "a", "b", (F.col("a") + min_gap).alias("_from"), (F.col("b") - min_gap).alias("_to")).filter("_from <= _to")
        inside = points_in_spans(shots, room, keys, t="start", start="_from", end="_to", closed_end=True)
        found = cut_lineage(inside.groupBy(*keys, "a", "b").agg(F.max_by("start", F.struct("novelty", -F.col("_i"))).alias("start")))
        cuts = cuts.unionByName(found.select(*keys, "start"))
        halves = found.select(*keys, F.inline(F.array(F.struct(F.col("a"), F.col("start").alias("b")), F.struct(F.col("start").alias("a"), F.col("b")))))
        todo = cut_lineage(halves.filter(F.col("b") - F.col("a") > max_run))
    return cuts


def chapterize(
    scenes: DataFrame, shots: DataFrame, videos: DataFrame, keys: Sequence[str], *, total: str = "duration", min_shots: int = MIN_SHOTS, **options: float
) -> DataFrame:
    """Chapters of every video, with the ``method`` that its shots allow.

    *scenes* has the ``start`` of every shot, *shots* (``shot, start, novelty``) those whose
    look was sampled. With fewer than *min_shots* scenes a video is one chapter (``single``);
    with fewer sampled shots than that it is cut near even marks (``shot-length``), else at
    novel shots (``visual``). *options* are those of :func:`pick_boundaries`, of which the
    even marks use *min_gap*, *max_run* and *target*.
    """
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    few = lambda name: F.coalesce(name, F.lit(0)) < min_shots
    sized = videos.join(count(scenes, "_scenes"), [*keys], "left").join(count(shots, "_seen"), [*keys], "left")
    method = F.when(few("_scenes"), "single").when(few("_seen"), "shot-length").otherwise("visual")
    decided = cut_lineage(sized.filter(F.col(total) > 0).select(*keys, total, method.alias("method")))
    of = lambda m: decided.filter(F.col("method") == m).drop("method")
    even = {k: v for k, v in options.items() if k in ("min_gap", "max_run", "target")}
    looks = shots.join(of("visual").select(*keys), [*keys])
    plain = scenes.join(of("shot-length").select(*keys), [*keys]).select(*keys, "start")
    cuts = pick_boundaries(looks, of("visual"), keys, total=total, **options).unionByName(even_boundaries(plain, of("shot-length"), keys, total=total, **even))
    out = chapters_from_cuts(cuts, scenes, looks.select(*keys, "start", "novelty"), decided.drop("method"), keys, total=total)
    return out.join(decided.select(*keys, "method"), [*keys])


def even_boundaries(
    shots: DataFrame,
    videos: DataFrame,
    keys: Sequence[str],
    *,
    total: str = "duration",
    min_gap: float = MIN_CHAPTER,
    max_run: float = MAX_CHAPTER,
    target: int | None = None,
) -> DataFrame:
    """Cuts nearest to evenly spaced marks, for videos with nothing to measure."""
    end = F.col(total).cast("double")
    if target and target > 1:
        count = F.lit(target)
    else:
        count = F.greatest(F.lit(1), F.rint(end / max(min_gap * 3, 1.0)).cast("int"))
        if max_run > 0:
            count = F.greatest(count, F.ceil(end / max_run).cast("int"))
    table = shots.groupBy(*keys).agg(F.array_sort(F.collect_list("start")).alias("_s"))
    x = table.join(videos.select(*keys, total), list(keys)).withColumn("_n", count).filter("_n > 1")

    def place(kept: Column, k: Column) -> Column:
        mark = end * k / F.col("_n")
        near = F.array_min(
            F.transform(
                "_s", lambda t, i: F.struct(F.abs(t - mark).alias("d"), i.alias("i"), t.alias("t"))
            )
        )
        ok = (near["i"] >= 1) & ~F.exists(kept, lambda c: F.abs(c - near["t"]) < min_gap)
        return F.when(ok, F.concat(kept, F.array(near["t"]))).otherwise(kept)

    cuts = F.aggregate(F.sequence(F.lit(1), F.col("_n") - 1), F.array().cast("array<double>"), place)
    return x.select(*keys, F.explode(F.array_sort(cuts)).alias("start"))


def chapters_from_cuts(
    cuts: DataFrame, scenes: DataFrame, shots: DataFrame, videos: DataFrame, keys: Sequence[str], *, total: str = "duration"
) -> DataFrame:
    """Numbered chapters between the boundaries: shots inside, score of the opening cut."""
    from tidemark.operators.joins import points_in_spans

    v = videos.select(*keys, F.col(total).cast("double").alias("_end"))
    edges = cuts.select(*keys, "start").unionByName(v.select(*keys, F.lit(0.0).alias("start"))).distinct()
    w = Window.partitionBy(*keys).orderBy("start")
    spans = (
        edges.join(v, list(keys))
        .withColumn("number", F.row_number().over(w))
        .withColumn("end", F.coalesce(F.lead("start").over(w), F.col("_end")))
        .filter(F.col("end") > F.col("start"))
        .drop("_end")
    )
    per = points_in_spans(
        scenes.select(*keys, F.col("start").alias("_t")), spans.select(*keys, "number", "start", "end"), keys, t="_t"
    )
    n = per.groupBy(*keys, "number").agg(F.count("*").alias("shots"))
    score = shots.select(*keys, "start", F.col("novelty").alias("_s"))
    return (
        spans.join(n, [*keys, "number"], "left")
        .join(score, [*keys, "start"], "left")
        .select(
            *keys,
            "number",
            "start",
            "end",
            F.coalesce("shots", F.lit(0)).alias("shots"),
            F.round(F.when(F.col("number") > 1, F.coalesce("_s", F.lit(0.0))).otherwise(0.0), 4).alias("boundary_score"),
        )
    )

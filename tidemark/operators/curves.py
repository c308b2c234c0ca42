"""Dense per-second curves: rolling statistics, ranks, local maxima, condition masks.

A curve has one row per second of a video. Frames of bounded width run on axis
chunks with a halo (:mod:`tidemark.operators.axis`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.operators.axis import DEFAULT_CHUNK, chunk_of, chunk_window, drop_halo, prefix_sum, with_halo
from tidemark.operators.ranks import median_and_deviation, value_counts
from tidemark.session import shuffle_width

# The vocal gate and the robust scale factor.
VOCAL_MAX_FLATNESS = 0.08
VOCAL_MAX_HIGH_RATIO = 0.15
VOCAL_MIN_PERIODICITY = 0.30
MAD_TO_SIGMA = 1.4826
SILENCE_DBFS = -100.0


def vocal(flatness: str, high_ratio: str, periodicity: str) -> Column:
    """True where a second carries voice rather than impacts or room tone."""
    return (
        (F.col(flatness) <= VOCAL_MAX_FLATNESS)
        & (F.col(high_ratio) <= VOCAL_MAX_HIGH_RATIO)
        & (F.col(periodicity) > VOCAL_MIN_PERIODICITY)
    )


def dbfs(amplitude: Column, digits: int | None = 1) -> Column:
    """Amplitude 0..1 in dBFS with a floor, so silence is a number."""
    db = F.lit(20.0) * F.log10(F.greatest(amplitude, F.lit(1e-12)))
    db = F.round(db, digits) if digits is not None else db
    return F.greatest(F.lit(SILENCE_DBFS), db)


def energy_level(frames: DataFrame, keys: Sequence[str], *, rms: str, tick: str = "sec") -> DataFrame:
    """Energy mean of the frames of each second, in dBFS."""
    return frames.groupBy(*keys, tick).agg(
        dbfs(F.sqrt(F.avg(F.col(rms) * F.col(rms))), None).alias("level")
    )


def rolling_baseline(
    curve: DataFrame,
    keys: Sequence[str],
    *,
    value: str,
    half: int = 60,
    min_spread: float = 0.5,
    tick: str = "sec",
    chunk: int = DEFAULT_CHUNK,
) -> DataFrame:
    """Rolling median and scaled MAD over ``2*half+1`` rows, and the z of each row.

    The frame is truncated at the ends. Spark places each chunk of the axis with its
    halo in a group of at most ``chunk + 2 * half`` rows and orders it; the groups of a
    task stream through numpy, many at once. A value that fills more than half of a
    frame is its median and the deviation is 0: that is seen from counts. The other
    frames are sorted, some thousands at once.
    """
    halo = with_halo(curve, tick, half, half, chunk)
    # A curve already placed by video would not be moved again, and all chunks of a
    # hot video would stay in one task.
    halo = halo.repartition(shuffle_width(curve), *keys, "_chunk")
    placed = halo.withColumn("_at", F.row_number().over(chunk_window(keys, tick)))
    kept = curve.columns
    schema = StructType([*curve.schema.fields, StructField("baseline", DoubleType()), StructField("spread", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            first = rows.column("_at").to_numpy(zero_copy_only=False) == 1
            values = rows.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False)
            base, spread = _medians(values, np.flatnonzero(first), half)
            own = rows.column("_own")
            out = rows.select(kept).append_column("baseline", pa.array(base, from_pandas=True))
            out = out.append_column("spread", pa.array(MAD_TO_SIGMA * spread, from_pandas=True)).filter(own)
            yield from out.combine_chunks().to_batches()

    return placed.mapInArrow(run, schema).withColumn(
        "z", (F.col(value) - F.col("baseline")) / F.greatest("spread", F.lit(min_spread))
    )


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches cut anew where a group begins (``_at`` is 1), so that none holds a part of a group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column("_at").to_numpy(zero_copy_only=False) == 1)
        if len(starts) == 0:
            held.append(batch)
            continue
        cut = int(starts[-1])
        if held or cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _medians(values: np.ndarray, starts: np.ndarray, half: int, slice_rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Median and median absolute deviation of the rows within *half* of each row of its group; NaN is no value."""
    size = len(values)
    row = np.arange(size)
    group = np.searchsorted(starts, row, side="right") - 1
    low = np.maximum(row - half, starts[group])
    high = np.minimum(row + half + 1, np.append(starts[1:], size)[group])

    def counted(flags: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(flags)])
        return upto[high] - upto[low]

    known = ~np.isnan(values)
    n = counted(known)
    base, spread = np.full(size, np.nan), np.full(size, np.nan)
    rest = n > 0
    if known.any():
        distinct, times = np.unique(values[known], return_counts=True)
        common = distinct[np.argmax(times)]
        filled = 2 * counted(values == common) > n
        base[filled], spread[filled] = common, 0.0
        rest &= ~filled

    def middle(frames: np.ndarray, m: np.ndarray) -> np.ndarray:
        # missing places sort to the end of a frame
        ordered = np.sort(frames, axis=1)
        at = np.arange(len(m))
        return (ordered[at, (m - 1) // 2] + ordered[at, m // 2]) / 2.0

    padded = np.concatenate([np.full(half, np.nan), values, np.full(half, np.nan)])
    frames = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1)
    todo = np.flatnonzero(rest)
    offset = np.arange(-half, half + 1)
    for at in range(0, len(todo), slice_rows):
        some = todo[at : at + slice_rows]
        place = some[:, None] + offset
        inside = (place >= low[some, None]) & (place < high[some, None])
        part = np.where(inside, frames[some], np.nan)
        base[some] = middle(part, n[some])
        spread[some] = middle(np.abs(part - base[some, None]), n[some])
    return base, spread


def bounded_frames(
    curve: DataFrame,
    keys: Sequence[str],
    columns: dict[str, tuple[Column, int, int]],
    *,
    tick: str = "sec",
    chunk: int = DEFAULT_CHUNK,
) -> DataFrame:
    """Several bounded row frames at once: one halo copy, one sort.

    *columns* maps a name to ``(aggregate, first, last)`` with the frame in rows.
    """
    before = max(0, *[-lo for _, lo, _ in columns.values()])
    after = max(0, *[hi for _, _, hi in columns.values()])
    df = with_halo(curve, tick, before, after, chunk)
    for name, (agg, lo, hi) in columns.items():
        df = df.withColumn(name, agg.over(chunk_window(keys, tick).rowsBetween(lo, hi)))
    return drop_halo(df)


def onset(curve: DataFrame, keys: Sequence[str], *, value: str, lookback: int = 2) -> DataFrame:
    """Rise above the lowest of the previous *lookback* rows; 0 in the first row."""
    out = bounded_frames(curve, keys, {"_low": (F.min(value), -lookback, -1)})
    return out.withColumn("onset", F.coalesce(F.col(value) - F.col("_low"), F.lit(0.0))).drop("_low")


def loud_density(
    curve: DataFrame, keys: Sequence[str], *, value: str, window: int = 10, percentile: float = 0.8
) -> DataFrame:
    """Share of loud rows times mean excess over the median, in a zero-padded box."""
    stats = curve.groupBy(*keys).agg(
        F.percentile(value, F.array(F.lit(0.5), F.lit(percentile))).alias("_s")
    )
    x = (
        curve.join(stats, list(keys))
        .withColumn("_hot", F.when(F.col(value) > F.col("_s")[1], 1.0).otherwise(0.0))
        .withColumn("_over", F.greatest(F.col(value) - F.col("_s")[0], F.lit(0.0)))
    )
    lo, hi = -(window // 2), window - window // 2 - 1
    out = bounded_frames(x, keys, {"_fh": (F.sum("_hot"), lo, hi), "_fo": (F.sum("_over"), lo, hi)})
    return out.withColumn(
        "density", (F.col("_fh") / window) * (F.col("_fo") / window)
    ).drop("_s", "_hot", "_over", "_fh", "_fo")


def mark_density(axis: DataFrame, keys: Sequence[str], *, marks: str, window: int = 20) -> DataFrame:
    """Marks within the window ``[i - w/2, i + w - w/2)`` of each row."""
    half = window // 2
    return bounded_frames(axis, keys, {"density": (F.sum(marks), -half, window - half - 1)})


def ordinal_rank(curve: DataFrame, keys: Sequence[str], *, value: str, out: str, tick: str = "sec", middle: str | None = None) -> DataFrame:
    """100 * rank / (n - 1), ties in time order; equal values are counted along the axis in chunks.

    *middle* names a second column for the percentile of :func:`midrank`, from the same counts.
    Rows are shuffled once: the counts of earlier chunks are read from the same shuffle.
    """
    ranked = value_counts(curve, keys, value, write=True)
    k = [*keys, value]
    placed = curve.withColumn("_chunk", F.coalesce(chunk_of(tick), F.lit(0).cast("long")))
    inner = Window.partitionBy(*k, "_chunk").orderBy(tick)
    whole = inner.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local = placed.withColumn("_nth", F.row_number().over(inner)).withColumn("_all", F.count(F.lit(1)).over(whole))
    outer = Window.partitionBy(*k).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_all").over(outer), F.lit(0))
    heads = local.filter("_nth = 1").select(*k, "_chunk", before.alias("_before"))
    x = local.join(heads.join(ranked, k), [*k, "_chunk"])
    rank = F.col("_upto") - F.col("_n") + F.col("_before") + F.col("_nth") - 1
    made = [(F.lit(100.0) * rank / F.greatest(F.col("_total") - 1, F.lit(1))).alias(out)]
    if middle is not None:
        made.append(_middle_percentile().alias(middle))
    return x.select(*curve.columns, *made)


def _middle_percentile() -> Column:
    return F.round((F.col("_upto") - F.col("_n") + F.col("_upto")) / 2.0 / F.col("_total") * 100.0, 1)


def midrank(curve: DataFrame, keys: Sequence[str], *, value: str, out: str) -> DataFrame:
    """Percentile with ties at their midrank.

    Ranking is done over distinct values with their counts, so a run of equal
    values costs one row.
    """
    ranks = value_counts(curve, keys, value)
    return curve.join(ranks.select(*keys, value, _middle_percentile().alias(out)), [*keys, value])


def local_maxima(
    curve: DataFrame,
    keys: Sequence[str],
    *,
    value: str,
    sensitivity: float = 0.75,
    low: float = 0.10,
    high: float = 0.97,
    tick: str = "sec",
) -> DataFrame:
    """Rows not below either neighbour after normalising between two order statistics.

    The percentiles are order statistics at index ``int(n * p)``, not interpolated.
    """
    ranked = value_counts(curve, keys, value, write=True)

    def at(p: float) -> Column:
        index = F.least(F.col("_total") - 1, F.floor(F.col("_total") * F.lit(p)).cast("long"))
        return F.min(F.when(F.col("_upto") > index, F.col(value)))

    bounds = ranked.groupBy(*keys).agg(at(low).alias("_lo"), at(high).alias("_hi"))
    norm = F.least(
        F.lit(1.0),
        F.greatest(F.lit(0.0), (F.col(value) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-6))),
    )
    normed = curve.join(bounds, list(keys)).withColumn("norm", norm).drop("_lo", "_hi")
    framed = bounded_frames(
        normed, keys, {"_b": (F.max("norm"), -1, -1), "_a": (F.max("norm"), 1, 1)}, tick=tick
    )
    peak = (
        (F.col("norm") >= sensitivity)
        & (F.col("norm") >= F.coalesce("_b", F.lit(-1.0)))
        & (F.col("norm") >= F.coalesce("_a", F.lit(-1.0)))
    )
    return framed.filter(peak).drop("_a", "_b")


def hold_and_reach(
    flags: DataFrame,
    keys: Sequence[str],
    *,
    flag: str,
    sustained: int = 1,
    within: int = 0,
    tick: str = "sec",
) -> DataFrame:
    """Rows of *flags* where a condition holds after its shape modifiers.

    Held for *sustained* consecutive rows it passes for its whole run, and every
    passing run then reaches *within* rows either way. A missing flag is never
    true. Runs come from the two-level islands; only true rows are touched.
    """
    on = flags.filter(F.coalesce(F.col(flag), F.lit(False))).select(*keys, tick).distinct()
    met = widened_runs(on, keys, tick=tick, sustained=F.lit(sustained), within=F.lit(within))
    return flags.join(met, [*keys, tick], "left_semi")


def widened_runs(on: DataFrame, keys: Sequence[str], *, tick: str, sustained: Column, within: Column) -> DataFrame:
    """Ticks covered by the runs of *on* that last long enough, widened on both sides.

    *sustained* and *within* may depend on *keys*.
    """
    from tidemark.operators.islands import point_islands

    runs = point_islands(on, keys, tick, 1).filter(F.col("end") - F.col("start") + 1 >= sustained)
    ticks = F.sequence(F.greatest(F.lit(0), F.col("start") - within), F.col("end") + within)
    return runs.select(*keys, F.explode(ticks).alias(tick)).distinct()


def robust_z_of_subset(
    df: DataFrame, keys: Sequence[str], *, value: str, subset: str, min_spread: float, out: str
) -> DataFrame:
    """z against the median and scaled MAD of the rows where *subset* is true."""
    part = df.filter(subset).select(*keys, value)
    stats = median_and_deviation(part, keys, value).select(*keys, F.col("median").alias("_m"), F.col("deviation").alias("_d"))
    return (
        df.join(stats, list(keys), "left")
        .withColumn(
            out,
            F.coalesce(
                (F.col(value) - F.col("_m"))
                / F.greatest(F.lit(MAD_TO_SIGMA) * F.col("_d"), F.lit(min_spread)),
                F.lit(0.0),
            ),
        )
        .drop("_m", "_d")
    )


def spike_then_still(
    curve: DataFrame,
    keys: Sequence[str],
    scene: str,
    *,
    value: str,
    spike: float,
    freeze: float,
    frames: int,
    tick: str = "sec",
) -> DataFrame:
    """Rows far above their scene's mean followed by *frames* quiet rows of the scene.

    The mean adds up in the order of *tick*, so that a row exactly at a bar is judged alike in every run.
    """
    w = Window.partitionBy(*keys, scene).orderBy(tick)
    ahead = w.rowsBetween(1, frames)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = (
        curve.withColumn("_mean", F.avg(value).over(whole))
        .withColumn("_next", F.collect_list(value).over(ahead))
        .withColumn("_calm", F.avg(value).over(ahead))
    )
    still = F.col("_mean") * freeze
    quiet = F.size(F.filter("_next", lambda v: v < still)) / F.lit(frames)
    return x.filter(
        (F.col(value) > F.col("_mean") * spike)
        & (F.size("_next") == frames)
        & (quiet >= 0.7)
        & (F.col("_calm") < still)
        & (F.col("_calm") < F.col(value) * 0.3)
    ).select(*keys, scene, tick, value)


def wave_bins(samples: DataFrame, keys: Sequence[str], *, index: str, value: str, points: int) -> DataFrame:
    """(min, max, rms) of runs of ``max(1, n // points)`` samples."""
    n = samples.groupBy(*keys).agg(F.count("*").alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / points)).cast("long")
    return (
        samples.join(n, list(keys))
        .withColumn("bin", F.floor(F.col(index) / step).cast("int"))
        .groupBy(*keys, "bin")
        .agg(
            F.min(value).alias("lo"),
            F.max(value).alias("hi"),
            F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"),
        )
    )


def downsample_max(curve: DataFrame, keys: Sequence[str], *, value: str, points: int, tick: str = "sec") -> DataFrame:
    """Reduce to *points* buckets keeping each bucket's maximum.

    Bucket edges are ``int(b * n / points)``; row *i* falls in
    ``ceil((i + 1) * points / n) - 1``. Shorter curves stay as they are.
    """
    n = curve.groupBy(*keys).agg(F.count("*").alias("_n"))
    spot = F.floor(((F.col(tick) + 1) * F.lit(points) + F.col("_n") - 1) / F.col("_n")) - 1
    return (
        curve.join(n, list(keys))
        .withColumn("bucket", F.when(F.col("_n") <= points, F.col(tick)).otherwise(spot).cast("int"))
        .groupBy(*keys, "bucket")
        .agg(F.round(F.max(value), 4).alias(value))
    )


def stretch_maxima(series: DataFrame, keys: Sequence[str], lengths: DataFrame, *, value: str, tick: str = "sec") -> DataFrame:
    """(*keys*, ``_k``, ``_start``, ``_max``): the maximum of every window of the lengths asked.

    *lengths* are distinct (*keys*, ``_k``, ``_n``) with ``_n`` the number of ticks of the
    dense series, which counts from 0. A range-maximum table holds, per tick, the maxima of
    the windows of 1, 2, 4, ... ticks that begin there, each made from two of half its size;
    any window is covered by two of them.
    """
    longest = lengths.agg(F.max("_k")).first()[0] or 1
    levels = longest.bit_length()
    df = with_halo(series.select(*keys, tick, F.col(value).alias("_m0")), tick, 0, (1 << levels) - 1)
    for j in range(1, levels):
        further = F.lead(f"_m{j - 1}", 1 << (j - 1)).over(chunk_window(keys, tick))
        df = df.withColumn(f"_m{j}", F.greatest(f"_m{j - 1}", further))
    table = df.filter("_own").select(*keys, "_chunk", tick, F.array(*[f"_m{j}" for j in range(levels)]).alias("_levels"))
    # joined by chunk, where the table lies: its rows are the many and wide ones
    asked = lengths.select(*keys, "_k", "_n", F.explode(F.sequence(F.lit(0).cast("long"), chunk_of(F.col("_n") - 1))).alias("_chunk"))
    j = F.length(F.bin("_k")) - 1
    reach = F.col("_k") - F.call_function("shiftleft", F.lit(1), j)  # how far the second part begins after the first
    placed = table.join(asked, [*keys, "_chunk"]).select(*keys, "_k", "_n", F.get("_levels", j).alias("_max"), F.explode(F.array_distinct(F.array(F.col(tick), F.col(tick) - reach))).alias("_start"))
    inside = (F.col("_start") >= 0) & (F.col("_start") <= F.col("_n") - F.col("_k"))
    return placed.filter(inside).groupBy(*keys, "_k", "_start").agg(F.max("_max").alias("_max"))


def rank_among_stretches(
    series: DataFrame,
    keys: Sequence[str],
    asked: DataFrame,
    *,
    value: str,
    length: str,
    mine: str,
    tick: str = "sec",
) -> DataFrame:
    """Midrank of a clip's maximum among all windows of the clip's own length.

    *asked* has one row per clip with its whole-second *length* and its own maximum *mine*.
    The series is dense from 0 on (0 where absent), and windows whose maximum is 0 do not
    count; a clip longer than the series has the whole series as its only window. Evidence is
    the number of windows divided back into whole stretches; without any, both are 0. Ranks
    come from running sums over the distinct maxima, in parts of their range.
    """
    n = series.groupBy(*keys).agg(F.count("*").cast("int").alias("_n"))
    a = asked.join(n, list(keys)).withColumn("_k", F.greatest(F.lit(1), F.least(F.col(length), F.col("_n"))).cast("int"))
    maxima = stretch_maxima(series, keys, a.select(*keys, "_k", "_n").distinct(), value=value, tick=tick)
    k = [*keys, "_k"]
    counted = maxima.filter(F.col("_max") > 0).groupBy(*k, "_max").agg(F.count("*").alias("_c"))
    marks = counted.unionByName(a.select(*k, F.col(mine).cast("double").alias("_max"), F.lit(0).cast("long").alias("_c")))
    marks = marks.groupBy(*k, "_max").agg(F.sum("_c").alias("_c"))
    total = marks.groupBy(*k).agg(F.sum("_c").alias("_total"), F.max("_max").alias("_top"))
    part = F.when(F.col("_top") > 0, F.floor(F.greatest(F.col("_max"), F.lit(0.0)) / F.col("_top") * 1024)).otherwise(0).cast("int")
    placed = marks.join(total, k).withColumn("_part", part)
    summed = prefix_sum(placed, k, ["_part", "_max"], "_c", "_upto", "_part", 1)
    got = a.join(summed.select(*k, F.col("_max").alias(mine), "_c", "_upto", "_total"), [*k, mine])
    some = F.col("_total") > 0
    percentile = F.when(some, F.round((2 * F.col("_upto") - F.col("_c")) / 2.0 / F.col("_total") * 100.0, 1)).otherwise(0.0)
    stretches = F.when(some, F.greatest(F.lit(1), F.rint(F.col("_total") / F.greatest(F.lit(1), F.col(length))).cast("long"))).otherwise(0)
    return got.select(*asked.columns, percentile.alias("percentile"), stretches.alias("stretches"))


def relative_size(
    largest: DataFrame,
    clips: DataFrame,
    videos: DataFrame,
    keys: Sequence[str],
    *,
    total: str = "duration",
    least_together: int = 6,
    least_stretches: int = 6,
) -> DataFrame:
    """How large a class is in a clip next to another class of the same second.

    *largest* has one row per (*keys*, sec, label) with the ``size`` of its largest instance.
    The reference of a class is what stands beside it most often in the video, among the
    classes that do so inside the clip and for *least_together* seconds at least (ties: the
    first name). Reported is the second with the greatest ratio (ties: the first), ranked
    among all stretches of the clip's length; ``linear`` is the ratio of lengths.
    """
    from tidemark.operators.joins import points_in_spans

    other = largest.select(*keys, "sec", F.col("label").alias("reference"), F.col("size").alias("_other"))
    pairs = largest.join(other, [*keys, "sec"]).filter("label <> reference")
    pair = [*keys, "label", "reference"]
    together = pairs.groupBy(*pair).agg(F.count("*").alias("together")).filter(F.col("together") >= least_together)
    known = pairs.join(together, pair).withColumn("ratio", F.when(F.col("_other") > 0, F.col("size") / F.col("_other")))
    spans = clips.select(*keys, "idx", "start", "end", (F.col("end") - F.col("start")).cast("int").alias("length"))
    seen = points_in_spans(known, spans, keys, t="sec").groupBy(*pair, "idx", "length", "together").agg(
        F.max("ratio").alias("ratio"), F.max_by("sec", F.struct("ratio", -F.col("sec"))).alias("at")
    )
    best = seen.groupBy(*keys, "label", "idx").agg(F.min_by("reference", F.struct(-F.col("together"), "reference")).alias("reference"))
    chosen = seen.join(best, [*keys, "label", "idx", "reference"]).filter("ratio is not null")
    asked = chosen.select(*pair).distinct()
    axis = asked.join(videos.select(*keys, total), list(keys)).select(*pair, F.explode(F.sequence(F.lit(0), F.col(total).cast("int") - 1)).alias("sec"))
    ratios = known.join(asked, pair, "left_semi").select(*pair, "sec", "ratio")
    series = axis.join(ratios, [*pair, "sec"], "left").select(*pair, "sec", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))
    typical = ratios.filter("ratio > 0").groupBy(*pair).agg(F.median("ratio").alias("median"))
    ranked = rank_among_stretches(series, pair, chosen, value="ratio", length="length", mine="ratio")
    return ranked.join(typical, pair, "left").select(
        *pair, "idx", "at", "ratio", F.sqrt("ratio").alias("linear"), "percentile", "median", "together", "stretches",
        (F.col("stretches") >= least_stretches).alias("enough"),
    )

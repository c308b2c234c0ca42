"""Ranking, quotas and constrained greedy selection.

Greedy picks are folds over a ranked array per video. The array holds one entry
per scored second (or per region), which the axis bounds, and the fold is a
native ``aggregate``: no Python worker is involved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_seconds(
    scores: DataFrame, keys: Sequence[str], *, mode: str = "MAX", score: str = "score", conf: str = "conf"
) -> DataFrame:
    """Score desc, confidence desc, second asc. ``MAX`` ignores seconds without score."""
    rows = scores if mode == "EXACT" else scores.filter(F.col(score) > 0)
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.desc(conf), F.asc("sec"))
    return rows.withColumn("rank", F.row_number().over(w))


def quota_per_type(
    sequences: DataFrame,
    keys: Sequence[str],
    label: str,
    *,
    target: float,
    factor: float = 3.0,
    conf: str = "conf",
    duration: str = "duration",
    tie: str = "start",
) -> DataFrame:
    """Best sequences of each type while the time taken before them is under quota.

    The quota is ``factor * target / number of types`` of the video.
    """
    types = sequences.groupBy(*keys).agg(F.count_distinct(label).alias("_types"))
    w = (
        Window.partitionBy(*keys, label)
        .orderBy(F.desc(conf), F.asc(tie))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum(duration).over(w), F.lit(0.0))
    return (
        sequences.withColumn("_before", before)
        .join(types, list(keys))
        .filter(F.col("_before") < F.lit(factor * target) / F.col("_types"))
        .drop("_before", "_types")
    )


def spaced_picks(
    candidates: DataFrame,
    keys: Sequence[str],
    *,
    t: str,
    rank: Sequence[Column],
    gap: float,
    strict: bool = True,
    limit: int | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Greedy picks in *rank* order, none too close to an earlier pick.

    ``strict``: two picks conflict when less than *gap* apart; otherwise also at
    exactly *gap*. Candidates further apart than that never influence each other,
    so the axis is first split into components at such distances and the greedy
    fold runs per component. Accepting is independent between components, so the
    first *limit* accepted overall are simply the best *limit* of all accepted.
    *rank* must be ascending sort columns that end in a unique one.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    step = F.col(t) - F.lag(t).over(w)
    apart = (step >= gap) if strict else (step > gap)
    parts = candidates.withColumn(
        "_comp",
        F.sum(F.when(step.isNull() | apart, 1).otherwise(0)).over(
            w.rowsBetween(Window.unboundedPreceding, 0)
        ),
    )
    order = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)])
    row = F.struct(order.alias("o"), F.col(t).cast("double").alias("t"), F.struct(t, *carry).alias("c"))
    folded = parts.groupBy(*keys, "_comp").agg(F.array_sort(F.collect_list(row)).alias("_all"))

    def keep(kept: Column, x: Column) -> Column:
        distance = lambda k: F.abs(k["t"] - x["t"])
        clash = F.exists(kept, lambda k: distance(k) < gap if strict else distance(k) <= gap)
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(x)))

    picked = folded.select(
        *keys, F.explode(F.aggregate("_all", F.slice("_all", 1, 0), keep)).alias("_p")
    )
    ranked = Window.partitionBy(*keys).orderBy("_p.o")
    out = picked.withColumn("pick", F.row_number().over(ranked))
    if limit is not None:
        out = out.filter(F.col("pick") <= limit)
    return out.select(*keys, "_p.c.*", "pick")


_SPANS = "array<struct<s: double, e: double, b: int>>"


def select_windows(
    scores: DataFrame,
    videos: DataFrame,
    keys: Sequence[str],
    *,
    clip_time: int,
    target: float | Column,
    total: str = "duration",
    mode: str = "MAX",
    coverage: float = 0.0,
    exclude: DataFrame | None = None,
    score: str = "score",
    conf: str = "conf",
) -> DataFrame:
    """Non-overlapping windows around the best seconds until the budget is spent.

    Windows are centred, pulled back inside the video, and the last is trimmed to
    what is left of the budget. With *coverage* a bucket of the timeline may only
    take its ceiling; a second pass without ceilings places what the first could
    not. *exclude* ranges are never touched and cost no budget.

    One fold per video over its ranked seconds, at most one entry per second.
    """
    clip = int(clip_time)
    goal = target if isinstance(target, Column) else F.lit(float(target))
    v = videos.select(*keys, F.col(total).cast("double").alias("_dur"), goal.alias("_goal"))
    ranked = rank_seconds(scores, keys, mode=mode, score=score, conf=conf).join(v, list(keys))
    if clip <= 0:
        buckets = F.lit(1)
    else:
        buckets = F.greatest(F.lit(1), F.floor(F.col("_goal") / clip).cast("int"))
    begin = F.greatest(F.lit(0.0), (F.col("sec") - clip // 2).cast("double"))
    finish = F.least(F.col("_dur"), begin + clip)
    pulled = F.when(
        (finish - begin < clip) & (begin > 0), F.greatest(F.lit(0.0), finish - clip)
    ).otherwise(begin)
    bucket = F.when(F.col("_dur") <= 0, 0).otherwise(
        F.least(buckets - 1, F.floor(F.col("sec") / F.col("_dur") * buckets).cast("int"))
    )
    cand = F.struct(
        F.col("rank").alias("r"),
        F.col("sec").cast("double").alias("t"),
        pulled.alias("s"),
        finish.alias("e"),
        bucket.alias("b"),
    )
    fair = F.col("_goal") / buckets
    share = min(1.0, max(0.0, float(coverage)))
    ceiling = fair + F.lit(1.0 - share) * (F.col("_goal") - fair)
    rows = ranked.withColumn("_cand", cand).withColumn("_ceiling", ceiling)
    table = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list("_cand")).alias("_all"),
        F.first("_goal").alias("_goal"),
        F.first("_ceiling").alias("_ceiling"),
    )
    if exclude is not None:
        banned = exclude.groupBy(*keys).agg(
            F.collect_list(F.struct(F.floor("start").alias("lo"), F.ceil("end").alias("hi"))).alias("_out")
        )
        table = table.join(banned, list(keys), "left")
        table = table.withColumn("_out", F.coalesce("_out", F.expr("cast(array() as array<struct<lo: bigint, hi: bigint>>)")))
    else:
        table = table.withColumn("_out", F.expr("cast(array() as array<struct<lo: bigint, hi: bigint>>)"))

    def fold(initial: Column, capped: bool) -> Column:
        def step(st: Column, c: Column) -> Column:
            lo, hi = F.floor(c["s"]), F.floor(c["e"])
            hits = lambda a, b: ((lo < b) & (a < hi)) | ((c["t"] >= a) & (c["t"] < b))
            clash = F.exists("_out", lambda x: hits(x["lo"], x["hi"])) | F.exists(
                st["spans"], lambda x: hits(F.floor(x["s"]), F.floor(x["e"]))
            )
            left = F.col("_goal") - st["total"]
            end = F.least(c["e"], c["s"] + left)
            length = end - c["s"]
            ok = ~clash
            if capped:
                spent = F.aggregate(
                    F.filter(st["spans"], lambda x: x["b"] == c["b"]), F.lit(0.0), lambda a, x: a + x["e"] - x["s"]
                )
                ok = ok & (spent + length <= F.col("_ceiling"))
            span = F.struct(c["s"].alias("s"), end.alias("e"), c["b"].alias("b"))
            taken = F.struct(
                F.concat(st["spans"], F.array(span)).alias("spans"), (st["total"] + length).alias("total")
            )
            return F.when(left <= 0, st).when(ok, taken).otherwise(st)

        return F.aggregate("_all", initial, step)

    empty = F.struct(F.array().cast(_SPANS).alias("spans"), F.lit(0.0).alias("total"))
    # The generator keeps the first fold from being evaluated once per use below.
    first = table.select("*", F.inline(F.array(F.struct(fold(empty, True).alias("_st")))))
    second = first.select(
        *keys,
        F.inline(
            F.array(
                F.struct(
                    F.when(F.col("_st.total") >= F.col("_goal"), F.col("_st"))
                    .otherwise(fold(F.col("_st"), False))
                    .alias("_st")
                )
            )
        ),
    )
    spans = F.array_sort(F.transform("_st.spans", lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end"))))
    return second.select(*keys, F.posexplode(spans).alias("_i", "_p")).select(
        *keys, (F.col("_i") + 1).alias("idx"), "_p.start", "_p.end"
    )


def swap_clip(
    scores: DataFrame,
    videos: DataFrame,
    clips: DataFrame,
    keys: Sequence[str],
    which: DataFrame,
    *,
    clip_time: int,
    rejected: DataFrame | None = None,
    total: str = "duration",
    mode: str = "MAX",
) -> DataFrame:
    """Replace one clip of each video by the best moment of equal length not yet used.

    *which* names the clip (``idx``) per video. Everything kept, the dropped clip
    and *rejected* are excluded. Videos with nothing else to offer have no row.
    """
    w = which.select(*keys, F.col("idx").alias("_which"))
    marked = clips.join(w, list(keys))
    dropped = marked.filter("idx = _which").select(*keys, (F.col("end") - F.col("start")).alias("_need"))
    banned = marked.select(*keys, "start", "end")
    if rejected is not None:
        banned = banned.unionByName(rejected.select(*keys, "start", "end"))
    wanted = videos.join(dropped, list(keys))
    new = select_windows(
        scores, wanted, keys, clip_time=clip_time, target=F.col("_need"), total=total, mode=mode, exclude=banned
    ).select(*keys, "start", "end", F.lit(True).alias("swapped"))
    found = new.select(*keys).distinct()
    kept = marked.filter("idx <> _which").join(found, list(keys), "left_semi")
    out = kept.select(*keys, "start", "end", F.lit(False).alias("swapped")).unionByName(new)
    order = Window.partitionBy(*keys).orderBy("start")
    return out.withColumn("idx", F.row_number().over(order))


def undo_swap(clips: DataFrame, swapped: DataFrame, rejected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Put the rejected clip back in place of the one that replaced it."""
    kept = clips.join(swapped.select(*keys, "start", "end"), [*keys, "start", "end"], "left_anti")
    back = kept.select(*keys, "start", "end").unionByName(rejected.select(*keys, "start", "end"))
    return back.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy("start")))


def span_scores(
    spans: DataFrame, curve: DataFrame, keys: Sequence[str], *, value: str = "score", out: str = "score"
) -> DataFrame:
    """Sum of a dense curve over the whole seconds ``int(start)..int(end)`` of each span.

    Two lookups in the curve's running sum instead of a row per second.
    """
    from tidemark.operators.axis import prefix_sum

    run = prefix_sum(curve.select(*keys, "sec", value), keys, ["sec"], value, "_cum", "sec").select(
        *keys, "sec", "_cum"
    )
    n = curve.groupBy(*keys).agg(F.max("sec").alias("_last"))
    x = (
        spans.drop(out)
        .join(n, list(keys))
        .withColumn("_hi", F.least(F.floor("end").cast("int"), F.col("_last")))
        .withColumn("_lo", F.greatest(F.lit(0), F.floor("start").cast("int")) - 1)
    )
    top = run.select(*keys, F.col("sec").alias("_hi"), F.col("_cum").alias("_c1"))
    low = run.select(*keys, F.col("sec").alias("_lo"), F.col("_cum").alias("_c0"))
    y = x.join(top, [*keys, "_hi"], "left").join(low, [*keys, "_lo"], "left")
    total = F.when(
        F.col("_hi") > F.col("_lo"), F.coalesce("_c1", F.lit(0.0)) - F.coalesce("_c0", F.lit(0.0))
    ).otherwise(0.0)
    return y.withColumn(out, total).drop("_hi", "_lo", "_last", "_c0", "_c1")


def snapped_clusters(
    clusters: DataFrame, scenes: DataFrame, keys: Sequence[str], *, snap: float = 3.0, growth: float = 5.0
) -> DataFrame:
    """Clusters stretched to the first scene holding their middle, by at most *growth*."""
    from tidemark.operators.joins import points_in_spans

    c = clusters.withColumn("_mid", (F.col("start") + F.col("end")) / 2)
    wide = scenes.select(
        *keys,
        (F.col("start") - snap).alias("_wlo"),
        (F.col("end") + snap).alias("_whi"),
        F.col("start").alias("_ss"),
        F.col("end").alias("_se"),
    )
    ident = [*clusters.columns]
    hit = points_in_spans(c, wide, keys, t="_mid", start="_wlo", end="_whi", closed_end=True)
    first = hit.groupBy(*ident).agg(F.min(F.struct("_ss", "_se")).alias("_sc"))
    j = clusters.join(first, ident, "left")
    lo = F.greatest(F.least("start", "_sc._ss"), F.col("start") - growth)
    hi = F.least(F.greatest("end", "_sc._se"), F.col("end") + growth)
    return j.withColumn("_nlo", F.when(F.col("_sc").isNull(), F.col("start")).otherwise(lo)).withColumn(
        "_nhi", F.when(F.col("_sc").isNull(), F.col("end")).otherwise(hi)
    ).select(*[c for c in ident if c not in ("start", "end")], F.col("_nlo").alias("start"), F.col("_nhi").alias("end"))


def point_regions(points: DataFrame, scenes: DataFrame, keys: Sequence[str], *, t: str) -> DataFrame:
    """Candidate regions of point signals: clustered, padded, snapped to scenes.

    *points* carries each signal's own ``source, gap, min_pad, max_pad``, so all
    signals are clustered in one pass.
    """
    from tidemark.operators.islands import pad_clusters, point_islands

    k = [*keys, "source", "gap", "min_pad", "max_pad"]
    c = point_islands(points, k, t, F.col("gap"))
    c = pad_clusters(c, min_pad=F.col("min_pad"), max_pad=F.col("max_pad")).drop("gap", "min_pad", "max_pad")
    return snapped_clusters(c, scenes, keys)


def merge_regions(regions: DataFrame, keys: Sequence[str], *, gap: float = 1.5) -> DataFrame:
    """Overlapping or near regions as one; scores add up, sources are gathered."""
    from tidemark.operators.islands import interval_islands

    return interval_islands(
        regions, keys, gap=gap, aggs={"score": ("sum", "score"), "sources": ("set", "source"), "n": ("count", "score")}
    )


def constrain_regions(
    regions: DataFrame,
    curve: DataFrame,
    videos: DataFrame,
    keys: Sequence[str],
    *,
    min_length: float = 1.5,
    max_length: float = 30.0,
    total: str = "duration",
    value: str = "score",
) -> DataFrame:
    """Short regions padded, long ones cut into back-to-back windows scored anew."""
    x = regions.join(videos.select(*keys, F.col(total).cast("double").alias("_dur")), list(keys))
    length = F.col("end") - F.col("start")
    half = (F.lit(min_length) - length) / 2
    lo = F.greatest(F.lit(0.0), F.col("start") - half)
    hi = F.least(F.col("_dur"), F.col("end") + half)
    lacking = hi - lo < min_length
    short = x.filter(length < min_length).select(
        *keys,
        F.when(lacking & (lo != 0), F.greatest(F.lit(0.0), hi - min_length)).otherwise(lo).alias("start"),
        F.when(lacking & (lo == 0), F.least(F.col("_dur"), F.lit(float(min_length)))).otherwise(hi).alias("end"),
        "score",
        "sources",
    )
    fits = x.filter((length >= min_length) & (length <= max_length)).select(*keys, "start", "end", "score", "sources")
    k = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((length - 0.01) / max_length).cast("int") - 1)))
    pieces = x.filter(length > max_length).withColumn("_k", k)
    at = F.col("start") + F.col("_k") * max_length
    cut = (
        pieces.withColumn("_s", at)
        .withColumn("_e", F.least(F.col("end"), at + max_length))
        .filter(F.col("_e") - F.col("_s") >= min_length)
        .select(*keys, F.col("_s").alias("start"), F.col("_e").alias("end"), "sources")
    )
    scored = span_scores(cut, curve, keys, value=value, out="score")
    return short.unionByName(fits).unionByName(scored.select(*keys, "start", "end", "score", "sources"))


def select_regions(regions: DataFrame, keys: Sequence[str], *, target: float) -> DataFrame:
    """Densest regions first, sharing no time, the last trimmed to the budget.

    A fold per video over its constrained regions (windows of bounded length on a
    bounded axis).
    """
    density = F.col("score") / F.greatest(F.lit(0.5), F.col("end") - F.col("start"))
    row = F.struct(
        (-density).alias("d"), (-F.col("score")).alias("sc"), F.col("start").alias("s"), F.col("end").alias("e")
    )
    table = regions.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_all"))
    kind = "array<struct<s: double, e: double, score: double>>"

    def step(st: Column, r: Column) -> Column:
        left = F.lit(float(target)) - st["total"]
        clash = F.exists(st["kept"], lambda k: F.least(k["e"], r["e"]) - F.greatest(k["s"], r["s"]) > 0)
        end = F.least(r["e"], r["s"] + left)
        span = F.struct(r["s"].alias("s"), end.alias("e"), (-r["sc"]).alias("score"))
        return F.when(clash | (left <= 0), st).otherwise(
            F.struct(
                F.concat(st["kept"], F.array(span)).alias("kept"), (st["total"] + end - r["s"]).alias("total")
            )
        )

    start = F.struct(F.array().cast(kind).alias("kept"), F.lit(0.0).alias("total"))
    kept = F.aggregate("_all", start, step, lambda st: F.array_sort(st["kept"]))
    return table.select(*keys, F.posexplode(kept).alias("_i", "_k")).select(
        *keys,
        (F.col("_i") + 1).alias("idx"),
        F.col("_k.s").alias("start"),
        F.col("_k.e").alias("end"),
        F.col("_k.score").alias("score"),
    )

"""Per-second scores from weighted signals, and action sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.axis import neighbour, run_ids


def action_sequences(
    detections: DataFrame,
    keys: Sequence[str],
    *,
    t: str,
    tie: str,
    conf: str = "conf",
    max_gap: float = 1.3,
    jump: float = 0.01,
    min_duration: float = 0.5,
) -> DataFrame:
    """Consecutive detections close in time and in confidence, one row a sequence."""
    ran = run_ids(
        detections,
        keys,
        [t, tie],
        F.struct(F.col(t).alias("t"), F.col(conf).alias("c")),
        lambda p: (F.col(t) - p["t"] > max_gap) | (F.abs(F.col(conf) - p["c"]) > jump),
        "_run",
        t,
    )
    return (
        ran.groupBy(*keys, "_run")
        .agg(
            F.min(t).alias("start"),
            F.max(t).alias("end"),
            F.avg(conf).alias("conf"),
            F.count("*").alias("n"),
        )
        .withColumn("duration", F.greatest(F.lit(min_duration), F.col("end") - F.col("start")))
        .drop("_run")
    )


def detection_runs(
    detections: DataFrame,
    keys: Sequence[str],
    *,
    t: str,
    tie: str,
    threshold: float = 0.01,
    min_duration: float = 1.0,
) -> DataFrame:
    """Runs of one label in time order.

    A row under *threshold* belongs to no run and ends the one before it at its
    own time; a change of label ends a run at its last own row.
    """
    d = detections.withColumn("_k", F.when(F.col("conf") >= threshold, F.col("label")))
    ran = run_ids(
        d,
        keys,
        [t, tie],
        F.struct(F.col("_k").alias("k")),
        lambda p: ~p["k"].eqNullSafe(F.col("_k")),
        "_run",
        t,
    )
    runs = ran.groupBy(*keys, "_run").agg(
        F.min("_k").alias("label"),
        F.min(t).alias("start"),
        F.max(t).alias("_last"),
        F.max("conf").alias("conf"),
    )
    after = neighbour(
        runs, keys, ["start", "_run"], F.struct("label", "start"), "_next", "start", step=1
    )
    closed_by_gap = F.col("_next").isNotNull() & F.col("_next.label").isNull()
    return (
        after.filter(F.col("label").isNotNull())
        .withColumn("end", F.when(closed_by_gap, F.col("_next.start")).otherwise(F.col("_last")))
        .filter(F.col("end") - F.col("start") >= min_duration)
        .select(*keys, "label", "start", "end", "conf")
    )


# The signals that count towards the boost; scene, face and position never do.
BOOST_SIGNALS = ("motion_event", "motion_peak", "audio", "burst", "keyword", "object", "action")
SIGNALS = ("scene", *BOOST_SIGNALS, "face", "beginning", "ending")


def point_marks(points: DataFrame, keys: Sequence[str], *, t: str, signal: str, weight: str) -> DataFrame:
    """Point signals as marks: points go to the rounded second (half to even),
    presence to the truncated one."""
    scored = F.struct(
        F.rint(t).cast("int").alias("sec"), F.col(weight).alias("points"), F.lit(False).alias("present")
    )
    seen = F.struct(
        F.floor(t).cast("int").alias("sec"), F.lit(0.0).alias("points"), F.lit(True).alias("present")
    )
    return points.select(*keys, F.col(signal).alias("signal"), F.explode(F.array(scored, seen)).alias("_m")).select(
        *keys, "signal", "_m.*"
    )


def span_marks(spans: DataFrame, keys: Sequence[str], *, signal: str, weight: float) -> DataFrame:
    """Every whole second a span touches, its end included; each second once."""
    secs = F.sequence(F.floor("start").cast("int"), F.floor("end").cast("int"))
    return (
        spans.select(*keys, F.explode(secs).alias("sec"))
        .distinct()
        .select(
            *keys,
            F.lit(signal).alias("signal"),
            "sec",
            F.lit(float(weight)).alias("points"),
            F.lit(True).alias("present"),
        )
    )


def band_marks(
    videos: DataFrame, keys: Sequence[str], *, total: str, head: int, tail: int, head_points: float, tail_points: float
) -> DataFrame:
    """The beginning and ending bands."""
    n = F.floor(total).cast("int")
    first = F.filter(F.sequence(F.lit(0), F.lit(head - 1)), lambda s: s < n)
    last = F.sequence(F.greatest(F.lit(0), n - tail), n - 1)

    def marks(secs, name, points):
        return videos.filter(n > 0).select(
            *keys,
            F.lit(name).alias("signal"),
            F.explode(secs).alias("sec"),
            F.lit(float(points)).alias("points"),
            F.lit(False).alias("present"),
        )

    return marks(first, "beginning", head_points).unionByName(marks(last, "ending", tail_points))


def action_tiers(
    actions: DataFrame,
    keys: Sequence[str],
    *,
    sec: str,
    label: str,
    conf: str,
    weight: float,
) -> DataFrame:
    """One mark a second from its best action: x1.5 / x1 / x0.5 by that label's own
    90th and 50th confidence percentile.

    Confidences are folded to (label, confidence, count) before the percentile,
    so its buffer holds distinct confidences and not detections.
    """
    freq = actions.groupBy(*keys, label, conf).agg(F.count("*").alias("_n"))
    bars = freq.groupBy(*keys, label).agg(
        F.percentile(conf, F.array(F.lit(0.5), F.lit(0.9)), F.col("_n")).alias("_p")
    )
    best = (
        actions.filter(F.col(conf) > 0)
        .groupBy(*keys, sec)
        .agg(F.max_by(F.struct(F.col(label), F.col(conf)), F.struct(F.col(conf), F.col(label))).alias("_b"))
        .select(*keys, F.col(sec).alias("sec"), F.col(f"_b.{label}").alias(label), F.col(f"_b.{conf}").alias(conf))
    )
    tier = F.when(F.col(conf) >= F.col("_p")[1], 1.5).when(F.col(conf) >= F.col("_p")[0], 1.0).otherwise(0.5)
    return best.join(bars, [*keys, label]).select(
        *keys,
        F.lit("action").alias("signal"),
        "sec",
        (tier * weight).alias("points"),
        F.lit(True).alias("present"),
    )


def score_seconds(
    marks: DataFrame,
    keys: Sequence[str],
    *,
    min_signals: int = 2,
    boost: float = 1.2,
    signals: Sequence[str] = SIGNALS,
) -> DataFrame:
    """Marks to one row per scored second: a column per signal, raw sum and boosted score."""
    per = [
        F.sum(F.when(F.col("signal") == s, F.col("points")).otherwise(0.0)).alias(s) for s in signals
    ]
    seen = [
        F.max(F.when((F.col("signal") == s) & F.col("present"), 1).otherwise(0))
        for s in signals
        if s in BOOST_SIGNALS
    ]
    total = seen[0]
    for c in seen[1:]:
        total = total + c
    table = marks.groupBy(*keys, "sec").agg(*per, total.alias("n_signals"))
    raw = F.lit(0.0)
    for s in signals:
        raw = raw + F.col(s)
    return table.withColumn("raw", raw).withColumn(
        "score", F.when(F.col("n_signals") >= min_signals, F.col("raw") * boost).otherwise(F.col("raw"))
    )


# The expression classes, in classifier order.
EXPRESSION_LABELS = ("neutral", "happy", "sad", "surprise", "anger")


def top_label(df: DataFrame, probs: str, labels: Sequence[str]) -> DataFrame:
    """Add ``label`` and ``conf`` of the (first) highest probability."""
    best = F.array_max(probs)
    names = F.array(*[F.lit(x) for x in labels])
    return df.withColumn("conf", best).withColumn(
        "label", F.get(names, (F.array_position(F.col(probs), best) - 1).cast("int"))
    )


def clearest_per_second(
    faces: DataFrame, keys: Sequence[str], *, order: str, min_confidence: float = 0.5
) -> DataFrame:
    """The most confident labelled face of each second, the first one on ties."""
    ok = faces.filter((F.col("conf") >= min_confidence) & (F.coalesce("label", F.lit("")) != ""))
    return ok.groupBy(*keys, "sec").agg(
        F.max_by("label", F.struct(F.col("conf"), -F.col(order))).alias("label"), F.max("conf").alias("conf")
    )


def density_clusters(
    actions: DataFrame,
    keys: Sequence[str],
    *,
    t: str,
    label: str,
    gap: float = 2.0,
    min_density: float = 0.5,
) -> DataFrame:
    """Action times less than *gap* apart; kept when count / length is high enough.

    The first cluster of a video starts its count at zero, later ones at one.
    """
    from pyspark.sql import Window

    from tidemark.operators.islands import point_islands

    times = actions.groupBy(*keys, t).agg(F.collect_set(label).alias("_names"))
    runs = point_islands(
        times, keys, t, gap, strict=True, aggs={"n": ("count", t), "_sets": ("set", "_names")}
    )
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("start")) == 1
    counted = runs.withColumn("action_count", F.col("n") - F.when(first, 1).otherwise(0))
    length = F.col("end") - F.col("start")
    return (
        counted.filter(length > 0)
        .withColumn("density", F.col("action_count") / length)
        .filter(F.col("density") >= min_density)
        .select(
            *keys,
            "start",
            "end",
            "action_count",
            "density",
            F.array_distinct(F.flatten("_sets")).alias("actions"),
        )
    )


def signal_totals(kept: DataFrame, keys: Sequence[str], signals: Sequence[str] = SIGNALS) -> DataFrame:
    """Points per signal over kept seconds; ``evidence`` is false for position bonuses."""
    long = kept.unpivot([*keys], list(signals), "signal", "points")
    return (
        long.groupBy(*keys, "signal")
        .agg(F.sum("points").alias("total"))
        .filter(F.col("total") != 0)
        .withColumn("evidence", ~F.col("signal").isin("beginning", "ending"))
    )


def collapsed_labels(detections: DataFrame, keys: Sequence[str], *, t: str, tie: str, out: str) -> DataFrame:
    """Labels in time order with consecutive repeats written once: ``a ×3, b ×2``.

    Runs are numbered first, so what is collected per group is one entry a run.
    """
    ran = run_ids(
        detections, keys, [t, tie], F.struct(F.col("label").alias("l")), lambda p: p["l"] != F.col("label"), "_run", t
    )
    runs = ran.groupBy(*keys, "_run", "label").agg(F.count("*").alias("_n"))
    shown = F.concat("label", F.lit(" ×"), F.col("_n").cast("string")).alias("s")
    return runs.groupBy(*keys).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_run", shown))), lambda r: r["s"]), ", "
        ).alias(out)
    )


# Three-action patterns and the transitions that count.
ACTION_PATTERNS = {
    "arrival": ("entering", "walking", "standing"),
    "departure": ("standing", "walking", "exiting"),
    "interaction": ("approaching", "talking", "leaving"),
    "combat": ("approaching", "fighting", "exiting"),
    "sports_play": ("running", "jumping", "throwing"),
}
TRANSITIONS = (
    ("standing", "walking"),
    ("walking", "running"),
    ("sitting", "standing"),
    ("lying", "sitting"),
    ("entering", "walking"),
    ("walking", "exiting"),
    ("approaching", "talking"),
    ("talking", "leaving"),
    ("walking", "jumping"),
    ("running", "jumping"),
)


def pattern_facts(
    actions: DataFrame, keys: Sequence[str], *, t: str, name: str, grid: int = 5, reach: int = 3, conf: str = "conf"
) -> DataFrame:
    """Facts around each grid time: patterns at least 60 % present, an allowed
    transition among the four most confident actions, and the activity level.

    Each action is sent to the grid times it is in reach of. Per grid time only the
    distinct names, the count and the four best actions are kept.
    """
    lo, hi = F.ceil((F.col(t) - reach) / grid), F.floor((F.col(t) + reach) / grid)
    placed = actions.filter(hi >= F.greatest(lo, F.lit(0))).select(
        *keys, name, conf, F.explode(F.sequence(F.greatest(lo, F.lit(0)), hi)).alias("_g")
    )
    per_name = placed.groupBy(*keys, "_g", name, conf).agg(F.count("*").alias("_n"))
    best = F.slice(
        F.array_sort(
            F.flatten(
                F.collect_list(
                    F.array_repeat(
                        F.struct((-F.col(conf)).alias("c"), F.col(name).alias("a")),
                        F.least(F.col("_n"), F.lit(4)).cast("int"),
                    )
                )
            )
        ),
        1,
        4,
    )
    at = per_name.groupBy(*keys, "_g").agg(
        F.sum("_n").alias("_count"), F.collect_set(name).alias("_names"), best.alias("_top")
    )

    def present(word: str):
        return F.exists("_names", lambda n: F.contains(n, F.lit(word)) | F.contains(F.lit(word), n)).cast("int")

    rows = []
    for label, words in ACTION_PATTERNS.items():
        ratio = sum((present(w) for w in words[1:]), present(words[0])) / F.lit(len(words))
        rows.append(
            F.when(
                ratio >= 0.6,
                F.struct(F.lit("pattern").alias("kind"), F.lit(label).alias("fact"), (ratio * 0.8).alias("confidence")),
            )
        )
    n = F.col("_count")
    rows.append(
        F.when(
            n >= 5,
            F.struct(
                F.lit("activity").alias("kind"),
                F.lit("high").alias("fact"),
                F.least(F.lit(0.9), F.lit(0.5) + n * 0.05).alias("confidence"),
            ),
        ).when(
            n >= 3,
            F.struct(
                F.lit("activity").alias("kind"), F.lit("moderate").alias("fact"), F.lit(0.6).alias("confidence")
            ),
        )
    )
    allowed = F.array(*[F.lit(f"{a}>{b}") for pair in TRANSITIONS for a, b in (pair, pair[::-1])])
    pair = lambda i, j: F.concat(
        F.get("_top", F.lit(i))["a"], F.lit(">"), F.get("_top", F.lit(j))["a"]
    )
    pairs = F.array_compact(F.array(*[pair(i, j) for i in range(3) for j in range(i + 1, 4)]))
    first = F.get(F.filter(pairs, lambda p: F.array_contains(allowed, p)), F.lit(0))
    rows.append(
        F.when(
            first.isNotNull(),
            F.struct(F.lit("transition").alias("kind"), first.alias("fact"), F.lit(0.7).alias("confidence")),
        )
    )
    return at.select(
        *keys, (F.col("_g") * grid).alias("t"), F.explode(F.array_compact(F.array(*rows))).alias("_f")
    ).select(*keys, "t", "_f.*")

"""Dense curves, bursts, thresholds and spaced picks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.operators import chapters, choose, curves
from tidemark.plans.registry import query

K = ["video_id"]
CURVE = fx.with_views("curve")
R = lambda c, n=6: F.round(c, n).alias(c)


@query(
    "w1_rolling_baseline",
    "W1 W2",
    CURVE
    + """, m AS (SELECT *, quantile_cont(value, 0.5) OVER w AS b, mad(value) OVER w AS d FROM curve
      WINDOW w AS (PARTITION BY video_id ORDER BY sec ROWS BETWEEN 60 PRECEDING AND 60 FOLLOWING))
    SELECT video_id, sec, round(b, 6) AS baseline, round(1.4826::DOUBLE * d, 6) AS spread,
      round((value - b) / greatest(1.4826::DOUBLE * d, 0.5), 6) AS z FROM m""",
)
def rolling_baseline(spark, sf):
    """Rolling median, MAD and excursion z over +-60 rows."""
    b = curves.rolling_baseline(fx.curve(spark, sf), K, value="value")
    return b.select("video_id", "sec", R("baseline"), R("spread"), R("z"))


@query(
    "w2_burst_candidates",
    "W2 W8",
    CURVE
    + """, m AS (SELECT *, quantile_cont(value, 0.5) OVER w AS b, mad(value) OVER w AS d FROM curve
      WINDOW w AS (PARTITION BY video_id ORDER BY sec ROWS BETWEEN 60 PRECEDING AND 60 FOLLOWING)),
    z AS (SELECT video_id, sec, value - b AS db, round((value - b) / greatest(1.4826::DOUBLE * d, 0.5), 6) AS z FROM m),
    h AS (SELECT *, sec - row_number() OVER (PARTITION BY video_id ORDER BY sec) AS k FROM z WHERE z > 3.0)
    SELECT video_id, min(sec) AS start, max(sec) + 1 AS "end", arg_max(sec, {'z': z, 's': -sec}) AS peak_sec,
      round(max(z), 2) AS z, round(max(db), 2) AS burst_db FROM h GROUP BY video_id, k HAVING max(sec) + 1 - min(sec) >= 1.5""",
)
def burst_candidates(spark, sf):
    """Unbroken runs with z over 3 of at least 1.5 rows."""
    from tidemark.operators.bursts import runs_above

    b = curves.rolling_baseline(fx.curve(spark, sf), K, value="value").withColumn("z", F.round("z", 6))
    b = b.withColumn("db", F.col("value") - F.col("baseline"))
    runs = runs_above(b, K, value="z", threshold=3.0, min_duration=1.5, extra={"burst_db": ("max", "db")})
    return runs.select("video_id", "start", "end", "peak_sec", R("z", 2), R("burst_db", 2))


@query(
    "w3_onset",
    "W3",
    CURVE
    + """SELECT video_id, sec, round(coalesce(value - min(value) OVER (PARTITION BY video_id ORDER BY sec ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0.0), 6) AS onset FROM curve""",
)
def onset(spark, sf):
    """Rise over the lowest of the previous two rows."""
    return curves.onset(fx.curve(spark, sf), K, value="value").select("video_id", "sec", R("onset"))


_DENSITY = """, s AS (SELECT video_id, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.8) AS p80 FROM curve GROUP BY video_id),
    x AS (SELECT c.video_id, c.sec, CASE WHEN value > p80 THEN 1.0 ELSE 0.0 END AS hot, greatest(value - med, 0.0) AS over FROM curve c JOIN s ON s.video_id = c.video_id),
    d AS (SELECT video_id, sec, round(sum(hot) OVER w / 10 * (sum(over) OVER w / 10), 6) AS density FROM x
      WINDOW w AS (PARTITION BY video_id ORDER BY sec ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING))"""


@query("w4_loud_density", "W4", CURVE + _DENSITY + " SELECT * FROM d")
def loud_density(spark, sf):
    """How concentrated the loud rows are around each row."""
    return curves.loud_density(fx.curve(spark, sf), K, value="value").select("video_id", "sec", R("density"))


@query(
    "w5_mark_density",
    "W5",
    fx.with_views("axis", "label_sec")
    + """, m AS (SELECT video_id, sec, count(*) AS n FROM label_sec WHERE label = 'click' GROUP BY video_id, sec)
    SELECT a.video_id, a.sec, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY a.video_id ORDER BY a.sec ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS BIGINT) AS density
    FROM axis a LEFT JOIN m ON a.video_id = m.video_id AND a.sec = m.sec""",
)
def mark_density(spark, sf):
    """Marks within 20 rows around each row."""
    from tidemark.operators.axis import dense_axis

    axis = dense_axis(fx.video(spark, sf), K, "duration")
    n = fx.label_sec(spark, sf).filter("label = 'click'").groupBy("video_id", "sec").agg(F.count("*").alias("n"))
    x = axis.join(n, ["video_id", "sec"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return curves.mark_density(x, K, marks="n").select("video_id", "sec", "density")


@query(
    "w6_ranks",
    "W6",
    CURVE
    + """, n AS (SELECT video_id, sec, value, row_number() OVER (PARTITION BY video_id ORDER BY value, sec) - 1 AS r,
      count(*) OVER (PARTITION BY video_id) AS n, rank() OVER (PARTITION BY video_id ORDER BY value) - 1 AS below,
      count(*) OVER (PARTITION BY video_id ORDER BY value RANGE UNBOUNDED PRECEDING) AS upto FROM curve)
    SELECT video_id, sec, round(100.0 * r / greatest(n - 1, 1), 6) AS ordinal, round((below + upto) / 2.0 / n * 100.0, 1) AS midrank FROM n""",
)
def ranks(spark, sf):
    """Ordinal rank and midrank percentile of every row of a curve."""
    c = curves.ordinal_rank(fx.curve(spark, sf), K, value="value", out="ordinal", middle="midrank")
    return c.select("video_id", "sec", R("ordinal"), "midrank")


_NORM = """, o AS (SELECT video_id, value, row_number() OVER (PARTITION BY video_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM curve),
    b AS (SELECT video_id, max(CASE WHEN i = least(n - 1, CAST(floor(n * 0.10::DOUBLE) AS BIGINT)) THEN value END) AS lo,
      max(CASE WHEN i = least(n - 1, CAST(floor(n * 0.97::DOUBLE) AS BIGINT)) THEN value END) AS hi FROM o GROUP BY video_id),
    m AS (SELECT c.video_id, c.sec, least(1.0, greatest(0.0, (value - lo) / greatest(hi - lo, 1e-6))) AS norm FROM curve c JOIN b ON b.video_id = c.video_id),
    f AS (SELECT *, lag(norm) OVER w AS p, lead(norm) OVER w AS q FROM m WINDOW w AS (PARTITION BY video_id ORDER BY sec)),
    k AS (SELECT video_id, sec, round(norm, 6) AS norm FROM f WHERE norm >= 0.75 AND norm >= coalesce(p, -1.0) AND norm >= coalesce(q, -1.0))"""


@query("w7_local_maxima", "W7", CURVE + _NORM + " SELECT * FROM k")
def local_maxima(spark, sf):
    """Peaks of the normalised curve before spacing."""
    return curves.local_maxima(fx.curve(spark, sf), K, value="value").select("video_id", "sec", R("norm"))


def _greedy_sql(cand: str, gap: str, limit: int | None = None) -> str:
    """Greedy spacing as a recursion over rank; *cand* yields video_id, rn, sec."""
    stop = f" AND len(kept) < {limit}" if limit else ""
    return f""", c AS MATERIALIZED ({cand}),
    g AS (WITH RECURSIVE r(video_id, rn, kept) AS (
        SELECT video_id, 0::BIGINT, []::BIGINT[] FROM (SELECT DISTINCT video_id FROM c)
        UNION ALL
        SELECT r.video_id, c.rn, CASE WHEN len(list_filter(kept, lambda x: abs(x - c.sec) {gap})) = 0{stop}
          THEN list_append(kept, CAST(c.sec AS BIGINT)) ELSE kept END
        FROM r JOIN c ON c.video_id = r.video_id AND c.rn = r.rn + 1)
      SELECT video_id, unnest(arg_max(kept, rn)) AS sec FROM r GROUP BY video_id)"""


@query(
    "t10_spaced_peaks",
    "T10 W7",
    CURVE
    + _NORM
    + _greedy_sql(
        "SELECT video_id, sec, row_number() OVER (PARTITION BY video_id ORDER BY norm DESC, sec) AS rn FROM k", "<= 3"
    )
    + " SELECT video_id, sec FROM g",
)
def spaced_peaks(spark, sf):
    """Loudest peaks first, dropping any within 3 of one already kept."""
    k = curves.local_maxima(fx.curve(spark, sf), K, value="value").withColumn("norm", F.round("norm", 6))
    p = choose.spaced_picks(k, K, t="sec", rank=[-F.col("norm"), F.col("sec")], gap=3, strict=False)
    return p.select("video_id", F.col("sec").cast("long").alias("sec"))


@query(
    "t10_near_misses",
    "T10",
    fx.with_views("score_sec", "clip")
    + _greedy_sql(
        """SELECT s.video_id, s.sec, row_number() OVER (PARTITION BY s.video_id ORDER BY round(score, 6) DESC, s.sec) AS rn FROM score_sec s
        LEFT JOIN clip k ON k.video_id = s.video_id AND s.sec >= k.start AND s.sec < k."end" WHERE k.video_id IS NULL AND score > 0""",
        "< 5",
        5,
    )
    + " SELECT video_id, sec FROM g",
)
def near_misses(spark, sf):
    """Best uncovered seconds, five apart, five a video."""
    from tidemark.operators.joins import points_in_spans

    s = fx.score_sec(spark, sf).filter("score > 0").select("video_id", "sec", F.round("score", 6).alias("score"))
    covered = points_in_spans(s.select("video_id", "sec"), fx.clip(spark, sf), K, t="sec").select("video_id", "sec")
    free = s.join(covered, ["video_id", "sec"], "left_anti")
    p = choose.spaced_picks(
        free, K, t="sec", rank=[-F.col("score"), F.col("sec")], gap=5, limit=5
    )
    return p.select("video_id", F.col("sec").cast("long").alias("sec"))


@query(
    "t9_strongest_of_cluster",
    "T9",
    CURVE
    + _greedy_sql(
        "SELECT video_id, sec, row_number() OVER (PARTITION BY video_id ORDER BY value DESC, sec) AS rn FROM curve WHERE value > 80", "< 10"
    )
    + " SELECT video_id, sec FROM g",
)
def strongest_of_cluster(spark, sf):
    """Neighbouring cuts collapsed to the strongest, at least 10 apart."""
    hot = fx.curve(spark, sf).filter("value > 80")
    p = choose.spaced_picks(hot, K, t="sec", rank=[-F.col("value"), F.col("sec")], gap=10)
    return p.select("video_id", F.col("sec").cast("long").alias("sec"))


@query(
    "w11_condition_mask",
    "W11",
    fx.with_views("axis", "tick_value")
    + """, v AS (SELECT a.video_id, a.sec, coalesce(t.value > 20, FALSE) AS flag FROM axis a LEFT JOIN tick_value t ON t.video_id = a.video_id AND t.sec = a.sec),
    h AS (SELECT *, flag AND (lag(flag, 1, FALSE) OVER o OR lead(flag, 1, FALSE) OVER o) AS held FROM v WINDOW o AS (PARTITION BY video_id ORDER BY sec)),
    d AS (SELECT video_id, sec, bool_or(held) OVER (PARTITION BY video_id ORDER BY sec ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM h)
    SELECT video_id, sec FROM d WHERE near""",
)
def condition_mask(spark, sf):
    """Held for two rows, then reaching three either way; missing never satisfies."""
    sparse = fx.tick_value(spark, sf).select("video_id", "sec", (F.col("value") > 20).alias("flag"))
    dense = fx.curve(spark, sf).select("video_id", "sec").join(sparse, ["video_id", "sec"], "left")
    m = curves.hold_and_reach(dense, K, flag="flag", sustained=2, within=3)
    return m.select("video_id", "sec")


@query(
    "w12_rank_among_stretches",
    "W12",
    fx.with_views("curve", "clip")
    + """, q AS (SELECT c.video_id, idx, CAST("end" - start AS INTEGER) AS length, start, least(CAST("end" - start AS INTEGER), duration) AS k FROM clip c JOIN video v ON v.video_id = c.video_id),
    mine AS (SELECT q.video_id, q.idx, q.length, q.k, max(value) AS mine FROM q JOIN curve c ON c.video_id = q.video_id AND c.sec >= q.start AND c.sec < q.start + q.length GROUP BY ALL),
    s AS (SELECT a.video_id, l.k, a.sec, max(b.value) AS m FROM curve a JOIN (SELECT DISTINCT video_id, k FROM mine) l ON l.video_id = a.video_id
      JOIN video v ON v.video_id = a.video_id AND a.sec + l.k <= v.duration JOIN curve b ON b.video_id = a.video_id AND b.sec BETWEEN a.sec AND a.sec + l.k - 1 GROUP BY ALL)
    SELECT m.video_id, m.idx, m.length,
      CASE WHEN count(*) FILTER (s.m > 0) = 0 THEN 0.0 ELSE round((count(*) FILTER (s.m > 0 AND s.m < mine) + count(*) FILTER (s.m > 0 AND s.m <= mine)) / 2.0 / count(*) FILTER (s.m > 0) * 100.0, 1) END AS percentile,
      CASE WHEN count(*) FILTER (s.m > 0) = 0 THEN 0 ELSE CAST(greatest(1, round_even(count(*) FILTER (s.m > 0) / any_value(m.length), 0)) AS BIGINT) END AS stretches
    FROM mine m JOIN s ON s.video_id = m.video_id AND s.k = m.k GROUP BY m.video_id, m.idx, m.length""",
)
def rank_among_stretches(spark, sf):
    """Every clip's maximum against all windows of its own length."""
    from tidemark.operators.joins import points_in_spans

    clips = fx.clip(spark, sf).withColumn("length", (F.col("end") - F.col("start")).cast("int"))
    c = fx.curve(spark, sf, of=clips)
    asked = points_in_spans(c, clips, K, t="sec").groupBy("video_id", "idx", "length").agg(F.max("value").alias("mine"))
    return curves.rank_among_stretches(c, K, asked, value="value", length="length", mine="mine").drop("mine")


@query(
    "w12_relative_size",
    "W12 A7 X5",
    fx.with_views("box")
    + """, g AS (SELECT video_id, frame AS sec, label, max(w * h) AS size FROM box GROUP BY ALL), v AS (SELECT video_id, max(frame) + 1 AS duration FROM box GROUP BY ALL),
    k AS (SELECT a.video_id, a.sec, a.label, b.label AS reference, CASE WHEN b.size > 0 THEN a.size / b.size END AS ratio, count(*) OVER (PARTITION BY a.video_id, a.label, b.label) AS together
      FROM g a JOIN g b ON b.video_id = a.video_id AND b.sec = a.sec AND b.label <> a.label QUALIFY together >= 2),
    w AS (SELECT *, sec // 5 AS idx FROM k),
    b AS (SELECT video_id, label, idx, arg_min(reference, {'t': -together, 'r': reference}) AS reference FROM w GROUP BY ALL),
    c AS (SELECT w.video_id, w.label, w.reference, w.idx, any_value(together) AS together, max(ratio) AS ratio, arg_max(sec, {'r': ratio, 's': -sec}) AS at FROM w JOIN b ON b.video_id = w.video_id AND b.label = w.label AND b.idx = w.idx AND b.reference = w.reference GROUP BY ALL),
    s AS (SELECT c.video_id, c.label, c.reference, c.idx, c.ratio, a.o, max(k.ratio) AS m FROM c JOIN v ON v.video_id = c.video_id, LATERAL (SELECT unnest(range(0, greatest(1, v.duration - 4))) AS o) a
      JOIN k ON k.video_id = c.video_id AND k.label = c.label AND k.reference = c.reference AND k.sec BETWEEN a.o AND a.o + 4 GROUP BY ALL),
    r AS (SELECT video_id, label, reference, idx, (count(*) FILTER (m < ratio) + count(*) FILTER (m <= ratio)) / 2.0 / count(*) * 100.0 AS percentile, greatest(1, round_even(count(*) / 5.0, 0))::BIGINT AS stretches FROM s WHERE m > 0 GROUP BY ALL),
    t AS (SELECT video_id, label, reference, median(ratio) FILTER (ratio > 0) AS median FROM k GROUP BY ALL)
    SELECT c.video_id, c.label, c.reference, c.idx, c.at, round(c.ratio, 6) AS ratio, round(sqrt(c.ratio), 6) AS linear, round(coalesce(percentile, 0.0), 1) AS percentile, round(median, 6) AS median, c.together, coalesce(stretches, 0) AS stretches, coalesce(stretches, 0) >= 6 AS enough
    FROM c LEFT JOIN r ON r.video_id = c.video_id AND r.label = c.label AND r.reference = c.reference AND r.idx = c.idx LEFT JOIN t ON t.video_id = c.video_id AND t.label = c.label AND t.reference = c.reference WHERE c.ratio IS NOT NULL""",
)
def relative_size(spark, sf):
    """Each class next to its usual companion, in stretches of five frames."""
    b = fx.box(spark, sf)
    largest = b.groupBy("video_id", F.col("frame").alias("sec"), "label").agg(F.max(F.col("w") * F.col("h")).alias("size"))
    videos = b.groupBy("video_id").agg((F.max("frame") + 1).alias("duration"))
    idx = F.floor(F.col("sec") / 5).cast("int")
    clips = largest.select("video_id", idx.alias("idx")).distinct().select("video_id", "idx", (F.col("idx") * 5.0).alias("start"), (F.col("idx") * 5.0 + 5.0).alias("end"))
    r = curves.relative_size(largest, clips, videos, K, least_together=2)
    return r.select("video_id", "label", "reference", "idx", "at", F.round("ratio", 6).alias("ratio"), F.round("linear", 6).alias("linear"), "percentile", F.round("median", 6).alias("median"), "together", "stretches", "enough")


@query(
    "w14_spike_then_still",
    "W14",
    CURVE
    + """, x AS (SELECT *, sec // 24 AS scene, avg(value) OVER (PARTITION BY video_id, sec // 24) AS m, list(value) OVER w AS nxt, avg(value) OVER w AS calm FROM curve
      WINDOW w AS (PARTITION BY video_id, sec // 24 ORDER BY sec ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING))
    SELECT video_id, scene, sec, value FROM x WHERE value > m * 2.0 AND len(nxt) = 4
      AND len(list_filter(nxt, lambda v: v < m * 0.8)) / 4.0 >= 0.7 AND calm < m * 0.8 AND calm < value * 0.3""",
)
def spike_then_still(spark, sf):
    """Spikes followed by quiet rows of the same scene."""
    c = fx.curve(spark, sf).withColumn("scene", F.floor(F.col("sec") / 24).cast("int"))
    return curves.spike_then_still(c, K, "scene", value="value", spike=2.0, freeze=0.8, frames=4)


@query(
    "w20_loudest_second",
    "W20",
    fx.with_views("curve", "clip")
    + """, m AS (SELECT video_id, quantile_cont(value, 0.5) AS med FROM curve GROUP BY video_id)
    SELECT c.video_id, c.idx, arg_max(v.sec, {'v': v.value, 's': -v.sec}) AS second, round(max(v.value), 2) AS level, round(max(v.value) - any_value(med), 2) AS vs_video
    FROM clip c JOIN curve v ON v.video_id = c.video_id AND v.sec >= floor(c.start) AND v.sec <= ceil(c."end") JOIN m ON m.video_id = c.video_id GROUP BY c.video_id, c.idx""",
)
def loudest_second(spark, sf):
    """First loudest second of a clip, its end included, against the video's median."""
    from tidemark.operators.compare import peak_in_range

    return peak_in_range(fx.curve(spark, sf), fx.clip(spark, sf), K, ident=["idx"], value="value")


@query(
    "w21_subset_z",
    "W21",
    CURVE
    + """, s AS (SELECT video_id, quantile_cont(value, 0.5) AS m FROM curve WHERE value > 0 GROUP BY video_id),
    d AS (SELECT c.video_id, any_value(m) AS m, quantile_cont(abs(value - m), 0.5) AS d FROM curve c JOIN s ON s.video_id = c.video_id WHERE value > 0 GROUP BY c.video_id)
    SELECT c.video_id, c.sec, round(CASE WHEN value > 0 THEN (value - m) / greatest(1.4826::DOUBLE * d, 0.5) ELSE 0 END, 6) AS effort
    FROM curve c JOIN d ON d.video_id = c.video_id""",
)
def subset_z(spark, sf):
    """z against the median and MAD of the live rows; 0 outside the subset."""
    z = curves.robust_z_of_subset(
        fx.curve(spark, sf), K, value="value", subset="value > 0", min_spread=0.5, out="z"
    )
    return z.select(
        "video_id", "sec", F.round(F.when(F.col("value") > 0, F.col("z")).otherwise(0.0), 6).alias("effort")
    )


@query(
    "a25_robust_threshold",
    "A25",
    CURVE
    + """, m AS (SELECT video_id, quantile_cont(value, 0.5) AS m, mad(value) AS d, count(*) AS n FROM curve WHERE value > 0 GROUP BY video_id)
    SELECT video_id, round(m + 1.5::DOUBLE * greatest(d * 1.4826::DOUBLE, 1e-6), 6) AS threshold, n AS samples FROM m""",
)
def robust_threshold(spark, sf):
    s = chapters.robust_stats(fx.curve(spark, sf).filter("value > 0"), K, value="value")
    return s.select("video_id", F.round(chapters.robust_threshold(1.5), 6).alias("threshold"), "samples")


@query(
    "a26_resolved_cuts",
    "A26 T9",
    fx.with_views("curve", "video")
    + """, l AS (SELECT video_id, sec, value + sec % 7 AS d FROM curve WHERE sec % 2 = 0), m AS (SELECT video_id, quantile_cont(d, 0.5) AS m, mad(d) * 1.4826::DOUBLE AS s, count(*) AS n FROM l GROUP BY video_id),
    t AS (SELECT *, m + 4.0::DOUBLE * greatest(s, 1e-6) AS bar FROM m),
    fixed AS (SELECT video_id, sec, d FROM l WHERE d > 250), derived AS (SELECT l.video_id, sec, d FROM l JOIN t ON t.video_id = l.video_id WHERE d > bar),
    nf AS (SELECT video_id, count(*) AS n FROM fixed GROUP BY video_id), nd AS (SELECT video_id, count(*) AS n FROM derived GROUP BY video_id),
    u AS (SELECT t.video_id, CASE WHEN t.n >= 120 AND coalesce(nf.n, 0) / (duration / 24.0) < 0.5 AND bar >= m * 1.25 AND coalesce(nd.n, 0) > coalesce(nf.n, 0) THEN 'derived' ELSE 'fixed' END AS method, bar
      FROM t JOIN video v ON v.video_id = t.video_id LEFT JOIN nf ON nf.video_id = t.video_id LEFT JOIN nd ON nd.video_id = t.video_id)
    SELECT u.video_id, x.sec, u.method FROM u JOIN (SELECT *, 'fixed' AS method FROM fixed UNION ALL SELECT *, 'derived' FROM derived) x ON x.video_id = u.video_id AND x.method = u.method""",
)
def resolved_cuts(spark, sf):
    """Fixed threshold first, derived where the fixed one finds almost nothing."""
    d = (
        fx.curve(spark, sf)
        .filter("sec % 2 = 0")
        .join(fx.video(spark, sf), "video_id")
        .select(
            "video_id", "sec", (F.col("value") + F.col("sec") % 7).alias("d"), (F.col("duration") / 24.0).alias("minutes")
        )
    )
    cuts = chapters.resolve_cuts(d, K, value="d", tick="sec", minutes="minutes", threshold=250.0, min_gap=1)
    return cuts.select("video_id", "sec", "method")


@query(
    "a31_wave_bins",
    "A31",
    CURVE
    + """, n AS (SELECT video_id, greatest(1, count(*) // 100) AS step FROM curve GROUP BY video_id)
    SELECT c.video_id, CAST(c.sec // step AS INTEGER) AS bin, min(value) AS lo, max(value) AS hi, round(sqrt(avg(value * value)), 6) AS rms
    FROM curve c JOIN n ON n.video_id = c.video_id GROUP BY ALL""",
)
def wave_bins(spark, sf):
    """Waveform bins (min, max, rms)."""
    w = curves.wave_bins(fx.curve(spark, sf), K, index="sec", value="value", points=100)
    return w.select("video_id", "bin", "lo", "hi", R("rms"))


@query(
    "a31_downsample",
    "A31",
    fx.with_views("curve")
    + """, n AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM curve)
    SELECT video_id, CASE WHEN n <= 48 THEN sec ELSE CAST(((sec + 1) * 48 + n - 1) // n AS INTEGER) - 1 END AS bucket, round(max(value), 4) AS value FROM n GROUP BY ALL""",
)
def downsample(spark, sf):
    """Max-preserving reduction of a curve to 48 points."""
    return curves.downsample_max(fx.curve(spark, sf), K, value="value", points=48)


@query(
    "a32_energy_level",
    "A32 X3",
    fx.with_views("detection")
    + """, l AS (SELECT video_id, sec, sqrt(avg(conf * conf)) AS rms FROM detection GROUP BY video_id, sec)
    SELECT video_id, sec, round(greatest(-100.0, 20.0::DOUBLE * log10(greatest(rms, 1e-12))), 4) AS level,
      greatest(-100.0, round(20.0::DOUBLE * log10(greatest(rms, 1e-12)), 1))::DOUBLE AS dbfs FROM l""",
)
def energy_level(spark, sf):
    """Energy mean per second in dBFS, and the one-decimal report form."""
    levels = curves.energy_level(fx.detection(spark, sf), K, rms="conf")
    return levels.select(
        "video_id",
        "sec",
        F.round("level", 4).alias("level"),
        F.greatest(F.lit(curves.SILENCE_DBFS), F.round("level", 1)).alias("dbfs"),
    )

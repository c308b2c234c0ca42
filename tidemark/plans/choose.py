"""Constrained selection (T2-T7): windows, coverage, swaps, regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.operators import choose
from tidemark.plans.registry import query

K = ["video_id"]


def _scores(spark, sf):
    """score per hour with the best confidence as tie-break, every hour present."""
    c = fx.label_sec(spark, sf).groupBy("video_id", "sec").agg(F.max("conf").alias("conf"))
    return (
        fx.curve(spark, sf)
        .withColumnRenamed("value", "score")
        .join(c, ["video_id", "sec"], "left")
        .withColumn("conf", F.coalesce("conf", F.lit(0.0)))
    )


def _windows(spark, sf, **kw):
    return choose.select_windows(
        _scores(spark, sf), fx.video(spark, sf), K, clip_time=10, target=65.0, **kw
    )


_RANKED = fx.with_views("curve", "label_sec") + """, c AS (SELECT video_id, sec, max(conf) AS conf FROM label_sec GROUP BY ALL),
    k AS MATERIALIZED (SELECT v.video_id, v.sec, row_number() OVER (PARTITION BY v.video_id ORDER BY v.value DESC, coalesce(conf, 0) DESC, v.sec) AS rn, duration,
      greatest(0, v.sec - 5) AS s0 FROM curve v JOIN video w ON w.video_id = v.video_id LEFT JOIN c ON c.video_id = v.video_id AND c.sec = v.sec WHERE v.value > 0),
    w AS MATERIALIZED (SELECT video_id, sec, rn, CASE WHEN least(duration, s0 + 10) - s0 < 10 AND s0 > 0 THEN greatest(0, least(duration, s0 + 10) - 10) ELSE s0 END AS s, least(duration, s0 + 10) AS e, least(5, CAST(floor(sec / duration * 6.0::DOUBLE) AS INTEGER)) AS b FROM k)"""


def _fold_sql(capped: bool, ceiling: str) -> str:
    """The greedy rule as a recursion over rank; ends are whole, so lists of integers do."""
    grab = "len(list_filter(ss, lambda x, i: s < ee[i] AND x < e)) = 0 AND total < 65"
    cap = f" AND (list_sum(list_transform(range(1, len(ss) + 1), lambda i: CASE WHEN bb[i] = b THEN ee[i] - ss[i] ELSE 0 END)) IS NULL OR list_sum(list_transform(range(1, len(ss) + 1), lambda i: CASE WHEN bb[i] = b THEN ee[i] - ss[i] ELSE 0 END)) + least(e - s, 65 - total) <= {ceiling}) AND least(e - s, 65 - total) <= {ceiling}"
    cond = grab + (cap if capped else "")
    seed = "SELECT DISTINCT video_id, 0::BIGINT, []::BIGINT[], []::BIGINT[], []::BIGINT[], 0::BIGINT FROM w" if capped else "SELECT video_id, 0::BIGINT, ss, ee, bb, total FROM p1"
    name = "p1" if capped else "p2"
    return f""", {name} AS (WITH RECURSIVE r(video_id, rn, ss, ee, bb, total) AS ({seed}
      UNION ALL SELECT r.video_id, w.rn, CASE WHEN {cond} THEN list_append(ss, s) ELSE ss END, CASE WHEN {cond} THEN list_append(ee, s + least(e - s, 65 - total)) ELSE ee END,
        CASE WHEN {cond} THEN list_append(bb, b) ELSE bb END, CASE WHEN {cond} THEN total + least(e - s, 65 - total) ELSE total END FROM r JOIN w ON w.video_id = r.video_id AND w.rn = r.rn + 1)
      SELECT video_id, arg_max(ss, rn) AS ss, arg_max(ee, rn) AS ee, arg_max(bb, rn) AS bb, arg_max(total, rn) AS total FROM r GROUP BY video_id)"""


_OUT = """ SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start)::INTEGER AS idx, start::DOUBLE AS start, "end"::DOUBLE AS "end" FROM (SELECT video_id, unnest(ss) AS start, unnest(ee) AS "end" FROM p2)"""


@query("t2_budgeted_windows", "T2", _RANKED + _fold_sql(True, "65") + _fold_sql(False, "65") + _OUT)
def budgeted_windows(spark, sf):
    """Best windows of 10 hours until 65 hours are spent."""
    return _windows(spark, sf)


@query("t3_coverage_ceiling", "T3", _RANKED + _fold_sql(True, "(65 / 6.0::DOUBLE + 0.3 * (65 - 65 / 6.0::DOUBLE))") + _fold_sql(False, "65") + _OUT)
def coverage_ceiling(spark, sf):
    """The same budget spread over the timeline (coverage 0.7)."""
    return _windows(spark, sf, coverage=0.7)


@query("t2_exact_windows", "T2")
def exact_windows(spark, sf):
    """EXACT mode: also seconds that scored nothing, so the budget is always met."""
    return _windows(spark, sf, mode="EXACT", coverage=1.0)


@query("t4_swapped_clip", "T4")
def swapped_clip(spark, sf):
    """The second clip replaced by the best unused moment."""
    scores, videos = _scores(spark, sf), fx.video(spark, sf)
    clips = _windows(spark, sf)
    which = videos.select("video_id", F.lit(2).alias("idx"))
    return choose.swap_clip(scores, videos, clips, K, which, clip_time=10)


def _regions(spark, sf):
    """Candidate regions of every kind over the hourly score."""
    from tidemark.operators import scoring
    from tidemark.operators.islands import partition_by_cuts

    d = fx.detection(spark, sf)
    v = fx.video(spark, sf)
    curve = fx.curve(spark, sf).withColumnRenamed("value", "score")
    scenes = partition_by_cuts(d.filter("label = 'signup' AND conf > 0.1").select("video_id", "t"), v, K, t="t", total="duration")
    acts = scoring.action_sequences(
        d.filter("label = 'error'"), ["video_id", "label"], t="t", tie="event_id", max_gap=1.3, jump=0.2
    ).select("video_id", "start", "end", F.concat(F.lit("action:"), "label").alias("source"))
    words = d.filter("label = 'purchase' AND conf > 0.3").select(
        "video_id",
        F.greatest(F.lit(0.0), F.col("t") - 1.0).alias("start"),
        (F.col("t") + 1.5).alias("end"),
        F.lit("keyword:deal").alias("source"),
    )
    kind = lambda src, at, gap, lo, hi: F.struct(
        F.lit(src).alias("source"), at.alias("t"), F.lit(gap).alias("gap"), F.lit(lo).alias("min_pad"), F.lit(hi).alias("max_pad")
    )
    kinds = (
        F.when(F.col("label") == "view", kind("objects:view", F.col("sec").cast("double"), 3.0, 1.0, 3.0))
        .when(F.col("label") == "click", kind("motion_event", F.col("t"), 2.0, 0.5, 2.0))
        .when(F.col("label") == "purchase", kind("audio_peak", F.col("t"), 2.0, 1.0, 3.0))
    )
    points = d.select("video_id", kinds.alias("_k")).filter("_k IS NOT NULL").select("video_id", "_k.*")
    parts = [
        scenes.withColumn("source", F.lit("scene")),
        acts,
        words,
        choose.point_regions(points, scenes, K, t="t"),
    ]
    out = parts[0].select("video_id", "start", "end", "source")
    for p in parts[1:]:
        out = out.unionByName(p.select("video_id", "start", "end", "source"))
    scored = choose.span_scores(out, curve, K).filter("score > 0")
    return scored, curve, v


_REGIONS = fx.with_views("detection", "video", "curve") + """,
    e AS (SELECT DISTINCT d.video_id, round(t, 3) AS start, duration FROM detection d JOIN video v ON d.video_id = v.video_id WHERE label = 'signup' AND conf > 0.1 AND t > 0 AND t < duration UNION SELECT video_id, 0.0, duration FROM video),
    sc AS (SELECT video_id, start, coalesce(lead(start) OVER (PARTITION BY video_id ORDER BY start), duration)::DOUBLE AS "end" FROM e),
    a0 AS (SELECT *, lag(t) OVER w AS pt, lag(conf) OVER w AS pc FROM detection WHERE label = 'error' WINDOW w AS (PARTITION BY video_id ORDER BY t, event_id)),
    a1 AS (SELECT *, sum(CASE WHEN pt IS NULL OR t - pt > 1.3 OR abs(conf - pc) > 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a0),
    pts AS (SELECT video_id, 'objects:view' AS source, sec::DOUBLE AS t, 3.0 AS gap, 1.0 AS mp FROM detection WHERE label = 'view' UNION ALL SELECT video_id, 'motion_event', t, 2.0, 0.5 FROM detection WHERE label = 'click' UNION ALL SELECT video_id, 'audio_peak', t, 2.0, 1.0 FROM detection WHERE label = 'purchase'),
    p1 AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY video_id, source ORDER BY t) <= gap THEN 0 ELSE 1 END AS f FROM pts),
    p2 AS (SELECT *, sum(f) OVER (PARTITION BY video_id, source ORDER BY t ROWS UNBOUNDED PRECEDING) AS i FROM p1),
    p3 AS (SELECT video_id, source, i, min(t) AS a, max(t) AS b, greatest(max(mp), CASE WHEN max(t) - min(t) < 1 THEN 1.0 ELSE 0.5 END) AS pad FROM p2 GROUP BY video_id, source, i),
    p4 AS (SELECT video_id, source, greatest(0.0, a - pad) AS a, b + pad AS b FROM p3),
    p5 AS (SELECT p4.video_id, source, a, b, min({'s': sc.start, 'e': sc."end"}) AS m FROM p4 LEFT JOIN sc ON sc.video_id = p4.video_id AND (a + b) / 2 BETWEEN sc.start - 3 AND sc."end" + 3 GROUP BY ALL),
    rg AS (SELECT video_id, start, "end", 'scene' AS source FROM sc UNION ALL SELECT video_id, min(t), max(t), 'action:error' FROM a1 GROUP BY video_id, run
      UNION ALL SELECT video_id, greatest(0.0, t - 1), t + 1.5, 'keyword:deal' FROM detection WHERE label = 'purchase' AND conf > 0.3
      UNION ALL SELECT video_id, CASE WHEN m IS NULL THEN a ELSE greatest(least(a, m.s), a - 5) END, CASE WHEN m IS NULL THEN b ELSE least(greatest(b, m.e), b + 5) END, source FROM p5),
    cu AS (SELECT video_id, sec, sum(value) OVER (PARTITION BY video_id ORDER BY sec) AS c FROM curve),
    rs AS (SELECT r.*, round(h.c - coalesce(l.c, 0), 6) AS score FROM rg r JOIN video v ON v.video_id = r.video_id JOIN cu h ON h.video_id = r.video_id AND h.sec = least(floor(r."end"), duration - 1) LEFT JOIN cu l ON l.video_id = r.video_id AND l.sec = greatest(0, floor(r.start)) - 1)"""


@query(
    "t5_candidate_regions",
    "T5",
    _REGIONS + """ SELECT video_id, source, round(start, 6) AS start, round("end", 6) AS "end", score FROM rs WHERE score > 0""",
)
def candidate_regions(spark, sf):
    """Regions of actions, scenes, keywords, object and point clusters with their scores."""
    r, _, _ = _regions(spark, sf)
    return r.select(
        "video_id", "source", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), F.round("score", 6).alias("score")
    )


@query(
    "t6_merged_regions",
    "T6",
    _REGIONS
    + """, o AS (SELECT *, max("end") OVER (PARTITION BY video_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rs WHERE score > 0),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start - reach > 1.5 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS i FROM o)
    SELECT video_id, round(min(start), 6) AS start, round(max("end"), 6) AS "end", round(sum(score), 4) AS score, count(*) AS n, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM g GROUP BY video_id, i""",
)
def merged_regions(spark, sf):
    """Near regions merged; scores add up."""
    r, _, _ = _regions(spark, sf)
    m = choose.merge_regions(r, K)
    return m.select(
        "video_id",
        F.round("start", 6).alias("start"),
        F.round("end", 6).alias("end"),
        F.round("score", 4).alias("score"),
        "n",
        F.array_join(F.array_sort("sources"), ",").alias("sources"),
    )


@query("t6_constrained_regions", "T6")
def constrained_regions(spark, sf):
    """Short regions padded, long ones split."""
    r, curve, v = _regions(spark, sf)
    c = choose.constrain_regions(choose.merge_regions(r, K), curve, v, K)
    return c.select(
        "video_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), F.round("score", 4).alias("score")
    )


@query("t7_selected_regions", "T7 T5 T6")
def selected_regions(spark, sf):
    """Densest regions first within 120 hours."""
    r, curve, v = _regions(spark, sf)
    c = choose.constrain_regions(choose.merge_regions(r, K), curve, v, K)
    s = choose.select_regions(c, K, target=120.0)
    return s.select(
        "video_id", "idx", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), F.round("score", 4).alias("score")
    )

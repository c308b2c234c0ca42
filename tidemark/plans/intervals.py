"""Islands, unions, differences and interval joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.operators import islands, joins
from tidemark.plans.registry import query


@query(
    "w8_second_islands",
    "W8",
    fx.with_views("label_sec")
    + """, s AS (SELECT DISTINCT video_id, sec FROM label_sec WHERE label = 'error'),
    f AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY video_id ORDER BY sec) <= 2 THEN 0 ELSE 1 END AS fresh FROM s),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY sec) AS island FROM f)
    SELECT video_id, CAST(min(sec) AS DOUBLE) AS start, CAST(max(sec) + 1 AS DOUBLE) AS "end",
           CAST(count(*) AS BIGINT) AS seconds
    FROM g GROUP BY video_id, island""",
)
def second_islands(spark, sf):
    """Whole seconds of one class, gaps up to 2 bridged, end exclusive."""
    s = fx.label_sec(spark, sf).filter("label = 'error'").select("video_id", "sec").distinct()
    out = islands.point_islands(s, ["video_id"], "sec", 2, aggs={"seconds": ("count", "sec")}, chunk=256)
    return out.select(
        "video_id",
        F.col("start").cast("double").alias("start"),
        (F.col("end") + 1).cast("double").alias("end"),
        "seconds",
    )


@query(
    "w8_point_clusters",
    "W8",
    fx.with_views("detection")
    + """, f AS (SELECT video_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY video_id ORDER BY t) <= 2 THEN 0 ELSE 1 END AS fresh FROM detection),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM f),
    c AS (SELECT video_id, min(t) AS cs, max(t) AS ce, count(*) AS n FROM g GROUP BY video_id, island)
    SELECT video_id, round(greatest(0.0, cs - CASE WHEN ce - cs < 1 THEN 1.0 ELSE 0.5 END), 6) AS start,
           round(ce + CASE WHEN ce - cs < 1 THEN 1.0 ELSE 0.5 END, 6) AS "end", CAST(n AS BIGINT) AS points FROM c""",
)
def point_clusters(spark, sf):
    """Point times grouped at gap 2 and padded by 1.0 (short) or 0.5."""
    from tidemark.operators.islands import pad_clusters, point_islands

    d = fx.detection(spark, sf)
    c = point_islands(d, ["video_id"], "t", 2.0, aggs={"points": ("count", "t")}, chunk=240)
    p = pad_clusters(c)
    return p.select(
        "video_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "points"
    )


@query(
    "w8_run_starts",
    "W8",
    fx.with_views("label_sec")
    + """, s AS (SELECT DISTINCT video_id, label, sec FROM label_sec),
    f AS (SELECT *, lag(sec) OVER (PARTITION BY video_id, label ORDER BY sec) AS p FROM s)
    SELECT video_id, label, sec AS start FROM f WHERE p IS NULL OR sec - p > 3""",
)
def run_starts(spark, sf):
    """One start per drawn bar: a new bar where the gap exceeds merge gap + 1."""
    s = fx.label_sec(spark, sf).select("video_id", "label", "sec").distinct()
    out = islands.point_islands(s, ["video_id", "label"], "sec", 2 + 1)
    return out.select("video_id", "label", "start")


@query(
    "w8_padded_segments",
    "W8",
    fx.with_views("detection", "video")
    + """, s AS (SELECT DISTINCT video_id, sec FROM detection WHERE label = 'view' AND conf >= 0.1),
    f AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY video_id ORDER BY sec) <= 2 THEN 0 ELSE 1 END AS fresh FROM s),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY sec) AS island FROM f),
    i AS (SELECT video_id, min(sec) AS lo, max(sec) AS hi FROM g GROUP BY video_id, island)
    SELECT i.video_id, greatest(0.0, lo - 0.5)::DOUBLE AS start, least(duration, hi + 1.5)::DOUBLE AS "end"
    FROM i JOIN video v ON i.video_id = v.video_id""",
)
def padded_segments(spark, sf):
    """Matching seconds of one label merged into watchable, padded ranges."""
    hits = (
        fx.detection(spark, sf).filter("label = 'view' AND conf >= 0.1").select("video_id", "sec").distinct()
    )
    return islands.watchable_ranges(hits, fx.video(spark, sf), ["video_id"], "sec", gap=2, pad=0.5)


@query(
    "w8_adaptive_sequences",
    "W8",
    fx.with_views("detection")
    + """, d AS (SELECT *, lag(t) OVER w AS pt, lag(conf) OVER w AS pc FROM detection
          WINDOW w AS (PARTITION BY video_id, label ORDER BY t, event_id)),
    g AS (SELECT *, sum(CASE WHEN pt IS NULL OR t - pt > 24 OR abs(conf - pc) > 0.1 THEN 1 ELSE 0 END)
          OVER (PARTITION BY video_id, label ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM d)
    SELECT video_id, label, round(min(t), 6) AS start, round(max(t), 6) AS "end",
           round(greatest(0.5, max(t) - min(t)), 6) AS duration, round(avg(conf), 6) AS conf, count(*) AS n
    FROM g GROUP BY video_id, label, run""",
)
def adaptive_sequences(spark, sf):
    """Same label, close in time and in confidence: one action sequence."""
    from tidemark.operators.scoring import action_sequences

    s = action_sequences(
        fx.detection(spark, sf), ["video_id", "label"], t="t", tie="event_id", max_gap=24.0, jump=0.1
    )
    return s.select(
        "video_id",
        "label",
        F.round("start", 6).alias("start"),
        F.round("end", 6).alias("end"),
        F.round("duration", 6).alias("duration"),
        F.round("conf", 6).alias("conf"),
        "n",
    )


@query(
    "w8_label_runs",
    "W8",
    fx.with_views("detection")
    + """, d AS (SELECT video_id, t, event_id, conf, CASE WHEN conf >= 0.02 THEN label END AS k FROM detection),
    l AS (SELECT *, lag(k) OVER w AS pk, row_number() OVER w AS rn FROM d WINDOW w AS (PARTITION BY video_id ORDER BY t, event_id)),
    g AS (SELECT *, sum(CASE WHEN rn = 1 OR k IS DISTINCT FROM pk THEN 1 ELSE 0 END)
          OVER (PARTITION BY video_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM l),
    r AS (SELECT video_id, run, min(k) AS k, min(t) AS s, max(t) AS e, max(conf) AS c FROM g GROUP BY video_id, run),
    n AS (SELECT *, lead(k) OVER (PARTITION BY video_id ORDER BY run) AS nk, lead(s) OVER (PARTITION BY video_id ORDER BY run) AS ns FROM r)
    SELECT video_id, k AS label, round(s, 6) AS start, round(CASE WHEN ns IS NOT NULL AND nk IS NULL THEN ns ELSE e END, 6) AS "end",
           round(c, 6) AS conf FROM n WHERE k IS NOT NULL AND (CASE WHEN ns IS NOT NULL AND nk IS NULL THEN ns ELSE e END) - s >= 1.0""",
)
def label_runs(spark, sf):
    """Runs of one label in time order; a row under the threshold closes a run."""
    from tidemark.operators.scoring import detection_runs

    r = detection_runs(
        fx.detection(spark, sf), ["video_id"], t="t", tie="event_id", threshold=0.02, min_duration=1.0
    )
    return r.select(
        "video_id",
        "label",
        F.round("start", 6).alias("start"),
        F.round("end", 6).alias("end"),
        F.round("conf", 6).alias("conf"),
    )


@query(
    "w8_speaker_turns",
    "W8",
    fx.with_views("segment")
    + """, s AS (SELECT video_id, seg, start, start + 9.75::DOUBLE AS "end", CASE WHEN seg % 4 < 2 THEN 'A' ELSE 'B' END AS speaker FROM segment),
    l AS (SELECT *, lag(speaker) OVER w AS ps, lag("end") OVER w AS pe FROM s WINDOW w AS (PARTITION BY video_id ORDER BY start, seg)),
    g AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps <> speaker OR start - pe >= 0.5 THEN 1 ELSE 0 END)
          OVER (PARTITION BY video_id ORDER BY start, seg ROWS UNBOUNDED PRECEDING) AS run FROM l)
    SELECT video_id, speaker, min(start) AS start, max("end") AS "end", count(*) AS n FROM g GROUP BY video_id, run, speaker""",
)
def speaker_turns(spark, sf):
    """Neighbouring lines of one speaker joined when the pause is under 0.5 s."""
    from tidemark.operators.speech import merge_turns

    s = fx.segment(spark, sf).select(
        "video_id",
        "seg",
        "start",
        (F.col("start") + 9.75).alias("end"),
        F.when(F.col("seg") % 4 < 2, "A").otherwise("B").alias("speaker"),
    )
    return merge_turns(s, ["video_id"], tie="seg", max_pause=0.5)


@query(
    "w8_labelled_intervals",
    "W8",
    fx.with_views("span")
    + """, s AS (SELECT *, max("end") OVER (PARTITION BY video_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM span),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start - reach > 5 THEN 1 ELSE 0 END)
          OVER (PARTITION BY video_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM s)
    SELECT video_id, min(start) AS start, max("end") AS "end", count(*) AS merged_count,
           array_to_string(list_sort(list(DISTINCT CAST(line_id AS VARCHAR))), ',') AS labels,
           round(avg(score), 6) AS avg_confidence, max(score) AS max_confidence
    FROM g GROUP BY video_id, island""",
)
def labelled_intervals(spark, sf):
    """Intervals merged at a threshold, with count, labels, mean and max confidence."""
    m = islands.interval_islands(
        fx.span(spark, sf),
        ["video_id"],
        gap=5,
        aggs={
            "merged_count": ("count", "line_id"),
            "labels": ("set", F.col("line_id").cast("string")),
            "total": ("sum", "score"),
            "max_confidence": ("max", "score"),
        },
        chunk=3650,
    )
    return m.select(
        "video_id",
        "start",
        "end",
        "merged_count",
        F.array_join(F.array_sort("labels"), ",").alias("labels"),
        F.round(F.col("total") / F.col("merged_count"), 6).alias("avg_confidence"),
        "max_confidence",
    )


@query(
    "w9_event_groups",
    "W9",
    fx.with_views("curve", "video")
    + """, h AS (SELECT *, sec - row_number() OVER (PARTITION BY video_id ORDER BY sec) AS k FROM curve WHERE value > 60),
    r AS (SELECT video_id, min(sec) AS start, max(sec) + 1 AS "end", arg_max(sec, {'v': value, 's': -sec}) AS peak_sec, max(value) AS z FROM h GROUP BY video_id, k),
    i AS (SELECT r.* FROM r JOIN video v ON r.video_id = v.video_id WHERE peak_sec >= 24 AND peak_sec <= duration - 24),
    f AS (SELECT *, max("end") OVER (PARTITION BY video_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR peak_sec - reach > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY start) AS ev FROM f)
    SELECT video_id, min(start) AS start, max("end") AS "end", arg_max(peak_sec, {'z': z, 's': -start}) AS peak_sec,
           round(max(z), 2) AS z, count(*) AS runs FROM g GROUP BY video_id, ev""",
)
def event_groups(spark, sf):
    """Runs above a level grouped into events with the edge guard."""
    from tidemark.operators.bursts import group_events, runs_above

    runs = runs_above(fx.curve(spark, sf), ["video_id"], value="value", threshold=60.0)
    runs = runs.join(fx.video(spark, sf), "video_id")
    ev = group_events(runs, ["video_id"], total="duration", edge_guard=24, merge_gap=30)
    return ev.withColumn("z", F.round("z", 2))


@query(
    "u1_interval_union",
    "U1",
    fx.with_views("span")
    + """, s AS (SELECT *, max("end") OVER (PARTITION BY video_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM span),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END)
          OVER (PARTITION BY video_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM s)
    SELECT video_id, min(start) AS start, max("end") AS "end" FROM g GROUP BY video_id, island""",
)
def interval_union(spark, sf):
    """Automatic (even lines) and manual (all other lines) ranges as one minimal cover."""
    s = fx.span(spark, sf)
    auto, manual = s.filter("line_id % 2 <=> 0"), s.filter("NOT line_id % 2 <=> 0")
    return islands.interval_islands(auto.unionByName(manual), ["video_id"], chunk=3650, keep_untimed=True)


@query(
    "u2_interval_difference",
    "U2",
    fx.with_views("clip", "label_sec")
    + """, c AS (SELECT video_id, idx, CAST(unnest(range(CAST(start AS BIGINT), CAST("end" AS BIGINT))) AS BIGINT) AS sec FROM clip),
    p AS (SELECT DISTINCT video_id, sec FROM label_sec WHERE label = 'purchase'),
    k AS (SELECT c.* FROM c LEFT JOIN p ON c.video_id = p.video_id AND c.sec = p.sec WHERE p.sec IS NULL),
    r AS (SELECT *, sec - row_number() OVER (PARTITION BY video_id, idx ORDER BY sec) AS run FROM k)
    SELECT video_id, idx, CAST(min(sec) AS DOUBLE) AS start, CAST(max(sec) + 1 AS DOUBLE) AS "end" FROM r GROUP BY video_id, idx, run""",
)
def interval_difference(spark, sf):
    """Forbidden ranges cut out of every clip; slivers under 0.5 dropped."""
    cuts = (
        fx.label_sec(spark, sf)
        .filter("label = 'purchase'")
        .select(
            "video_id",
            F.col("sec").cast("double").alias("start"),
            (F.col("sec") + 1).cast("double").alias("end"),
        )
        .distinct()
    )
    return islands.subtract_intervals(fx.clip(spark, sf), cuts, ["video_id"], ["idx"], bin_width=64)


@query(
    "u2_zeroed_scores",
    "U2",
    fx.with_views("curve", "label_sec")
    + """, p AS (SELECT DISTINCT video_id, sec FROM label_sec WHERE label = 'purchase')
    SELECT c.video_id, c.sec, CASE WHEN p.sec IS NULL THEN value ELSE 0.0 END AS value
    FROM curve c LEFT JOIN p ON c.video_id = p.video_id AND c.sec = p.sec WHERE value > 0""",
)
def zeroed_scores(spark, sf):
    """Scores inside forbidden seconds set to 0."""
    bad = (
        fx.label_sec(spark, sf)
        .filter("label = 'purchase'")
        .select("video_id", "sec")
        .distinct()
        .withColumn("_bad", F.lit(True))
    )
    c = fx.curve(spark, sf).filter("value > 0").join(bad, ["video_id", "sec"], "left")
    return c.select(
        "video_id", "sec", F.when(F.col("_bad"), F.lit(0.0)).otherwise(F.col("value")).alias("value")
    )


@query(
    "u7_scene_partition",
    "U7",
    fx.with_views("detection", "video")
    + """, e AS (SELECT DISTINCT d.video_id, round(t, 3) AS start, duration FROM detection d JOIN video v ON d.video_id = v.video_id
          WHERE label = 'signup' AND t > 0 AND t < duration UNION SELECT video_id, 0.0, duration FROM video)
    SELECT video_id, start, coalesce(lead(start) OVER (PARTITION BY video_id ORDER BY start), duration)::DOUBLE AS "end" FROM e""",
)
def scene_partition(spark, sf):
    """Gap-free scenes between cut times, duplicates at 3 decimals dropped."""
    cuts = fx.detection(spark, sf).filter("label = 'signup'").select("video_id", "t")
    return islands.partition_by_cuts(cuts, fx.video(spark, sf), ["video_id"], t="t", total="duration")


@query(
    "f2_time_range",
    "F2",
    fx.with_views("span", "detection")
    + """SELECT 'overlap' AS mode, video_id, start, "end", count(*) AS n FROM span WHERE NOT ("end" < 2000 OR start > 2100) GROUP BY ALL
    UNION ALL SELECT 'contained', video_id, start, "end", count(*) FROM span WHERE start >= 2000 AND "end" <= 2100 GROUP BY ALL
    UNION ALL SELECT 'strict', video_id, start, "end", count(*) FROM span WHERE start < 2100 AND "end" > 2000 GROUP BY ALL
    UNION ALL SELECT 'point', video_id, round(t, 6), round(t, 6), count(*) FROM detection WHERE t BETWEEN 100 AND 200 GROUP BY ALL""",
)
def time_range(spark, sf):
    """The overlap, containment, strict and point forms of a time-range filter."""
    from tidemark.operators import filters

    s = fx.span(spark, sf)
    out = None
    for mode in ("overlap", "contained", "strict"):
        part = s.filter(filters.in_range(F.col("start"), F.col("end"), 2000, 2100, mode))
        part = part.withColumn("mode", F.lit(mode)).select("mode", "video_id", "start", "end")
        out = part if out is None else out.unionByName(part)
    d = fx.detection(spark, sf).filter(filters.in_range(F.col("t"), F.col("t"), 100, 200, "point"))
    pts = d.select(
        F.lit("point").alias("mode"), "video_id", F.round("t", 6).alias("start"), F.round("t", 6).alias("end")
    )
    return out.unionByName(pts).groupBy("mode", "video_id", "start", "end").agg(F.count("*").alias("n"))


KEYWORDS = ["ation", "keit", "thing", "the"]


@query(
    "j1_keyword_context",
    "J1",
    fx.with_views("segment")
    + """, m AS (SELECT *, CASE WHEN contains(lower(text), 'ation') THEN 'ation' WHEN contains(lower(text), 'keit') THEN 'keit'
          WHEN contains(lower(text), 'thing') THEN 'thing' WHEN contains(lower(text), 'the') THEN 'the' END AS keyword FROM segment)
    SELECT m.video_id, m.seg, m.keyword, greatest(0.0, m.start - 5)::DOUBLE AS start, m."end" + 5 AS "end",
           count(s.seg) AS context_count, array_to_string(list_sort(list(s.seg)), ',') AS context
    FROM m JOIN segment s ON m.video_id = s.video_id AND s.start >= m.start - 5 AND s."end" <= m."end" + 5
    WHERE m.keyword IS NOT NULL GROUP BY ALL""",
)
def keyword_context(spark, sf):
    """First keyword found in a line, with the lines contained in its surroundings."""
    from tidemark.operators.speech import keyword_matches

    return keyword_matches(fx.segment(spark, sf), ["video_id"], KEYWORDS, seg="seg", context=5.0)


@query(
    "j2_clip_chapter",
    "J2",
    fx.with_views("clip", "chapter")
    + """, l AS (SELECT video_id, max("end") AS last_end, arg_max(number, "end") AS last_number FROM chapter GROUP BY video_id)
    SELECT c.video_id, c.idx, CAST(coalesce(h.number, CASE WHEN c.start >= l.last_end THEN l.last_number END, 0) AS INTEGER) AS chapter
    FROM clip c LEFT JOIN chapter h ON c.video_id = h.video_id AND c.start >= h.start AND c.start < h."end"
    LEFT JOIN l ON l.video_id = c.video_id""",
)
def clip_chapter(spark, sf):
    """Clips placed in chapters by their start."""
    from tidemark.operators.compare import assign_chapters

    return assign_chapters(fx.clip(spark, sf), fx.chapter(spark, sf), ["video_id"]).select(
        "video_id", "idx", "chapter"
    )


@query(
    "j3_overlap_join",
    "J3",
    fx.with_views("talk_chapter")
    + """SELECT s.video_id, s.seg, c.number, round(least(s."end", c."end") - greatest(s.start, c.start), 6) AS shared
    FROM segment s JOIN talk_chapter c ON s.video_id = c.video_id AND s.start < c."end" AND s."end" > c.start""",
)
def overlap_join(spark, sf):
    """Transcript lines and the chapters they share time with."""
    ch = fx.talk_chapter(spark, sf).select(
        "video_id", "number", F.col("start").alias("r_start"), F.col("end").alias("r_end")
    )
    pairs = joins.overlap_pairs(fx.segment(spark, sf), ch, ["video_id"], bin_width=60)
    shared = F.least("end", "r_end") - F.greatest("start", "r_start")
    return pairs.select("video_id", "seg", "number", F.round(shared, 6).alias("shared"))


@query(
    "j4_max_overlap",
    "J4",
    fx.with_views("talk_chapter")
    + """, t AS (SELECT video_id, start, "end", 'S' || (number % 3) AS speaker FROM talk_chapter WHERE number % 4 <> 0),
    p AS (SELECT s.video_id, s.seg, t.speaker, t.start, least(s."end", t."end") - greatest(s.start, t.start) AS shared
          FROM segment s JOIN t ON s.video_id = t.video_id AND s.start < t."end" AND s."end" > t.start),
    b AS (SELECT *, row_number() OVER (PARTITION BY video_id, seg ORDER BY shared DESC, start) AS rn FROM p)
    SELECT s.video_id, s.seg, coalesce(b.speaker, 'UNKNOWN') AS turn_speaker
    FROM segment s LEFT JOIN b ON s.video_id = b.video_id AND s.seg = b.seg AND b.rn = 1""",
)
def max_overlap(spark, sf):
    """Each line takes the speaker of the turn it shares most time with."""
    from tidemark.operators.speech import tag_speakers

    turns = (
        fx.talk_chapter(spark, sf)
        .filter("number % 4 <> 0")
        .select(
            "video_id",
            F.col("start").alias("r_start"),
            F.col("end").alias("r_end"),
            F.concat(F.lit("S"), F.col("number") % 3).alias("turn_speaker"),
        )
    )
    return tag_speakers(fx.segment(spark, sf), turns, ["video_id"], seg="seg").select(
        "video_id", "seg", "turn_speaker"
    )


@query(
    "j5_active_segment",
    "J5",
    fx.with_views("talk_chapter")
    + """, p AS (SELECT video_id, number, start + 7 AS t FROM talk_chapter),
    s AS (SELECT video_id, seg, start, least("end", start + 8) AS "end" FROM segment)
    SELECT p.video_id, p.number, p.t, (SELECT arg_max(s.seg, s.start) FROM s WHERE s.video_id = p.video_id AND s.start <= p.t) AS active
    FROM p""",
)
def active_segment(spark, sf):
    """The line active at a time, or the nearest preceding one inside a gap."""
    probes = fx.talk_chapter(spark, sf).select("video_id", "number", (F.col("start") + 7).alias("t"))
    got = joins.asof_backward(
        probes, fx.segment(spark, sf), ["video_id"], t="t", right_t="start", value="seg", out="hit", chunk=600
    )
    return got.select("video_id", "number", "t", F.col("hit.v").alias("active"))


@query(
    "j5_reading_before_onset",
    "J5",
    fx.with_views("reading")
    + """SELECT o.video_id, o.sec, (SELECT arg_max(r.label, r.sec) FROM reading r WHERE r.video_id = o.video_id AND r.sec < o.sec AND r.sec >= o.sec - 4) AS turned_from
    FROM reading o WHERE o.label = 'anger'""",
)
def reading_before_onset(spark, sf):
    """Last reading before an onset, no older than 4 s."""
    r = fx.reading(spark, sf)
    onsets = r.filter("label = 'anger'").select("video_id", "sec", (F.col("sec") - 1).alias("before"))
    got = joins.asof_backward(
        onsets, r, ["video_id"], t="before", right_t="sec", value="label", out="hit", tolerance=3.0
    )
    return got.select("video_id", "sec", F.col("hit.v").alias("turned_from"))


@query(
    "j6_near_cut",
    "J6",
    fx.with_views("detection")
    + """, c AS (SELECT video_id, t FROM detection WHERE label = 'signup' AND conf > 0.2),
    m AS (SELECT video_id, event_id, t FROM detection WHERE label = 'error')
    SELECT video_id, event_id, CASE WHEN video_id IN (SELECT video_id FROM c) THEN
      EXISTS (SELECT 1 FROM c WHERE c.video_id = m.video_id AND abs(c.t - m.t) <= 2.0) END AS at_cut FROM m""",
)
def near_cut(spark, sf):
    """Whether a cut lies within 2 of a mark; NULL where the video has no cuts."""
    d = fx.detection(spark, sf)
    cuts = d.filter("label = 'signup' AND conf > 0.2").select("video_id", F.col("t").alias("cut"))
    marks = d.filter("label = 'error'").select("video_id", "event_id", "t")
    g = joins.nearest_gap(marks, cuts, ["video_id"], t="t", other="cut")
    return g.select("video_id", "event_id", (F.col("gap") <= 2.0).alias("at_cut"))


@query(
    "j7_require_companion",
    "J7",
    fx.with_views("label_sec")
    + """, a AS (SELECT DISTINCT video_id, sec FROM label_sec WHERE label = 'purchase'),
    o AS (SELECT DISTINCT video_id, sec FROM label_sec WHERE label = 'view')
    SELECT a.video_id, a.sec FROM a WHERE EXISTS (SELECT 1 FROM o WHERE o.video_id = a.video_id AND abs(o.sec - a.sec) <= 10)""",
)
def require_companion(spark, sf):
    """Action seconds with an object second within 10."""
    s = fx.label_sec(spark, sf)
    actions = s.filter("label = 'purchase'").select("video_id", "sec").distinct()
    objects = s.filter("label = 'view'").select("video_id", F.col("sec").alias("o"))
    return joins.near_semi(actions, objects, ["video_id"], t="sec", other="o", within=10)

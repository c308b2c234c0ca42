"""Classes, levels and chapters against the whole video."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.operators import compare, scoring
from tidemark.plans.registry import query

K = ["video_id"]
J = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


@query(
    "a7_largest_instance",
    "A7 X5",
    fx.with_views("box")
    + """SELECT video_id, frame, label, round(area, 9) AS area, conf FROM (SELECT *, greatest(w, 0) * greatest(h, 0) AS area,
      row_number() OVER (PARTITION BY video_id, frame, label ORDER BY greatest(w, 0) * greatest(h, 0) DESC, idx) AS rn FROM box) WHERE rn = 1 AND area > 0""",
)
def largest_instance(spark, sf):
    """Biggest box of each class and frame."""
    b = compare.largest_instances(fx.box(spark, sf), K, tick="frame")
    return b.withColumn("area", F.round("area", 9))


@query(
    "a8_presence",
    "A8",
    fx.with_views("label_sec")
    + """, m AS (SELECT DISTINCT video_id, sec, label FROM label_sec), v AS (SELECT video_id, count(DISTINCT sec) AS detected_seconds, max(sec) + 1 AS span FROM m GROUP BY video_id)
    SELECT m.video_id, label, count(*) AS seconds_with, any_value(detected_seconds) AS detected_seconds, any_value(span) AS span
    FROM m JOIN v ON v.video_id = m.video_id GROUP BY m.video_id, label""",
)
def presence(spark, sf):
    return compare.presence(fx.label_sec(spark, sf), K)


@query(
    "a10_level_by_class",
    "A10",
    fx.with_views("label_sec", "curve")
    + """, m AS (SELECT DISTINCT video_id, sec, label FROM label_sec)
    SELECT m.video_id, label, count(*) AS seconds, round(quantile_cont(value, 0.5), 6) AS median_level,
      round(quantile_cont(value, 0.25), 6) AS p25_level, round(quantile_cont(value, 0.75), 6) AS p75_level
    FROM m JOIN curve c ON c.video_id = m.video_id AND c.sec = m.sec GROUP BY m.video_id, label HAVING count(*) >= 8""",
)
def level_by_class(spark, sf):
    return compare.level_by_class(fx.label_sec(spark, sf), fx.curve(spark, sf), K, value="value", digits=6)


_PAIRS = """, m AS (SELECT DISTINCT video_id, sec, label FROM label_sec),
    a AS (SELECT video_id, sec FROM m WHERE label = 'purchase'),
    b AS (SELECT video_id, sec FROM m WHERE label = 'view' AND NOT EXISTS (SELECT 1 FROM a WHERE a.video_id = m.video_id AND a.sec = m.sec)),
    f AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY video_id ORDER BY sec) <= 30 THEN 0 ELSE 1 END AS fresh FROM a),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY sec) AS island FROM f),
    s AS (SELECT video_id, min(sec) AS lo, max(sec) AS hi FROM g GROUP BY video_id, island),
    i AS (SELECT s.video_id, lo, hi, count(*) AS n_class, quantile_cont(value, 0.5) AS med FROM s JOIN a ON a.video_id = s.video_id AND a.sec BETWEEN lo AND hi
      JOIN curve c ON c.video_id = a.video_id AND c.sec = a.sec GROUP BY s.video_id, lo, hi),
    n AS (SELECT s.video_id, lo, hi, count(*) AS n_control, quantile_cont(value, 0.5) AS med FROM s JOIN b ON b.video_id = s.video_id AND b.sec BETWEEN lo - 120 AND hi + 120 AND NOT (b.sec BETWEEN lo AND hi)
      JOIN curve c ON c.video_id = b.video_id AND c.sec = b.sec GROUP BY s.video_id, lo, hi),
    p AS (SELECT i.video_id, i.lo AS start, i.hi AS "end", n_class, n_control, round(i.med - n.med, 6) AS difference
      FROM i JOIN n ON n.video_id = i.video_id AND n.lo = i.lo WHERE n_class >= 3 AND n_control >= 3)"""


def _pairs(spark, sf):
    marks = fx.label_sec(spark, sf)
    pairs = fx.video(spark, sf).select("video_id", F.lit("purchase").alias("a"), F.lit("view").alias("b"))
    return compare.matched_controls(marks, fx.curve(spark, sf), pairs, K, value="value", digits=6)


@query("j12_matched_control", "J12", fx.with_views("label_sec", "curve") + _PAIRS + " SELECT * FROM p")
def matched_control(spark, sf):
    """Stretches of one class against nearby seconds of another."""
    return _pairs(spark, sf)


@query(
    "a11_paired_comparison",
    "A11",
    fx.with_views("label_sec", "curve")
    + _PAIRS
    + """, t AS (SELECT video_id, count(*) AS pairs, quantile_cont(difference, 0.5) AS obs, coalesce(stddev_samp(difference), 0.0) AS sd,
      count(*) FILTER (difference <> 0) AS n, greatest(count(*) FILTER (difference > 0), count(*) FILTER (difference < 0)) AS k FROM p GROUP BY video_id),
    q AS (SELECT *, CASE WHEN sd > 0 THEN 2.8::DOUBLE * sd / sqrt(pairs) ELSE 0.0 END AS mde,
      CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - lgamma(n - i + 1) - n * ln(2.0::DOUBLE))))) END AS pv FROM t)
    SELECT video_id, pairs, round(obs, 6) AS median_difference, round(sd, 6) AS spread, round(mde, 6) AS min_detectable, round(pv, 6) AS p_value,
      abs(obs) >= mde AND pv < 0.05 AS resolvable FROM q""",
)
def paired_comparison(spark, sf):
    """Whether the paired difference is one this much material can resolve."""
    return compare.paired_comparison(_pairs(spark, sf), K, digits=6)


_LIFT = """, m AS (SELECT DISTINCT video_id, sec, label FROM label_sec),
    c AS (SELECT m.*, number FROM m JOIN chapter h ON h.video_id = m.video_id AND m.sec >= floor(h.start) AND m.sec < ceil(h."end")),
    d AS (SELECT video_id, number, count(DISTINCT sec) AS det FROM c GROUP BY ALL), vd AS (SELECT video_id, count(DISTINCT sec) AS det FROM m GROUP BY ALL),
    n AS (SELECT video_id, number, label, count(*) AS seconds FROM c GROUP BY ALL), vn AS (SELECT video_id, label, count(*) AS seconds FROM m GROUP BY ALL),
    x AS (SELECT n.video_id, n.number, n.label, n.seconds, n.seconds / d.det AS here, vn.seconds / vd.det AS allv FROM n JOIN d ON d.video_id = n.video_id AND d.number = n.number
      JOIN vn ON vn.video_id = n.video_id AND vn.label = n.label JOIN vd ON vd.video_id = n.video_id),
    l AS (SELECT video_id, number, label, seconds, round(here * 100.0::DOUBLE, 6) AS chapter_share_pct, round(allv * 100.0::DOUBLE, 6) AS video_share_pct, round(here / allv, 6) AS lift FROM x)"""


@query(
    "a12_prevalence_lift",
    "A12",
    fx.with_views("label_sec", "chapter")
    + _LIFT
    + " SELECT *, seconds >= 8 AS enough_samples, lift > 0 AND (lift >= 1.4 OR lift <= 1.0::DOUBLE / 1.4) AS notable, round(abs(ln(greatest(lift, 1e-3))), 6) AS distance FROM l",
)
def prevalence_lift(spark, sf):
    """Class share of each chapter over detected seconds, against the video."""
    return compare.prevalence_lift(fx.label_sec(spark, sf), fx.chapter(spark, sf), K, digits=6)


@query(
    "a13_chapter_summary",
    "A13",
    fx.with_views("clip", "chapter", "curve")
    + """, p AS (SELECT k.video_id, h.number, k."end" - k.start AS len FROM clip k JOIN chapter h ON h.video_id = k.video_id AND k.start >= h.start AND k.start < h."end"),
    cut AS (SELECT video_id, number, count(*) AS clips, sum(len) AS clip_s FROM p GROUP BY ALL), kept AS (SELECT video_id, sum("end" - start) AS kept FROM clip GROUP BY ALL),
    hc AS (SELECT h.video_id, h.number, coalesce(avg(value) FILTER (value > 0), 0.0) AS m, max(value) AS pk, arg_max(sec, {'v': value, 's': -sec}) AS pks, quantile_cont(value, 0.5) FILTER (value > 0) AS med
      FROM chapter h JOIN curve c ON c.video_id = h.video_id AND c.sec >= floor(h.start) AND c.sec < ceil(h."end") GROUP BY ALL),
    w AS (SELECT video_id, avg(value) FILTER (value > 0) AS vm, quantile_cont(value, 0.5) FILTER (value > 0) AS vmed FROM curve GROUP BY ALL),
    x AS (SELECT h.*, v.duration, hc.m, hc.pk, hc.pks, hc.med, w.vm, w.vmed, coalesce(clips, 0) AS clips, coalesce(clip_s, 0.0) AS clip_s, coalesce(kept, 0.0) AS kept FROM chapter h JOIN video v ON v.video_id = h.video_id
      JOIN hc ON hc.video_id = h.video_id AND hc.number = h.number JOIN w ON w.video_id = h.video_id LEFT JOIN cut ON cut.video_id = h.video_id AND cut.number = h.number LEFT JOIN kept ON kept.video_id = h.video_id),
    y AS (SELECT *, ("end" - start) / duration AS rt, CASE WHEN kept <> 0 THEN clip_s / kept ELSE 0.0 END AS cs, round(shots / (("end" - start) / 60.0::DOUBLE), 6) AS spm FROM x)
    SELECT video_id, number, clips, round(clip_s, 6) AS clip_seconds, round(rt * 100.0::DOUBLE, 6) AS runtime_share_pct, round(cs * 100.0::DOUBLE, 6) AS cut_share_pct, round(cs / rt, 6) AS cut_share_lift,
      round(m, 6) AS score_mean, round(round(m, 6) / vm, 6) AS score_lift, round(pk, 6) AS score_peak, pks AS score_peak_second, spm AS shots_per_minute, round(spm / (63 / (duration / 60.0::DOUBLE)), 6) AS pace_lift,
      round(med, 6) AS loudness_median, round(20.0::DOUBLE * log10(greatest(med, 1e-9) / vmed), 6) AS loudness_delta_db FROM y""",
)
def chapter_summary(spark, sf):
    """Every chapter measured against the whole video."""
    return compare.chapter_summary(
        fx.chapter(spark, sf), fx.clip(spark, sf), fx.curve(spark, sf), fx.video(spark, sf), K, value="value", digits=6
    )


@query(
    "a35_densest_chapter",
    "A35",
    fx.with_views("label_sec", "chapter")
    + _LIFT
    + """ SELECT video_id, label, number, chapter_share_pct FROM (SELECT *, row_number() OVER (PARTITION BY video_id, label ORDER BY chapter_share_pct DESC, number) AS rn FROM l) WHERE rn = 1""",
)
def densest_chapter(spark, sf):
    shares = compare.prevalence_lift(fx.label_sec(spark, sf), fx.chapter(spark, sf), K, digits=6)
    return compare.densest_chapter(shares, K)


@query(
    "w10_chapter_changes",
    "W10",
    fx.with_views("label_sec", "chapter")
    + _LIFT
    + """, r AS (SELECT coalesce(a.video_id, b.video_id) AS video_id, coalesce(a.number, b.number + 1) AS number, coalesce(a.label, b.label) AS label, coalesce(a.chapter_share_pct, 0.0) AS to_pct, coalesce(b.chapter_share_pct, 0.0) AS from_pct
      FROM l a FULL JOIN l b ON a.video_id = b.video_id AND a.label = b.label AND a.number = b.number + 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY video_id, number ORDER BY round(abs(to_pct - from_pct), 6) DESC, label) AS pos FROM r WHERE number BETWEEN 2 AND 6 AND abs(to_pct - from_pct) >= 12.0)
    SELECT *, CASE WHEN to_pct > from_pct THEN 'rose' ELSE 'fell' END AS direction FROM o WHERE pos <= 2""",
)
def chapter_changes(spark, sf):
    """The two largest share movements at each chapter boundary."""
    ch = fx.chapter(spark, sf)
    shares = compare.prevalence_lift(fx.label_sec(spark, sf), ch, K, digits=6)
    last = ch.groupBy("video_id").agg(F.max("number").alias("_last"))
    moved = compare.share_changes(shares, K).join(last, "video_id")
    return moved.filter("number <= _last").drop("_last")


@query(
    "j11_cooccurrence",
    "J11",
    fx.with_views("label_sec")
    + """, m AS (SELECT DISTINCT video_id, sec, label FROM label_sec)
    SELECT a.video_id, a.label, b.label AS other, count(*) AS seconds FROM m a JOIN m b ON a.video_id = b.video_id AND a.sec = b.sec AND a.label <> b.label GROUP BY ALL""",
)
def cooccurrence(spark, sf):
    """Seconds that ordered class pairs share."""
    return compare.pair_seconds(fx.label_sec(spark, sf), K)


@query(
    "j13_event_labels",
    "J13",
    fx.with_views("curve", "label_sec")
    + """, h AS (SELECT *, sec - row_number() OVER (PARTITION BY video_id ORDER BY sec) AS k FROM curve WHERE value > 100),
    r AS (SELECT video_id, min(sec) AS start, max(sec) + 1 AS "end", arg_max(sec, {'v': value, 's': -sec}) AS peak_sec FROM h GROUP BY video_id, k),
    m AS (SELECT DISTINCT video_id, sec, label FROM label_sec)
    SELECT r.video_id, start, "end", peak_sec, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (m.sec = peak_sec)), ','), '') AS classes_at_peak,
      coalesce(array_to_string(list_sort(list(DISTINCT label)), ','), '') AS classes_spanning
    FROM r LEFT JOIN m ON m.video_id = r.video_id AND m.sec BETWEEN r.start AND r."end" GROUP BY ALL""",
)
def event_labels(spark, sf):
    """Classes labelled at an event's peak and across its span."""
    from tidemark.operators.bursts import runs_above

    runs = runs_above(fx.curve(spark, sf), K, value="value", threshold=100.0)
    e = compare.annotate_events(runs, fx.label_sec(spark, sf), K)
    return e.select("video_id", "start", "end", "peak_sec", J("classes_at_peak"), J("classes_spanning"))


@query(
    "j19_clips_carrying",
    "J19",
    fx.with_views("label_sec", "clip")
    + """SELECT l.video_id, label, array_to_string(list_sort(list(DISTINCT idx)), ',') AS clips FROM label_sec l JOIN clip c ON c.video_id = l.video_id AND l.sec >= floor(c.start) AND l.sec < ceil(c."end") GROUP BY ALL""",
)
def clips_carrying(spark, sf):
    c = compare.clips_carrying(fx.label_sec(spark, sf), fx.clip(spark, sf), K)
    return c.select("video_id", "label", J("clips"))


@query(
    "j20_rejected_overlap",
    "J20",
    fx.with_views("span")
    + """, s AS (SELECT DISTINCT video_id, order_id, line_id, start, "end" FROM span WHERE "end" > start)
    SELECT a.* FROM s a WHERE a.line_id < 5 AND EXISTS (SELECT 1 FROM s b WHERE b.line_id >= 5 AND b.video_id = a.video_id AND a.start < b."end" AND a."end" > b.start)""",
)
def rejected_overlap(spark, sf):
    """Spans that share time with any rejected range."""
    s = fx.span(spark, sf).filter("end > start").select("video_id", "order_id", "line_id", "start", "end").distinct()
    return compare.overlapping_any(s.filter("line_id < 5"), s.filter("line_id >= 5"), K)


@query(
    "w18_arrivals",
    "W18",
    fx.with_views("label_sec", "chapter")
    + """, h AS (SELECT c.video_id, idx, floor(c.start) AS lo, label, min(l.sec) AS second, count(*) AS seconds FROM (SELECT *, number AS idx FROM chapter) c JOIN label_sec l ON l.video_id = c.video_id AND l.sec >= floor(c.start) AND l.sec < ceil(c."end") GROUP BY ALL),
    r AS (SELECT *, label IN ('signup', 'purchase') AS composed FROM h WHERE second > lo AND seconds >= 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY video_id, idx ORDER BY composed DESC, seconds DESC, second, label DESC) AS rn FROM r)
    SELECT video_id, idx, second, label, composed, seconds FROM o WHERE rn = 1""",
)
def arrivals(spark, sf):
    """What arrives on screen inside each clip."""
    return compare.arrivals(fx.label_sec(spark, sf), fx.chapter(spark, sf).withColumnRenamed("number", "idx"), K, ["signup", "purchase"])


@query(
    "a39_clip_measurement",
    "A39 W6",
    fx.with_views("score_sec", "clip")
    + """, r AS (SELECT s.*, round(score, 6) AS sc FROM score_sec s), k AS (SELECT *, round((rank() OVER (PARTITION BY video_id ORDER BY sc) - 1 + count(*) OVER (PARTITION BY video_id ORDER BY sc RANGE UNBOUNDED PRECEDING)) / 2.0 / count(*) OVER (PARTITION BY video_id) * 100.0, 1) AS pct FROM r),
    j AS (SELECT c.idx, k.* FROM clip c JOIN k ON k.video_id = c.video_id AND k.sec >= floor(c.start) AND k.sec < ceil(c."end")),
    g AS (SELECT video_id, idx, arg_max(sec, {'v': sc, 's': -sec}) AS peak, arg_max(pct, {'v': sc, 's': -sec}) AS score_percentile, """
    + ", ".join(f"CASE WHEN max({n}) > 0 THEN arg_max(sec, {{'v': {n}, 's': -sec}}) END AS at_{n}, max({n}) AS v_{n}" for n in scoring.SIGNALS)
    + " FROM j GROUP BY ALL), f AS (SELECT *, list_filter(["
    + ", ".join(f"at_{n}" for n in scoring.BOOST_SIGNALS)
    + """], lambda x: x IS NOT NULL) AS fired FROM g)
    SELECT video_id, idx, peak, score_percentile, """
    + " || ".join(f"CASE WHEN v_{n} > 0 THEN '{n}@' || at_{n} || ' ' ELSE '' END" for n in scoring.SIGNALS)
    + """ AS fired_at, CASE WHEN len(fired) > 1 THEN list_max(fired) - list_min(fired) END AS signal_spread,
      CASE WHEN len(fired) > 1 THEN list_max(fired) - list_min(fired) <= 1 END AS signals_coincide FROM f""",
)
def clip_measurement(spark, sf):
    """Score percentile, signals fired, their spread and coincidence per clip."""
    s = fx.score_sec(spark, sf).withColumn("score", F.round("score", 6))
    m = compare.measure_clips(s, fx.clip(spark, sf), K, names=scoring.SIGNALS, boost=scoring.BOOST_SIGNALS)
    fired = F.concat_ws(
        "", F.transform("signals", lambda x: F.concat(x["signal"], F.lit("@"), x["at"].cast("string"), F.lit(" ")))
    )
    return m.withColumn("fired_at", fired).drop("signals")

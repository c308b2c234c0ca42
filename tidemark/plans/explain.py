"""Explaining results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.operators import compare, curves, scoring
from tidemark.operators import explain as ex
from tidemark.operators import readings as rd
from tidemark.operators.joins import points_in_spans
from tidemark.operators.speech import distinctive_words, marked_words, vocabulary_gaps
from tidemark.plans import speech
from tidemark.plans.registry import query
from tidemark.session import cut_lineage

K = ["video_id"]


def _marks(spark, sf, spans, with_readings=False):
    found = {
        "movement": points_in_spans(
            fx.detection(spark, sf).filter("label = 'click' AND conf > 0.2").select("video_id", "t"), spans, K, t="t"
        ),
        "loud": ex.loud_spans(spans, fx.curve(spark, sf), K, value="value"),
        "arrival": compare.arrivals(fx.label_sec(spark, sf), spans, K, ["signup", "purchase"]),
    }
    if with_readings:
        found["reading"] = rd.reading_onsets(fx.reading(spark, sf), spans, K, ident="idx")
    return ex.mark_sets(spans, found, K)


def _days(spark, sf):
    return fx.chapter(spark, sf).select("video_id", F.col("number").alias("idx"), "start", (F.col("start") + 24).alias("end"))


_SPANS = """, sp AS (SELECT 'w' AS src, video_id, CAST(unnest(range(duration // 30)) AS INTEGER) AS idx, 0.0 AS start, 0.0 AS "end" FROM video),
    s AS (SELECT src, video_id, idx, idx * 30.0::DOUBLE AS start, idx * 30.0::DOUBLE + 30 AS "end" FROM sp UNION ALL SELECT 'c', video_id, number, start, start + 24 FROM chapter),
    bar AS (SELECT video_id, quantile_cont(value, 0.9) AS b FROM curve GROUP BY ALL),
    mk AS (SELECT DISTINCT src, s.video_id, idx, 'movement' AS mark FROM s JOIN detection d ON d.video_id = s.video_id AND label = 'click' AND conf > 0.2 AND t >= s.start AND t < s."end"
      UNION SELECT src, s.video_id, idx, 'loud' FROM s JOIN curve c ON c.video_id = s.video_id AND c.sec >= s.start AND c.sec < s."end" JOIN bar ON bar.video_id = s.video_id AND c.value > b
      UNION SELECT src, video_id, idx, 'arrival' FROM (SELECT src, s.video_id, idx, s.start, label FROM s JOIN label_sec l ON l.video_id = s.video_id AND l.sec >= s.start AND l.sec < s."end" GROUP BY ALL HAVING min(l.sec) > s.start AND count(*) >= 2)),
    st AS (SELECT s.src, s.video_id, s.idx, list_sort(list(mark) FILTER (mark IS NOT NULL)) AS marks FROM s LEFT JOIN mk ON mk.src = s.src AND mk.video_id = s.video_id AND mk.idx = s.idx GROUP BY ALL)"""


@query(
    "a28_comark_rates",
    "A28",
    fx.with_views("detection", "label_sec", "video", "curve", "chapter")
    + _SPANS
    + """ SELECT c.video_id, c.idx, array_to_string(c.marks, ',') AS marks, count(*) FILTER (list_has_all(coalesce(w.marks, []), c.marks)) AS matching, count(*) AS windows,
      round(count(*) FILTER (list_has_all(coalesce(w.marks, []), c.marks)) * 100.0::DOUBLE / count(*), 6) AS pct FROM st c JOIN st w ON w.src = 'w' AND w.video_id = c.video_id WHERE c.src = 'c' AND len(c.marks) > 0 GROUP BY ALL HAVING count(*) >= 8""",
)
def comark_rates(spark, sf):
    """How much of a video carries at least the marks of each clip."""
    windows = _marks(spark, sf, ex.fixed_windows(fx.video(spark, sf), K))
    clips = _marks(spark, sf, _days(spark, sf))
    r = ex.comark_rates(clips, windows, K)
    return r.withColumn("marks", F.array_join("marks", ","))


@query("a28_comark_rates_with_readings", "A28")
def comark_rates_with_readings(spark, sf):
    """The same with the settling of the expression reading as a fourth mark."""
    windows = _marks(spark, sf, ex.fixed_windows(fx.video(spark, sf), K), True)
    clips = _marks(spark, sf, _days(spark, sf), True)
    return ex.comark_rates(clips, windows, K).withColumn("marks", F.array_join("marks", ","))


@query(
    "a29_ordering_pattern",
    "A29",
    fx.with_views("label_sec", "video", "curve")
    + """, s AS (SELECT video_id, CAST(unnest(range(duration // 30)) AS INTEGER) AS idx FROM video),
    l AS (SELECT s.video_id, idx, arg_max(sec, {'v': value, 's': -sec}) AS loud FROM s JOIN curve c ON c.video_id = s.video_id AND c.sec BETWEEN idx * 30 AND idx * 30 + 30 GROUP BY ALL),
    e AS (SELECT s.video_id, idx, min(sec) AS first FROM s JOIN label_sec c ON c.video_id = s.video_id AND label = 'error' AND c.sec >= idx * 30 AND c.sec < idx * 30 + 30 GROUP BY ALL),
    g AS (SELECT l.video_id, loud - first AS gap FROM l JOIN e ON e.video_id = l.video_id AND e.idx = l.idx WHERE abs(loud - first) <= 20),
    k AS (SELECT video_id, CASE WHEN gap > 2 THEN 'after' WHEN gap < -2 THEN 'before' ELSE 'together' END AS kind, gap FROM g), t AS (SELECT video_id, count(*) AS total FROM k GROUP BY ALL)
    SELECT k.video_id, kind, count(*) AS count, any_value(total) AS total, list_sort(list(abs(gap)))[count(*) // 2 + 1] AS lag FROM k JOIN t ON t.video_id = k.video_id GROUP BY k.video_id, kind HAVING any_value(total) >= 4 AND count(*) / any_value(total) >= 0.67""",
)
def ordering_pattern(spark, sf):
    """Whether the loudest second tends to follow the first error of a window."""
    w = ex.fixed_windows(fx.video(spark, sf), K)
    loud = compare.peak_in_range(fx.curve(spark, sf), w, K, ident=["idx"], value="value").select(
        "video_id", "idx", F.col("second").alias("loud")
    )
    errors = fx.label_sec(spark, sf).filter("label = 'error'")
    first = points_in_spans(errors, w, K, t="sec").groupBy("video_id", "idx").agg(F.min("sec").alias("first"))
    return ex.ordering_pattern(loud.join(first, ["video_id", "idx"]), K, later="loud", earlier="first")


@query(
    "a33_condition_log",
    "A33",
    fx.with_views("label_sec", "moment")
    + """, w AS (SELECT DISTINCT m.video_id, m.idx, m.start, m."end", label FROM moment m JOIN label_sec l ON l.video_id = m.video_id AND l.sec >= m.start AND l.sec < m."end" WHERE m.idx <= 5),
    s AS (SELECT video_id, CASE WHEN label IN ('signup', 'purchase') THEN 'event' ELSE 'object' END AS kind, label AS name, min(start) AS first, max("end") AS last, count(*) AS windows FROM w GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY first, kind, name)::INTEGER AS "order", round(first - lag(first) OVER (PARTITION BY video_id ORDER BY first, kind, name), 2) AS since_previous FROM s""",
)
def condition_log(spark, sf):
    """Conditions of the kept moments in order of first appearance."""
    m = fx.moment(spark, sf).filter("idx <= 5").drop("score")
    hits = points_in_spans(fx.label_sec(spark, sf).select("video_id", "sec", "label"), m, K, t="sec")
    w = hits.select("video_id", "idx", "start", "end", F.col("label").alias("name")).distinct()
    kind = F.when(F.col("name").isin("signup", "purchase"), "event").otherwise("object")
    return ex.condition_log(w.withColumn("kind", kind), K)


@query(
    "a41_standing",
    "A41",
    fx.with_views("moment")
    + """, k AS (SELECT *, round(score, 0) AS s FROM moment WHERE idx <= 5), n AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n, count(*) OVER (PARTITION BY video_id, s) AS tied, rank() OVER (PARTITION BY video_id ORDER BY s) - 1 AS below FROM k),
    m AS (SELECT *, (below + below + tied) / 2.0 / n * 100.0 AS share, min(s) OVER (PARTITION BY video_id) = max(s) OVER (PARTITION BY video_id) AS flat FROM n)
    SELECT video_id, idx, CASE WHEN n < 3 THEN NULL WHEN flat THEN 'all equal' WHEN tied / n >= 0.5 THEN 'tied' WHEN share >= 90 THEN 'strongest' WHEN share >= 70 THEN 'stronger' WHEN share >= 30 THEN 'middling' ELSE 'weaker' END AS standing FROM m""",
)
def standing(spark, sf):
    """Each kept moment's band among its peers."""
    k = fx.moment(spark, sf).filter("idx <= 5").withColumn("score", F.round("score", 0))
    return ex.standing(k, K).select("video_id", "idx", "standing")


@query(
    "a41_why_not_selected",
    "A41",
    fx.with_views("moment", "chapter", "curve")
    + """, c AS (SELECT h.video_id, h.number, max(value) AS peak FROM chapter h JOIN curve c ON c.video_id = h.video_id AND c.sec >= h.start AND c.sec < h."end" GROUP BY ALL), k AS (SELECT * FROM moment WHERE idx <= 3),
    n AS (SELECT h.video_id, h.number, count(k.idx) AS clips FROM chapter h LEFT JOIN k ON k.video_id = h.video_id AND k.start >= h.start AND k.start < h."end" GROUP BY ALL), b AS (SELECT video_id, min(pk) AS bar FROM (SELECT k.video_id, k.idx, max(value) AS pk FROM k JOIN curve c ON c.video_id = k.video_id AND c.sec >= k.start AND c.sec < k."end" GROUP BY ALL) GROUP BY ALL)
    SELECT c.video_id, c.number, CASE WHEN peak <= 0 THEN 'silent' WHEN peak >= bar THEN 'lost to length' WHEN peak >= bar * 0.9 THEN 'near miss' ELSE 'short' END AS reason, CASE WHEN peak > 0 AND peak < bar THEN round(bar - peak, 6) END AS short_by
    FROM c JOIN n ON n.video_id = c.video_id AND n.number = c.number JOIN b ON b.video_id = c.video_id WHERE clips = 0""",
)
def why_not_selected(spark, sf):
    """Why a chapter got nothing."""
    ch, curve = fx.chapter(spark, sf), fx.curve(spark, sf)
    k = fx.moment(spark, sf).filter("idx <= 3").drop("score")
    peak = points_in_spans(curve, ch.select("video_id", "number", "start", "end"), K, t="sec", bin_width=120)
    peak = peak.groupBy("video_id", "number").agg(F.max("value").alias("score_peak"))
    mine = points_in_spans(curve, k, K, t="sec").groupBy("video_id", "idx").agg(F.max("value").alias("p"))
    bar = mine.groupBy("video_id").agg(F.min("p").alias("cut_threshold"))
    n = compare.assign_chapters(k, ch, K).groupBy("video_id", F.col("chapter").alias("number")).agg(F.count("*").alias("clips"))
    x = peak.join(n, ["video_id", "number"], "left").join(bar, "video_id")
    return ex.why_not_selected(x, K).select("video_id", "number", "reason", F.round("short_by", 6).alias("short_by"))


def _moments_with_signals(spark, sf):
    """Moments with the signals that fired in them and the most seen in one hour."""
    m = fx.moment(spark, sf)
    s = fx.score_sec(spark, sf)
    hits = points_in_spans(s.drop("score", "raw"), m, K, t="sec")
    fired = F.array_compact(F.array(*[F.when(F.max(c) > 0, F.lit(c)) for c in scoring.SIGNALS]))
    return hits.groupBy("video_id", "idx", "start", "end", "score").agg(
        F.max("n_signals").alias("n_signals"), fired.alias("signals")
    )


@query(
    "u5_near_miss_signals",
    "U5",
    fx.with_views("moment", "score_sec")
    + ", j AS (SELECT m.video_id, m.idx, s.* EXCLUDE (video_id) FROM moment m JOIN score_sec s ON s.video_id = m.video_id AND s.sec >= m.start AND s.sec < m.\"end\"), "
    + "u AS (SELECT DISTINCT video_id, idx <= 5 AS kept, signal FROM (UNPIVOT (SELECT video_id, idx, "
    + ", ".join(scoring.SIGNALS)
    + " FROM j) ON "
    + ", ".join(scoring.SIGNALS)
    + " INTO NAME signal VALUE points) WHERE points > 0) SELECT video_id, signal FROM u WHERE NOT kept EXCEPT SELECT video_id, signal FROM u WHERE kept",
)
def near_miss_signals(spark, sf):
    """Signals that only ever appear in moments that did not make the cut."""
    m = _moments_with_signals(spark, sf)
    part = lambda cond: m.filter(cond).select("video_id", F.explode("signals").alias("signal"))
    return part("idx > 5").subtract(part("idx <= 5"))


@query("a34_diagnosis", "A34 A18 U5 J20")
def diagnosis(spark, sf):
    """All findings of every video."""
    # read by a dozen branches below: written once to the shared folder
    m = cut_lineage(_moments_with_signals(spark, sf))
    kept, near = m.filter("idx <= 5"), m.filter("idx > 5")
    s = fx.score_sec(spark, sf)
    inside = points_in_spans(s, kept.select("video_id", "idx", F.col("start"), F.col("end")), K, t="sec")
    totals = scoring.signal_totals(inside, K)
    labels = fx.label_sec(spark, sf)
    tags = points_in_spans(labels.select("video_id", "sec", F.col("label").alias("tag")), kept.select("video_id", "idx", "start", "end"), K, t="sec")
    names = {"click": "motion_event", "view": "object", "signup": "scene", "purchase": "action", "error": "keyword"}
    sig = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    activity = labels.groupBy("video_id", sig[F.col("label")].alias("signal")).agg(F.count("*").alias("found"))
    counts = fx.reading(spark, sf).groupBy("video_id", "label").agg(F.count("*").alias("n"))
    rejected = kept.filter("idx >= 4").select("video_id", "start", "end")
    first = kept.filter("idx = 1")
    # a row a line, read for its marked words and for its claims: written once
    slim, weighted = speech._weights(spark, sf)
    weighted = cut_lineage(weighted)
    keyed = marked_words(weighted, K, "number")
    gaps = vocabulary_gaps(distinctive_words(keyed, K, "number", digits=6), K, speech.CLASSES, "number")
    checks = first.select("video_id", F.lit("two_kinds").alias("rule"), F.when(F.col("n_signals") > 3, "fired").otherwise("never_fired").alias("state"))
    facts = ex.video_facts(
        fx.video(spark, sf), kept, near, totals, tags, activity, counts, rejected,
        gaps, speech._claims(slim, weighted), checks, K,
    )
    settings = {
        "weights": {"scene": 1.0, "motion_event": 0.0, "motion_peak": 3.0, "audio": 1.5, "keyword": 2.5, "object": 1.0, "action": 6.0, "face": 2.0},
        "coverage": 0.2, "target": 60.0, "boost": 1.2, "min_signals": 4, "face_labels": ["happy"],
    }
    return ex.diagnose(facts, K, settings, concern="repetitive")


@query("a40_report_records", "A40 A31")
def report_records(spark, sf):
    """The nested record of every video, as JSON text."""
    m = cut_lineage(_moments_with_signals(spark, sf))
    kept, near = m.filter("idx <= 5"), m.filter("idx > 5")
    inside = points_in_spans(fx.score_sec(spark, sf), kept.select("video_id", "idx", "start", "end"), K, t="sec")
    totals = scoring.signal_totals(inside, K).withColumn("total", F.round("total", 4))
    curve = curves.downsample_max(fx.curve(spark, sf), K, value="value", points=48)
    rec = ex.report_records(fx.video(spark, sf), kept, near, totals, curve, fx.chapter(spark, sf), K)
    body = F.to_json(F.struct(*[c for c in rec.columns if c != "video_id"]))
    return rec.select("video_id", body.alias("record"))

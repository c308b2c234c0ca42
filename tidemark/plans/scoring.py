"""Scores, ranks, filters and simple aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.operators import choose, filters, scoring
from tidemark.plans.registry import query
from tidemark.session import spread

R = lambda c, n=6: F.round(c, n).alias(c)


@query(
    "top_moments",
    "A1 A2 W8",
    fx.with_views("score_sec")
    + """, h AS (SELECT * FROM score_sec WHERE score > 0),
    f AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY video_id ORDER BY sec) <= 2 THEN 0 ELSE 1 END AS fresh FROM h),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY sec) AS island FROM f),
    i AS (SELECT video_id, min(sec) AS start, max(sec) + 1 AS "end", sum(score) AS score FROM g GROUP BY video_id, island),
    d AS (SELECT *, round(score / greatest(0.5, "end" - start), 6) AS density FROM i),
    r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY density DESC, start) AS rank FROM d)
    SELECT video_id, rank, start, "end", round(score, 6) AS score, density FROM r WHERE rank <= 3""",
)
def top_moments(spark, sf):
    """Flagship: the three densest moments of each stream."""
    from tidemark.operators.islands import point_islands

    hot = fx.score_sec(spark, sf).filter("score > 0")
    runs = point_islands(hot, ["video_id"], "sec", 2, aggs={"score": ("sum", "score")})
    runs = runs.withColumn("end", F.col("end") + 1)
    dense = runs.withColumn(
        "density", F.round(F.col("score") / F.greatest(F.lit(0.5), F.col("end") - F.col("start")), 6)
    )
    w = Window.partitionBy("video_id").orderBy(F.desc("density"), "start")
    return (
        dense.withColumn("rank", F.row_number().over(w))
        .filter("rank <= 3")
        .select("video_id", "rank", "start", "end", R("score"), "density")
    )


@query(
    "a1_second_scores",
    "A1 A2",
    fx.with_views("score_sec")
    + "SELECT video_id, sec, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in [*scoring.SIGNALS, "raw", "score"])
    + ", n_signals FROM score_sec",
)
def second_scores(spark, sf):
    """All signals per second with the multi-signal boost."""
    s = fx.score_sec(spark, sf)
    return s.select("video_id", "sec", *[R(c) for c in [*scoring.SIGNALS, "raw", "score"]], "n_signals")


@query(
    "a3_confidence_tiers",
    "A3",
    fx.with_views("action_points") + "SELECT video_id, sec, points FROM action_points",
)
def confidence_tiers(spark, sf):
    """Best action of a second scored against its own type's percentiles."""
    acts = fx.detection(spark, sf).filter("label IN ('purchase', 'error')")
    t = scoring.action_tiers(acts, ["video_id"], sec="sec", label="label", conf="conf", weight=6.0)
    return t.select("video_id", "sec", "points")


@query(
    "a4_peak_confidence",
    "A4",
    fx.with_views("label_sec") + "SELECT video_id, sec, max(conf) AS conf FROM label_sec GROUP BY video_id, sec",
)
def peak_confidence(spark, sf):
    return fx.label_sec(spark, sf).groupBy("video_id", "sec").agg(F.max("conf").alias("conf"))


@query(
    "a5_clearest_reading",
    "A5",
    fx.with_views("embedding")
    + """, p AS (SELECT video_id, sec // 2 AS sec, vec_id, vec[1:5] AS p FROM embedding),
    t AS (SELECT *, list_max(p) AS conf, list_position(p, list_max(p)) AS pos FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY video_id, sec ORDER BY conf DESC, vec_id) AS rn FROM t WHERE conf >= 0.1)
    SELECT video_id, sec, ['neutral', 'happy', 'sad', 'surprise', 'anger'][pos] AS label, round(conf, 6) AS conf FROM r WHERE rn = 1""",
)
def clearest_reading(spark, sf):
    """Argmax label per face, then the most confident face of a second (first best)."""
    e = fx.embedding(spark, sf).select(
        "video_id", F.expr("cast(sec div 2 as int)").alias("sec"), "vec_id", F.slice("vec", 1, 5).alias("p")
    )
    faces = scoring.top_label(e, "p", scoring.EXPRESSION_LABELS)
    best = scoring.clearest_per_second(faces, ["video_id"], order="vec_id", min_confidence=0.1)
    return best.select("video_id", "sec", "label", R("conf"))


@query(
    "a6_label_counts",
    "A6",
    fx.with_views("label_sec")
    + "SELECT label, count(*) AS n FROM label_sec GROUP BY label ORDER BY n DESC, label LIMIT 3",
)
def label_counts(spark, sf):
    return (
        fx.label_sec(spark, sf)
        .groupBy("label")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "label")
        .limit(3)
    )


@query(
    "a9_action_clusters",
    "A9",
    fx.with_views("detection")
    + """, p AS (SELECT video_id, sec, label FROM detection), s AS (SELECT DISTINCT video_id, sec FROM p),
    f AS (SELECT *, lag(sec) OVER (PARTITION BY video_id ORDER BY sec) AS prev FROM s),
    g AS (SELECT *, sum(CASE WHEN prev IS NULL OR sec - prev >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY sec) AS run FROM f),
    c AS (SELECT video_id, run, min(sec) AS start, max(sec) AS "end", count(*) - CASE WHEN run = 1 THEN 1 ELSE 0 END AS n FROM g GROUP BY video_id, run)
    SELECT c.video_id, c.start, c."end", c.n AS action_count, round(n / (c."end" - c.start), 6) AS density,
      array_to_string(list_sort(list(DISTINCT label)), ',') AS actions
    FROM c JOIN p ON p.video_id = c.video_id AND p.sec BETWEEN c.start AND c."end"
    WHERE c."end" > c.start AND n / (c."end" - c.start) >= 0.5 GROUP BY ALL""",
)
def action_clusters(spark, sf):
    """Stretches of action times under 2 apart with density at least 0.5."""
    d = fx.detection(spark, sf)
    out = scoring.density_clusters(d, ["video_id"], t="sec", label="label", gap=2.0, min_density=0.5)
    return out.withColumn("density", F.round("density", 6)).withColumn(
        "actions", F.array_join(F.array_sort("actions"), ",")
    )


@query(
    "a9_action_statistics",
    "A9",
    fx.with_views("detection")
    + """SELECT video_id, count(*) AS total_actions, count(DISTINCT label) AS unique_actions,
    count(DISTINCT sec) AS timestamps_with_actions FROM detection GROUP BY video_id""",
)
def action_statistics(spark, sf):
    """Totals per video; folded to (video, second, label) before the distinct counts."""
    d = fx.detection(spark, sf).groupBy("video_id", "sec", "label").agg(F.count("*").alias("n"))
    return d.groupBy("video_id").agg(
        F.sum("n").alias("total_actions"),
        F.count_distinct("label").alias("unique_actions"),
        F.count_distinct("sec").alias("timestamps_with_actions"),
    )


@query(
    "a18_signal_totals",
    "A18",
    fx.with_views("score_sec", "clip")
    + ", k AS (SELECT s.* FROM score_sec s JOIN clip c ON s.video_id = c.video_id AND s.sec >= c.start AND s.sec < c.\"end\"), "
    + "u AS (UNPIVOT (SELECT video_id, sec, "
    + ", ".join(scoring.SIGNALS)
    + " FROM k) ON "
    + ", ".join(scoring.SIGNALS)
    + " INTO NAME signal VALUE points) SELECT video_id, signal, round(sum(points), 6) AS total, "
    + "signal NOT IN ('beginning', 'ending') AS evidence FROM u GROUP BY video_id, signal HAVING sum(points) <> 0",
)
def signal_totals(spark, sf):
    """Points per signal over the kept clips; position bonuses are no evidence."""
    from tidemark.operators.joins import points_in_spans

    kept = points_in_spans(fx.score_sec(spark, sf), fx.clip(spark, sf), ["video_id"], t="sec")
    return scoring.signal_totals(kept, ["video_id"]).withColumn("total", F.round("total", 6))


@query(
    "f1_keyword_filter",
    "F1",
    fx.with_views("segment")
    + "SELECT video_id, seg, text FROM segment WHERE contains(lower(text), 'ation') OR contains(lower(text), 'thing')",
)
def keyword_filter(spark, sf):
    s = fx.segment(spark, sf)
    from tidemark.functions.text import any_keyword

    return s.filter(any_keyword(F.col("text"), ["ation", "Thing"])).select("video_id", "seg", "text")


@query(
    "f3_confidence_band",
    "F3",
    fx.with_views("detection")
    + "SELECT event_id, label, conf FROM detection WHERE conf BETWEEN 0.1 AND 0.4 AND label IN ('view', 'error')",
)
def confidence_band(spark, sf):
    d = filters.confidence_band(fx.detection(spark, sf), lo=0.1, hi=0.4, classes=["view", "error"])
    return d.select("event_id", "label", "conf")


@query(
    "f4_admission",
    "F4",
    fx.with_views("detection") + "SELECT event_id, label FROM detection WHERE conf > 0.3 AND label IN ('click', 'view')",
)
def admission(spark, sf):
    return filters.admit(fx.detection(spark, sf), threshold=0.3, wanted=["Click", "view"]).select("event_id", "label")


@query(
    "f5_label_moments",
    "F5",
    fx.with_views("reading") + "SELECT video_id, sec, conf FROM reading WHERE lower(label) = 'happy' AND conf >= 0.5",
)
def label_moments(spark, sf):
    """Moments of one expression, strongest first."""
    r = fx.reading(spark, sf)
    return (
        r.filter((F.lower("label") == "happy") & (F.col("conf") >= 0.5))
        .select("video_id", "sec", "conf")
        .orderBy(F.desc("conf"), "video_id", "sec")
    )


_LISTS = """, n AS (SELECT video_id, sec, list_sort(list(label)) AS names FROM label_sec GROUP BY video_id, sec)"""


def _name_lists(spark, sf):
    return (
        fx.label_sec(spark, sf)
        .groupBy("video_id", "sec", "label")
        .agg(F.count("*").alias("n"))
        .groupBy("video_id", "sec")
        .agg(F.flatten(F.array_sort(F.collect_list(F.array_repeat("label", F.col("n").cast("int"))))).alias("names"))
    )


@query(
    "f6_strip_names",
    "F6",
    fx.with_views("label_sec")
    + _LISTS
    + """SELECT video_id, sec, array_to_string(list_filter(names, lambda x: x NOT IN ('error', 'view')), ',') AS names,
    len(names) AS frame_size FROM n WHERE len(list_filter(names, lambda x: x NOT IN ('error', 'view'))) > 0""",
)
def strip_names(spark, sf):
    """Names stripped from per-second lists; a frame goes only if all its names go."""
    n = _name_lists(spark, sf)
    drop = ["error", "view"]
    kept = filters.strip_names(F.col("names"), drop)
    return n.filter(filters.frame_survives(F.col("names"), drop)).select(
        "video_id", "sec", F.array_join(kept, ",").alias("names"), F.size("names").alias("frame_size")
    )


@query(
    "f7_split_tags",
    "F7",
    fx.with_views("label_sec")
    + _LISTS
    + """SELECT video_id, sec, array_to_string(list_filter(names, lambda x: x NOT IN ('signup', 'purchase')), ',') AS objects,
    array_to_string(list_filter(names, lambda x: x IN ('signup', 'purchase')), ',') AS events FROM n""",
)
def split_tags(spark, sf):
    """Composed events separated from the detections they were made of."""
    n = _name_lists(spark, sf)
    composed = ["signup", "purchase"]
    return n.select(
        "video_id",
        "sec",
        F.array_join(filters.strip_names(F.col("names"), composed), ",").alias("objects"),
        F.array_join(F.filter("names", lambda x: x.isin(*composed)), ",").alias("events"),
    )


@query(
    "f8_valid_speech",
    "F8",
    """WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+'), lambda x: x <> '') AS words FROM documents),
    u AS (SELECT doc_id, unnest(words) AS word FROM w),
    c AS (SELECT doc_id, max(n) AS top FROM (SELECT doc_id, word, count(*) AS n FROM u GROUP BY doc_id, word) GROUP BY doc_id)
    SELECT w.doc_id FROM w LEFT JOIN c ON w.doc_id = c.doc_id
    WHERE length(trim(lower(text))) >= 2 AND NOT regexp_matches(trim(lower(text)), '^(oh+,?\\s*)+$|^(ah+,?\\s*)+$|^(ha+,?\\s*)+$|^(um+,?\\s*)+$|^(uh+,?\\s*)+$')
      AND NOT (len(words) >= 3 AND top / len(words) > 0.7)""",
)
def valid_speech(spark, sf):
    """Documents that pass the speech-validity test."""
    d = spread(fx.table(spark, sf, "documents").select("doc_id", "text"))
    return d.filter(filters.valid_speech(F.col("text"))).select("doc_id")


@query(
    "f9_vocal_gate",
    "F9",
    fx.with_views("embedding")
    + """SELECT video_id, sec FROM embedding WHERE abs(vec[1]) <= 0.08 AND abs(vec[2]) <= 0.15 AND abs(vec[3]) * 3 > 0.30""",
)
def vocal_gate(spark, sf):
    """Seconds carrying voice: flatness, high-band share and periodicity."""
    e = fx.embedding(spark, sf).select(
        "video_id",
        "sec",
        F.abs(F.col("vec")[0]).alias("flatness"),
        F.abs(F.col("vec")[1]).alias("high_ratio"),
        (F.abs(F.col("vec")[2]) * 3).alias("periodicity"),
    )
    from tidemark.operators.curves import vocal

    return e.filter(vocal("flatness", "high_ratio", "periodicity")).select("video_id", "sec")


@query(
    "f10_triage",
    "F10",
    fx.with_views("embedding")
    + """, p AS (SELECT vec_id, list_transform(vec[1:10], lambda v: exp(v * 3)) AS e FROM embedding),
    q AS (SELECT vec_id, unnest(e) / list_sum(e) AS p, unnest(range(10)) AS i FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(p, 9) DESC, i) AS rn FROM q)
    SELECT vec_id, max(CASE WHEN rn = 1 THEN 'class' || i END) AS label, round(max(CASE WHEN rn = 1 THEN p END), 6) AS top,
      CASE WHEN max(p) >= 0.2 THEN 'sorted' WHEN max(p) >= 0.16 THEN 'uncertain' ELSE 'review' END AS decision,
      string_agg('class' || i, ',' ORDER BY rn) FILTER (rn <= 5) AS top5 FROM r GROUP BY vec_id""",
)
def triage(spark, sf):
    """Argmax label, top five and the sorted/uncertain/review decision."""
    e = fx.embedding(spark, sf).select(
        "vec_id", F.transform(F.slice("vec", 1, 10), lambda v: F.exp(v * 3)).alias("e")
    )
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    ranked = F.array_sort(
        F.transform(
            "e", lambda x, i: F.struct((-F.round(x / total, 9)).alias("neg"), i.alias("i"), (x / total).alias("p"))
        )
    )
    r = e.select("vec_id", ranked.alias("r"))
    name = lambda s: F.concat(F.lit("class"), s["i"].cast("string"))
    top = F.col("r")[0]
    return r.select(
        "vec_id",
        name(top).alias("label"),
        F.round(top["p"], 6).alias("top"),
        filters.triage(top["p"], sure=0.2, maybe=0.16).alias("decision"),
        F.array_join(F.transform(F.slice("r", 1, 5), name), ",").alias("top5"),
    )


@query(
    "f11_observed_classes",
    "F11",
    fx.with_views("label_sec")
    + "SELECT DISTINCT label FROM label_sec WHERE label NOT IN ('signup', 'purchase')",
)
def observed_classes(spark, sf):
    from tidemark.operators.compare import observed_classes as observed

    composed = spark.sql("SELECT * FROM VALUES ('signup'), ('purchase') AS t(label)")
    return observed(fx.label_sec(spark, sf), composed)


@query(
    "f12_cut_gate",
    "F12",
    fx.with_views("detection", "video")
    + """SELECT v.video_id, count(d.event_id) AS cuts, round(count(d.event_id) / (duration / 24.0), 6) AS per_unit,
    count(d.event_id) / (duration / 24.0) < 0.5 AS undetected
    FROM video v LEFT JOIN detection d ON d.video_id = v.video_id AND label = 'signup' GROUP BY v.video_id, duration""",
)
def cut_gate(spark, sf):
    """Too few cuts per unit of time to be an edit."""
    from tidemark.operators.chapters import cut_rate

    cuts = fx.detection(spark, sf).filter("label = 'signup'")
    return cut_rate(cuts, fx.video(spark, sf), ["video_id"], total="duration", unit=24.0).select(
        "video_id", "cuts", R("per_unit"), "undetected"
    )


@query(
    "t1_ranked_seconds",
    "T1",
    fx.with_views("score_sec", "label_sec")
    + """, c AS (SELECT video_id, sec, max(conf) AS conf FROM label_sec GROUP BY video_id, sec),
    j AS (SELECT s.video_id, s.sec, round(score, 6) AS score, coalesce(conf, 0.0) AS conf FROM score_sec s LEFT JOIN c ON s.video_id = c.video_id AND s.sec = c.sec)
    SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, conf DESC, sec) AS rank FROM j WHERE score > 0""",
)
def ranked_seconds(spark, sf):
    """Seconds ranked by score, confidence, then time (MAX mode)."""
    return choose.rank_seconds(fx.ranked_input(spark, sf), ["video_id"])


@query(
    "t13_type_quota",
    "T13",
    fx.with_views("span")
    + """, s AS (SELECT video_id, order_id, line_id, line_id % 3 AS label, start, "end" - start AS duration, score FROM span WHERE "end" > start),
    n AS (SELECT video_id, count(DISTINCT label) AS types FROM s GROUP BY video_id),
    b AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY video_id, label ORDER BY score DESC, start, order_id, line_id, duration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
    SELECT b.video_id, order_id, line_id, duration FROM b JOIN n ON n.video_id = b.video_id WHERE before < 3 * 365 / types""",
)
def type_quota(spark, sf):
    """Sequences by confidence while the time before them is under the type's quota."""
    s = (
        fx.span(spark, sf)
        .filter("end > start")
        .select(
            "video_id",
            "order_id",
            "line_id",
            (F.col("line_id") % 3).alias("label"),
            (F.col("end") - F.col("start")).alias("duration"),
            "score",
            F.struct("start", "order_id", "line_id", F.col("end") - F.col("start")).alias("tie"),
        )
    )
    q = choose.quota_per_type(s, ["video_id"], "label", target=365.0, conf="score", tie="tie")
    return q.select("video_id", "order_id", "line_id", "duration")


@query(
    "t15_top_detections",
    "T15",
    fx.with_views("detection")
    + "SELECT event_id, label, conf FROM detection ORDER BY conf DESC, event_id LIMIT 20",
)
def top_detections(spark, sf):
    d = fx.detection(spark, sf)
    return d.select("event_id", "label", "conf").orderBy(F.desc("conf"), "event_id").limit(20)

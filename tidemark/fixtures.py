"""Stand-in views: the driver's tables seen as timeline tables.

Every view exists twice, as a DataFrame function and as a DuckDB common table
expression of the same name, so a registered query and its check start from the
same rows. ``with_views("label_sec", ...)`` gives the SQL prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Event kinds read as expressions.
EXPRESSIONS = {
    "click": "happy",
    "view": "neutral",
    "signup": "surprise",
    "purchase": "sad",
    "error": "anger",
}

_MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as detections: hour tick ``sec``, exact time ``t`` in hours."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_id"),
        F.expr(f"cast({_MICROS} div 3600000000 as int)").alias("sec"),
        F.expr(f"{_MICROS} / 3600000000D").alias("t"),
        F.col("event_type").alias("label"),
        (F.col("value") / 500.0).alias("conf"),
        F.col("event_id"),
        F.col("value"),
    )


def label_sec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection(spark, sf_dir).select("video_id", "sec", "label", "conf")


def video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user; the axis is rounded up to whole days."""
    return (
        detection(spark, sf_dir)
        .groupBy("video_id")
        .agg(((F.floor(F.max("sec") / 24) + 1) * 24).cast("int").alias("duration"))
    )


def tick_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse curve: one row per user and hour that has events."""
    return (
        detection(spark, sf_dir)
        .groupBy("video_id", "sec")
        .agg(F.sum("value").alias("value"), F.count("*").alias("n"))
    )


def curve(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Dense hourly curve, 0 where nothing was seen; values rounded so that the
    order of summation cannot show. With *of* only the curves of its videos."""
    from tidemark.operators.axis import dense_curve

    values = detection(spark, sf_dir).select("video_id", "sec", "value")
    videos = video(spark, sf_dir)
    if of is not None:
        values, videos = (x.join(of.select("video_id"), "video_id", "left_semi") for x in (values, videos))
    dense = dense_curve(values, videos, ["video_id"], "duration", value="value")
    return dense.withColumn("value", F.round(F.coalesce("value", F.lit(0.0)), 2))


def span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem x orders: a customer's order-to-ship intervals in days."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity"
    )
    day = "datediff({0}, DATE'1992-01-01')"
    return (
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").alias("video_id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_id"),
            F.col("l_partkey").alias("part_id"),
            F.expr(day.format("o_orderdate")).cast("double").alias("a"),
            F.expr(day.format("l_shipdate")).cast("double").alias("b"),
            F.col("l_quantity").alias("score"),
        )
        .select(
            "video_id",
            "order_id",
            "line_id",
            "part_id",
            F.least("a", "b").alias("start"),
            F.greatest("a", "b").alias("end"),
            "score",
        )
    )


def segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as transcript lines; a turn starts every 10 s."""
    start = F.col("turn") * 10.0
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("video_id"),
        F.col("turn").alias("seg"),
        start.alias("start"),
        (start + F.length("text") / 20.0).alias("end"),
        "text",
        F.col("role").alias("speaker"),
    )


def embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as frames: 100 to a video, one a second, ten to a shot."""
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 100").alias("video_id"),
        F.expr("cast(vec_id % 100 as int)").alias("sec"),
        F.expr("cast((vec_id % 100) div 10 as int)").alias("shot"),
        F.expr("transform(embedding, v -> cast(v as double))").alias("vec"),
        "label",
        "vec_id",
    )


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as boxes, five to a frame, class from the label."""
    return box_columns(table(spark, sf_dir, "embeddings"))


def box_columns(e: DataFrame) -> DataFrame:
    """The box view of rows of the embedding table, batch or stream."""
    v = [F.col("embedding")[i].cast("double") for i in range(5)]
    return e.select(
        F.expr("vec_id div 100").alias("video_id"),
        F.expr("cast((vec_id % 100) div 5 as int)").alias("frame"),
        F.expr("cast((vec_id % 100) % 5 as int)").alias("idx"),
        F.concat(F.lit("c"), F.col("label") % 4).alias("label"),
        F.round(0.4 + v[0], 4).alias("x"),
        F.round(0.4 + v[1], 4).alias("y"),
        F.round(0.2 + F.abs(v[2]), 4).alias("w"),
        F.round(0.2 + F.abs(v[3]), 4).alias("h"),
        F.round(F.abs(v[4]) * 3, 4).alias("conf"),
    )


def reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clearest expression per user and hour, from the strongest event."""
    names = F.create_map(*[F.lit(x) for kv in EXPRESSIONS.items() for x in kv])
    d = detection(spark, sf_dir)
    return d.groupBy("video_id", "sec").agg(
        F.max_by(names[F.col("label")], F.struct("value", "event_id")).alias("label"),
        F.least(F.max("conf") + 0.3, F.lit(1.0)).alias("conf"),
    )


_EXPR_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXPRESSIONS.items())
_US = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00'))"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "detection": (
        (),
        f"SELECT user_id AS video_id, CAST({_US} // 3600000000 AS INTEGER) AS sec, "
        f"{_US} / 3600000000.0::DOUBLE AS t, event_type AS label, value / 500.0::DOUBLE AS conf, "
        "event_id, value FROM events",
    ),
    "label_sec": (("detection",), "SELECT video_id, sec, label, conf FROM detection"),
    "video": (
        ("detection",),
        "SELECT video_id, CAST((max(sec) // 24 + 1) * 24 AS INTEGER) AS duration "
        "FROM detection GROUP BY video_id",
    ),
    "tick_value": (
        ("detection",),
        "SELECT video_id, sec, sum(value) AS value, count(*) AS n FROM detection GROUP BY video_id, sec",
    ),
    "axis": (
        ("video",),
        "SELECT video_id, CAST(unnest(range(duration)) AS INTEGER) AS sec FROM video",
    ),
    "curve": (
        ("axis", "tick_value"),
        "SELECT a.video_id, a.sec, round(coalesce(v.value, 0.0), 2) AS value FROM axis a "
        "LEFT JOIN tick_value v ON a.video_id = v.video_id AND a.sec = v.sec",
    ),
    "span": (
        (),
        "SELECT o_custkey AS video_id, l_orderkey AS order_id, l_linenumber AS line_id, l_partkey AS part_id, "
        "CAST(least(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)), "
        "date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))) AS DOUBLE) AS start, "
        "CAST(greatest(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)), "
        "date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))) AS DOUBLE) AS \"end\", "
        "l_quantity AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    ),
    "segment": (
        (),
        "SELECT conv_id AS video_id, turn AS seg, turn * 10.0::DOUBLE AS start, "
        "turn * 10.0::DOUBLE + length(text) / 20.0::DOUBLE AS \"end\", text, role AS speaker FROM conversations",
    ),
    "embedding": (
        (),
        "SELECT vec_id // 100 AS video_id, CAST(vec_id % 100 AS INTEGER) AS sec, "
        "CAST((vec_id % 100) // 10 AS INTEGER) AS shot, "
        "CAST(embedding AS DOUBLE[]) AS vec, label, vec_id FROM embeddings",
    ),
    "box": (
        (),
        "SELECT vec_id // 100 AS video_id, CAST((vec_id % 100) // 5 AS INTEGER) AS frame, "
        "CAST((vec_id % 100) % 5 AS INTEGER) AS idx, 'c' || (label % 4) AS label, "
        "round(0.4::DOUBLE + embedding[1]::DOUBLE, 4) AS x, round(0.4::DOUBLE + embedding[2]::DOUBLE, 4) AS y, "
        "round(0.2::DOUBLE + abs(embedding[3]::DOUBLE), 4) AS w, "
        "round(0.2::DOUBLE + abs(embedding[4]::DOUBLE), 4) AS h, "
        "round(abs(embedding[5]::DOUBLE) * 3, 4) AS conf FROM embeddings",
    ),
    "reading": (
        ("detection",),
        "SELECT video_id, sec, arg_max(CASE label " + _EXPR_CASE + " END, {'v': value, 'e': event_id}) AS label, "
        "least(max(conf) + 0.3::DOUBLE, 1.0::DOUBLE) AS conf FROM detection GROUP BY video_id, sec",
    ),
}


def with_views(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for *names* and what they build on."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in CTES[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)


def clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept clips: error hours merged at gap 2, at least two hours long, numbered."""
    from pyspark.sql import Window

    from tidemark.operators.islands import point_islands

    s = label_sec(spark, sf_dir).filter("label = 'error'").select("video_id", "sec").distinct()
    c = point_islands(s, ["video_id"], "sec", 2).filter("end > start")
    w = Window.partitionBy("video_id").orderBy("start")
    return c.select(
        "video_id",
        F.row_number().over(w).alias("idx"),
        F.col("start").cast("double").alias("start"),
        (F.col("end") + 1).cast("double").alias("end"),
    )


def chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six equal chapters per user."""
    n = F.explode(F.sequence(F.lit(1), F.lit(6)))
    return (
        video(spark, sf_dir)
        .select("video_id", "duration", n.alias("number"))
        .select(
            "video_id",
            "number",
            ((F.col("number") - 1) * F.col("duration") / 6).alias("start"),
            (F.col("number") * F.col("duration") / 6).alias("end"),
            (F.col("number") * 3).alias("shots"),
        )
    )


def talk_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30-second chapters over each conversation."""
    last = segment(spark, sf_dir).groupBy("video_id").agg(F.max("end").alias("total"))
    n = F.explode(F.sequence(F.lit(1), F.ceil(F.col("total") / 30).cast("int")))
    return last.select("video_id", n.alias("number")).select(
        "video_id",
        "number",
        ((F.col("number") - 1) * 30.0).alias("start"),
        (F.col("number") * 30.0).alias("end"),
    )


CTES["clip"] = (
    ("label_sec",),
    "SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY s) AS INTEGER) AS idx, "
    'CAST(s AS DOUBLE) AS start, CAST(e + 1 AS DOUBLE) AS "end" FROM ('
    "SELECT video_id, min(sec) AS s, max(sec) AS e FROM ("
    "SELECT video_id, sec, sum(fresh) OVER (PARTITION BY video_id ORDER BY sec) AS island FROM ("
    "SELECT video_id, sec, CASE WHEN sec - lag(sec) OVER (PARTITION BY video_id ORDER BY sec) <= 2 THEN 0 ELSE 1 END AS fresh "
    "FROM (SELECT DISTINCT video_id, sec FROM label_sec WHERE label = 'error'))) GROUP BY video_id, island) WHERE e > s",
)
CTES["chapter"] = (
    ("video",),
    "SELECT video_id, number, (number - 1) * duration / 6.0::DOUBLE AS start, "
    'number * duration / 6.0::DOUBLE AS "end", number * 3 AS shots '
    "FROM (SELECT video_id, duration, CAST(unnest(range(1, 7)) AS INTEGER) AS number FROM video)",
)
CTES["talk_chapter"] = (
    ("segment",),
    "SELECT video_id, number, (number - 1) * 30.0::DOUBLE AS start, number * 30.0::DOUBLE AS \"end\" FROM ("
    "SELECT video_id, CAST(unnest(range(1, CAST(ceil(total / 30) AS BIGINT) + 1)) AS INTEGER) AS number FROM ("
    'SELECT video_id, max("end") AS total FROM segment GROUP BY video_id))',
)


# Fixed values of the stand-in weight table.
WEIGHTS = {
    "scene": 1.0,
    "motion_event": 2.0,
    "motion_peak": 3.0,
    "audio": 1.5,
    "burst": 4.0,
    "keyword": 2.5,
    "object": 1.0,
    "action": 6.0,
    "face": 2.0,
    "beginning": 0.5,
    "ending": 0.25,
}


def score_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of every signal; the point signals come from one pass over events."""
    from tidemark.operators import scoring
    from tidemark.operators.bursts import runs_above

    w = WEIGHTS
    k = ["video_id"]
    d = detection(spark, sf_dir)

    def sig(name):
        return F.struct(F.lit(name).alias("signal"), F.lit(w[name]).alias("weight"))

    kinds = (
        F.when(F.col("label") == "signup", F.array(sig("scene")))
        .when((F.col("label") == "click") & (F.col("conf") > 0.2), F.array(sig("motion_event"), sig("motion_peak")))
        .when(F.col("label") == "click", F.array(sig("motion_event")))
        .when((F.col("label") == "view") & (F.col("conf") > 0.1), F.array(sig("audio")))
    )
    points = d.select("video_id", "t", F.explode(kinds).alias("k")).select(
        "video_id", "t", F.col("k.signal").alias("signal"), F.col("k.weight").alias("weight")
    )
    objects = d.filter("label = 'view'").select(
        "video_id",
        F.lit("object").alias("signal"),
        "sec",
        F.lit(w["object"]).alias("points"),
        F.lit(True).alias("present"),
    )
    # only hours with events can be loud: the sparse curve has the same runs
    loud = tick_value(spark, sf_dir).withColumn("value", F.round("value", 2))
    bursts = runs_above(loud, k, value="value", threshold=150.0)
    keywords = d.filter("label = 'signup' AND conf > 0.3").select(
        "video_id", F.col("t").alias("start"), (F.col("t") + 1.5).alias("end")
    )
    faces = (
        reading(spark, sf_dir)
        .filter("label IN ('happy', 'surprise') AND conf >= 0.5")
        .select(
            "video_id",
            F.lit("face").alias("signal"),
            "sec",
            F.lit(w["face"]).alias("points"),
            F.lit(False).alias("present"),
        )
    )
    actions = d.filter("label IN ('purchase', 'error')")
    parts = [
        scoring.point_marks(points, k, t="t", signal="signal", weight="weight"),
        objects,
        scoring.span_marks(bursts, k, signal="burst", weight=w["burst"]),
        scoring.span_marks(keywords, k, signal="keyword", weight=w["keyword"]),
        faces,
        scoring.action_tiers(actions, k, sec="sec", label="label", conf="conf", weight=w["action"]),
        scoring.band_marks(
            video(spark, sf_dir), k, total="duration", head=12, tail=12,
            head_points=w["beginning"], tail_points=w["ending"],
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def score_sec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scored second inside the video, all signals."""
    from tidemark.operators.scoring import score_seconds

    s = score_seconds(score_marks(spark, sf_dir), ["video_id"])
    return s.join(video(spark, sf_dir), "video_id").filter("sec >= 0 AND sec < duration").drop("duration")


def _w(name: str) -> str:
    return f"{WEIGHTS[name]}::DOUBLE"


_POINTS = [
    ("scene", "label = 'signup'"),
    ("motion_event", "label = 'click'"),
    ("motion_peak", "label = 'click' AND conf > 0.2"),
    ("audio", "label = 'view' AND conf > 0.1"),
]
CTES["action_bars"] = (
    ("detection",),
    "SELECT video_id, label, quantile_cont(conf, 0.5) AS p50, quantile_cont(conf, 0.9) AS p90 "
    "FROM detection WHERE label IN ('purchase', 'error') GROUP BY video_id, label",
)
CTES["action_points"] = (
    ("detection", "action_bars"),
    "SELECT b.video_id, b.sec, CASE WHEN b.conf >= p90 THEN 1.5 WHEN b.conf >= p50 THEN 1.0 ELSE 0.5 END::DOUBLE "
    f"* {_w('action')} AS points FROM (SELECT video_id, sec, label, conf, row_number() OVER (PARTITION BY video_id, sec "
    "ORDER BY conf DESC, label DESC) AS rn FROM detection WHERE label IN ('purchase', 'error') AND conf > 0) b "
    "JOIN action_bars q ON b.video_id = q.video_id AND b.label = q.label WHERE rn = 1",
)
CTES["burst_run"] = (
    ("curve",),
    'SELECT video_id, min(sec) AS start, max(sec) + 1 AS "end", max(value) AS z FROM (SELECT *, sec - row_number() OVER '
    "(PARTITION BY video_id ORDER BY sec) AS k FROM curve WHERE value > 150) GROUP BY video_id, k",
)
CTES["score_marks"] = (
    ("detection", "burst_run", "action_points", "reading", "video"),
    " UNION ALL ".join(
        f"SELECT video_id, '{n}' AS signal, CAST(round_even(t, 0) AS INTEGER) AS sec, {_w(n)} AS points, FALSE AS present "
        f"FROM detection WHERE {c} UNION ALL SELECT video_id, '{n}', sec, 0.0, TRUE FROM detection WHERE {c}"
        for n, c in _POINTS
    )
    + f" UNION ALL SELECT video_id, 'object', sec, {_w('object')}, TRUE FROM detection WHERE label = 'view'"
    + f" UNION ALL SELECT DISTINCT video_id, 'burst', CAST(unnest(range(start, \"end\" + 1)) AS INTEGER), {_w('burst')}, TRUE FROM burst_run"
    + f" UNION ALL SELECT DISTINCT video_id, 'keyword', CAST(unnest(range(CAST(floor(t) AS BIGINT), CAST(floor(t + 1.5) AS BIGINT) + 1)) AS INTEGER), {_w('keyword')}, TRUE "
    "FROM detection WHERE label = 'signup' AND conf > 0.3"
    + f" UNION ALL SELECT video_id, 'face', sec, {_w('face')}, FALSE FROM reading WHERE label IN ('happy', 'surprise') AND conf >= 0.5"
    + " UNION ALL SELECT video_id, 'action', sec, points, TRUE FROM action_points"
    + f" UNION ALL SELECT video_id, 'beginning', CAST(unnest(range(least(12, duration))) AS INTEGER), {_w('beginning')}, FALSE FROM video"
    + f" UNION ALL SELECT video_id, 'ending', CAST(unnest(range(greatest(0, duration - 12), duration)) AS INTEGER), {_w('ending')}, FALSE FROM video",
)
_SIG = ["scene", "motion_event", "motion_peak", "audio", "burst", "keyword", "object", "action", "face", "beginning", "ending"]
_BOOST = ["motion_event", "motion_peak", "audio", "burst", "keyword", "object", "action"]
CTES["score_sec"] = (
    ("score_marks", "video"),
    "SELECT s.*, CASE WHEN n_signals >= 2 THEN raw * 1.2::DOUBLE ELSE raw END AS score FROM (SELECT *, "
    + " + ".join(_SIG)
    + " AS raw FROM (SELECT video_id, sec, "
    + ", ".join(f"sum(CASE WHEN signal = '{x}' THEN points ELSE 0.0 END) AS {x}" for x in _SIG)
    + ", count(DISTINCT CASE WHEN present AND signal IN ("
    + ", ".join(f"'{x}'" for x in _BOOST)
    + ") THEN signal END) AS n_signals FROM score_marks GROUP BY video_id, sec)) s JOIN video v ON s.video_id = v.video_id "
    "WHERE sec >= 0 AND sec < duration",
)


def ranked_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_sec with the best confidence of each second."""
    c = label_sec(spark, sf_dir).groupBy("video_id", "sec").agg(F.max("conf").alias("conf"))
    s = score_sec(spark, sf_dir).select("video_id", "sec", F.round("score", 6).alias("score"))
    return s.join(c, ["video_id", "sec"], "left").withColumn("conf", F.coalesce("conf", F.lit(0.0)))


def moment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate moments: runs of scored hours ranked by rounded density; 1-5 are kept."""
    from pyspark.sql import Window

    from tidemark.operators.islands import point_islands

    hot = score_sec(spark, sf_dir).filter("score > 0")
    runs = point_islands(hot, ["video_id"], "sec", 2, aggs={"score": ("sum", "score")})
    end = F.col("end") + 1
    dense = F.round(F.col("score") / F.greatest(F.lit(0.5), end - F.col("start")), 6)
    w = Window.partitionBy("video_id").orderBy(F.desc("density"), "start")
    return (
        runs.withColumn("density", dense)
        .withColumn("end", end.cast("double"))
        .withColumn("idx", F.row_number().over(w))
        .filter("idx <= 10")
        .select("video_id", "idx", F.col("start").cast("double").alias("start"), "end", F.round("score", 6).alias("score"))
    )


CTES["moment"] = (
    ("score_sec",),
    "SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY round(score / greatest(0.5, e - s), 6) DESC, s) AS INTEGER) AS idx, "
    'CAST(s AS DOUBLE) AS start, CAST(e AS DOUBLE) AS "end", round(score, 6) AS score FROM ('
    "SELECT video_id, min(sec) AS s, max(sec) + 1 AS e, sum(score) AS score FROM (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY sec) AS island FROM ("
    "SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY video_id ORDER BY sec) <= 2 THEN 0 ELSE 1 END AS fresh FROM score_sec WHERE score > 0)) GROUP BY video_id, island) "
    "QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY round(score / greatest(0.5, e - s), 6) DESC, s) <= 10",
)

"""Expression readings (A19-A24, J14, W8 episodes, W19, X4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.operators import readings as rd
from tidemark.plans.registry import query

K = ["video_id"]
# The nudge keeps an exact tie from being rounded differently by two engines.
R = lambda c, n=9: F.round(F.col(c) + 3e-11, n).alias(c)
MIX = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat(x["label"], F.lit(":"), x["n"].cast("string")))).alias("counts")

_VAL = ", r AS (SELECT *, CASE label WHEN 'happy' THEN 1.0 WHEN 'sad' THEN -1.0 WHEN 'anger' THEN -1.0 ELSE 0.0 END::DOUBLE * conf AS v FROM reading)"


def _mix_sql(src: str, keys: str) -> str:
    return (
        f"SELECT {keys}, sum(n)::BIGINT AS read_seconds, sum(sv) / sum(n) AS valence, arg_min(label, {{'n': -n, 'l': label}}) AS dominant, "
        f"string_agg(label || ':' || n, ',' ORDER BY label) AS counts FROM (SELECT {keys}, label, count(*) AS n, sum(v) AS sv FROM {src} GROUP BY {keys}, label) GROUP BY {keys}"
    )


_BUCKETS = (
    _VAL
    + ", rb AS (SELECT r.*, CAST(floor(sec / (duration / 12.0::DOUBLE)) AS INTEGER) AS bucket FROM r JOIN video w ON w.video_id = r.video_id), mb AS ("
    + _mix_sql("rb", "video_id, bucket")
    + "), b AS (SELECT g.video_id, g.bucket, bucket_start AS start, coalesce(read_seconds, 0) AS read_seconds, valence, dominant, counts FROM "
    "(SELECT video_id, duration, CAST(unnest(range(12)) AS INTEGER) AS bucket, bucket * duration / 12.0::DOUBLE AS bucket_start FROM video) g "
    "LEFT JOIN mb ON mb.video_id = g.video_id AND mb.bucket = g.bucket)"
)
VIEWS = fx.with_views("reading", "video")


def _buckets(spark, sf):
    return rd.bucketed(fx.reading(spark, sf), fx.video(spark, sf), K)


@query(
    "a19_reading_buckets",
    "A19 X4",
    VIEWS + _BUCKETS + " SELECT video_id, bucket, start, read_seconds, round(valence + 3e-11::DOUBLE, 9) AS valence, dominant, coalesce(counts, '') AS counts FROM b",
)
def reading_buckets(spark, sf):
    """Twelve equal spans with reads, mean valence, dominant label and counts."""
    return _buckets(spark, sf).select("video_id", "bucket", "start", "read_seconds", R("valence"), "dominant", MIX("counts"))


@query(
    "a20_arc",
    "A20",
    VIEWS
    + _BUCKETS
    + """, f AS (SELECT video_id, count(*) AS buckets_used, regr_slope(valence, bucket) AS s, regr_intercept(valence, bucket) AS i, coalesce(regr_r2(valence, bucket), 0.0) AS fit, min(bucket) AS a, max(bucket) AS z
      FROM b WHERE read_seconds >= 3 GROUP BY video_id), c AS (SELECT *, s * (z - a) AS change FROM f)
    SELECT video_id, buckets_used, CASE WHEN buckets_used < 3 THEN 'unknown' WHEN abs(change) < 0.20 THEN 'flat' WHEN change > 0 THEN 'toward positive' ELSE 'toward negative' END AS direction,
      CASE WHEN buckets_used >= 3 THEN round(change + 3e-11::DOUBLE, 9) END AS change, CASE WHEN buckets_used >= 3 THEN round(s * a + i + 3e-11::DOUBLE, 9) END AS start_valence,
      CASE WHEN buckets_used >= 3 THEN round(s * z + i + 3e-11::DOUBLE, 9) END AS end_valence, CASE WHEN buckets_used >= 3 THEN round(fit + 3e-11::DOUBLE, 9) END AS fit,
      buckets_used >= 3 AND abs(change) >= 0.20 AND fit >= 0.35 AS confident FROM c""",
)
def arc(spark, sf):
    """Trend of the readings over the video."""
    return rd.arc(_buckets(spark, sf), K).select(
        "video_id", "buckets_used", "direction", R("change"), R("start_valence"), R("end_valence"), R("fit"), "confident"
    )


@query(
    "a21_shift",
    "A21",
    VIEWS
    + _BUCKETS
    + """, u AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY bucket) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM b WHERE read_seconds >= 3),
    c AS (SELECT c.video_id, c.bucket, c.start, sum(o.valence * o.read_seconds) FILTER (o.i < c.i) / sum(o.read_seconds) FILTER (o.i < c.i) AS before,
      sum(o.valence * o.read_seconds) FILTER (o.i >= c.i) / sum(o.read_seconds) FILTER (o.i >= c.i) AS after
      FROM u c JOIN u o ON o.video_id = c.video_id WHERE c.i >= 2 AND c.i <= c.n - 2 GROUP BY c.video_id, c.bucket, c.start),
    k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(abs(after - before), 9) DESC, bucket) AS rn FROM c)
    SELECT video_id, start AS at, round(before + 3e-11::DOUBLE, 9) AS before, round(after + 3e-11::DOUBLE, 9) AS after, round(after - before + 3e-11::DOUBLE, 9) AS change,
      CASE WHEN after > before THEN 'toward positive' ELSE 'toward negative' END AS direction FROM k WHERE rn = 1 AND abs(after - before) >= 0.22""",
)
def shift(spark, sf):
    """The split point where the reading changes most."""
    return rd.shift(_buckets(spark, sf), K).select("video_id", "at", R("before"), R("after"), R("change"), "direction")


@query(
    "a22_dispersion",
    "A22",
    VIEWS
    + _BUCKETS
    + """, u AS (SELECT rb.video_id, rb.bucket, rb.label, round(count(*) * 100.0::DOUBLE / any_value(b.read_seconds), 1) AS share FROM rb JOIN b ON b.video_id = rb.video_id AND b.bucket = rb.bucket WHERE b.read_seconds >= 3 GROUP BY ALL),
    g AS (SELECT DISTINCT l.video_id, l.label, k.bucket FROM (SELECT DISTINCT video_id, label FROM u) l JOIN b k ON k.video_id = l.video_id AND k.read_seconds >= 3),
    s AS (SELECT g.video_id, g.label, coalesce(share, 0.0) AS share FROM g LEFT JOIN u ON u.video_id = g.video_id AND u.label = g.label AND u.bucket = g.bucket)
    SELECT video_id, label, round(stddev_pop(share) / avg(share) + 3e-11::DOUBLE, 9) AS cv, stddev_pop(share) / avg(share) < 0.35 AS uniform, max(share) AS peak_share_pct, min(share) AS low_share_pct, round(avg(share) + 3e-11::DOUBLE, 9) AS mean_share_pct
    FROM s GROUP BY video_id, label HAVING count(*) >= 3""",
)
def dispersion(spark, sf):
    """Whether a label clusters or is smeared over the video."""
    return rd.dispersion(fx.reading(spark, sf), fx.video(spark, sf), K).select(
        "video_id", "label", R("cv"), "uniform", "peak_share_pct", "low_share_pct", R("mean_share_pct")
    )


@query(
    "a23_reading_summary",
    "A23",
    VIEWS
    + _BUCKETS
    + """, u AS (SELECT rb.video_id, rb.bucket, rb.label, round(count(*) * 100.0::DOUBLE / any_value(b.read_seconds), 1) AS share FROM rb JOIN b ON b.video_id = rb.video_id AND b.bucket = rb.bucket WHERE b.read_seconds >= 3 GROUP BY ALL),
    g AS (SELECT DISTINCT l.video_id, l.label, k.bucket FROM (SELECT DISTINCT video_id, label FROM u) l JOIN b k ON k.video_id = l.video_id AND k.read_seconds >= 3),
    d AS (SELECT g.video_id, g.label, stddev_pop(coalesce(share, 0.0)) / avg(coalesce(share, 0.0)) AS cv FROM g LEFT JOIN u ON u.video_id = g.video_id AND u.label = g.label AND u.bucket = g.bucket GROUP BY g.video_id, g.label HAVING count(*) >= 3),
    m AS (SELECT video_id, count(*) AS n, avg(conf) AS mc, coalesce(avg(v) FILTER (v <> 0), 0.0) AS mv, avg(v) AS mall, count(*) FILTER (v > 0) AS p, count(*) FILTER (v < 0) AS q, count(*) FILTER (label = 'surprise') AS un FROM r GROUP BY video_id),
    l AS (SELECT video_id, sec, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY video_id ORDER BY sec) THEN 1 ELSE 0 END AS f FROM r),
    x AS (SELECT video_id, sec, sum(f) OVER (PARTITION BY video_id ORDER BY sec) AS run FROM l),
    y AS (SELECT video_id, count(*) AS runs, round(avg(len), 2) AS mean_run FROM (SELECT video_id, run, max(sec) - min(sec) + 1 AS len FROM x GROUP BY video_id, run) GROUP BY video_id),
    e AS (SELECT c.video_id, count(*) AS n FROM (SELECT video_id, label, count(*) AS n FROM r GROUP BY ALL) c JOIN m ON m.video_id = c.video_id JOIN d ON d.video_id = c.video_id AND d.label = c.label WHERE cv < 0.35 AND round(c.n * 100.0::DOUBLE / m.n, 1) >= 45 GROUP BY c.video_id),
    z AS (SELECT m.*, y.runs, y.mean_run, round(m.n * 100.0::DOUBLE / duration, 1) AS cov, coalesce(e.n, 0) AS even FROM m JOIN y ON y.video_id = m.video_id JOIN video w ON w.video_id = m.video_id LEFT JOIN e ON e.video_id = m.video_id),
    t AS (SELECT *, CASE WHEN cov < 35 THEN 1 ELSE 0 END + CASE WHEN mc < 0.6 THEN 1 ELSE 0 END + CASE WHEN mean_run > 0 AND mean_run < 2 THEN 1 ELSE 0 END + even AS reasons FROM z)
    SELECT video_id, n AS read_seconds, cov AS coverage_pct, round(mv + 3e-11::DOUBLE, 9) AS mean_valence, round(mall + 3e-11::DOUBLE, 9) AS mean_all_read, round(p * 100.0::DOUBLE / n + 3e-11::DOUBLE, 9) AS positive_pct, round(q * 100.0::DOUBLE / n + 3e-11::DOUBLE, 9) AS negative_pct,
      round(un * 100.0::DOUBLE / n + 3e-11::DOUBLE, 9) AS unvalenced_pct, runs, mean_run, CAST(reasons AS BIGINT) AS reasons, CASE WHEN reasons >= 2 THEN 'low' WHEN reasons >= 1 THEN 'moderate' ELSE 'unflagged' END AS reliability FROM t""",
)
def reading_summary(spark, sf):
    """Coverage, mix, stability and reliability."""
    s = rd.reading_summary(fx.reading(spark, sf), fx.video(spark, sf), K)
    return s.select(
        "video_id", "read_seconds", "coverage_pct", R("mean_valence"), R("mean_all_read"), R("positive_pct"),
        R("negative_pct"), R("unvalenced_pct"), "runs", "mean_run", "reasons", "reliability",
    )


@query(
    "w8_episodes",
    "W8 A23",
    fx.with_views("reading")
    + _VAL
    + """, s AS (SELECT *, CASE WHEN v > 0 THEN 1 ELSE -1 END AS sign FROM r WHERE v <> 0), l AS (SELECT *, lag(sign) OVER w AS ps, lag(sec) OVER w AS pt FROM s WINDOW w AS (PARTITION BY video_id ORDER BY sec)),
    g AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps <> sign OR sec - pt > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY sec) AS run FROM l),
    c AS (SELECT video_id, run, sign, label, count(*) AS n, sum(v) AS sv, min(sec) AS a, max(sec) AS z FROM g GROUP BY ALL)
    SELECT video_id, sign, CAST(min(a) AS DOUBLE) AS start, CAST(max(z) + 1 AS DOUBLE) AS "end", CAST(sum(n) AS BIGINT) AS read_seconds, round(sum(sv) / sum(n) + 3e-11::DOUBLE, 9) AS valence, arg_min(label, {'n': -n, 'l': label}) AS dominant
    FROM c GROUP BY video_id, run, sign HAVING max(z) + 1 - min(a) >= 8""",
)
def episodes(spark, sf):
    """Stretches that read one way."""
    return rd.episodes(fx.reading(spark, sf), K, min_seconds=8, gap=12).withColumn("valence", F.round(F.col("valence") + 3e-11, 9))


@query(
    "a24_span_readings",
    "A24",
    fx.with_views("reading", "chapter")
    + _VAL
    + ", i AS (SELECT r.*, number FROM r JOIN chapter h ON h.video_id = r.video_id AND r.sec >= h.start AND r.sec < h.\"end\"), m AS ("
    + _mix_sql("i", "video_id, number")
    + "), k AS (SELECT video_id, avg(v) AS base FROM r GROUP BY video_id) SELECT m.video_id, number, read_seconds, round(valence + 3e-11::DOUBLE, 9) AS valence, dominant, counts, round(valence - base + 3e-11::DOUBLE, 9) AS delta FROM m JOIN k ON k.video_id = m.video_id",
)
def span_readings(spark, sf):
    """A span's own reading against the video's mean."""
    s = rd.span_readings(fx.reading(spark, sf), fx.chapter(spark, sf), K, ident="number")
    return s.select("video_id", "number", "read_seconds", R("valence"), "dominant", MIX("counts"), R("delta"))


@query(
    "j14_class_readings",
    "J14",
    fx.with_views("reading", "label_sec")
    + _VAL
    + ", i AS (SELECT r.*, m.cls FROM r JOIN (SELECT DISTINCT video_id, sec, label AS cls FROM label_sec) m ON m.video_id = r.video_id AND m.sec = r.sec), m AS ("
    + _mix_sql("i", "video_id, cls")
    + "), k AS (SELECT video_id, avg(v) AS base FROM r GROUP BY video_id) SELECT m.video_id, cls AS class, read_seconds, round(valence + 3e-11::DOUBLE, 9) AS valence, dominant, counts, round(valence - base + 3e-11::DOUBLE, 9) AS delta, "
    "abs(valence - base) >= 0.15 AS distinguishable FROM m JOIN k ON k.video_id = m.video_id WHERE read_seconds >= 12",
)
def class_readings(spark, sf):
    """The reading while a class is on screen."""
    s = rd.class_readings(fx.reading(spark, sf), fx.label_sec(spark, sf), K, min_seconds=12)
    return s.select("video_id", "class", "read_seconds", R("valence"), "dominant", MIX("counts"), R("delta"), "distinguishable")


@query(
    "w19_reading_onset",
    "W19",
    fx.with_views("reading", "chapter")
    + """, hi AS (SELECT *, least(conf + 0.25, 1.0)::DOUBLE AS c2 FROM reading), n AS (SELECT video_id, arg_min(label, {'n': -n, 'l': label}) AS dom, max(n) * 100.0 / sum(n) >= 45 AS perv FROM (SELECT video_id, label, count(*) AS n FROM reading GROUP BY ALL) GROUP BY video_id),
    i AS (SELECT r.*, number FROM hi r JOIN chapter h ON h.video_id = r.video_id AND r.sec >= h.start AND r.sec < h."end"),
    l AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY video_id, number ORDER BY sec) THEN 1 ELSE 0 END AS f FROM i),
    g AS (SELECT *, sum(f) OVER (PARTITION BY video_id, number ORDER BY sec) AS run FROM l),
    u AS (SELECT g.video_id, number, run, label, min(sec) AS second, count(*) AS seconds, avg(c2) AS confidence FROM g GROUP BY ALL),
    k AS (SELECT u.*, row_number() OVER (PARTITION BY u.video_id, number ORDER BY round(confidence, 9) DESC, seconds DESC, second) AS rn FROM u JOIN n ON n.video_id = u.video_id WHERE label <> 'neutral' AND NOT (perv AND label = dom) AND seconds >= 2 AND confidence >= 0.6)
    SELECT k.video_id, number, second, label, round(confidence + 3e-11::DOUBLE, 9) AS confidence, seconds,
      coalesce((SELECT CASE WHEN p.label <> k.label THEN p.label END FROM reading p WHERE p.video_id = k.video_id AND p.sec = (SELECT max(q.sec) FROM reading q WHERE q.video_id = k.video_id AND q.sec < k.second) AND k.second - p.sec <= 4), '') AS from_label
    FROM k WHERE rn = 1""",
)
def reading_onset(spark, sf):
    """Where the clearest departing reading of a span began."""
    r = fx.reading(spark, sf).withColumn("conf", F.least(F.col("conf") + 0.25, F.lit(1.0)))
    o = rd.reading_onsets(r, fx.chapter(spark, sf), K, ident="number")
    return o.select("video_id", "number", "second", "label", R("confidence"), "seconds", "from_label")

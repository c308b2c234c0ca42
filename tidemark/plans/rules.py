"""Event rules in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.operators import rules as rl
from tidemark.plans.registry import query
from tidemark.sources import rules_table as rt

K = ["video_id"]

# The stand-in rule set: two spatial events, one gated by a signal, one signal-only.
RULES = rt.parse(
    {
        "events": [
            {"name": "pair_in_region", "rules": [{"source": "c1", "region": "c2"}], "window_secs": 2.0, "persist_secs": 2.0},
            {
                "name": "two_kinds_inside",
                "rules": [
                    {"source": "c1", "region": "c0", "min_count": 1},
                    {"source": "c3", "region": "c0", "min_count": 1, "max_count": 3},
                ],
                "signals": [{"signal": "level", "min": 0.2, "within_secs": 1}],
                "window_secs": 3.0,
                "persist_secs": 3.0,
                "min_duration_secs": 2.0,
            },
            {
                "name": "held_level",
                "signals": [{"signal": "level", "min": 0.3, "sustained_secs": 2}, {"signal": "kind", "any_of": ["even"], "within_secs": 1}],
                "ignore_start_secs": 1.0,
            },
            {"name": "off", "enabled": False, "rules": [{"source": "c0", "region": "c1"}]},
        ]
    }
)


def inputs(spark, sf):
    b = fx.box(spark, sf).withColumn("ts", F.col("frame").cast("double"))
    level = b.groupBy("video_id", F.col("frame").alias("sec")).agg(F.max("conf").alias("value"))
    signals = level.select("video_id", F.lit("level").alias("signal"), "sec", "value", F.lit(None).cast("string").alias("text"))
    kind = level.select(
        "video_id", F.lit("kind").alias("signal"), "sec", F.lit(None).cast("double").alias("value"), F.when(F.col("sec") % 4 == 0, "even").otherwise("odd").alias("text")
    )
    videos = b.groupBy("video_id").agg((F.max("frame") + 1).alias("duration"))
    return b, signals.unionByName(kind), videos


def _marked(spark, sf):
    b, s, v = inputs(spark, sf)
    return rl.apply_rules(b, s, v, K, RULES)


@query("r1_rule_events", "R1 A42 V2 S15")
def rule_events(spark, sf):
    """Every marked time with its confidence and box."""
    m = _marked(spark, sf)
    return m.select("video_id", "ts", "event", *[F.round(c, 6).alias(c) for c in ("conf", "x", "y", "w", "h")])


@query("r1_event_seconds", "R1")
def event_seconds(spark, sf):
    """Events per whole second."""
    return rl.event_seconds(_marked(spark, sf), K)


@query(
    "w11_signal_only_event",
    "W11 V2 R1",
    fx.with_views("box")
    + """, l AS (SELECT video_id, frame AS sec, max(conf) AS v FROM box GROUP BY ALL), d AS (SELECT video_id, max(frame) + 1 AS n FROM box GROUP BY ALL),
    h AS (SELECT *, sec - row_number() OVER (PARTITION BY video_id ORDER BY sec) AS k FROM l WHERE v >= 0.3), s AS (SELECT video_id, sec FROM (SELECT *, count(*) OVER (PARTITION BY video_id, k) AS c FROM h) WHERE c >= 2),
    e AS (SELECT DISTINCT l.video_id, l.sec + o AS sec FROM l JOIN d ON d.video_id = l.video_id, (SELECT unnest([-1, 0, 1]) AS o) WHERE l.sec % 4 = 0 AND l.sec + o BETWEEN 0 AND n - 1)
    SELECT s.video_id, s.sec::DOUBLE AS ts FROM s JOIN e ON e.video_id = s.video_id AND e.sec = s.sec WHERE s.sec >= 1""",
)
def signal_only_event(spark, sf):
    """A signal-only event: sustained level near a labelled second."""
    b, s, v = inputs(spark, sf)
    m = rl.apply_rules(b, s, v, K, [e for e in RULES if e.event == "held_level"])
    return m.select("video_id", "ts")


@query(
    "w16_majority_vote",
    "W16",
    fx.with_views("detection")
    + """, f AS (SELECT video_id, round_even(t * 1000, 0)::BIGINT AS ms, event_id, label = 'error' AS fired FROM detection), v AS (SELECT *, avg(CASE WHEN fired THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY video_id ORDER BY ms RANGE BETWEEN 12000 PRECEDING AND CURRENT ROW) AS share FROM f)
    SELECT video_id, ms, count(*) AS n FROM v WHERE share >= 0.5 GROUP BY ALL""",
)
def majority_vote(spark, sf):
    """Times whose trailing 12 hours fired at least half of the time."""
    d = fx.detection(spark, sf)
    nul = lambda c: F.lit(None).cast("double").alias(c)
    fired = d.select(
        "video_id", F.col("t").alias("ts"), F.lit("e").alias("event"), (F.col("label") == "error").alias("fired"),
        nul("conf"), nul("x"), nul("y"), nul("w"), nul("h"),
    )
    v = rl.majority_vote(fired, K, {"e": 12000}, chunk=96.0)
    return v.groupBy("video_id", F.rint(F.col("ts") * 1000).cast("long").alias("ms")).agg(F.count("*").alias("n"))


@query("u6_composed_labels", "U6 F6")
def composed_labels(spark, sf):
    """Detected and composed labels of each second after a re-run."""
    b = fx.box(spark, sf)
    labels = b.select("video_id", F.col("frame").alias("sec"), "label").distinct()
    stale = b.select("video_id", F.col("frame").alias("sec"), F.lit("off").alias("label")).distinct()
    ev = rl.event_seconds(_marked(spark, sf), K)
    c = rl.compose(labels.unionByName(stale), ev, K, [e.event for e in RULES])
    return c.select("video_id", "sec", F.array_join("labels", ",").alias("labels"))


_PROPOSED = [
    {"name": "good_rule", "rules": [{"source": "click", "region": "view"}]},
    {"name": "good_rule", "rules": [{"source": "click", "region": "ghost"}]},
    {"name": "Bad Name", "rules": [{"source": "error", "region": "view", "min_count": 3, "max_count": 1}]},
    {"name": "odd_bounds", "signals": [{"signal": "level", "min": 5, "max": 1}]},
]


@query(
    "j21_rule_validation",
    "J21 S15",
    fx.with_views("label_sec")
    + """, r AS (SELECT * FROM (VALUES ('good_rule','click'),('good_rule','view'),('good_rule','ghost'),('Bad Name','error'),('Bad Name','view')) t(event, label))
    SELECT event, 'class never observed: ' || label AS reason FROM r WHERE label NOT IN (SELECT label FROM label_sec)
    UNION ALL VALUES ('good_rule', 'duplicate name'), ('Bad Name', 'ill-formed name'), ('Bad Name', 'max_count below min_count'), ('odd_bounds', 'max below min')""",
)
def rule_validation(spark, sf):
    """Why proposed rules are refused against the classes seen."""
    rules = rt.table(spark, rt.parse(_PROPOSED))
    return rl.invalid_rules(rules, fx.label_sec(spark, sf).select("label").distinct())


@query(
    "j18_settled_checks",
    "J18",
    fx.with_views("label_sec", "video")
    + """, c AS (SELECT video_id, unnest(['error', 'signup', 'teleport']) AS rule FROM video), s AS (SELECT DISTINCT video_id, label, sec FROM label_sec WHERE label = 'error' OR sec < 24),
    f AS (SELECT video_id, label, count(*) AS seconds, min(sec) AS first, max(sec) AS last FROM s GROUP BY ALL)
    SELECT c.video_id, c.rule, CASE WHEN c.rule = 'teleport' THEN 'not_in_rules' WHEN f.seconds > 0 THEN 'fired' ELSE 'never_fired' END AS state, f.seconds, f.first, f.last FROM c LEFT JOIN f ON f.video_id = c.video_id AND f.label = c.rule""",
)
def settled_checks(spark, sf):
    """What became of each check added by an earlier run."""
    checks = fx.video(spark, sf).select(
        "video_id", F.explode(F.array(*[F.lit(x) for x in ("error", "signup", "teleport")])).alias("rule")
    )
    fired = (
        fx.label_sec(spark, sf)
        .filter("label = 'error' OR sec < 24")
        .select("video_id", F.col("label").alias("event"), "sec")
        .distinct()
    )
    return rl.settle_checks(checks, ["error", "signup", "click"], fired, K)

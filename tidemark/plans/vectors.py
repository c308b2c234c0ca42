"""Vectors, shots, chapters, identities, boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.functions import vectors as vx
from tidemark.operators import boxes as bx
from tidemark.operators import chapters as ch
from tidemark.operators import nearpairs, tracking
from tidemark.operators import vectors as vec
from tidemark.plans.registry import query

K = ["video_id"]
R = lambda c, n=6: F.round(c, n).alias(c)
EMB = fx.with_views("embedding")
# per-class mean vectors: the query and its negatives, and the gallery
_MEAN = """, dim AS (SELECT label, i, avg(vec[i]) AS m FROM embedding, (SELECT CAST(unnest(range(1, 65)) AS INTEGER) AS i) GROUP BY ALL),
    cent AS (SELECT label, list(m ORDER BY i) AS vec FROM dim GROUP BY label)"""


@query(
    "t12_vector_search",
    "T12 X6",
    EMB
    + _MEAN
    + """, q AS (SELECT vec AS p FROM cent WHERE label = 3), s AS (SELECT e.vec_id, list_cosine_similarity(e.vec, q.p) * 100 AS pos, list_transform((SELECT list(vec) FROM cent WHERE label IN (1, 2, 5)), lambda n: list_cosine_similarity(e.vec, n) * 100) AS neg FROM embedding e, q),
    m AS (SELECT *, greatest(pos, list_max(neg)) AS top FROM s), r AS (SELECT vec_id, round(exp(pos - top) / (exp(pos - top) + list_sum(list_transform(neg, lambda x: exp(x - top)))), 6) AS score FROM m)
    SELECT vec_id, score FROM r ORDER BY score DESC, vec_id LIMIT 20""",
)
def vector_search(spark, sf):
    """Twenty best frames for a class vector against three negatives."""
    e = fx.embedding(spark, sf)
    cent = vec.mean_vectors(e, ["label"])
    q = cent.agg(
        F.max(F.when(F.col("label") == 3, F.col("vec"))).alias("positive"),
        F.collect_list(F.when(F.col("label").isin(1, 2, 5), F.col("vec"))).alias("negatives"),
    )
    s = vec.score_frames(e, q).select("vec_id", R("score"))
    return vec.top_k(s, 20, "vec_id")


@query(
    "t12_cosine_search",
    "T12",
    EMB
    + _MEAN
    + """ SELECT e.vec_id, round((list_cosine_similarity(e.vec, c.vec) + 1) / 2, 6) AS score FROM embedding e, (SELECT vec FROM cent WHERE label = 7) c ORDER BY score DESC, vec_id LIMIT 20""",
)
def cosine_search(spark, sf):
    """Without negatives: cosine moved to [0, 1]."""
    e = fx.embedding(spark, sf)
    q = vec.mean_vectors(e.filter("label = 7"), ["label"]).select(
        F.col("vec").alias("positive"), F.array().cast("array<array<double>>").alias("negatives")
    )
    return vec.top_k(vec.score_frames(e, q).select("vec_id", R("score")), 20, "vec_id")


@query(
    "x6_vector_functions",
    "X6",
    EMB
    + """ SELECT vec_id, round(sqrt(list_sum(list_transform(vec, lambda x: x * x))), 6) AS norm, round(list_cosine_similarity(vec[1:32], vec[33:64]), 6) AS halves,
      round(exp(vec[1] - list_max(vec[1:4])) / list_sum(list_transform(vec[1:4], lambda x: exp(x - list_max(vec[1:4])))), 6) AS share FROM embedding""",
)
def vector_functions(spark, sf):
    v = F.col("vec")
    return fx.embedding(spark, sf).select(
        "vec_id",
        F.round(vx.norm(v), 6).alias("norm"),
        F.round(vx.cosine(F.slice(v, 1, 32), F.slice(v, 33, 32)), 6).alias("halves"),
        F.round(vx.softmax(F.slice(v, 1, 4))[0], 6).alias("share"),
    )


def _gallery(spark, sf):
    """Per class and video one mean vector: the class is the identity; 8 and 9 are watched."""
    g = vec.mean_vectors(fx.embedding(spark, sf), ["label", "video_id"])
    return g.select(
        F.concat(F.lit("id"), F.col("label")).alias("identity_id"),
        F.col("video_id").alias("seq"),
        "vec",
        (F.col("label") >= 8).alias("avoid"),
    )


@query(
    "j10_nearest_identity",
    "J10",
    EMB
    + """, dim AS (SELECT label, video_id, i, avg(vec[i]) AS m FROM embedding, (SELECT CAST(unnest(range(1, 65)) AS INTEGER) AS i) GROUP BY ALL),
    g AS (SELECT 'id' || label AS id, list(m ORDER BY i) AS vec FROM dim GROUP BY label, video_id),
    s AS (SELECT e.vec_id, g.id, max(round(list_cosine_similarity(e.vec, g.vec), 9)) AS sim FROM embedding e, g GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, id DESC) AS rn FROM s)
    SELECT vec_id, id AS best_id, round(sim, 6) AS similarity, CASE WHEN sim >= CASE WHEN id IN ('id8', 'id9') THEN 0.38 ELSE 0.5 END THEN id END AS identity FROM b WHERE rn = 1""",
)
def nearest_identity(spark, sf):
    """Best identity over its gallery, with a relaxed bar for watched ones."""
    n = vec.nearest_identity(
        fx.embedding(spark, sf), _gallery(spark, sf), ["vec_id"], threshold=0.5, watch_threshold=0.38
    )
    return n.select("vec_id", "best_id", R("similarity"), "identity")


@query(
    "j17_known_times",
    "J17",
    EMB
    + """, i AS (SELECT DISTINCT video_id, CAST(round_even(sec * 1.0 * 1000, 0) AS BIGINT) AS ts_ms FROM embedding WHERE label < 5), w AS (SELECT video_id, vec_id, sec + 0.0001::DOUBLE AS ts FROM embedding)
    SELECT w.video_id, w.vec_id, CAST(round_even(ts * 1000, 0) AS BIGINT) AS ts_ms, i.ts_ms IS NOT NULL AS known FROM w LEFT JOIN i ON i.video_id = w.video_id AND i.ts_ms = CAST(round_even(ts * 1000, 0) AS BIGINT)""",
)
def known_times(spark, sf):
    """Which wanted times an index already holds, at millisecond resolution."""
    e = fx.embedding(spark, sf)
    index = e.filter("label < 5").select("video_id", (F.col("sec") * 1000).cast("long").alias("ts_ms"))
    wanted = e.select("video_id", "vec_id", (F.col("sec") + 0.0001).alias("ts"))
    return vec.lookup(wanted, index, K).select("video_id", "vec_id", "ts_ms", "known")


@query(
    "u3_insert_if_absent",
    "U3 S14",
    EMB
    + """ SELECT video_id, ts_ms, count(*) AS copies FROM (SELECT video_id, sec * 500 AS ts_ms FROM embedding WHERE label < 5 UNION ALL
      (SELECT DISTINCT video_id, sec * 500 AS ts_ms FROM embedding WHERE label >= 3 EXCEPT SELECT video_id, sec * 500 FROM embedding WHERE label < 5)) GROUP BY ALL""",
)
def insert_if_absent(spark, sf):
    """A batch added to an index; keys it already holds stay as they are."""
    e = fx.embedding(spark, sf).withColumn("ts_ms", F.col("sec") * 500)
    index = e.filter("label < 5").select("video_id", "ts_ms", "vec")
    batch = e.filter("label >= 3").select("video_id", "ts_ms", "vec")
    grown = vec.insert_if_absent(index, batch, ["video_id", "ts_ms"])
    return grown.groupBy("video_id", "ts_ms").agg(F.count("*").alias("copies"))


def _shots(spark, sf):
    s = vec.mean_vectors(fx.embedding(spark, sf), ["video_id", "shot"])
    return s.withColumn("vec", vx.unit(F.col("vec"))).withColumn("start", F.col("shot") * 10.0)


_SHOT = """, dim AS (SELECT video_id, shot, i, avg(vec[i]) AS m FROM embedding, (SELECT CAST(unnest(range(1, 65)) AS INTEGER) AS i) GROUP BY ALL),
    raw AS (SELECT video_id, shot, list(m ORDER BY i) AS v FROM dim GROUP BY ALL), s AS (SELECT video_id, shot, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM raw)"""


@query(
    "a27_shot_signatures",
    "A27",
    EMB + _SHOT + " SELECT video_id, shot, round(v[1], 6) AS first, round(v[64], 6) AS last, round(list_sum(v), 6) AS total FROM s",
)
def shot_signatures(spark, sf):
    """Unit mean vector of each shot."""
    s = _shots(spark, sf)
    return s.select(
        "video_id",
        "shot",
        F.round(F.col("vec")[0], 6).alias("first"),
        F.round(F.col("vec")[63], 6).alias("last"),
        F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


_NOVELTY = _SHOT + """, e AS (SELECT video_id, shot, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM s),
    b AS (SELECT a.video_id, a.shot, e.i, sum(e.x) FILTER (e.shot < a.shot) AS p, sum(e.x) FILTER (e.shot >= a.shot) AS n FROM s a JOIN e ON e.video_id = a.video_id AND e.shot BETWEEN a.shot - 6 AND a.shot + 5 GROUP BY ALL),
    nv AS (SELECT video_id, shot, CASE WHEN count(p) = 0 THEN 0.0 ELSE 1 - sum(p * n) / (sqrt(sum(p * p)) * sqrt(sum(n * n))) END AS novelty FROM b GROUP BY ALL)"""


@query("w13_boundary_novelty", "W13", EMB + _NOVELTY + " SELECT video_id, shot, round(novelty, 6) AS novelty FROM nv")
def boundary_novelty(spark, sf):
    """How unlike the shots before and after each cut are."""
    n = vec.boundary_novelty(_shots(spark, sf), K)
    return n.select("video_id", "shot", R("novelty"))


def _videos(spark, sf):
    e = fx.embedding(spark, sf)
    return e.groupBy("video_id").agg((F.max("shot") * 10.0 + 10).alias("duration"))


@query("t8_chapters", "T8")
def chapters(spark, sf):
    """Chapters from boundary novelty: threshold, spacing, long runs split."""
    n = vec.boundary_novelty(_shots(spark, sf), K).drop("vec")
    v = _videos(spark, sf)
    cuts = ch.pick_boundaries(n, v, K, min_gap=15.0, max_run=40.0)
    return ch.chapters_from_cuts(cuts, n, n, v, K)


@query("t8_chapter_methods", "T8")
def chapter_methods(spark, sf):
    """Chapters by the method that each video's shots allow: whole, even marks or novelty."""
    s = _shots(spark, sf).filter(~((F.col("video_id") % 4 == 1) & (F.col("shot") > 2)))
    n = vec.boundary_novelty(s.filter(~((F.col("video_id") % 4 == 2) & (F.col("shot") > 2))), K).drop("vec")
    return ch.chapterize(s.select("video_id", "start"), n, _videos(spark, sf), K, min_gap=15.0, max_run=40.0)


@query("t8_chapters_by_count", "T8")
def chapters_by_count(spark, sf):
    """About four chapters, without splitting."""
    n = vec.boundary_novelty(_shots(spark, sf), K).drop("vec")
    v = _videos(spark, sf)
    cuts = ch.pick_boundaries(n, v, K, min_gap=15.0, max_run=0.0, target=4)
    return ch.chapters_from_cuts(cuts, n, n, v, K)


@query("t8_even_chapters", "T8")
def even_chapters(spark, sf):
    """The fallback: cuts nearest to even marks."""
    n = _shots(spark, sf).select("video_id", "start", F.lit(0.0).alias("novelty"))
    v = _videos(spark, sf)
    cuts = ch.even_boundaries(n, v, K, min_gap=10.0, max_run=40.0)
    return ch.chapters_from_cuts(cuts, n, n, v, K)


@query(
    "a30_track_vote",
    "A30",
    EMB
    + """, v AS (SELECT video_id, shot AS track, 'id' || label AS identity, count(*) AS n, min(sec) AS f FROM embedding WHERE label < 8 GROUP BY ALL), w AS (SELECT video_id, shot AS track, 'id' || label AS identity, count(*) AS n, min(sec) AS f FROM embedding WHERE label >= 8 GROUP BY ALL),
    a AS (SELECT video_id, track, identity FROM (SELECT *, row_number() OVER (PARTITION BY video_id, track ORDER BY n DESC, f) AS rn FROM v) WHERE rn = 1 AND n >= 2),
    b AS (SELECT video_id, track, identity FROM (SELECT *, row_number() OVER (PARTITION BY video_id, track ORDER BY n DESC, f) AS rn FROM w) WHERE rn = 1)
    SELECT coalesce(a.video_id, b.video_id) AS video_id, coalesce(a.track, b.track) AS track, coalesce(b.identity, a.identity) AS identity, b.identity IS NOT NULL AS forced FROM a FULL JOIN b ON a.video_id = b.video_id AND a.track = b.track""",
)
def track_vote(spark, sf):
    """Majority identity of a track, overridden by a watch-list hit."""
    e = fx.embedding(spark, sf).select(
        "video_id", F.col("shot").alias("track"), F.concat(F.lit("id"), F.col("label")).alias("identity"), F.col("sec").alias("frame"), "label"
    )
    return vec.track_identities(e.filter("label < 8"), e.filter("label >= 8"), K, min_votes=2)


@query("r3_identity_assignment", "R3")
def identity_assignment(spark, sf):
    """Faces matched to an identity of their video, or opening a new one."""
    a = vec.assign_identities(
        fx.embedding(spark, sf), K, order="sec", threshold=0.35, max_gallery=20, novelty_max=0.7
    )
    return a.withColumn("similarity", F.round("similarity", 6))


@query("r3_merged_identities", "R3")
def merged_identities(spark, sf):
    """Identities of all videos joined where faces of theirs are near each other."""
    e = fx.embedding(spark, sf)
    a = vec.assign_identities(e, K, order="sec", threshold=0.35, max_gallery=20)
    name = F.concat_ws("-", F.format_string("%06d", "video_id"), F.format_string("%04d", "identity"))
    faces = a.join(e.select("video_id", "sec", "vec"), ["video_id", "sec"]).select(name.alias("id"), "vec")
    return vec.merged_ids(nearpairs.near_edges(faces, least=0.4))


@query(
    "r3_near_identities",
    "R3",
    """WITH RECURSIVE f AS (SELECT printf('%06d-%02d', vec_id // 100, (vec_id % 100) // 10) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM f a JOIN f b ON list_cosine_similarity(a.v, b.v) >= 0.45),
    r AS (SELECT a AS id, b AS reached FROM p UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.reached),
    m AS (SELECT id, min(reached) AS merged_id, count(DISTINCT reached) AS n FROM r GROUP BY id)
    SELECT id, merged_id FROM m WHERE n > 1""",
)
def near_identities(spark, sf):
    """Shots of all videos joined where faces of theirs are near each other."""
    name = F.format_string("%06d-%02d", "video_id", "shot")
    return vec.merged_ids(nearpairs.near_edges(fx.embedding(spark, sf).select(name.alias("id"), "vec"), least=0.45))


BOX = fx.with_views("box")
_IN = "s.x + s.w / 2 >= r.x AND s.x + s.w / 2 <= r.x + r.w AND s.y + s.h / 2 >= r.y AND s.y + s.h / 2 <= r.y + r.h"


@query(
    "j8_contained_boxes",
    "J8",
    BOX
    + f" SELECT s.video_id, s.frame, s.idx FROM box s WHERE s.label = 'c1' AND EXISTS (SELECT 1 FROM box r WHERE r.label = 'c2' AND r.video_id = s.video_id AND r.frame = s.frame AND {_IN})",
)
def contained_boxes(spark, sf):
    """Boxes of one class centred inside a box of another in the same frame."""
    c = bx.contained_sources(fx.box(spark, sf), ["video_id", "frame"], source="c1", region="c2")
    return c.select("video_id", "frame", "idx")


@query(
    "j8_face_of_person",
    "J8",
    BOX
    + f""", c AS (SELECT r.video_id, r.frame, r.idx, s.idx AS face_idx, s.conf AS face_score, row_number() OVER (PARTITION BY r.video_id, r.frame, r.idx ORDER BY s.conf DESC, s.idx) AS rn
      FROM box r JOIN box s ON s.video_id = r.video_id AND s.frame = r.frame AND r.label = 'c0' AND s.label <> 'c0' AND {_IN}) SELECT video_id, frame, idx, face_idx, face_score FROM c WHERE rn = 1""",
)
def face_of_person(spark, sf):
    """Highest-scoring face centred inside each person box."""
    b = fx.box(spark, sf)
    f = bx.best_face_per_box(b.filter("label = 'c0'"), b.filter("label <> 'c0'"), ["video_id", "frame"])
    return f.select("video_id", "frame", "idx", "face_idx", "face_score")


@query("j9_merged_boxes", "J9 X5")
def merged_boxes(spark, sf):
    """Overlapping boxes of a frame merged into their union."""
    b = fx.box(spark, sf).withColumn("corner", F.col("x") < 0.3)
    m = bx.merge_boxes(b, ["video_id", "frame"], threshold=0.3)
    return m.select("video_id", "frame", "box", R("x1"), R("y1"), R("x2"), R("y2"), "corner", "merged")


@query(
    "x5_pair_overlap",
    "X5",
    BOX
    + """, p AS (SELECT a.video_id, a.frame, a.idx AS a, b.idx AS b, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h AS s, b.w * b.h AS t,
        a.x + a.w / 2 BETWEEN b.x AND b.x + b.w AND a.y + a.h / 2 BETWEEN b.y AND b.y + b.h AS inside
      FROM box a JOIN box b ON a.video_id = b.video_id AND a.frame = b.frame AND a.idx < b.idx) SELECT video_id, frame, a, b, round(CASE WHEN s + t - i > 0 THEN i / (s + t - i) ELSE 0.0 END, 6) AS iou, round(s, 9) AS area, inside FROM p""",
)
def pair_overlap(spark, sf):
    """Every two boxes of a frame: IoU, the first one's area and whether its centre is in the second."""
    row = F.struct("idx", "x", "y", "w", "h")
    f = fx.box(spark, sf).groupBy("video_id", "frame").agg(F.array_sort(F.collect_list(row)).alias("s"))
    after = F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    p = f.select("video_id", "frame", F.inline(F.flatten(after)))
    return p.select(
        "video_id", "frame", F.col("a.idx").alias("a"), F.col("b.idx").alias("b"), F.round(vx.iou(F.col("a"), F.col("b")), 6).alias("iou"),
        F.round(vx.area(F.col("a")), 9).alias("area"), vx.centre_inside(F.col("a"), F.col("b")).alias("inside"),
    )


@query("r2_tracks", "R2")
def tracks(spark, sf):
    """Track ids over the frames of each video."""
    return tracking.track_boxes(fx.box(spark, sf), K, threshold=0.3, max_lost=3)


@query("r2_stream_tracks", "R2")
def stream_tracks(spark, sf):
    """The same track ids from a stream of boxes, each video closed by an end row."""
    from tidemark.streaming import engine
    from tidemark.streaming import rules as stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", engine.ROCKSDB)
    raw = spark.readStream.schema("vec_id BIGINT, embedding ARRAY<FLOAT>, label INT").parquet(f"{sf}/embedding*.parquet")
    rows = stream.box_rows(fx.box_columns(raw).withColumn("ts", F.col("frame").cast("double")))
    ends = fx.box(spark, sf).groupBy("video_id").agg((F.max("frame") + 1).alias("duration"), F.count("*").alias("rows"))
    folder = engine.shared_folder(spark, "ends")
    stream.end_rows(ends).write.parquet(folder)
    rows = rows.unionByName(spark.readStream.schema(rows.schema).parquet(folder))
    t = engine.run_available(stream.track_stream(rows, threshold=0.3, max_lost=3), "tracks")
    return t.select("video_id", "frame", "idx", "track")


@query("w17_synchrony", "W17 R2")
def synchrony(spark, sf):
    """How alike the first two tracks of a video move."""
    b = fx.box(spark, sf)
    t = tracking.track_boxes(b, K, threshold=0.3, max_lost=3)
    s = bx.synchrony(b.join(t, ["video_id", "frame", "idx"]), K, frame="frame")
    return s.withColumn("synchrony", F.round("synchrony", 6))


@query(
    "w15_moving_average",
    "W15",
    BOX
    + " SELECT video_id, idx, frame, round(avg(x) OVER w, 6) AS x, round(avg(y) OVER w, 6) AS y FROM box WINDOW w AS (PARTITION BY video_id, idx ORDER BY frame ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)",
)
def moving_average(spark, sf):
    """Trailing mean of tracked coordinates."""
    m = bx.moving_average(fx.box(spark, sf), ["video_id", "idx"], order="frame", columns=["x", "y"], window=3)
    return m.select("video_id", "idx", "frame", R("x"), R("y"))


@query(
    "w15_gap_fill",
    "W15",
    BOX
    + """, a AS (SELECT video_id, idx, frame * 3 AS frame, x, CASE WHEN label = 'c2' THEN NULL ELSE y END AS y, label = 'c3' AS occ FROM box), n AS (SELECT *, lead(frame) OVER w AS nf, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(occ) OVER w AS nocc FROM a WINDOW w AS (PARTITION BY video_id, idx ORDER BY frame)),
    f AS (SELECT *, CAST(unnest(range(frame + 1, nf)) AS INTEGER) AS k FROM n WHERE nf - frame > 1 AND NOT occ AND NOT nocc)
    SELECT video_id, idx, k AS frame, round(x + (k - frame) / (nf - frame) * (nx - x), 6) AS x, round(coalesce(y + (k - frame) / (nf - frame) * (ny - y), y, ny), 6) AS y FROM f""",
)
def gap_fill(spark, sf):
    """Frames between anchors interpolated; occluded anchors are skipped."""
    a = fx.box(spark, sf).select(
        "video_id", "idx", (F.col("frame") * 3).alias("frame"), "x", F.when(F.col("label") != "c2", F.col("y")).alias("y"), (F.col("label") == "c3").alias("occluded")
    )
    g = bx.fill_between(a, ["video_id", "idx"], frame="frame", columns=["x", "y"])
    return g.select("video_id", "idx", "frame", R("x"), R("y"))


@query(
    "w22_median_smoothing",
    "W22",
    BOX
    + """ SELECT video_id, idx, frame, round(CASE WHEN count(*) OVER w >= 3 THEN quantile_cont(x, 0.5) OVER w ELSE x END, 6) AS x, round(CASE WHEN count(*) OVER w >= 3 THEN quantile_cont(w, 0.5) OVER w ELSE w END, 6) AS w
      FROM box WINDOW w AS (PARTITION BY video_id, idx ORDER BY frame ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""",
)
def median_smoothing(spark, sf):
    """Trailing median of box coordinates."""
    m = bx.median_smoothing(fx.box(spark, sf), ["video_id", "idx"], order="frame", columns=["x", "w"], window=8)
    return m.select("video_id", "idx", "frame", R("x"), R("w"))


@query(
    "t16_even_sampling",
    "T16",
    EMB
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY sec) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM embedding), p AS (SELECT CAST(unnest(range(16)) AS INTEGER) AS position)
    SELECT video_id, sec, position FROM n JOIN p ON floor(position * ((n - 1) / 15.0::DOUBLE)) = i""",
)
def even_sampling(spark, sf):
    """Sixteen positions evenly spread over each video."""
    from tidemark.operators.sampling import even_sample

    return even_sample(fx.embedding(spark, sf), K, order="sec", length=16).select("video_id", "sec", "position")


@query(
    "t16_strided_sampling",
    "T16",
    EMB
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY sec) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM embedding) SELECT video_id, sec FROM n WHERE i % greatest(3, least(8, n // 16)) = 0 AND i < greatest(3, least(8, n // 16)) * 8""",
)
def strided_sampling(spark, sf):
    """The first eight frames at a stride that depends on the video's length."""
    from tidemark.operators.sampling import strided_sample

    return strided_sample(fx.embedding(spark, sf), K, order="sec", length=8).select("video_id", "sec")

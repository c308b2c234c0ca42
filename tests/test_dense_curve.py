"""The dense curve, its ranks and rolling medians: spread over tasks, few rows moved, exact."""

import io
import math
import statistics
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from tidemark.operators import curves
from tidemark.operators.axis import dense_axis, dense_curve


def _plan(df):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain()
    return text.getvalue()


def test_axis_of_videos_placed_by_key_is_dealt_out(spark):
    videos = spark.range(40).select((F.col("id") % 10).alias("v")).groupBy("v").agg(F.lit(500).alias("n"))
    axis = dense_axis(videos, ["v"], "n").withColumn("p", F.spark_partition_id())
    row = axis.agg(F.count("*").alias("rows"), F.count_distinct("p").alias("tasks")).first()
    assert row.rows == 5000 and row.tasks > 1


def test_one_long_axis_is_dealt_out_by_chunk(spark):
    videos = spark.createDataFrame([(1, 100_000)], "v long, n int")
    axis = dense_axis(videos, ["v"], "n").withColumn("p", F.spark_partition_id())
    row = axis.agg(F.count_distinct("sec").alias("rows"), F.max("sec").alias("last"), F.count_distinct("p").alias("tasks")).first()
    assert (row.rows, row.last) == (100_000, 99_999) and row.tasks > 1


def test_dense_curve_on_odd_points(spark):
    videos = spark.createDataFrame([(1, 10), (2, 3), (3, 0), (4, None), (None, 2)], "v long, n int")
    points = [(1, 0, 1.0), (1, 4, 2.0), (1, 4, 0.5), (1, 3, None), (1, 10, 9.0), (1, -1, 9.0), (1, None, 9.0), (1, 9, 7.0), (2, 99, 1.0), (3, 0, 1.0), (None, 0, 5.0), (8, 0, 1.0)]
    dense = dense_curve(spark.createDataFrame(points, "v long, sec int, x double"), videos, ["v"], "n", value="x", width=4)
    got = sorted(((r.v, r.sec, r.x) for r in dense.collect()), key=str)
    want = [(1, s, {0: 1.0, 4: 2.5, 9: 7.0}.get(s)) for s in range(10)] + [(2, s, None) for s in range(3)] + [(None, s, None) for s in range(2)]
    assert got == sorted(want, key=str)


def test_dense_curve_moves_points_and_not_the_axis(spark):
    from tidemark import fixtures as fx

    plan = _plan(fx.curve(spark, "/root/testdata/sf0.001"))
    assert "Join" not in plan
    # nothing is shuffled after the empty ticks are made
    assert "Exchange" not in plan[: plan.index("Generate explode(sequence((_before")]


def test_rank_and_midrank_read_the_counts_once(spark):
    rows = [("a", s, float(s % 3)) for s in range(9000)] + [("b", s, 0.0) for s in range(5)]
    df = spark.createDataFrame(rows, "v string, sec int, x double").repartition(3)
    got = {(r.v, r.sec): (r.o, r.m) for r in curves.ordinal_rank(df, ["v"], value="x", out="o", middle="m").collect()}
    for v in "ab":
        mine = sorted((x, s) for k, s, x in rows if k == v)
        n = len(mine)
        for at, (x, s) in enumerate(mine):
            below, upto = sum(y < x for y, _ in mine) if v == "b" else int(x) * 3000, sum(y <= x for y, _ in mine) if v == "b" else (int(x) + 1) * 3000
            assert math.isclose(got[v, s][0], 100.0 * at / (n - 1))
            assert math.isclose(got[v, s][1], round((below + upto) / 2 / n * 100, 1), abs_tol=1e-9)


def test_medians_of_frames_half_full_of_one_value(spark):
    """Frames with exactly half, or a value more, of equal values; missing values; many groups in a batch."""
    rows = []
    for v in range(60):
        for s in range(40):
            x = 0.0 if (s * 7 + v) % 4 < 2 else float((s * 13 + v * 5) % 11)
            rows.append((v, s, None if v == 7 and s % 3 else x))
    df = spark.createDataFrame(rows, "v int, sec int, x double")
    got = {(r.v, r.sec): r for r in curves.rolling_baseline(df, ["v"], value="x", half=3, chunk=8).collect()}
    assert len(got) == len(rows)
    for v, s, _ in rows:
        frame = [x for k, t, x in rows if k == v and abs(t - s) <= 3 and x is not None]
        middle = statistics.median(frame)
        assert got[v, s].baseline == middle
        assert math.isclose(got[v, s].spread, 1.4826 * statistics.median([abs(x - middle) for x in frame]))


def test_rolling_medians_do_not_go_through_pandas_groups(spark):
    df = spark.createDataFrame([(1, 0, 1.0)], "v int, sec int, x double")
    assert "FlatMapGroupsInPandas" not in _plan(curves.rolling_baseline(df, ["v"], value="x"))


def test_windows_of_asked_lengths_are_joined_by_chunk(spark):
    """Maxima of windows over chunk edges; the wide table of maxima is not dealt out anew by key alone."""
    values = [float((s * 37) % 101) if s % 5 == 0 else 0.0 for s in range(9000)]
    series = spark.createDataFrame([(1, s, x) for s, x in enumerate(values)], "v long, sec int, x double")
    lengths = spark.createDataFrame([(1, 3, 9000), (1, 12, 9000), (1, 8999, 9000)], "v long, _k int, _n int")
    made = curves.stretch_maxima(series, ["v"], lengths, value="x")
    got = {(r["_k"], r["_start"]): r["_max"] for r in made.collect()}
    assert len(got) == 8998 + 8989 + 2
    for k, step in ((3, 1), (12, 1), (8999, 1)):
        for s in range(0, 9000 - k + 1, step):
            assert got[k, s] == max(values[s : s + k])
    assert "_chunk" in next(line for line in _plan(made).splitlines() if "Join" in line)

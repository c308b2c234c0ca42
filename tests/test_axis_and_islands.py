"""Chunked operators must give the same answer as a plain loop, whatever the chunk."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import axis, islands, joins


def clusters(spark, times, **kw):
    df = spark.createDataFrame([(1, float(t)) for t in times], "v INT, t DOUBLE")
    out = islands.pad_clusters(islands.point_islands(df, ["v"], "t", 2.0, **kw))
    return sorted((r.start, r.end) for r in out.collect())


def test_cluster_literals(spark):
    assert clusters(spark, [10, 11, 12]) == [(9.5, 12.5)]
    assert clusters(spark, [10, 15]) == [(9.0, 11.0), (14.0, 16.0)]
    assert clusters(spark, [12, 10, 11]) == [(9.5, 12.5)]
    assert clusters(spark, [0.2]) == [(0.0, 1.2)]


def test_seconds_merge_literals(spark):
    def merged(secs):
        df = spark.createDataFrame([(1, s) for s in secs], "v INT, s INT")
        out = islands.point_islands(df, ["v"], "s", 2)
        return sorted((r.start, r.end + 1) for r in out.collect())

    assert merged([7]) == [(7, 8)]
    assert merged([1, 3]) == [(1, 4)]
    assert merged([1, 4]) == [(1, 2), (4, 5)]


@pytest.mark.parametrize("chunk", [3, 10, 1000])
@pytest.mark.parametrize("strict", [False, True])
def test_point_islands_by_loop(spark, chunk, strict):
    rnd = random.Random(chunk)
    data = [(v, round(rnd.uniform(0, 100), 1)) for v in range(3) for _ in range(60)]
    df = spark.createDataFrame(data, "v INT, t DOUBLE")
    out = islands.point_islands(
        df, ["v"], "t", 1.5, strict=strict, aggs={"n": ("count", "t"), "s": ("sum", "t"), "m": ("set", F.floor("t"))}, chunk=chunk
    )
    got = sorted((r.v, r.start, r.end, r.n, round(r.s, 4), tuple(sorted(r.m))) for r in out.collect())
    want = []
    for v in range(3):
        ts = sorted(t for u, t in data if u == v)
        run = [ts[0]]
        for t in ts[1:] + [None]:
            if t is not None and (t - run[-1] < 1.5 if strict else t - run[-1] <= 1.5):
                run.append(t)
                continue
            want.append((v, run[0], run[-1], len(run), round(sum(run), 4), tuple(sorted({int(x) for x in run}))))
            run = [t]
    assert got == sorted(want)


@pytest.mark.parametrize("chunk", [4, 17, 500])
@pytest.mark.parametrize("gap", [0.0, 1.5])
def test_interval_islands_by_loop(spark, chunk, gap):
    rnd = random.Random(int(chunk + gap))
    data = []
    for v in range(3):
        for _ in range(25):
            a = rnd.randint(0, 150)
            data.append((v, float(a), float(a + rnd.choice([0, 1, 2, 5, 30])), 1.0))
    df = spark.createDataFrame(data, "v INT, start DOUBLE, end DOUBLE, score DOUBLE")
    out = islands.interval_islands(df, ["v"], gap=gap, aggs={"score": ("sum", "score"), "n": ("count", "score")}, chunk=chunk)
    got = sorted((r.v, r.start, r.end, r.score, r.n) for r in out.collect())
    want = []
    for v in range(3):
        cur = None
        for _, a, b, s in sorted(x for x in data if x[0] == v):
            if cur and a <= cur[2] + gap:
                cur = (v, cur[1], max(cur[2], b), cur[3] + s, cur[4] + 1)
            else:
                if cur:
                    want.append(cur)
                cur = (v, a, b, s, 1)
        want.append(cur)
    assert got == sorted(want)


def test_difference_by_loop(spark):
    rnd = random.Random(5)
    spans = [(v, i, float(a := rnd.randint(0, 80)), float(a + rnd.randint(1, 20))) for v in range(3) for i in range(8)]
    cuts = [(v, float(a := rnd.randint(0, 90)), a + rnd.choice([0.3, 1.0, 4.0])) for v in range(3) for _ in range(12)]
    s = spark.createDataFrame(spans, "v INT, idx INT, start DOUBLE, end DOUBLE")
    c = spark.createDataFrame(cuts, "v INT, start DOUBLE, end DOUBLE")
    out = islands.subtract_intervals(s, c, ["v"], ["idx"], bin_width=7)
    got = sorted((r.v, r.idx, round(r.start, 6), round(r.end, 6)) for r in out.collect())
    want = []
    for v, i, a, b in spans:
        left = [(a, b)]
        for u, x, y in cuts:
            if u == v:
                left = [q for p in left for q in ((p[0], min(p[1], x)), (max(p[0], y), p[1])) if q[1] > q[0]]
        want += [(v, i, round(p, 6), round(q, 6)) for p, q in left if q - p >= 0.5]
    assert got == sorted(set(want))


@pytest.mark.parametrize("width", [5, 64])
def test_two_level_windows(spark, width):
    rnd = random.Random(width)
    data = [(v, t, rnd.choice([None, float(rnd.randint(1, 9))])) for v in range(2) for t in sorted(rnd.sample(range(120), 50))]
    df = spark.createDataFrame(data, "v INT, t INT, x DOUBLE")
    total = axis.prefix_sum(df.fillna({"x": 0.0}), ["v"], ["t"], "x", "c", "t", width)
    last = axis.fill_forward(df, ["v"], ["t"], "x", "f", "t", width)
    near = axis.neighbour(df, ["v"], ["t"], F.col("t"), "n", "t", step=1, width=width)
    for v in range(2):
        mine = [(t, x) for u, t, x in data if u == v]
        acc, seen = 0.0, None
        want_sum, want_last = {}, {}
        for t, x in mine:
            acc += x or 0.0
            seen = x if x is not None else seen
            want_sum[t], want_last[t] = acc, seen
        assert {r.t: r.c for r in total.filter(f"v={v}").collect()} == want_sum
        assert {r.t: r.f for r in last.filter(f"v={v}").collect()} == want_last
        ts = [t for t, _ in mine]
        assert {r.t: r.n for r in near.filter(f"v={v}").collect()} == dict(zip(ts, ts[1:] + [None]))


def test_halo_covers_bounded_frames(spark):
    from tidemark.operators.curves import bounded_frames

    df = spark.createDataFrame([(1, i, float(i * 7 % 11)) for i in range(100)], "v INT, sec INT, x DOUBLE")
    whole = bounded_frames(df, ["v"], {"m": (F.max("x"), -4, 3)}, chunk=1000)
    small = bounded_frames(df, ["v"], {"m": (F.max("x"), -4, 3)}, chunk=9)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, small.collect()))


@pytest.mark.parametrize("bin_width", [3.0, 50.0])
def test_overlap_pairs_has_each_pair_once(spark, bin_width):
    rnd = random.Random(3)
    left = [(i % 2, i, float(a := rnd.randint(0, 60)), float(a + rnd.randint(1, 25))) for i in range(30)]
    right = [(i % 2, i, float(a := rnd.randint(0, 60)), float(a + rnd.randint(1, 25))) for i in range(30)]
    a = spark.createDataFrame(left, "v INT, i INT, start DOUBLE, end DOUBLE")
    b = spark.createDataFrame(right, "v INT, j INT, r_start DOUBLE, r_end DOUBLE")
    got = sorted((r.i, r.j) for r in joins.overlap_pairs(a, b, ["v"], bin_width=bin_width).collect())
    assert got == sorted((i, j) for v, i, s, e in left for u, j, x, y in right if u == v and s < y and e > x)


def test_nearest_gap_and_asof(spark):
    rnd = random.Random(8)
    left = [(v, i, rnd.uniform(0, 50)) for v in range(3) for i in range(15)]
    right = [(v, rnd.uniform(0, 50)) for v in range(2) for _ in range(6)]
    a = spark.createDataFrame(left, "v INT, i INT, t DOUBLE")
    b = spark.createDataFrame(right, "v INT, o DOUBLE")
    got = {(r.v, r.i): r.gap for r in joins.nearest_gap(a, b, ["v"], t="t", other="o", chunk=6).collect()}
    for v, i, t in left:
        gaps = [abs(t - o) for u, o in right if u == v]
        assert (got[v, i] is None) == (not gaps)
        if gaps:
            assert got[v, i] == pytest.approx(min(gaps))
    back = joins.asof_backward(a, b, ["v"], t="t", right_t="o", value="o", out="h", tolerance=5.0, chunk=6).collect()
    for r in back:
        prior = [o for u, o in right if u == r.v and o <= r.t]
        want = max(prior) if prior and r.t - max(prior) <= 5.0 else None
        assert (r.h.v if r.h else None) == want


def test_edge_guard_literal(spark):
    from tidemark.operators.bursts import group_events

    runs = spark.createDataFrame(
        [(1, float(p), float(p + 1), p, 2.0, 3600.0) for p in (10, 600, 3590)],
        "v INT, start DOUBLE, end DOUBLE, peak_sec INT, z DOUBLE, total DOUBLE",
    )
    assert [r.peak_sec for r in group_events(runs, ["v"], total="total").collect()] == [600]


def test_checkpoint_folder_is_the_sessions(spark, tmp_path):
    from tidemark.session import cut_lineage

    df = cut_lineage(spark.range(5))
    assert df.count() == 5
    assert spark.sparkContext.getCheckpointDir() is not None


def test_interval_union_keeps_customers_without_dates_as_its_sql_does(spark, tmp_path):
    import duckdb

    from tidemark.plans import load_all

    day = "DATE'1995-01-01'"
    orders = [(1, 10, 0), (2, 10, None), (3, 20, None), (4, 20, None), (5, None, 7), (6, 30, 4000), (7, 30, None)]
    lines = [(1, 1, 5), (1, 2, 9), (2, 1, None), (3, 1, None), (3, 2, None), (4, 1, None), (5, 1, None), (6, 1, 4300), (7, 1, 4310), (7, None, 4400), (6, -3, 4500)]
    o = spark.createDataFrame(orders, "o_orderkey LONG, o_custkey LONG, d INT")
    li = spark.createDataFrame(lines, "l_orderkey LONG, l_linenumber INT, d INT")
    o.selectExpr("o_orderkey", "o_custkey", f"cast(date_add({day}, d) as timestamp_ntz) as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    li.selectExpr(
        "l_orderkey", "l_linenumber", "1L as l_partkey", f"cast(date_add({day}, d) as timestamp_ntz) as l_shipdate", "1.0D as l_quantity"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    q = load_all()["u1_interval_union"]
    got = q.run(spark, str(tmp_path)).select("video_id", "start", "end").collect()
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(q.sql).fetchall()
    assert (20, None, None) in want
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)

"""Ranks among stretches of any length against sliding windows."""

import random

from tidemark.operators import curves


def plain(series, length, mine):
    k = max(1, min(length, len(series)))
    tops = [max(series[i : i + k]) for i in range(len(series) - k + 1)]
    tops = [t for t in tops if t > 0]
    if not tops:
        return 0.0, 0
    rank = (sum(t < mine for t in tops) + sum(t <= mine for t in tops)) / 2 / len(tops) * 100
    return round(rank, 1), max(1, round(len(tops) / max(1, length)))


def test_every_length(spark):
    rnd = random.Random(4)
    series = {v: [0.0 if rnd.random() < p else round(rnd.uniform(0, 9), 1) for _ in range(n)] for v, n, p in ((1, 300, 0.3), (2, 41, 0.9), (3, 7, 0.0), (4, 20, 1.1))}
    asked = []
    for v, s in series.items():
        for i, k in enumerate([0, 1, 2, 3, 4, 5, 7, 8, 9, 16, 31, 33, 64, 250, 500]):
            at = rnd.randrange(len(s))
            asked.append((v, i, k, max(s[at : at + max(k, 1)])))
        asked.append((v, 99, 4, 3.14159))  # no window's own maximum
    points = spark.createDataFrame([(v, t, x) for v, s in series.items() for t, x in enumerate(s)], "v INT, sec INT, value DOUBLE")
    a = spark.createDataFrame(asked, "v INT, idx INT, length INT, mine DOUBLE")
    got = {(r.v, r.idx): (r.percentile, r.stretches) for r in curves.rank_among_stretches(points, ["v"], a, value="value", length="length", mine="mine").collect()}
    assert len(got) == len(asked)
    for v, i, k, mine in asked:
        p, n = plain(series[v], k, mine)
        assert abs(got[v, i][0] - p) <= 0.1 + 1e-9 and got[v, i][1] == n, (v, i, k)
    none = curves.rank_among_stretches(points, ["v"], a.limit(0), value="value", length="length", mine="mine")
    assert none.collect() == []

"""Spans that share time with any range, against a plain loop; no pairs, no bins."""

import io
import random
from contextlib import redirect_stdout

from tidemark.operators.compare import overlapping_any


def test_long_spans_and_ranges_like_a_plain_loop(spark):
    rnd = random.Random(5)

    def some(n, longest):
        out = [(rnd.choice([1, 2, 3, None]), i, float(rnd.randrange(20_000)), rnd.randrange(longest)) for i in range(n)]
        return [(k, i, a, a + w) for k, i, a, w in out]

    # touching edges, empty spans, a span over several chunks of the axis, missing edges
    spans = some(300, 50) + [(1, 900, 10.0, 19_000.0), (2, 901, 5.0, 5.0), (3, 902, None, 7.0), (3, 903, 7.0, None), (4, 904, 0.0, 10.0), (5, 905, 1.0, 6.0), (5, 906, 20.0, 30.0)]
    ranges = some(40, 400) + [(5, 0, 6.0, 20.0), (4, 0, 3.0, 3.0), (1, 0, 4096.0, 8192.0)]
    kind = "k long, i long, start double, end double"
    got = overlapping_any(spark.createDataFrame(spans, kind), spark.createDataFrame(ranges, kind), ["k"])
    want = {
        s for s in spans
        if s[0] is not None and None not in s[2:] and any(r[0] == s[0] and r[3] > r[2] and s[2] < r[3] and s[3] > r[2] for r in ranges)
    }
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_a_span_is_not_copied_into_bins(spark):
    kind = "k long, i long, start double, end double"
    spans = spark.createDataFrame([(1, 1, 0.0, 1e6)], kind)
    text = io.StringIO()
    with redirect_stdout(text):
        overlapping_any(spans, spans.filter("i < 0"), ["k"]).explain()
    assert "_bin" not in text.getvalue()

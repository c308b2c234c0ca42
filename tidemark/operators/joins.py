"""Interval, containment and as-of joins with a time-bin equi key.

A pure range predicate inside an entity would be a nested loop over the
entity's rows. Every join here therefore explodes both sides into the bins they
touch and joins on ``(keys, bin)``; a pair that shares several bins is kept once,
in the first bin both sides touch, so no distinct is needed afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.axis import chunk_of, fill_forward


def _bins(df: DataFrame, lo: Column, hi: Column, width: float, tag: str) -> DataFrame:
    first = chunk_of(lo, width)
    return df.withColumn(f"_b{tag}", first).withColumn(
        "_bin", F.explode(F.sequence(first, F.greatest(first, chunk_of(hi, width))))
    )


def overlap_pairs(
    left_df: DataFrame,
    right_df: DataFrame,
    keys: Sequence[str],
    *,
    left: tuple[str, str] = ("start", "end"),
    right: tuple[str, str] = ("r_start", "r_end"),
    bin_width: float = 60.0,
    how: str = "inner",
    touching: bool = False,
    slack: float = 0.0,
) -> DataFrame:
    """Pairs of intervals that share time (``touching`` also takes a common edge).

    *slack* widens the left interval on both sides. ``how`` may be ``inner`` or
    ``left``; for ``left`` unmatched left rows come back once with NULLs, which
    needs the left rows to be distinct.
    """
    ls, le = F.col(left[0]) - slack, F.col(left[1]) + slack
    rs, re = F.col(right[0]), F.col(right[1])
    a = _bins(left_df.select("*", ls.alias("_ls"), le.alias("_le")), F.col("_ls"), F.col("_le"), bin_width, "l")
    b = _bins(right_df, rs, re, bin_width, "r")
    meets = (F.col("_ls") <= re) & (F.col("_le") >= rs) if touching else (F.col("_ls") < re) & (F.col("_le") > rs)
    joined = a.join(b, [*keys, "_bin"]).filter(
        meets & (F.col("_bin") == F.greatest("_bl", "_br"))
    )
    pairs = joined.drop("_bin", "_bl", "_br", "_ls", "_le")
    if how == "inner":
        return pairs
    extra = [c for c in right_df.columns if c not in keys]
    matched = pairs.select(*left_df.columns).distinct()
    lonely = left_df.join(matched, left_df.columns, "left_anti")
    for c in extra:
        lonely = lonely.withColumn(c, F.lit(None).cast(right_df.schema[c].dataType))
    return pairs.select(*left_df.columns, *extra).unionByName(lonely.select(*left_df.columns, *extra))


def points_in_spans(
    points: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    *,
    t: str,
    start: str = "start",
    end: str = "end",
    bin_width: float = 60.0,
    closed_end: bool = False,
) -> DataFrame:
    """Points inside ``[start, end)`` (or ``[start, end]``) of a span.

    A point lives in exactly one bin, so only the spans are exploded.
    """
    a = points.withColumn("_bin", chunk_of(t, bin_width))
    b = _bins(spans, F.col(start), F.col(end), bin_width, "r").drop("_br")
    inside = (F.col(t) >= F.col(start)) & (
        F.col(t) <= F.col(end) if closed_end else F.col(t) < F.col(end)
    )
    return a.join(b, [*keys, "_bin"]).filter(inside).drop("_bin")


def nearest_gap(
    left_df: DataFrame,
    right_df: DataFrame,
    keys: Sequence[str],
    *,
    t: str,
    other: str,
    out: str = "gap",
    chunk: float = 4096,
) -> DataFrame:
    """Distance from each left row to the nearest right time, NULL without any.

    No pairs are formed: both sides are laid on one axis and the previous and the
    next right time are carried along it, chunk by chunk.
    """
    rights = right_df.select(*keys, F.col(other).cast("double").alias("_t")).distinct()
    both = left_df.withColumn("_t", F.col(t).cast("double")).withColumn("_left", F.lit(True))
    both = both.unionByName(
        rights.withColumn("_left", F.lit(False)), allowMissingColumns=True
    ).withColumn("_chunk", chunk_of("_t", chunk))
    mark = F.when(~F.col("_left"), F.col("_t"))
    inner = Window.partitionBy(*keys, "_chunk").orderBy("_t")
    local = both.withColumn(
        "_p", F.max(mark).over(inner.rangeBetween(Window.unboundedPreceding, 0))
    ).withColumn("_n", F.min(mark).over(inner.rangeBetween(0, Window.unboundedFollowing)))
    ends = both.groupBy(*keys, "_chunk").agg(F.min(mark).alias("_lo"), F.max(mark).alias("_hi"))
    outer = Window.partitionBy(*keys).orderBy("_chunk")
    far = ends.select(
        *keys,
        "_chunk",
        F.max("_hi").over(outer.rowsBetween(Window.unboundedPreceding, -1)).alias("_fp"),
        F.min("_lo").over(outer.rowsBetween(1, Window.unboundedFollowing)).alias("_fn"),
    )
    prev, nxt = F.coalesce("_p", "_fp"), F.coalesce("_n", "_fn")
    return (
        local.filter("_left")
        .join(far, [*keys, "_chunk"])
        .withColumn(out, F.least(F.col("_t") - prev, nxt - F.col("_t")))
        .select(*left_df.columns, out)
    )


def near_semi(
    left_df: DataFrame,
    right_df: DataFrame,
    keys: Sequence[str],
    *,
    t: str,
    other: str,
    within: float,
) -> DataFrame:
    """Left rows with some right time no further than *within* away."""
    gap = nearest_gap(left_df, right_df, keys, t=t, other=other, out="_gap")
    return gap.filter(F.col("_gap") <= within).drop("_gap")


def asof_backward(
    left_df: DataFrame,
    right_df: DataFrame,
    keys: Sequence[str],
    *,
    t: str,
    right_t: str,
    value: str,
    out: str,
    tolerance: float | None = None,
    chunk: float = 4096,
) -> DataFrame:
    """The latest right row at or before each left row, as a struct ``out``.

    Union of both sides, last non-null carried forward chunk by chunk.
    """
    payload = F.struct(F.col(right_t).cast("double").alias("t"), F.col(value).alias("v"))
    lefts = left_df.select(
        "*",
        F.col(t).cast("double").alias("_t"),
        F.lit(1).alias("_side"),
        F.lit(None).cast(right_df.select(payload.alias("p")).schema["p"].dataType).alias("_pay_asof"),
    )
    rights = right_df.select(
        *keys, F.col(right_t).cast("double").alias("_t"), F.lit(0).alias("_side"), payload.alias("_pay_asof")
    )
    both = lefts.unionByName(rights, allowMissingColumns=True)
    filled = fill_forward(both, keys, ["_t", "_side"], "_pay_asof", out, "_t", chunk)
    rows = filled.filter(F.col("_side") == 1)
    if tolerance is not None:
        rows = rows.withColumn(
            out, F.when(F.col("_t") - F.col(f"{out}.t") <= tolerance, F.col(out))
        )
    return rows.drop("_t", "_side", "_pay_asof")

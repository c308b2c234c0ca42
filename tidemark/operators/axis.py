"""Work along a time axis without putting a whole entity into one task.

``chunk`` cuts the axis into fixed-width pieces; window functions then run on
``(keys, chunk)``. Three ways to get the exact whole-axis answer back:

* :func:`with_halo` copies the rows near a chunk edge into the neighbouring
  chunk, so a bounded frame (rolling median, centred count, lag by n ticks)
  sees everything it needs;
* :func:`prefix_sum` adds the total of the earlier chunks, one row per chunk;
* :func:`fill_forward` brings the last value of the earlier chunks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import shuffle_width

DEFAULT_CHUNK = 4096


def chunk_of(col: Column | str, width: float = DEFAULT_CHUNK) -> Column:
    """Index of the axis chunk a time falls in."""
    return F.floor(F.col(col) / width if isinstance(col, str) else col / width).cast("long")


def dense_axis(videos: DataFrame, keys: Sequence[str], length: str, tick: str = "sec", width: int = DEFAULT_CHUNK) -> DataFrame:
    """One row per whole tick in ``[0, length)``; *videos* has one row per entity.

    The few bytes of *videos* would be coalesced into one task, and everything up to
    the next shuffle would then run there on the expanded axis; they are therefore
    dealt out by key and chunk first, to a fixed number of partitions. (Dealt by key
    alone they would not be moved where they are already placed by key.)
    """
    dealt = _axis_chunks(videos, keys, length, tick, width).repartition(shuffle_width(videos), *keys, "_chunk")
    ticks = F.sequence((F.col("_chunk") * width).cast("int"), F.col(tick))
    return dealt.select(*keys, F.explode(ticks).alias(tick))


def _axis_chunks(videos: DataFrame, keys: Sequence[str], length: str, tick: str, width: int) -> DataFrame:
    """(*keys*, ``_chunk``, *tick*): the last tick of every chunk of every axis."""
    last = F.col(length).cast("int") - 1
    chunks = videos.filter(last >= 0).select(*keys, last.alias(tick), F.explode(F.sequence(F.lit(0).cast("long"), chunk_of(last, width))).alias("_chunk"))
    return chunks.withColumn(tick, F.least(F.col(tick), ((F.col("_chunk") + 1) * width - 1).cast("int")))


def dense_curve(
    points: DataFrame,
    videos: DataFrame,
    keys: Sequence[str],
    length: str,
    *,
    value: str,
    tick: str = "sec",
    width: int = DEFAULT_CHUNK,
) -> DataFrame:
    """The dense axis with the sum of the points' *value* at each tick, missing where there is none.

    Only points and one row per chunk are shuffled. The empty ticks before a point are
    made beside it, so the expanded axis is neither joined nor moved. Points off the axis
    or without a key go.
    """
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]) & (F.col(tick) >= 0)
    ends = _axis_chunks(videos, keys, length, tick, width)
    kind = points.schema[value].dataType
    marked = points.filter(present).select(*keys, chunk_of(tick, width).alias("_chunk"), F.col(tick).cast("int").alias(tick), value, F.lit(False).alias("_end"))
    marked = marked.unionByName(ends.select(*keys, "_chunk", tick, F.lit(None).cast(kind).alias(value), F.lit(True).alias("_end")))
    folded = marked.groupBy(*keys, "_chunk", tick).agg(F.sum(value).alias(value), F.max("_end").alias("_end"))
    w = chunk_window(keys, tick)
    before = F.coalesce(F.lag(tick).over(w), (F.col("_chunk") * width - 1).cast("int"))
    end = F.max(F.when(F.col("_end"), F.col(tick))).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    placed = folded.withColumn("_before", before).withColumn("_end", end).filter(F.col(tick) <= F.col("_end"))
    at = F.explode(F.sequence(F.col("_before") + 1, F.col(tick))).alias("_at")
    filled = placed.select(*keys, F.col(tick).alias("_tick"), F.col(value).alias("_value"), at)
    return filled.select(*keys, F.col("_at").alias(tick), F.when(F.col("_at") == F.col("_tick"), F.col("_value")).alias(value))


def with_halo(
    df: DataFrame, tick: str, before: float, after: float, width: float = DEFAULT_CHUNK
) -> DataFrame:
    """Add ``_chunk``/``_own``; rows within a halo of an edge appear in both chunks.

    A frame that looks *before* ticks back and *after* ticks ahead, computed
    over ``(keys, _chunk)``, is exact on the rows where ``_own`` is true.
    """
    home = chunk_of(tick, width)
    lo = chunk_of(F.col(tick) - F.lit(after), width)
    hi = chunk_of(F.col(tick) + F.lit(before), width)
    return (
        df.withColumn("_home", home)
        .withColumn("_chunk", F.explode(F.sequence(lo, hi)))
        .withColumn("_own", F.col("_chunk") == F.col("_home"))
        .drop("_home")
    )


def chunk_window(keys: Sequence[str], *order: str | Column):
    """Window over one entity's chunk, as prepared by :func:`with_halo`."""
    return Window.partitionBy(*keys, "_chunk").orderBy(*order)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_own", "_chunk")


def prefix_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    value: str,
    out: str,
    tick: str,
    width: float = DEFAULT_CHUNK,
) -> DataFrame:
    """Inclusive running sum of *value* per entity, two-level.

    *order* must begin with *tick*. Only one row per chunk is ordered per entity.
    """
    local = df.withColumn("_chunk", chunk_of(tick, width))
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    local = local.withColumn(out, F.sum(value).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    totals = local.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_total"))
    outer = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_chunk", F.coalesce(F.sum("_total").over(outer), F.lit(0)).alias("_before")
    )
    return (
        local.join(offsets, [*keys, "_chunk"])
        .withColumn(out, F.col(out) + F.col("_before"))
        .drop("_chunk", "_before")
    )


def fill_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    value: str,
    out: str,
    tick: str,
    width: float = DEFAULT_CHUNK,
) -> DataFrame:
    """Last non-null *value* at or before each row (an as-of carry), two-level."""
    local = df.withColumn("_chunk", chunk_of(tick, width))
    inner = (
        Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    local = local.withColumn(out, F.last(value, ignorenulls=True).over(inner))
    ends = local.groupBy(*keys, "_chunk").agg(
        F.max_by(out, F.struct(*[o for o in order])).alias("_end")
    )
    outer = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *keys, "_chunk", F.last("_end", ignorenulls=True).over(outer).alias("_carry")
    )
    return (
        local.join(carried, [*keys, "_chunk"])
        .withColumn(out, F.coalesce(out, "_carry"))
        .drop("_chunk", "_carry")
    )


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    payload: Column,
    out: str,
    tick: str,
    *,
    step: int = -1,
    width: float = DEFAULT_CHUNK,
) -> DataFrame:
    """The previous (``step=-1``) or next (``step=1``) row's *payload*, two-level.

    ``lag``/``lead`` inside the chunk; the row at a chunk edge takes the edge row
    of the nearest non-empty chunk. *order* must be unique and begin with *tick*.
    """
    placed = df.withColumn("_chunk", chunk_of(tick, width)).withColumn("_pay", payload)
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    move = F.lag if step < 0 else F.lead
    local = placed.withColumn("_near", move("_pay").over(inner))
    pick = F.max_by if step < 0 else F.min_by
    ends = placed.groupBy(*keys, "_chunk").agg(pick("_pay", F.struct(*order)).alias("_end"))
    outer = Window.partitionBy(*keys).orderBy("_chunk")
    far = ends.select(*keys, "_chunk", move("_end").over(outer).alias("_far"))
    return (
        local.join(far, [*keys, "_chunk"])
        .withColumn(out, F.coalesce("_near", "_far"))
        .drop("_chunk", "_pay", "_near", "_far")
    )


def run_ids(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    payload: Column,
    is_new,
    out: str,
    tick: str,
    *,
    width: float = DEFAULT_CHUNK,
) -> DataFrame:
    """Number consecutive rows; a new run starts where ``is_new(previous)`` holds.

    *is_new* receives the previous row's *payload* column and returns a boolean
    column; the first row of an entity always starts a run. Rows without a key or
    a tick belong to no run and go.

    One pass over the chunks: each counts the runs that start inside it and keeps
    its last payload. A chunk's first row is then judged against the last payload
    of the chunk before it, over one row a chunk, which also carries the count. Both
    uses read the same shuffle: neither side gets a filter of its own.
    """
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in (*keys, tick)])
    chunk = F.coalesce(chunk_of(tick, width), F.lit(0).cast("long"))
    placed = df.filter(present).withColumn("_chunk", chunk).withColumn("_pay", payload)
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    whole = inner.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def starts(previous: Column) -> Column:
        return previous.isNull() | is_new(previous)

    local = placed.withColumn("_prev", F.lag("_pay").over(inner)).withColumn("_at", F.row_number().over(inner))
    local = local.withColumn("_fresh", F.when((F.col("_at") > 1) & starts(F.col("_prev")), 1).otherwise(0)).drop("_prev")
    local = (
        local.withColumn("_n", F.sum("_fresh").over(upto))
        .withColumn("_total", F.sum("_fresh").over(whole))
        .withColumn("_last", F.last("_pay").over(whole))
        .drop("_fresh", "_pay")
    )
    outer = Window.partitionBy(*keys).orderBy("_chunk")
    heads = local.filter("_at = 1").withColumn("_prev", F.lag("_last").over(outer))
    heads = heads.withColumn("_open", F.when(starts(F.col("_prev")), 1).otherwise(0))
    before = F.sum("_open").over(outer.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(
        F.sum("_total").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = heads.select(*keys, "_chunk", before.alias("_before"))
    return (
        local.join(offsets, [*keys, "_chunk"])
        .withColumn(out, F.col("_n") + F.col("_before"))
        .drop("_chunk", "_at", "_n", "_total", "_last", "_before")
    )

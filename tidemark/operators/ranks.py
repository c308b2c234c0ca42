"""Exact order statistics and ranks of entities of any size, without ordering an entity in one task.

Rows are first counted per distinct value. Approximate quantiles of the distinct values cut an
entity's value axis into parts of about equal size; running counts are made inside a part and
over the parts' totals. All that is ordered at once is one part, or one row per part. Tables
with a row per entity are joined by merging: as broadcasts they would all lie in the driver's
memory, and there are as many rows as entities.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: Parts of an entity's value axis.
PARTS = 64


def value_counts(df: DataFrame, keys: Sequence[str], value: str, write: bool = False) -> DataFrame:
    """(*keys*, *value*, ``_n``, ``_upto``, ``_total``) per distinct value: rows with it, rows up to it, all rows.

    Missing values are left out. The counts are read three times; with *write* they are
    written once to the shared folder, for a *df* that is dear to make.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    counts = cut_lineage(counts) if write else counts
    shares = [i / PARTS for i in range(1, PARTS)]
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, shares, 10_000).alias("_cuts"), F.sum("_n").alias("_total"))
    part = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    placed = counts.join(cuts.hint("merge"), [*keys]).withColumn("_part", part).drop("_cuts")
    inner = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy(*keys, "_part").agg(F.sum("_n").alias("_all")).select(*keys, "_part", F.coalesce(F.sum("_all").over(outer), F.lit(0)).alias("_before"))
    local = placed.withColumn("_upto", F.sum("_n").over(inner))
    return local.join(before.hint("merge"), [*keys, "_part"]).select(*keys, value, "_n", (F.col("_upto") + F.col("_before")).alias("_upto"), "_total")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(*keys*, ``samples`` and a column per name): exact quantiles with linear interpolation."""
    ranked = value_counts(df, keys, value)

    def at(share: float, up: bool):
        place = F.lit(share) * (F.col("_total") - 1)
        return F.min(F.when(F.col("_upto") > (F.ceil(place) if up else F.floor(place)), F.col(value)))

    found = ranked.groupBy(*keys).agg(
        F.max("_total").alias("samples"), *[at(q, False).alias(f"_lo_{n}") for n, q in shares.items()], *[at(q, True).alias(f"_hi_{n}") for n, q in shares.items()]
    )

    def between(name: str, share: float):
        place = F.lit(share) * (F.col("samples") - 1)
        step = place - F.floor(place)
        return ((1 - step) * F.col(f"_lo_{name}") + step * F.col(f"_hi_{name}")).alias(name)

    return found.select(*keys, "samples", *[between(n, q) for n, q in shares.items()])


def median_and_deviation(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(*keys*, ``samples``, ``median``, ``deviation``): median and median absolute deviation."""
    middle = quantiles(df, keys, value, {"median": 0.5})
    away = df.select(*keys, value).join(middle.hint("merge"), [*keys]).select(*keys, F.abs(F.col(value) - F.col("median")).alias("_away"))
    spread = quantiles(away, keys, "_away", {"deviation": 0.5}).drop("samples")
    return middle.join(spread.hint("merge"), [*keys])

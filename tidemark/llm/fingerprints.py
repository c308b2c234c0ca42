"""Document fingerprints: a homomorphic multiset hash, with column functions only.

A text is a multiset of paragraphs (its lines). Each paragraph is hashed to a wide vector
and the vectors are added, so paragraphs may come in any order, and a paragraph is
inserted or deleted by adding or subtracting its vector:

* ``exact``: 16 lanes modulo 2**32, random for each paragraph, for equality;
* ``lanes``: packed counters modulo 2**20. A paragraph's vector here is itself a sum over
  its blocks of four words, each of which adds 0 or 1 to each lane by the bits of its
  hash. Centred, two such sums correlate as the shared blocks do, which gives a likeness.

Null counts as the empty text, which has one empty paragraph and no blocks. Texts with the
same paragraphs in another order have equal fingerprints, by design. Row-wise expressions:
any other column, repeated rows, ties and empty tables are no special case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT_HASHES = 8
WORD32 = 0xFFFFFFFF
#: Three counters of 20 bits in a long, at bits 0, 20 and 40.
FIELDS, FIELD_BITS = 3, 20
SHIFTS = 20
MASK = sum(1 << (FIELD_BITS * f) for f in range(FIELDS))
HASHES = 2
BLOCK = r"[^\s]+(?:[^\S\n]+[^\s]+){0,3}"


def _zero(n: int) -> Column:
    return F.array_repeat(F.lit(0).cast("long"), n)


def _exact(text: Column) -> Column:
    def hashes(p: Column) -> Column:
        return F.flatten(
            F.array(*[F.array(h.bitwiseAND(WORD32), F.shiftrightunsigned(h, 32)) for h in (F.xxhash64(F.lit(i), p) for i in range(EXACT_HASHES))])
        )

    vectors = F.transform(F.split(text, "\n", -1), hashes)
    return F.aggregate(vectors, _zero(2 * EXACT_HASHES), lambda acc, v: F.zip_with(acc, v, lambda a, b: (a + b).bitwiseAND(WORD32)))


def _lanes(text: Column) -> Column:
    """The packed counters, and the number of blocks as the last entry."""
    shifts = F.array(*[F.lit(s) for s in range(SHIFTS)] * HASHES)
    blocks = F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0))
    coded = F.transform(blocks, lambda b: F.struct(F.xxhash64(F.lit(101), b).alias("a"), F.xxhash64(F.lit(202), b).alias("b")))

    def add(acc: Column, h: Column) -> Column:
        bits = F.concat(F.array_repeat(h["a"], SHIFTS), F.array_repeat(h["b"], SHIFTS))
        return F.zip_with(acc, F.zip_with(bits, shifts, lambda x, s: F.call_function("shiftrightunsigned", x, s).bitwiseAND(F.lit(MASK).cast("long"))), lambda p, q: p + q)

    return F.concat(F.aggregate(coded, _zero(SHIFTS * HASHES), add), F.array(F.size(blocks).cast("long")))


def fingerprint(text: Column) -> Column:
    """struct(exact, lanes) of a text."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(_exact(text).alias("exact"), _lanes(text).alias("lanes"))


def added(a: Column, b: Column) -> Column:
    """The fingerprint of both multisets together."""
    return F.struct(
        F.zip_with(a["exact"], b["exact"], lambda x, y: (x + y).bitwiseAND(WORD32)).alias("exact"),
        F.zip_with(a["lanes"], b["lanes"], lambda x, y: x + y).alias("lanes"),
    )


def removed(a: Column, b: Column) -> Column:
    """The fingerprint of *a* without the paragraphs of *b*, which it must hold."""
    return F.struct(
        F.zip_with(a["exact"], b["exact"], lambda x, y: (x - y).bitwiseAND(WORD32)).alias("exact"),
        F.zip_with(a["lanes"], b["lanes"], lambda x, y: x - y).alias("lanes"),
    )


def as_text(fp: Column) -> Column:
    """Hex digits: 8 for each exact lane, 16 for each packed counter."""
    hexed = lambda width: lambda v: F.lpad(F.hex(v), width, "0")
    return F.lower(F.concat(F.array_join(F.transform(fp["exact"], hexed(8)), ""), F.array_join(F.transform(fp["lanes"], hexed(16)), "")))


def _signed(lanes: Column) -> Column:
    n = F.element_at(lanes, -1)

    def field(f: int) -> Column:
        return F.transform(
            F.slice(lanes, 1, SHIFTS * HASHES), lambda p: (F.shiftrightunsigned(p, f * FIELD_BITS).bitwiseAND((1 << FIELD_BITS) - 1) * 2 - n).cast("double")
        )

    return F.concat(*[field(f) for f in range(FIELDS)])


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal multisets, else the correlation of their counters, at least 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    x, y = _signed(a["lanes"]), _signed(b["lanes"])
    norm = F.sqrt(dot(x, x) * dot(y, y))
    cosine = F.when(norm > 0, dot(x, y) / norm).otherwise(0.0)
    return F.when(a["exact"] == b["exact"], 1.0).otherwise(F.least(F.greatest(cosine, F.lit(0.0)), F.lit(1.0)))


def with_next(df: DataFrame, payload: list[str], id_col: str = "doc_id", per_bin: int = 200, bins: int = 1000) -> DataFrame:
    """Add ``next``: *payload* of the following row in descending order of *id_col*, in a ring.

    Rows tied in the id follow each other by their payload; null ids come last. The id axis
    is cut into pieces of about *per_bin* rows, each ordered by itself; only the first row
    of a piece is brought to the end of the piece above it, over an axis of pieces that is
    itself cut into *bins*. A single row follows itself.
    """
    ends = df.agg(F.min(id_col).alias("lo"), F.max(id_col).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, hi = ends.lo or 0, ends.hi or 0
    width = max(1, (hi - lo + 1) * per_bin // max(1, ends.n))
    # never null, so that no filter sets the two uses of the shuffled rows apart and they share it
    place = F.coalesce(((F.coalesce(F.col(id_col), F.lit(lo)) - F.lit(lo)) / F.lit(width)).cast("long"), F.lit(0).cast("long"))
    order = Window.partitionBy("_bin").orderBy(F.col(id_col).desc_nulls_last(), *payload)
    own = F.struct(*payload)
    rows = df.withColumn("_bin", place).repartition("_bin")
    first = rows.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").select(F.col("_bin").alias("_at"), own.alias("_edge"))
    rows = rows.withColumn("_next", F.lead(own).over(order))

    pieces = df.select(place.alias("_bin")).distinct().withColumn("_far", (F.col("_bin") / bins).cast("long"))
    far = pieces.groupBy("_far").agg(F.max("_bin").alias("_top"))
    below = far.withColumn("_into", F.lead("_top").over(Window.orderBy(F.desc("_far")))).select("_far", "_into")
    below = below.crossJoin(far.agg(F.max("_top").alias("_ring")))
    inside = pieces.withColumn("_to", F.lead("_bin").over(Window.partitionBy("_far").orderBy(F.desc("_bin"))))
    steps = inside.join(below, "_far").select("_bin", F.coalesce("_to", "_into", "_ring").alias("_at"))
    edges = steps.join(first, "_at").drop("_at")
    return rows.join(edges, "_bin", "left").withColumn("next", F.coalesce("_next", "_edge")).drop("_bin", "_next", "_edge")

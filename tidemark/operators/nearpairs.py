"""Similarity join of vectors: which belong together by near pairs, exactly and without all pairs.

Each vector has a home cell, the reference direction that it is closest to. If two vectors
are within an angle ``alpha`` of each other and one's home is cell c, the other lies within
``alpha`` plus the cell's radius of c's direction, and at most ``2 alpha`` further from it than
from its own direction (both by the triangle inequality of angles). So a vector visits just
the cells for which both hold, and near pairs meet in a cell. Cells are cut into blocks of a
bounded number of vectors; a task multiplies two blocks and returns a forest over the near
pairs that it finds, not the pairs.

Blocks first meet themselves and a sample of all. What is tied together there falls into groups,
and pairs inside the largest group need no second look: only vectors outside it are sent to the
cells they visit.
Where most vectors belong together, that is few, and nothing grows faster than the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.vectors import unit
from tidemark.operators.vectors import merged_ids
from tidemark.session import cut_lineage

#: Widening of angles, far above rounding.
MARGIN = 1e-6
#: Numbers of a block of vectors, and of the cosines that are worked on at once.
BLOCK_NUMBERS, COSINES = 2**21, 2**22


def reference_directions(vectors: np.ndarray, count: int) -> np.ndarray:
    """Rows of *vectors* (unit vectors), each as far from those before as can be."""
    picked = [0] if len(vectors) else []
    nearest = vectors @ vectors[0] if picked else np.empty(0)
    while picked and len(picked) < min(count, len(vectors)):
        at = int(nearest.argmin())
        if nearest[at] > 1 - 1e-9:
            break
        picked.append(at)
        nearest = np.maximum(nearest, vectors @ vectors[at])
    return vectors[picked]


def _angles(pdf: pd.DataFrame, references: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(np.array(pdf["v"].tolist()).reshape(len(pdf), -1) @ references.T, -1, 1))


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each one's group, once every *a* and its *b* are in one group."""
    while True:
        one, other = label[a], label[b]
        apart = one != other
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(one, other)[apart], np.minimum(one, other)[apart])
        while (label[label] != label).any():
            label = label[label]


def _slices(left: np.ndarray, right: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
    step = max(1, COSINES // max(1, len(right)))
    for at in range(0, len(left), step):
        yield at, left[at : at + step] @ right.T >= least


def forest(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> list[tuple[str, str]]:
    """Edges that connect the same ids (*a* of *left*, *b* of *right*) as all near pairs."""
    names, own = np.unique(np.concatenate([a, b]).astype(str), return_inverse=True)
    rows, columns = own[: len(a)], own[len(a) :]
    label = np.arange(len(names))
    for at, near in _slices(left, right, least):
        mine = rows[at : at + len(near)]
        if np.count_nonzero(near) <= 4 * sum(near.shape):
            i, k = np.nonzero(near)
            label = _joined(label, mine[i], columns[k])
            continue
        # of many pairs one for each row and column at a time, until no pair is left apart
        while True:
            near &= label[mine][:, None] != label[columns][None, :]
            i, k = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            if not len(i):
                break
            met, meets = columns[near[i].argmax(axis=1)], mine[near[:, k].argmax(axis=0)]
            label = _joined(label, np.concatenate([mine[i], meets]), np.concatenate([met, columns[k]]))
    return [(names[k], names[i]) for i, k in enumerate(label) if i != k]


def first_near(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> list[tuple[str, str]]:
    """An edge for each of *right* that is near any of *left*."""
    found = np.full(len(right), -1)
    for at, near in _slices(left, right, least):
        hit = near.any(axis=0) & (found < 0)
        found[hit] = at + near[:, hit].argmax(axis=0)
    return [(a[i], b[k]) for k, i in enumerate(found) if i >= 0]


def _block(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    flat = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows.num_rows, -1), rows.column("id").to_numpy()


def _edges(found: list[tuple[str, str]]) -> pa.Table:
    keep, gone = zip(*found) if found else ((), ())
    return pa.table({"keep": pa.array(keep, pa.string()), "gone": pa.array(gone, pa.string())})


def near_edges(vectors: DataFrame, *, least: float, cells: int = 32, sample: int = 1024, block: int | None = None) -> DataFrame:
    """Edges (keep, gone) whose components are those of all pairs of ids with a near pair of vectors.

    *vectors* are (id STRING, vec); an id may have many. Near means a cosine of *least* or
    more, *least* above 0. Equal vectors are one row with the smallest id, the other ids
    being tied to it directly, so that copies are never compared; vectors without a direction
    (zero, not finite) take no part. Directions come from at most *sample* vectors, which
    also meet every block; all are joined. Ids without a near neighbour have no row. A
    *block* is by default as many vectors as have ``BLOCK_NUMBERS`` numbers.
    """
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = vectors.select("id", unit(F.col("vec")).alias("v")).filter(F.col("v").isNotNull() & (length > 0) & ~F.isnan(length))
    first = cut_lineage(rows.groupBy("v").agg(F.min("id").alias("id")))
    equal = rows.join(first.withColumnRenamed("id", "keep"), "v").filter("id <> keep").select("keep", F.col("id").alias("gone")).distinct()
    sampled = first.orderBy(F.xxhash64("v")).limit(sample).collect()
    if not sampled:
        return equal
    some, some_ids = np.array([r.v for r in sampled], float), np.array([r.id for r in sampled], object)
    references = reference_directions(some, cells)
    alpha = float(np.arccos(np.clip(least, -1, 1))) + MARGIN
    size = block or max(1, BLOCK_NUMBERS // some.shape[1])

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a = _angles(pdf, references) if len(pdf) else np.empty((0, len(references)))
            yield pdf.assign(cell=a.argmin(axis=1) if len(pdf) else [], angle=a.min(axis=1) if len(pdf) else [])

    placed = cut_lineage(first.select("id", "v").mapInPandas(home, "id STRING, v ARRAY<DOUBLE>, cell INT, angle DOUBLE"))
    homes = placed.groupBy("cell").agg(F.max("angle").alias("r"), F.ceil(F.count("*") / size).cast("int").alias("_homes")).collect()
    radius = {r.cell: r.r for r in homes}
    radii = np.array([radius.get(c, -np.inf) for c in range(len(references))])

    def met_itself(table: pa.Table) -> pa.Table:
        v, ids = _block(table)
        return _edges(forest(v, np.concatenate([v, some]), ids, np.concatenate([ids, some_ids]), least))

    at = lambda n: F.pmod(F.xxhash64("v"), n).cast("int")
    blocks = F.element_at(F.create_map(*[F.lit(x) for r in homes for x in (r.cell, r["_homes"])]), F.col("cell"))
    tied = placed.select("cell", at(blocks).alias("h"), "id", "v").groupBy("cell", "h").applyInArrow(met_itself, "keep STRING, gone STRING")
    groups = merged_ids(equal.unionByName(tied))
    known = groups.filter("id <> merged_id").select(F.col("merged_id").alias("keep"), F.col("id").alias("gone"))
    largest = groups.groupBy("merged_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "merged_id").limit(1)
    inside = groups.join(F.broadcast(largest), "merged_id").select("id", F.lit(True).alias("_in"))

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            out = ~pdf["inside"].to_numpy(bool)
            meets = np.zeros((len(pdf), len(references)), bool)
            if out.any():
                a = _angles(pdf[out], references)
                meets[out] = (a <= radii + alpha) & (a <= a.min(axis=1, keepdims=True) + 2 * alpha)
            yield pdf.assign(cells=[np.flatnonzero(m).astype(np.int32) for m in meets])

    # a vector leaves Python once, however many cells it visits
    marked = placed.join(inside, "id", "left").select("id", "v", "cell", F.col("_in").isNotNull().alias("inside"))
    called = cut_lineage(marked.mapInPandas(visits, "id STRING, v ARRAY<DOUBLE>, cell INT, inside BOOLEAN, cells ARRAY<INT>"))
    # those outside meet each other once, at the one with the lower home, and all of the largest group
    guests = called.filter("NOT inside").select("id", "v", F.col("cell").alias("_home"), F.explode("cells").alias("cell"))
    guests = guests.select("id", "v", "cell", "_home", F.explode(F.array(F.lit(False), F.lit(True))).alias("inside")).filter("inside OR _home >= cell")
    # one row per cell and side each: as many blocks as it needs on both sides
    where = ["cell", "inside"]
    sizes = called.groupBy(*where).agg(F.ceil(F.count("*") / size).cast("int").alias("_homes")).join(
        guests.groupBy(*where).agg(F.ceil(F.count("*") / size).cast("int").alias("_guests")), where
    )
    sizes = F.broadcast(cut_lineage(sizes))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    hosts = called.join(sizes, where).select(*where, at(F.col("_homes")).alias("h"), every("_guests").alias("g"), "id", "v", F.lit(True).alias("host"))
    calls = guests.join(sizes, where).select(*where, every("_homes").alias("h"), at(F.col("_guests")).alias("g"), "id", "v", F.lit(False).alias("host"))

    def met(table: pa.Table) -> pa.Table:
        host = table.column("host")
        here, there = table.filter(host), table.filter(pc.invert(host))
        if not len(here) or not len(there):
            return _edges([])
        (left, a), (right, b) = _block(here), _block(there)
        link = first_near if table.column("inside")[0].as_py() else forest
        return _edges(link(left, right, a, b, least))

    found = hosts.unionByName(calls).groupBy(*where, "h", "g").applyInArrow(met, "keep STRING, gone STRING")
    return known.unionByName(found).distinct()

"""Hard negatives by angular triangle filtering: exact scores, few of them computed.

Vectors are whole numbers and scores are their inner products. A bounded sample of the rows
gives reference directions; each row belongs to the direction it is closest to, and the rows
of one label and direction are sorted by that angle, stored with their angles from all
directions, and cut into windows of a fixed number of rows. A window has, for every
direction, the least and the greatest angle of its rows, and their least and greatest norm.

For an anchor at angle p from a direction and a window whose angles lie in [a, b], the
triangle inequality of angles bounds the angle between the anchor and any row of the window
by [max(a - p, p - b, 0), min(p + b, 2 pi - (p + a), pi)]; the intervals of all directions
are intersected. Their cosines times the norms, widened by a margin far above rounding,
bound the scores from both sides. Only windows whose bounds overlap the scores in question
(above the anchor's fifth best so far, or between the wanted shares of a positive's score)
are scored in whole numbers.

Anchors come in blocks of a bounded number, each of them broadcast in turn, so that neither
the driver nor a task ever holds all of them; windows are read from a written table. Each
task keeps the best rows of each query that it meets, and a ranking over these is the
result: a fixed number of rows per query and task, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import written

#: Rows of a window.
WINDOW = 256
#: Components beyond this count as not finite: sums of products stay within 63 bits.
LARGEST = 1 << 24
#: Widening of the angles, and of the bounds relative to the norms; rounding is below 1e-7.
MARGIN = 1e-5
NO_ID = int(np.iinfo(np.int64).max)


@dataclass
class Block:
    """Queries of one pass, as arrays by query: only *wanted* labels (same or other) count.

    ``low`` and ``high`` are the whole scores between which a row counts, both included.
    """

    vectors: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    anchor: np.ndarray
    same: bool


def whole_rows(rows: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, v): rows that take part, components floor(scale * x); rows that repeat exactly are one.

    A null label, a null vector, and a null, non-finite or (scaled) beyond +-2**24 component
    keep a row out.
    """
    v = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int"))
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & (F.abs(F.lit(float(scale)) * x.cast("double")) <= LARGEST))
    picked = rows.filter(F.col(label_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    return picked.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"), v.alias("v")).distinct()


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Rows of the vectors, shorter ones filled up with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def whole_matrix(column: pa.Array, width: int) -> np.ndarray:
    """:func:`_matrix` of an array column."""
    flat = column.flatten().to_numpy()
    if len(flat) == len(column) * width and (np.diff(column.offsets.to_numpy()) == width).all():
        return flat.reshape(-1, width)
    return _matrix(column.to_pylist(), width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole inner products: through doubles where these are exact, else in 64-bit integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2**53:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def angles(v: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angle between each row and each reference direction; a right angle for zero rows."""
    norm = np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    return np.arccos(np.clip(v @ references.T / np.where(norm > 0, norm, 1), -1, 1))


def directions(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors of the sample, each as far in angle from those before as can be."""
    sample = sample.astype(np.float64)
    norm = np.linalg.norm(sample, axis=1)
    unit = sample[norm > 0] / norm[norm > 0, None]
    picked: list[np.ndarray] = []
    nearest = np.full(len(unit), -np.inf)
    while len(unit) and len(picked) < count:
        at = int(np.argmin(nearest))
        if nearest[at] > 1 - 1e-9:
            break
        picked.append(unit[at])
        nearest = np.maximum(nearest, unit @ unit[at])
    return np.array(picked) if picked else np.zeros((1, sample.shape[1] if sample.ndim == 2 else 0))


def indexed(rows: DataFrame, references: np.ndarray) -> DataFrame:
    """The rows (id, label, v) with their cell and stored angles, in the order of the windows."""
    width = references.shape[1]

    def placed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            a = angles(whole_matrix(batch.column(2), width), references)
            cell = a.argmin(axis=1)
            more = [pa.array(cell.astype(np.int32)), pa.array(a[np.arange(len(a)), cell]), pa.array(list(a.astype(np.float32)), pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], ["id", "label", "v", "cell", "angle", "turns"])

    near = rows.mapInArrow(placed, "id long, label int, v array<int>, cell int, angle double, turns array<float>")
    # equal vectors differ in their ids, so no value of the sort key stands on many rows
    return near.repartitionByRange("label", "cell", "angle", "id").sortWithinPartitions("label", "cell", "angle", "id")


def bounds(query_angles: np.ndarray, query_norms: np.ndarray, near: np.ndarray, far: np.ndarray, thin: np.ndarray, thick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each query (rows) with the members of each window (columns)."""
    least = np.zeros((len(query_angles), len(near)))
    most = np.full_like(least, np.pi)
    for k in range(query_angles.shape[1]):
        p, a, b = query_angles[:, k, None], near[None, :, k], far[None, :, k]
        np.maximum(least, np.maximum(a - p, p - b), out=least)
        np.minimum(most, np.minimum(p + b, 2 * np.pi - p - a), out=most)
    high, low = np.cos(np.maximum(least - MARGIN, 0)), np.cos(np.minimum(most + MARGIN, np.pi))
    n, least_norm, most_norm = query_norms[:, None], thin[None], thick[None]
    slack = n * most_norm * MARGIN + 0.5
    return n * np.where(low < 0, low * most_norm, low * least_norm) - slack, n * np.where(high > 0, high * most_norm, high * least_norm) + slack


class Best:
    """The first *keep* rows of each query: highest score first, then the smallest id (none last)."""

    def __init__(self, n: int, keep: int):
        self.keep = keep
        self.score = np.full((n, keep), np.iinfo(np.int64).min)
        self.ids = np.full((n, keep), NO_ID)
        self.named = np.zeros((n, keep), bool)
        self.filled = np.zeros((n, keep), bool)

    def floor(self) -> np.ndarray:
        """Score that a further row must have at least."""
        return self.score[:, -1]

    def add(self, queries: np.ndarray, score: np.ndarray, ids: np.ndarray, named: np.ndarray, allowed: np.ndarray) -> None:
        """Rows (columns of *score* and *allowed*) for some queries (rows)."""
        k = len(queries)
        wide = lambda x: np.broadcast_to(x, (k, len(ids)))
        s = np.concatenate([self.score[queries], score], axis=1)
        i = np.concatenate([self.ids[queries], wide(ids)], axis=1)
        n = np.concatenate([self.named[queries], wide(named)], axis=1)
        f = np.concatenate([self.filled[queries], allowed], axis=1)
        order = np.lexsort((i, ~n, -s, ~f), axis=1)[:, : self.keep]
        self.score[queries], self.ids[queries], self.named[queries], self.filled[queries] = (np.take_along_axis(x, order, axis=1) for x in (s, i, n, f))
        self.score[~self.filled] = np.iinfo(np.int64).min


def window_starts(label: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Where windows begin: at each change of label or cell, and every WINDOW rows."""
    change = np.r_[True, (label[1:] != label[:-1]) | (cell[1:] != cell[:-1])]
    at = np.arange(len(label))
    return np.flatnonzero((at - np.maximum.accumulate(np.where(change, at, 0))) % WINDOW == 0)


def _search(table: DataFrame, block: Block, references: np.ndarray, keep: int) -> DataFrame:
    """(query, score, id): of each task, the first *keep* rows of each query of *block*."""
    spark, width = table.sparkSession, references.shape[1]
    shared = spark.sparkContext.broadcast((block, references))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, refs = shared.value
        best = Best(len(q.ids), keep)
        # queries of the same anchor share its vector: angles and products once per anchor
        first = np.unique(q.anchor, return_index=True)[1]
        of_anchor = np.searchsorted(q.anchor[first], q.anchor)
        vectors = q.vectors[first]
        norms, turned = np.linalg.norm(vectors.astype(np.float64), axis=1), angles(vectors, refs)
        for batch in it:
            if not batch.num_rows:
                continue
            label, cell = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            cuts = window_starts(label, cell)
            ends = np.r_[cuts[1:], len(label)]
            vectors_here, turns = whole_matrix(batch.column(2), width), whole_matrix(batch.column(4), len(refs)).astype(np.float64)
            size = np.linalg.norm(vectors_here.astype(np.float64), axis=1)
            near, far = np.minimum.reduceat(turns, cuts), np.maximum.reduceat(turns, cuts)
            low, high = bounds(turned, norms, near, far, np.minimum.reduceat(size, cuts), np.maximum.reduceat(size, cuts))
            named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            for w in np.argsort(-high.max(axis=0)):
                s = slice(cuts[w], ends[w])
                fits = (q.labels == label[cuts[w]]) == q.same
                floor = np.maximum(q.low, best.floor())
                live = np.flatnonzero(fits & (high[of_anchor, w] >= floor) & (low[of_anchor, w] <= q.high))
                if not len(live):
                    continue
                mine, row = np.unique(of_anchor[live], return_inverse=True)
                score = products(vectors[mine], vectors_here[s])[row]
                other = ~(named[None, s] & (ids[None, s] == q.ids[live, None]))
                allowed = other & (score >= floor[live, None]) & (score <= q.high[live, None])
                some = allowed.any(axis=1)
                best.add(live[some], score[some], ids[s], named[s], allowed[some])
        k, at = np.nonzero(best.filled)
        ids = pa.array(best.ids[k, at], pa.int64(), mask=~best.named[k, at])
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(best.score[k, at]), ids], ["query", "score", "id"])

    found = table.select("id", "label", "v", "cell", "turns").mapInArrow(batches, "query long, score long, id long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def _blocks(anchors: DataFrame, size: int) -> Iterator[list]:
    """Anchors in blocks of *size*, one block on the driver at a time."""
    rows: list = []
    for r in anchors.orderBy("id", "label", "v").toLocalIterator(prefetchPartitions=False):
        rows.append(r)
        if len(rows) == size:
            yield rows
            rows = []
    if rows:
        yield rows


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    n_positives: int = 5,
    n_negatives: int = 5,
    low_percent: int = 80,
    high_percent: int = 100,
    block: int = 8192,
    sample: int = 4096,
    n_directions: int = 48,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    *rows* are (id, label, v) of :func:`whole_rows`; *is_anchor* is a condition on id. An
    anchor's positives are its first *n_positives* rows of the same label and another id;
    its negatives for each of them the first *n_negatives* of other labels with
    low_percent * positive_score <= 100 * negative_score <= high_percent * positive_score.
    First means highest score, then smallest id; rows without an id come last among equal
    scores and are never anchors. Rows that share an id but differ are different rows, and
    different anchors. Shorter vectors count as filled up with zeros. No anchors, no
    positives or an empty table give no rows. Other columns are not read.

    Reference directions are fitted on at most *sample* rows (the first by a hash of the
    vector); all rows are indexed and results are exact. At most *block* anchors are on the
    driver and broadcast at a time; each block is two passes over the windows it overlaps.
    """
    spark: SparkSession = rows.sparkSession
    table = written(rows)
    width = table.agg(F.max(F.size("v"))).first()[0] or 0
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not width:  # no rows, or vectors without components: all scores are 0 and need no index
        width = 1
    seeds = table.select("v").distinct().orderBy(F.xxhash64("v")).limit(sample).collect()
    references = directions(_matrix([r.v for r in seeds], width), n_directions)
    index = written(indexed(table, references))
    results: list[DataFrame] = []
    for part in _blocks(table.filter(is_anchor & F.col("id").isNotNull()), block):
        vectors = _matrix([r.v for r in part], width)
        labels, ids = np.array([r.label for r in part]), np.array([r.id for r in part], np.int64)
        least, most = np.full(len(part), np.iinfo(np.int64).min), np.full(len(part), np.iinfo(np.int64).max)
        at = np.arange(len(part))
        positives = _search(index, Block(vectors, labels, ids, least, most, at, True), references, n_positives).collect()
        if not positives:
            continue
        positives.sort(key=lambda r: (r.query, r["rank"]))
        own = np.array([r.query for r in positives])
        scores = np.array([r.score for r in positives], np.int64)
        low, high = -((-scores * low_percent) // 100), (scores * high_percent) // 100
        found = _search(index, Block(vectors[own], labels[own], ids[own], low, high, own, False), references, n_negatives)
        names = spark.createDataFrame([(k, part[r.query].id, r.id, r.score) for k, r in enumerate(positives)], "query long, anchor_id long, positive_id long, positive_score long")
        out = found.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").join(F.broadcast(names), "query")
        results.append(written(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")))
    if not results:
        return spark.createDataFrame([], schema)
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out

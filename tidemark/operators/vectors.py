"""Embedding search, galleries and identities."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import cosine, dot, softmax, unit
from tidemark.session import cut_lineage, shuffle_width

LOGIT_SCALE = 100.0
#: Vectors of a block, and faces that are multiplied with one at once.
GALLERY_BLOCK = 16384
PROBES = 512


def score_frames(frames: DataFrame, query: DataFrame, *, scale: float = LOGIT_SCALE) -> DataFrame:
    """Score every frame against one query vector.

    *query* is one row ``(positive, negatives)``, so broadcasting it is bounded by
    construction. With negatives the score is the positive's share of a softmax
    over scaled cosines; without, the cosine moved to [0, 1].
    """
    q = query.select(
        unit(F.col("positive")).alias("_q"), F.transform("negatives", lambda v: unit(v)).alias("_n")
    ).limit(1)
    x = frames.crossJoin(F.broadcast(q)).withColumn("_v", unit(F.col("vec")))
    logits = F.concat(
        F.array(dot(F.col("_v"), F.col("_q")) * scale),
        F.transform("_n", lambda n: dot(F.col("_v"), n) * scale),
    )
    score = F.when(F.size("_n") > 0, softmax(logits)[0]).otherwise(
        (dot(F.col("_v"), F.col("_q")) + 1.0) / 2.0
    )
    return x.withColumn("score", score).drop("_q", "_n", "_v")


def top_k(scored: DataFrame, k: int, *order: str) -> DataFrame:
    return scored.orderBy(F.desc("score"), *order).limit(k)


def mean_vectors(rows: DataFrame, keys: Sequence[str], *, vec: str = "vec") -> DataFrame:
    """Element-wise mean per group, combined on the map side."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col(vec))))
    return rows.groupBy(*keys).agg(mean.alias(vec))


def nearest_identity(
    faces: DataFrame,
    gallery: DataFrame,
    ident: Sequence[str],
    *,
    threshold: float,
    watch_threshold: float | None = None,
    block: int = GALLERY_BLOCK,
) -> DataFrame:
    """Best identity of each face by the highest cosine over its gallery, if near enough.

    Faces and gallery are dealt into blocks of about *block* vectors; a task multiplies one
    block of each and returns every face's best of it, so that memory is bounded, and the
    best over blocks is a partial maximum: a gallery of any size is searched exactly. Equal
    vectors of an identity are one. Cosines are compared at nine decimals, ties go to the
    greatest identity, and a face without a cosine has that of the whole gallery.
    ``watch_threshold`` applies to faces where the best is a watch-listed identity (``avoid``).
    """
    gallery = gallery.withColumn("vec", unit(F.col("vec")))
    known = cut_lineage(gallery.groupBy(F.col("identity_id").alias("_id"), F.col("vec").alias("_v")).agg(F.max("avoid").alias("avoid")))
    probes = faces.select(*ident, unit(F.col("vec")).alias("_v"))
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    rows = -(-probes.count() // block)
    columns = max(1, -(-known.count() // block))
    p, g = max(rows, shuffle_width(faces)), columns
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ids = [F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in ident]
    hosts = known.filter(whole("_v")).select(every(p).alias("_p"), F.pmod(F.xxhash64("_id", "_v"), F.lit(g)).cast("int").alias("_g"), *ids, "_id", "_v")
    calls = probes.filter(whole("_v")).select(
        F.pmod(F.xxhash64(*ident), F.lit(p)).cast("int").alias("_p"), every(g).alias("_g"), *ident, F.lit(None).cast("string").alias("_id"), "_v"
    )

    def met(table: pa.Table) -> pa.Table:
        host = table.column("_id").is_valid()
        names = table.filter(host).sort_by([("_id", "descending")])
        own = table.filter(pc.invert(host))
        a, b = _matrix(own.column("_v")), _matrix(names.column("_v"))
        best, sim = np.zeros(len(a), np.int64), np.zeros(len(a))
        for at in range(0, len(a) if len(b) else 0, PROBES):
            best[at : at + PROBES], sim[at : at + PROBES] = _best(a[at : at + PROBES] @ b.T)
        if not len(b):
            own = own.slice(0, 0)
        out = own.select([*ident])
        return out.append_column("_sim", pa.array(sim[: len(out)])).append_column("_id", names.column("_id").take(pa.array(best[: len(out)])))

    schema = ", ".join(f"`{c}` {probes.schema[c].dataType.simpleString()}" for c in ident)
    found = calls.unionByName(hosts).groupBy("_p", "_g").applyInArrow(met, f"{schema}, _sim DOUBLE, _id STRING")
    last = F.broadcast(known.agg(F.max("_id").alias("_id")).filter("_id is not null"))  # one row
    found = found.unionByName(probes.select(*ident, F.lit(None).cast("double").alias("_sim")).crossJoin(last))
    best = (
        found.groupBy(*ident)
        .agg(F.max(F.struct("_sim", "_id")).alias("_b"))
        .select(*ident, F.col("_b._id").alias("best_id"), F.col("_b._sim").alias("similarity"))
    )
    bar = F.lit(threshold)
    if watch_threshold is not None:
        watched = known.filter("avoid").select(F.col("_id").alias("best_id")).distinct()
        best = best.join(watched.withColumn("_w", F.lit(True)), "best_id", "left")
        bar = F.when(F.col("_w"), watch_threshold).otherwise(threshold)
    out = best.withColumn("identity", F.when(F.col("similarity") >= bar, F.col("best_id")))
    return out.select(*ident, "best_id", "similarity", "identity")


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.empty((0, 0))


def _best(sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the first column with the greatest value at nine decimals, and that value; NaN is the greatest."""
    sims = np.where(np.isnan(sims), np.inf, sims)
    top = sims.max(axis=1)
    near = sims >= (top - 2e-9)[:, None]
    at, value = sims.argmax(axis=1), np.sign(top) * np.floor(np.abs(top) * 1e9 + 0.5) / 1e9
    for i in np.flatnonzero(near.sum(axis=1) > 1):
        c = np.flatnonzero(near[i])
        r = np.sign(sims[i, c]) * np.floor(np.abs(sims[i, c]) * 1e9 + 0.5) / 1e9
        at[i], value[i] = c[r.argmax()], r.max()
    return at, np.where(np.isinf(value), np.nan, value)


def lookup(wanted: DataFrame, index: DataFrame, keys: Sequence[str], *, ts: str = "ts") -> DataFrame:
    """Which times an index already holds, at millisecond resolution."""
    have = index.select(*keys, "ts_ms").distinct().withColumn("known", F.lit(True))
    return (
        wanted.withColumn("ts_ms", F.rint(F.col(ts) * 1000).cast("long"))
        .join(have, [*keys, "ts_ms"], "left")
        .withColumn("known", F.coalesce("known", F.lit(False)))
    )


def insert_if_absent(index: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Index with the rows of *batch* whose key it does not hold; first of a batch wins."""
    fresh = batch.dropDuplicates([*keys]).join(index.select(*keys), list(keys), "left_anti")
    return index.unionByName(fresh)


def boundary_novelty(shots: DataFrame, keys: Sequence[str], *, order: str = "shot", window: int = 6) -> DataFrame:
    """One less the cosine between the means of up to *window* shots on either side."""
    w = Window.partitionBy(*keys).orderBy(order)

    def total(frame):
        first = F.element_at(frame, 1)
        return F.when(F.size(frame) > 0, F.aggregate(F.slice(frame, F.lit(2), F.size(frame)), first, lambda a, v: F.zip_with(a, v, lambda x, y: x + y)))

    before = F.collect_list("vec").over(w.rowsBetween(-window, -1))
    after = F.collect_list("vec").over(w.rowsBetween(0, window - 1))
    x = shots.withColumn("_b", before).withColumn("_a", after)
    nov = F.when(F.size("_b") > 0, F.lit(1.0) - cosine(total(F.col("_b")), total(F.col("_a")))).otherwise(0.0)
    return x.withColumn("novelty", nov).drop("_a", "_b")


def track_identities(votes: DataFrame, forced: DataFrame, keys: Sequence[str], *, min_votes: int = 1) -> DataFrame:
    """Most voted identity of each track, replaced by any direct watch-list hit.

    Both inputs have ``track, identity, frame``; ties go to the identity seen first.
    """

    def winner(v: DataFrame, out: str) -> DataFrame:
        n = v.groupBy(*keys, "track", "identity").agg(F.count("*").alias("n"), F.min("frame").alias("f"))
        return n.groupBy(*keys, "track").agg(
            F.max_by("identity", F.struct(F.col("n"), -F.col("f"))).alias(out), F.max("n").alias(f"{out}_votes")
        )

    voted = winner(votes, "voted").filter(F.col("voted_votes") >= min_votes)
    direct = winner(forced, "forced")
    return voted.join(direct, [*keys, "track"], "full").select(
        *keys, "track", F.coalesce("forced", "voted").alias("identity"), F.col("forced").isNotNull().alias("forced")
    )


def assign_identities(
    faces: DataFrame,
    keys: Sequence[str],
    *,
    order: str,
    threshold: float,
    max_gallery: int = 50,
    novelty_max: float | None = None,
) -> DataFrame:
    """Match each face to an identity of its shard or open a new one, in time order.

    The rule depends on the order of faces, so a shard is streamed through one task
    batch by batch; only the capped galleries are held. With *novelty_max* a match
    grows the gallery only if it shows a new view. Identities are numbered by shard.
    """
    cols = [*keys, order]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in faces.select(*cols).schema)
    nk = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = None
        galleries: list[np.ndarray] = []
        for pdf in batches:
            got: list[int] = []
            sims: list[float] = []
            for row in pdf.itertuples(index=False):
                key = tuple(row[:nk])
                if key != shard:
                    shard, galleries = key, []
                v = np.asarray(row[-1], dtype=np.float64)
                v = v / max(float(np.linalg.norm(v)), 1e-12)
                best, sim = -1, -1.0
                for i, g in enumerate(galleries):
                    s = float((g @ v).max())
                    if s > sim:
                        best, sim = i, s
                if best < 0 or sim < threshold:
                    galleries.append(v[None, :])
                    best = len(galleries) - 1
                elif novelty_max is None or sim <= novelty_max:
                    galleries[best] = np.vstack([galleries[best], v])[-max_gallery:]
                got.append(best)
                sims.append(sim)
            out = pdf[cols].copy()
            out["identity"] = got
            out["similarity"] = sims
            yield out

    return (
        faces.select(*cols, "vec")
        .repartition(*keys)
        .sortWithinPartitions(*keys, order)
        .mapInPandas(run, f"{schema}, identity INT, similarity DOUBLE")
    )


def merged_ids(pairs: DataFrame, *, a: str = "keep", b: str = "gone") -> DataFrame:
    """Smallest member of each group of identities joined by *pairs*.

    Each round every id takes the smallest label among itself and its neighbours
    and then that label's own label, which halves path lengths; lineage is cut by
    a checkpoint each round. Rounds end when no label moves.
    """
    edges = pairs.select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    edges = cut_lineage(edges)
    labels = cut_lineage(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")))
    while True:
        near = (
            edges.join(labels.select(F.col("u").alias("v"), "label"), "v")
            .groupBy("u")
            .agg(F.min("label").alias("_near"))
        )
        step = labels.join(near, "u").select("u", "label", F.least("label", "_near").alias("_m"))
        jump = labels.select(F.col("u").alias("_m"), F.col("label").alias("_j"))
        after = step.join(jump, "_m", "left").select("u", F.col("label").alias("_old"), F.least("_m", "_j").alias("label"))
        after = cut_lineage(after)
        labels = after.select("u", "label")
        if after.filter(F.col("label") < F.col("_old")).isEmpty():
            break
    return labels.select(F.col("u").alias("id"), F.col("label").alias("merged_id"))

"""Parameter-signed storage, single-signal merges, back-fill plans and history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64
HISTORY = 10


def signature(*params: str) -> Column:
    """First 16 hex digits of the digest of the parameters' JSON in name order."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(params))), 256), 1, 16)


def save_signed(df: DataFrame, path: str, params: Sequence[str]) -> None:
    """Append results under their parameter signature; changed parameters are a new entry."""
    df.withColumn("params_sig", signature(*params)).write.mode("append").partitionBy("params_sig").parquet(path)


def load_signed(spark: SparkSession, path: str, sig: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("params_sig") == sig)


def fold_signal(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows with the fresh signal of the fresh videos in place of the old one."""
    new = fresh.select("video_id", "signal").distinct()
    return stored.join(new, ["video_id", "signal"], "left_anti").unionByName(fresh)


def merge_signal(spark: SparkSession, path: str, fresh: DataFrame) -> None:
    """Fold a fresh signal into a stored table, rewriting only the partitions it touches.

    The table is partitioned by signal and a hash bucket of the video, so one
    signal of a few videos rewrites those buckets and nothing else.
    """
    bucket = F.pmod(F.xxhash64("video_id"), F.lit(BUCKETS)).cast("int")
    rows = fresh.withColumn("bucket", bucket)
    touched = rows.select("signal", "bucket").distinct()
    try:
        stored = spark.read.parquet(path)
    except Exception as missing:  # first write
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        stored = None
    if stored is not None:
        # at most signals x buckets rows
        kept = stored.join(F.broadcast(touched), ["signal", "bucket"], "left_semi")
        rows = fold_signal(kept.select(*rows.columns), rows)
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("signal", "bucket")
        .parquet(path)
    )


def refold_classes(cached: DataFrame, fresh: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Cached boxes less the named classes, box by box, with the fresh ones added."""
    return cached.filter(~F.col("label").isin(*classes)).unionByName(fresh)


def merge_partials(*parts: DataFrame) -> DataFrame:
    """Per-second lists of several frame ranges as one list per second."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # equal labels of a second are counted before anything is gathered
    n = out.groupBy("video_id", "sec", "label").agg(F.count("*").alias("_n"))
    return n.groupBy("video_id", "sec").agg(
        F.flatten(
            F.transform(
                F.array_sort(F.collect_list(F.struct("label", "_n"))),
                lambda s: F.array_repeat(s["label"], s["_n"].cast("int")),
            )
        ).alias("labels")
    )


def backfill_plan(
    videos: DataFrame, present: DataFrame, gates: Mapping[str, Sequence[str]], settings: Mapping[str, float]
) -> DataFrame:
    """Artifacts each cached video still needs: its gate is open and nothing is stored.

    *gates* maps an artifact to the settings that ask for it; *present* has
    ``video_id, artifact`` of non-empty stored values; *videos* a ``cached`` flag.
    """
    wanted = [a for a, names in gates.items() if any(settings.get(n) for n in names)]
    need = videos.filter("cached").select(
        "video_id", F.explode(F.array(*[F.lit(a) for a in wanted]).cast("array<string>")).alias("artifact")
    )
    return need.join(present.select("video_id", "artifact"), ["video_id", "artifact"], "left_anti")


def inventory(stored: DataFrame) -> DataFrame:
    """Per video which signals exist, when last written, and how many rows."""
    per = stored.groupBy("video_id", "signal").agg(F.max("cached_at").alias("_at"), F.count("*").alias("_n"))
    return per.groupBy("video_id").agg(
        F.array_sort(F.collect_set("signal")).alias("signals"),
        F.max("_at").alias("cached_at"),
        F.sum("_n").alias("size"),
    )


def history(results: DataFrame, keys: Sequence[str] = ("video_id",), *, at: str = "created_at", tie: str = "id", keep: int = HISTORY) -> DataFrame:
    """Newest *keep* results of each video, newest first.

    The rank filter is applied before the shuffle as well, so a hot video sends
    *keep* rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie))
    return results.withColumn("version", F.row_number().over(w)).filter(F.col("version") <= keep)


def stale(index: DataFrame, files: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Index entries whose model, size or modification time no longer match the file."""
    f = files.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("model_id", "size", "mtime")])
    same = F.lit(True)
    for c in ("model_id", "size", "mtime"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return index.join(f, list(keys), "left").withColumn("stale", ~same).drop("_model_id", "_size", "_mtime")

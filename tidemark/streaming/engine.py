"""Sessions, feature windows, first arrivals and index growth over endless input."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import local_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder (a temporary one on a single machine)."""
    base = spark.conf.get("spark.checkpoint.dir", "") or local_folder(spark, "spark-stream-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _run(stream: DataFrame, folder: str) -> DataFrame:
    """One run over everything there is now; state and output stay in *folder*."""
    q = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything there is now, into a table in the shared folder."""
    return _run(stream, shared_folder(stream.sparkSession, name))


#: Event time of the row that ends an input: later than all others.
END = "9999-01-01 00:00:00"


def run_to_end(rows: DataFrame, at: str, query: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``query(rows)`` over everything there is now, what is still open included.

    A second source takes one closing row, written when the first run is done: nothing but
    its event time *at* is set, which moves the watermark past all windows and sessions, so
    that a second run of the same query delivers those that the first left in its state. The
    closing row's own window stays open and is never delivered.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark, name)
    spark.createDataFrame([], rows.schema).write.parquet(f"{folder}/end")
    ending = spark.readStream.schema(rows.schema).parquet(f"{folder}/end")
    stream = query(rows.unionByName(ending))
    _run(stream, folder)
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in rows.schema}
    last = spark.range(1).select(*(c.alias(n) for n, c in (nothing | {at: F.lit(END).cast(rows.schema[at].dataType)}).items()))
    last.write.mode("append").parquet(f"{folder}/end")
    return _run(stream, folder)


def sessions(points: DataFrame, keys: Sequence[str], *, at: str, gap: str, late: str) -> DataFrame:
    """Bursts of points as sessions; two points exactly *gap* apart belong together."""
    w = F.session_window(at, gap)
    return (
        points.withWatermark(at, late)
        .groupBy(*keys, w.alias("_w"))
        .agg(F.count("*").alias("points"), F.min(at).alias("start"), F.max(at).alias("end"))
        .drop("_w")
    )


def second_features(samples: DataFrame, keys: Sequence[str], *, at: str, value: str, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Per-window level features of an endless sample stream.

    Blocks and their carried remainder are the engine's state: a window stays open
    until the watermark passes it, whatever batches its samples arrive in.
    """
    return (
        samples.withWatermark(at, late)
        .groupBy(*keys, F.window(at, width).alias("_w"))
        .agg(
            F.count("*").alias("samples"),
            F.min(value).alias("lo"),
            F.max(value).alias("hi"),
            F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"),
        )
        .select(*keys, F.col("_w.start").alias("start"), "samples", "lo", "hi", "rms")
    )


def first_arrivals(rows: DataFrame, keys: Sequence[str], *, at: str, late: str) -> DataFrame:
    """Repeated rows of a key ignored while within the lateness bound."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([*keys])


def grow_index(stream: DataFrame, path: str, keys: Sequence[str], *, bucket_by: Sequence[str] | None = None, buckets: int = 256):
    """A writer that adds only unseen keys of each micro-batch to a stored index.

    The index lies in *buckets* folders by a hash of *bucket_by* (the first key by default),
    and a batch reads the keys of the buckets that it touches and no others: batches that
    bring few videos cost what these videos' buckets hold. A batch that is run again, after a
    failure or by hand, finds its rows already there and adds nothing.
    """
    spark = stream.sparkSession
    own = [*(bucket_by or keys[:1])]
    bucket = F.pmod(F.xxhash64(*own), F.lit(buckets)).cast("int").alias("_bucket")
    fields = stream.select("*", bucket).schema
    spark.createDataFrame([], fields).write.mode("append").partitionBy("_bucket").parquet(path)  # so that the folder is there

    def add(batch: DataFrame, _batch_id: int) -> None:
        fresh = batch.dropDuplicates([*keys]).select("*", bucket)
        touched = [r[0] for r in fresh.select("_bucket").distinct().collect()]  # *buckets* at most
        stored = batch.sparkSession.read.schema(fields).parquet(path).filter(F.col("_bucket").isin(touched))
        new = fresh.join(stored.select("_bucket", *keys), ["_bucket", *keys], "left_anti").select(*fields.names)
        new.write.mode("append").partitionBy("_bucket").parquet(path)

    return stream.writeStream.foreachBatch(add)

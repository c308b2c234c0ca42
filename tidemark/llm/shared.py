"""The cluster's shared folder, and tables written there to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import local_folder


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below ``spark.checkpoint.dir``.

    Only a local session may leave that setting out; it gets a temporary folder, as
    in tests. On a cluster a machine's own folder would lose rows, so that is an error.
    Folders are named ``tidemark-...`` and may be deleted once the result is written.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or "file://" + local_folder(spark, "spark-shared-")
    return f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write *df* to the shared folder and read it back.

    What follows reads files, so a lost executor costs no recomputation, and plans
    that use the table twice do not run it twice.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salted(big: DataFrame, small: DataFrame, keys: list[str], spread: str, ways: int = 16, how: str = "inner") -> DataFrame:
    """Join on *keys*, a hot key of *big* dealt out over *ways* tasks by column *spread*.

    *small* has few rows per key and is copied *ways* times.
    """
    left = big.withColumn("_way", F.pmod(F.xxhash64(spread), F.lit(ways)))
    right = small.withColumn("_way", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ways - 1).cast("long"))))
    return left.join(right, [*keys, "_way"], how).drop("_way")

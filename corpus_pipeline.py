"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and, but
for the last, returns the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, minhash, packing, quality, toxicity
from tidemark.llm.shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3; null and empty texts have the bias's score.

    Rows are judged one by one: null ids and repeated rows stay or go with their own text, an
    empty table gives none, and columns beside those of ``documents`` are left behind.
    """
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = docs.select(*COLUMNS).withColumn("_score", toxicity.score(spark, model, F.coalesce("text", F.lit(""))))
    return scored.filter(F.col("_score") < 0.3).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.7 or more; null texts are scored as empty ones.

    Rows are judged one by one: null ids and repeated rows stay or go with their own text, an
    empty table gives none, and columns beside those of ``documents`` are left behind.
    """
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    scored = docs.select(*COLUMNS).withColumn("_score", quality.score(spark, model, F.coalesce("text", F.lit(""))))
    return scored.filter(F.col("_score") >= 0.7).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, 80 of 100.

    Rows are told apart by id and text, also those without an id; repeated rows are one row.
    Documents without words are in no group and stay.
    """
    return minhash.one_of_each(docs.select(*COLUMNS), words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``, each judged by its own text, whatever its id."""
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("_text_key"))
    found = decontaminate.contaminated(keyed, _table(spark, sf_dir, "benchmark"), id_col="_text_key")
    gone = found.select(F.col("doc_id").alias("_text_key")).distinct()
    return keyed.join(gone, "_text_key", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as sequences of at most 2048 ids, one row per piece.

    Null ids and repeated rows are packed each, null texts as the end id alone; an empty table
    gives none.
    """
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(docs, path, public_tokenizers.PATTERN, capacity=2048, end_id=1, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Models, tokens and similarities are not expressible in SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Token counts of whole texts by the whole-token shortcut.

Most words of a text are one token. Which vocabulary strings are one token when they
stand alone is proved once, on the driver, by encoding each of them; the proved strings
are broadcast (their number is bounded by the vocabulary). A text is cut at plain
spaces and newlines, which no pre-token of the library crosses, and each word is then

* looked up among the proved strings (count 1), or
* merged by the library, and its count remembered in a bounded dictionary.

A text that contains the opening of a special token's string goes to the library whole,
since the library finds those strings before it cuts anything.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.memo import Memo

WORD = re.compile(r"[^ \n]+")
END = "</w>"


def load(path: str):
    """The library's tokenizer for a vocabulary file; one thread, as Spark owns the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def whole_tokens(path: str) -> frozenset[str]:
    """Strings that the library encodes as exactly one token when they stand alone.

    Proved, not assumed: every word-final vocabulary entry is decoded to text, encoded
    again by the library, and kept only if one token comes back.
    """
    tokenizer = load(path)
    texts = sorted({t[: -len(END)] for t in tokenizer.get_vocab() if t.endswith(END) and t != END})
    texts = [t for t in texts if t.isascii() and WORD.fullmatch(t)]
    coded = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    return frozenset(t for t, c in zip(texts, coded) if len(c.ids) == 1)


def counter(path: str, proved: frozenset[str], keep: int = 400_000) -> Callable[[str], int]:
    """A function from a whole text to its number of tokens."""
    tokenizer = load(path)
    openings = {t.content[:2] for t in tokenizer.get_added_tokens_decoder().values()}

    def merged(word: str) -> int:
        lower = word.lower() if word.isascii() else word
        if lower in proved:
            return 1
        return len(tokenizer.encode(word, add_special_tokens=False).ids)

    count = Memo(merged, keep)
    crossing = any(re.search(r"\s", o) for o in openings)

    def of(text: str) -> int:
        if crossing or any(o in text for o in openings):
            return len(tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(map(count.__getitem__, WORD.findall(text)))

    return of


def count_tokens(
    spark: SparkSession, docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Bytes and tokens of every whole text.

    Null text counts as empty (0 bytes, 0 tokens); a null id, repeated rows and ties
    give one row each; other columns are not read, so their names cannot clash; an
    empty table gives an empty result. Row-wise: no shuffle, one Arrow batch in memory.
    """
    proved = spark.sparkContext.broadcast(whole_tokens(path))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path, proved.value)
        for batch in it:
            counts = [of(t) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = rows.mapInArrow(batches, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

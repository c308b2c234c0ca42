"""Hashed features of texts for the classifiers, and their labelled samples."""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.memo import Memo

WORD = re.compile(r"\w+")
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Odd multipliers that set n-grams of different kinds apart.
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Shapes of a token; a repeated token has its own.
PUNCTUATION, DIGITS, CAPITALS, TITLE, LOWER, OTHER, REPEATED, BAR, STOP = range(9)
SHAPES = 9
SHARES = 8


def mixed(h: np.ndarray, bits: int) -> np.ndarray:
    """The upper *bits* of a multiplied hash, as positions."""
    return ((h * P1) >> np.uint64(64 - bits)).astype(np.int64)


def shape_of(token: str) -> int:
    first = token[0]
    if not (first.isalnum() or first == "_"):
        return BAR if first == "|" else STOP if token in (".", ",") else PUNCTUATION
    if token.isdigit():
        return DIGITS
    if token.isupper():
        return CAPITALS if len(token) > 1 else TITLE
    if token.islower():
        return LOWER
    return TITLE if token.istitle() else OTHER


class WordGrams:
    """Distinct word unigrams, bigrams and skip-grams (one word left out) of a text.

    Unigrams also stand by their first four, five and six letters, so that an inflected
    word meets its stem.
    """

    STEMS = (4, 5, 6)

    def __init__(self, bits: int):
        self.bits, self.size = bits, 1 << bits
        self.code = Memo(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")))
        self.stems = Memo(lambda w: tuple(xxhash.xxh3_64_intdigest(w[:n].encode("utf-8", "surrogatepass"), seed=n) for n in self.STEMS if len(w) >= n))

    def __call__(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        h = np.fromiter(map(self.code.__getitem__, words), np.uint64, len(words))
        stems = np.fromiter(chain.from_iterable(map(self.stems.__getitem__, set(words))), np.uint64)
        grams = [h, h[:-1] * P2 + h[1:], h[:-2] * P3 + h[2:], stems]
        return np.unique(mixed(np.concatenate(grams), self.bits))


class StyleGrams:
    """Distinct word unigrams and bigrams, and n-grams of token shapes with their share of the text.

    A shape n-gram (n up to 3) is an indicator for one power-of-two step of its share of
    all positions, so it means the same in a short and in a long text.
    """

    def __init__(self, bits: int):
        self.bits = bits
        self.size = (1 << bits) + SHARES * (SHAPES + SHAPES**2 + SHAPES**3)
        self.code = Memo(lambda t: xxhash.xxh3_64_intdigest(t.lower().encode("utf-8", "surrogatepass")) >> 8 << 8 | shape_of(t))

    def __call__(self, text: str) -> np.ndarray:
        tokens = TOKEN.findall(text)
        coded = np.fromiter(map(self.code.__getitem__, tokens), np.uint64, len(tokens))
        h = coded >> np.uint64(8)
        shape = (coded & np.uint64(255)).astype(np.int64)
        shape[1:][(h[1:] == h[:-1]) & (shape[1:] != STOP)] = REPEATED
        found = [mixed(np.concatenate([h, h[:-1] * P2 + h[1:]]), self.bits)]
        at, gram = 1 << self.bits, np.zeros(len(shape), np.int64)
        for n in (1, 2, 3):
            if len(shape) < n:
                break
            gram = gram[: len(shape) - n + 1] * SHAPES + shape[n - 1 :]
            counts = np.bincount(gram, minlength=SHAPES**n)
            seen = np.flatnonzero(counts)
            share = np.minimum(SHARES - 1, np.floor(-np.log2(counts[seen] / len(gram))).astype(np.int64))
            found.append(at + seen * SHARES + share)
            at += SHARES * SHAPES**n
        return np.unique(np.concatenate(found))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text has remainder 2 by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_features(
    docs: DataFrame, labels: DataFrame, label: str, grams: Callable[[], Callable[[str], np.ndarray]], max_rows: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(o, y, f): label and features of at most *max_rows* labelled rows outside the held-out fold, in order.

    Rows are taken in the order of a hash of their id, so the sample is the same on each
    run; rows that repeat an id and its text count once. A document labelled twice has its
    higher label. Features are computed where the texts are.
    """
    key = F.col("doc_id")
    chosen = (
        labels.filter(F.col(label).isNotNull() & key.isNotNull() & ~held_out(key))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = grams()
        for batch in it:
            found = [of(t).astype(np.int32) for t in batch.column(2).to_pylist()]
            arrays = [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["o", "y", "f"])

    rows = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"]).select(F.xxhash64("doc_id").alias("o"), "y", "text")
    return rows.mapInArrow(batches, "o long, y int, f array<int>").orderBy("o", "y", "f").limit(max_rows)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, grams: Callable[[], Callable[[str], np.ndarray]], max_rows: int, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[list[np.ndarray], np.ndarray]:
    """The rows of :func:`labelled_features` on the driver, for samples that fit there."""
    got = labelled_features(docs, labels, label, grams, max_rows, id_col, text_col).toArrow()
    return _views(got.column("f").chunks), np.asarray(got.column("y"), float)


def _views(columns: list[pa.Array]) -> list[np.ndarray]:
    return [np.asarray(f.values) for column in columns for f in column]  # views: nothing is copied


def fitted(sample: DataFrame, fit: Callable) -> object:
    """``fit(rows, y)`` of the rows of :func:`labelled_features`, in the task that has them in order.

    The fit goes over the bounded sample row after row; only the model comes to the driver.
    """

    def model(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(it)
        y = np.concatenate([np.asarray(b.column(1), float) for b in got]) if got else np.empty(0)
        if len(y):
            blob = pickle.dumps(fit(_views([b.column(2) for b in got]), y))
            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["model"])

    found = sample.mapInArrow(model, "model binary").collect()
    return pickle.loads(found[0].model) if found else fit([], np.empty(0))


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))

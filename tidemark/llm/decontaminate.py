"""Benchmark decontamination by latent semantic retrieval.

1. Every text is cut into words once; of each document the words that occur in the
   benchmark are kept with their positions, and passages (16 words each) are counted per
   such word. This table, a small part of the texts, is what the later steps read.
2. Passages are TF-IDF rows of unit length; words in more than a given share of the passages
   keep a tenth of their weight, words foreign to the benchmark only count in a passage's length. A
   randomised singular value decomposition of all rows takes one pass: each task multiplies
   its rows with a random matrix and back, and the sums of the tasks give the leading
   directions by Nystroem's formula.
3. Every window of two passages is compared with every item by the weight they share, divided
   by the item's length and by the window's or the item's, whichever is less. No weight is 0
   and of an item's verbatim copy one window holds half its squared length at least, so such
   a copy is a candidate however frequent its words are and however long the text around it.
   Both are projected into the leading directions too, where their cosine is measured anew:
   windows of an item's subject are candidates that share few of its words, each by itself.
4. Around each candidate window the longest common subsequence with the item is computed on
   whole word sequences, as far as an item's length to both sides. An item counts as
   contained when enough of it is in order there, and enough of its answer (a column of its
   own, else the item's rarer half of words) is there too.

The benchmark is worked through in blocks of a fixed number of items, so what is broadcast
(word ids, weights, the latent space) has a fixed bound whatever the benchmark's size; each
block reads the texts once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidemark.llm.shared import written

STEP = 16
#: Bytes to word characters: A-Z in lower case, other ASCII that is not a letter or digit to a space.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SLICE = 16_384
#: What is left of the weight of a word in more than max_df of the passages; never 0, as an item may have no other words.
FREQUENT = 0.1
TABLE = "doc_id long, n_words int, ids array<int>, at array<int>, counts array<long>"
FOUND = "doc_id long, item_id long, cosine double, share double, first_word long, last_word long"


def words_of(text: str | bytes) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return data.translate(PLAIN).split()


@dataclass(frozen=True)
class Query:
    """A stretch of a benchmark item: word ids, and ids of its answer."""

    item_id: int | None
    ids: np.ndarray
    answer: frozenset[int]


@dataclass(frozen=True)
class Scores:
    """What each word adds to the score of each item: a matrix, its most read rows dense, the others sparse."""

    column: np.ndarray
    dense: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, matrix: np.ndarray, often: np.ndarray, dense: int = 128) -> Scores:
        """*often*: how many passages have each word."""
        held = (matrix != 0).sum(axis=1)
        top = np.argsort(-held * often, kind="stable")[:dense]
        column = np.full(len(matrix), -1)
        column[top] = np.arange(len(top))
        words, items = np.nonzero(np.where((column < 0)[:, None], matrix, 0))
        starts = np.searchsorted(words, np.arange(len(matrix) + 1))
        return cls(column, np.ascontiguousarray(matrix[top]), starts, items, matrix[words, items])

    def sums(self, rows: np.ndarray, ids: np.ndarray, n_rows: int, n_items: int) -> np.ndarray:
        """Sums over the entries (row, word): a matrix of *n_rows* and all items."""
        column = self.column[ids]
        some = column >= 0
        n = len(self.dense)
        counts = np.bincount(rows[some] * n + column[some], minlength=n_rows * n).reshape(n_rows, n)
        out = counts.astype(np.float32) @ self.dense
        rows, ids = rows[~some], ids[~some]
        each = self.starts[ids + 1] - self.starts[ids]
        at = np.arange(int(each.sum())) + np.repeat(self.starts[ids] - (np.cumsum(each) - each), each)
        keys = np.repeat(rows, each) * n_items + self.items[at]
        return out + np.bincount(keys, self.values[at], n_rows * n_items).reshape(n_rows, n_items)


@dataclass(frozen=True)
class Space:
    """What tasks need of one block: queries, weights per word and the latent space."""

    queries: list[Query]
    idf: np.ndarray
    foreign: float
    scores: Scores
    lengths: np.ndarray
    holds: np.ndarray
    leading: Scores
    latent: np.ndarray


def queries_of(items: list[Row], longest: int) -> tuple[list[Query], dict[bytes, int]]:
    """Items as queries; one longer than *longest* words is cut into several."""
    vocabulary: dict[bytes, int] = {}
    found = []
    for item in items:
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(item.text or "")], np.int64)
        answer = frozenset(vocabulary.setdefault(w, len(vocabulary)) for w in words_of(item.answer or ""))
        parts = max(1, math.ceil(len(ids) / longest))
        found += [Query(item.item_id, part, answer) for part in np.array_split(ids, parts) if len(part)]
    return found, vocabulary


def known_words(texts: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """TABLE rows: one per document, and one per task with passage counts per word."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = shared.value
        counts = np.zeros(len(ids_of) + 1, np.int64)
        types = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        names = ["doc_id", "n_words", "ids", "at", "counts"]
        for batch in _slices(it):
            sizes, ids, places = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = words_of(text or b"")
                coded = np.fromiter(map(ids_of.get, words, repeat(-1)), np.int32, len(words))
                at = np.flatnonzero(coded >= 0).astype(np.int32)
                known = coded[at]
                pairs = np.unique((at // STEP).astype(np.int64) * len(counts) + known)
                counts += np.bincount(pairs % len(counts), minlength=len(counts))
                counts[-1] += math.ceil(len(words) / STEP)
                sizes.append(len(words))
                ids.append(known)
                places.append(at)
            columns = [batch.column(0), sizes, ids, places, [None] * len(sizes)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([None, -1, [], [], counts], types)], names)

    return texts.mapInArrow(batches, TABLE)


def passages(ids: np.ndarray, at: np.ndarray, starts: np.ndarray, n_words: np.ndarray, idf: np.ndarray, foreign: float):
    """The flat (passage, word, weight) entries of a batch, and every passage's squared length.

    Passages are numbered through the batch; ``starts`` are the documents' first numbers.
    """
    per_doc = -(-n_words // STEP)
    first = np.cumsum(per_doc) - per_doc
    which = np.repeat(first, np.diff(starts)) + at // STEP
    weight = idf[ids]
    total = int(per_doc.sum())
    words = np.full(total, STEP)
    short = n_words % STEP
    ends = (first + per_doc - 1)[short > 0]
    words[ends] = short[short > 0]
    known = np.bincount(which, minlength=total)
    square = np.bincount(which, weight * weight, total) + (words - known) * foreign**2
    return which, weight, np.maximum(square, 1e-12), first, per_doc


def _slices(it: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of at most *rows* documents, so that a task's arrays stay small."""
    for batch in it:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def arrays_of(batch: pa.RecordBatch):
    """Flat ids, positions, document starts and word counts of TABLE's document rows."""
    ids, at = batch.column("ids"), batch.column("at")
    starts = np.asarray(ids.offsets)
    flat = np.asarray(ids.values)[starts[0] : starts[-1]].astype(np.int64)
    place = np.asarray(at.values)[at.offsets[0].as_py() : at.offsets[-1].as_py()].astype(np.int64)
    return flat, place, starts - starts[0], np.asarray(batch.column("n_words")).astype(np.int64)


def _back(z: np.ndarray, rows: np.ndarray, words: np.ndarray, weight: np.ndarray, random: np.ndarray) -> None:
    """Add (rows' matrix)^T (rows' matrix) random to *z*; entries are sorted by row."""
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    y = np.add.reduceat(random[words] * weight[:, None], starts, axis=0)
    order = np.argsort(words, kind="stable")
    local = np.cumsum(np.r_[False, rows[1:] != rows[:-1]])
    terms = words[order]
    heads = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
    z[terms[heads]] += np.add.reduceat(y[local[order]] * weight[order][:, None], heads, axis=0)


def sketch(table: DataFrame, random: np.ndarray, idf: np.ndarray, foreign: float, blocks: int = 16) -> np.ndarray:
    """The sum over all tasks of A^T A R: one matrix of (words, columns of *random*).

    Each task sends its sum once, in *blocks* of words; each block is added up in one task.
    """
    shared = table.sparkSession.sparkContext.broadcast((random, idf, foreign))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, weights, outside = shared.value
        z = np.zeros(r.shape, np.float32)
        for batch in _slices(it):
            ids, at, starts, n_words = arrays_of(batch)
            which, weight, square, _, _ = passages(ids, at, starts, n_words, weights, outside)
            kept = weight > 0
            which, ids, weight = which[kept], ids[kept], (weight[kept] / np.sqrt(square[which[kept]])).astype(np.float32)
            low = 0
            while low < len(which):
                high = min(len(which), low + SLICE)
                while high < len(which) and which[high] == which[high - 1]:
                    high += 1
                _back(z, which[low:high], ids[low:high], weight[low:high], r)
                low = high
        yield packed(z)

    def packed(z: np.ndarray) -> pa.RecordBatch:
        parts = np.array_split(z, blocks)
        return pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "part"])

    def added(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in it:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new = np.frombuffer(part, np.float32)
                sums[block] = new + sums[block] if block in sums else new
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["block", "part"])

    ddl = "block int, part binary"
    sums = table.mapInArrow(batches, ddl).repartition(blocks, "block").mapInArrow(added, ddl).collect()
    total = np.zeros(random.shape, np.float32)
    parts = np.array_split(np.arange(len(total)), blocks)
    for row in sums:
        total[parts[row.block]] += np.frombuffer(row.part, np.float32).reshape(-1, random.shape[1])
    return total


def item_matrix(queries: list[Query], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items as rows of unit length, and the lengths they had."""
    rows = np.zeros((len(queries), len(idf)), np.float32)
    for row, q in zip(rows, queries):
        row[:] = np.bincount(q.ids, minlength=len(idf)) * idf
    lengths = np.sqrt((rows * rows).sum(axis=1))
    return rows / lengths[:, None], lengths


def nystroem(z: np.ndarray, random: np.ndarray, dims: int) -> np.ndarray:
    """The leading eigenvectors of C from C R, R random: C is about Z (R^T Z)^-1 Z^T."""
    shift = 1e-6 * max(1e-12, float(np.linalg.norm(z)))
    z = z + shift * random
    core = random.T @ z
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values[-1], 1e-300) * 1e-6
    half = (z @ vectors[:, good]) / np.sqrt(values[good])
    left, _, _ = np.linalg.svd(half, full_matrices=False)
    return np.ascontiguousarray(left[:, :dims]).astype(np.float32)


def decompose(table: DataFrame, queries: list[Query], words: int, max_df: float, dims: int = 48, seed: int = 11) -> Space:
    """Word weights from all passages, and the latent space: *dims* leading directions and the items'."""
    counts = table.filter("n_words < 0").select(F.posexplode("counts").alias("word", "n")).groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(words + 1)
    for row in counts:
        df[row.word] = row.n
    total = max(1.0, df[-1])
    foreign = math.log(1 + total)
    idf = np.log((1 + total) / (1 + df[:-1])) + 1e-3
    idf[df[:-1] > max(max_df * total, 8)] *= FREQUENT
    random = np.random.default_rng(seed).standard_normal((words, min(words, dims + 16))).astype(np.float32)
    z = sketch(table.filter("n_words >= 0"), random, idf, foreign)
    leading = nystroem(z.astype(np.float64), random.astype(np.float64), dims)
    items, lengths = item_matrix(queries, idf)
    latent = items @ leading
    latent /= np.maximum(1e-9, np.sqrt((latent * latent).sum(axis=1, keepdims=True)))
    scores = Scores.of(items.T * idf[:, None], df[:-1])
    return Space(queries, idf, foreign, scores, lengths, items > 0, Scores.of(leading * idf[:, None], df[:-1], 256), latent)


def lcs(item: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[int, int, int]:
    """Length of the longest common subsequence, and where in *at* its matches begin and end.

    Bit-parallel over the item: one addition and a few logical steps per word of the text.
    The end is where the full length is first reached; the same walk backwards gives the
    beginning.
    """

    def walk(item: list[int], ids: list[int]) -> tuple[int, int]:
        masks: dict[int, int] = {}
        for k, w in enumerate(item):
            masks[w] = masks.get(w, 0) | 1 << k
        full = (1 << len(item)) - 1
        v, best, end = full, 0, 0
        for k, w in enumerate(ids):
            m = masks.get(w)
            if m:
                u = v & m
                v = (v + u | v - u) & full
                found = len(item) - v.bit_count()
                if found > best:
                    best, end = found, k
        return best, end

    best, end = walk(item.tolist(), ids.tolist())
    if not best:
        return 0, 0, 0
    upto = ids[: end + 1]
    _, back = walk(item.tolist()[::-1], upto.tolist()[::-1])
    return best, int(at[end - back]), int(at[end])


def confirmed(space: Space, i: int, ids: np.ndarray, at: np.ndarray, low: int, high: int, least: float, least_answer: float):
    """The share of item *i* around words [low, high) of a document, or None if it is not contained."""
    q = space.queries[i]
    reach = len(q.ids)
    a, b = np.searchsorted(at, [low - reach, high + reach])
    if np.count_nonzero(space.holds[i][ids[a:b]]) < least * len(q.ids):
        return None
    found, first, last = lcs(q.ids, ids[a:b], at[a:b])
    if found < least * len(q.ids):
        return None
    answer = q.answer
    if not answer:
        ranked = sorted(set(q.ids.tolist()), key=lambda w: (-space.idf[w], w))
        answer = ranked[: max(1, len(ranked) // 2)]
    near = set(ids[a:b].tolist())
    if sum(w in near for w in answer) < least_answer * len(answer):
        return None
    return found / len(q.ids), first, last


def search(table: DataFrame, space: Space, cosine: float, latent: float, least: float, least_answer: float) -> DataFrame:
    """Confirmed stretches of every document: FOUND rows, one or more per (doc_id, item_id)."""
    shared = table.sparkSession.sparkContext.broadcast(space)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in _slices(it):
            ids, at, starts, n_words = arrays_of(batch)
            which, weight, square, first, per_doc = passages(ids, at, starts, n_words, s.idf, s.foreign)
            last = np.zeros(len(square), bool)
            last[(first + per_doc - 1)[per_doc > 0]] = True
            both = np.sqrt(square + np.where(last, 0, np.roll(square, -1)))
            rows: dict[tuple[int, int], tuple] = {}
            edges = np.searchsorted(which, np.arange(len(square) + 1))
            for lo in range(0, len(square), 512):
                some = slice(lo, min(len(square), lo + 512))
                far = min(len(square), some.stop + 1)
                e = slice(edges[lo], edges[far])
                follow = np.flatnonzero(~last[some])

                def windows(words: Scores, columns: int) -> np.ndarray:
                    sums = words.sums(which[e] - lo, ids[e], far - lo, columns)
                    out = sums[: some.stop - lo].copy()
                    out[follow] += sums[follow + 1]
                    return out

                window = windows(s.scores, len(s.queries))
                near = windows(s.leading, s.latent.shape[1])
                near /= np.maximum(1e-9, np.sqrt((near * near).sum(axis=1, keepdims=True)))
                least_sum = cosine * np.minimum(both[some, None], s.lengths)
                for k, i in zip(*np.nonzero((window >= least_sum) | (near @ s.latent.T >= latent))):
                    d = int(np.searchsorted(first, lo + k, side="right")) - 1
                    begin = int(lo + k - first[d]) * STEP
                    done = rows.get((d, int(i)))
                    if done is not None and done[0] <= begin and begin + 2 * STEP <= done[1] and done[2] is not None:
                        continue
                    own = slice(starts[d], starts[d + 1])
                    got = confirmed(s, i, ids[own], at[own], begin, begin + 2 * STEP, least, least_answer)
                    if got is not None and (done is None or done[2] is None or got[0] > done[2][0]):
                        rows[d, int(i)] = (begin, begin + 2 * STEP, got, float(window[k, i] / both[lo + k]))
            docs = batch.column("doc_id").to_pylist()
            out = [(docs[d], s.queries[i].item_id, c, *got) for (d, i), (_, _, got, c) in rows.items()]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [f.split()[0] for f in FOUND.split(", ")])

    return table.mapInArrow(batches, FOUND)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    cosine: float = 0.3,
    least: float = 0.6,
    least_answer: float = 0.5,
    max_df: float = 0.01,
    block_items: int = 256,
    longest: int = 48,
    answer_col: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    latent: float = 0.9,
) -> DataFrame:
    """Documents that contain a benchmark item: doc_id, item_id, cosine, share, first_word, last_word.

    One row per document and item, with the best stretch. *cosine* and *latent* are the least
    likeness of candidates by shared words and in the latent space; the column ``cosine`` is the
    former's, over the window's whole length, and can be below its threshold. Null and empty texts and items
    contain nothing and are contained in nothing; null ids and repeated rows are kept apart
    only by their ids; other columns are not read, so their names cannot clash; an empty
    table on either side gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", answer.alias("answer")).filter("length(text) > 0").orderBy("item_id", "text")
    found, block = [], []

    def finish() -> None:
        queries, vocabulary = queries_of(block, longest)
        if queries:
            table = written(known_words(texts, vocabulary))
            space = decompose(table, queries, len(vocabulary), max_df)
            found.append(search(table.filter("n_words >= 0"), space, cosine, latent, least, least_answer))
        block.clear()

    for item in items.toLocalIterator():
        block.append(item)
        if len(block) == block_items:
            finish()
    if block:
        finish()
    rows = spark.createDataFrame([], FOUND)
    for part in found:
        rows = rows.unionByName(part)
    best = F.max(F.struct("share", "cosine", -F.col("first_word"), F.col("last_word"), F.col("first_word"))).alias("b")
    return rows.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.cosine", "b.share", "b.first_word", "b.last_word")

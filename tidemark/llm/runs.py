"""Periodic runs of words by an enhanced suffix array, and texts with their repeats removed.

A run is a stretch of consecutive words with a smallest period q (words q apart are
identical) that no neighbouring word extends. The words of many documents are laid behind
each other, each document with word numbers of its own and an end mark of its own, so that
no repeat spans two documents, and numpy works on them together:

1. Prefix doubling sorts the suffixes; the ranks after each doubling are kept. Equal ranks
   of level k mean 2**k equal words, so the levels also give common prefixes and suffixes.
2. The intervals of the LCP array are enumerated with one stack, without tree nodes.
3. Branching-tandem test: in an interval of depth d, for every suffix i in any child but the
   largest, i + d or i - d lies in the same interval (its place is looked up in the inverse
   suffix array) but in another child exactly if a square of two roots of d words begins at
   i, or at i - d, whose next word breaks the period. Each suffix is in a smaller child at
   most log n times.
4. That square is the last one of its run; rotating it to the left, in steps of powers of
   two by the rank levels, gives the run's start. Squares with the same stretch are merged
   and the smallest root is the period.

An interval of fewer suffixes than *min_exponent* cannot hold a run of that exponent, since
a root occurs once a period; such intervals are left out.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
#: Words worked on together; a longer document is worked on alone.
BLOCK = 200_000


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _sorted_suffixes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffix array, its inverse and the rank levels; the last key of each document is unique."""
    n = len(keys)
    sa = np.argsort(keys, kind="stable").astype(np.int32)
    k = keys[sa]
    slots = np.arange(n, dtype=np.int32)
    new = np.r_[True, k[1:] != k[:-1]]
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(new, slots, 0))
    levels, step = [rank], 1
    single = new & np.r_[new[1:], True]
    live = slots[~single]
    while len(live):
        i = sa[live]
        ahead = i.astype(np.int64) + step
        after = np.where(ahead < n, rank[np.minimum(ahead, n - 1)].astype(np.int64) + 1, 0)
        key = rank[i].astype(np.int64) * (n + 1) + after
        order = np.argsort(key)
        sa[live] = i = i[order]
        key = key[order]
        new = np.r_[True, key[1:] != key[:-1]]
        rank = rank.copy()
        rank[i] = np.maximum.accumulate(np.where(new, live, 0))
        levels.append(rank)
        step *= 2
        live = live[~(new & np.r_[new[1:], True])]
    return sa, rank, levels


def _common_prefixes(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """LCP of each slot with the one before."""
    lcp = np.zeros(len(sa), np.int32)
    slots = 1 + np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]])
    a, b = sa[slots - 1].copy(), sa[slots].copy()
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][a] == levels[k][b]
        a[same] += 1 << k
        b[same] += 1 << k
    lcp[slots] = a - sa[slots - 1]
    return lcp


def _intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Depth, first and last slot of the LCP intervals, and (slot, interval) of their splits.

    Only stretches without a zero that hold *least* suffixes are walked.
    """
    zero = np.flatnonzero(np.r_[lcp, 0] == 0)
    wide = np.diff(zero) >= least
    spans = list(zip(zero[:-1][wide].tolist(), zero[1:][wide].tolist()))
    depth, first, last, at, own = [0], [0], [0], [], []
    for begin, end in spans:
        stack, top, deep = [0], 0, 0
        values = lcp[begin + 1 : end].tolist()
        values.append(0)
        for p, d in enumerate(values, begin + 1):
            left = p - 1
            while d < deep:
                last[top] = p - 1
                left = first[top]
                stack.pop()
                top = stack[-1]
                deep = depth[top]
            if d > deep:
                top, deep = len(depth), d
                stack.append(top)
                depth.append(d)
                first.append(left)
                last.append(0)
            if d:
                own.append(top)
        at.append(np.arange(begin + 1, end))
    splits = np.concatenate(at) if at else np.empty(0, np.int64)
    return tuple(np.array(x, np.int64) for x in (depth, first, last)) + (splits, np.array(own, np.int64))


def _branching_squares(sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and root length of the squares whose next word breaks the period."""
    depth, first, last, splits, own = _intervals(lcp, least)
    good = last - first + 1 >= least
    good[0] = False
    ids = np.flatnonzero(good)
    splits, own = splits[good[own]], own[good[own]]
    begin, owner = np.r_[first[ids], splits], np.r_[ids, own]
    if not len(begin):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.lexsort((begin, owner))
    begin, owner = begin[order], owner[order]
    change = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    end = np.r_[begin[1:], 0]
    end[np.r_[change[1:], len(begin)] - 1] = last[owner[change]] + 1
    size = end - begin
    sizes = np.diff(np.r_[change, len(begin)])
    largest = np.repeat(np.maximum.reduceat(size, change), sizes)
    place = np.where(size == largest, np.arange(len(size)), len(size))
    small = np.ones(len(size), bool)
    small[np.minimum.reduceat(place, change)] = False  # one largest child of each is left out
    begin, end, owner, size = begin[small], end[small], owner[small], size[small]
    slot = np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    child = np.repeat(np.arange(len(size)), size)
    i, d = sa[slot].astype(np.int64), depth[owner][child]
    starts, roots = [], []
    for j, start in ((i + d, i), (i - d, i - d)):
        inside = (j >= 0) & (j < len(sa))
        r = isa[np.where(inside, j, 0)]
        hit = inside & (r >= first[owner][child]) & (r <= last[owner][child]) & ((r < begin[child]) | (r >= end[child]))
        starts.append(start[hit])
        roots.append(d[hit])
    return np.concatenate(starts), np.concatenate(roots)


def runs_of(keys: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs, by start and period, of at least both minima."""
    sa, isa, levels = _sorted_suffixes(keys)
    start, root = _branching_squares(sa, isa, _common_prefixes(sa, levels), max(min_exponent, 2))
    end = start + 2 * root
    for k in range(len(levels) - 1, -1, -1):  # rotate to the left
        before = start - (1 << k)
        inside = before >= 0
        at = np.where(inside, before, 0)
        start = np.where(inside & (levels[k][at] == levels[k][at + root]), before, start)
    keep = end - start >= np.maximum(min_length, min_exponent * root)
    start, end, root = start[keep], end[keep], root[keep]
    order = np.lexsort((root, end, start))
    start, end, root = start[order], end[order], root[order]
    own = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
    start, end, root = start[own], end[own], root[own]
    order = np.lexsort((root, start))
    return start[order], end[order], root[order]


def _solve(texts: list[bytes], min_length: int, min_exponent: int) -> Iterator[tuple[int, list, str]]:
    """Number of words, runs and collapsed text of each text, worked on together."""
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words])
    offsets = np.r_[0, np.cumsum(sizes + 1)]
    numbers = _Numbers()
    keys = np.empty(offsets[-1], np.int64)
    for d, w in enumerate(words):
        keys[offsets[d] : offsets[d] + len(w)] = np.fromiter(map(numbers.__getitem__, w), np.int64, len(w))
    keys += np.repeat(np.arange(len(words)), sizes + 1) * len(numbers)
    keys[offsets[1:] - 1] = np.arange(len(words)) + len(words) * max(len(numbers), 1)
    start, end, period = runs_of(keys, min_length, min_exponent)
    doc = np.searchsorted(offsets, start, "right") - 1
    bounds = np.searchsorted(doc, np.arange(len(words) + 1)).tolist()
    for d, w in enumerate(words):
        mine = slice(bounds[d], bounds[d + 1])
        if bounds[d] == bounds[d + 1]:
            yield len(w), [], b" ".join(w).decode("utf-8", "replace")
            continue
        s, e, q = start[mine] - offsets[d], end[mine] - offsets[d], period[mine]
        inside = np.zeros(len(w) + 1, np.int64)
        np.add.at(inside, s + q, 1)
        np.add.at(inside, e, -1)
        left = np.flatnonzero(np.cumsum(inside[:-1]) == 0).tolist()
        runs = [{"start": a, "length": n, "period": p} for a, n, p in zip(s.tolist(), (e - s).tolist(), q.tolist())]
        yield len(w), runs, b" ".join([w[x] for x in left]).decode("utf-8", "replace")


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """*id_col*, n_words, runs (by start, then period) and collapsed for every row.

    Words are what ASCII white space leaves, told apart by case. Runs have at least
    *min_length* words and *min_exponent* periods. In ``collapsed`` a word is missing if any
    run contains it after that run's first period; the others are joined by one blank. A
    null, empty or blank text has no words, no runs and an empty ``collapsed``. Repeated
    rows and null ids give a row each; other columns are not read, so their names cannot
    clash; an empty table gives none. A document is one value, worked on in one task with
    memory in proportion to its words; shorter ones are worked on in blocks of 200,000.
    """
    if min_exponent < 2:
        raise ValueError("a run has at least two periods")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            ends = np.cumsum([t.count(b" ") + 2 for t in texts]).tolist()
            at = 0
            while at < len(texts):
                to = max(at + 1, bisect.bisect_right(ends, (ends[at - 1] if at else 0) + BLOCK))
                n, runs, left = zip(*_solve(texts[at:to], min_length, min_exponent))
                arrays = [batch.column(0).slice(at, to - at), pa.array(n, pa.int64()), pa.array(runs, RUN_TYPE), pa.array(left, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n_words", "runs", "collapsed"])
                at = to

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(batches, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string")
    return out.withColumnRenamed("id", id_col)

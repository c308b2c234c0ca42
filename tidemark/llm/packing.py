"""Harmonic packing of token ids into fixed sequences.

The capacity C is divided into reciprocal classes: class k < K takes pieces of exactly
``C // k`` ids, of which a bin holds k; the last class takes what is shorter than
``C // K``, and its bins hold as many pieces as follow each other and fit. A document is
cut greedily: as many whole sequences as it fills, then again and again the largest class
size that still fits into the rest. Each task fills the bins of each class on its own and
holds at most one open bin per class, so memory does not grow with the data and no
shuffle or coordination is needed. What stays open at the end of a task is chained into
full sequences, and the last rest is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import array
import os
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.memo import Memo

ID_BYTES = 4
#: A space before something that is not white space; no pre-token begins left of it and ends right of it.
CUT = re.compile(r" (?=\S)")
LONG = 10_000
AMBIGUOUS = re.compile(r" (?!\S)")
FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def encoder(path: str, pattern: str, keep: int = 250_000) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian unsigned 32-bit integers.

    The ids are those of ``tokenizers`` for the vocabulary file. Words between safe cuts
    are encoded once and remembered; their merges are run on the same vocabulary as a rank
    table, where an id is the rank of its merge. A text that holds a special token's
    string goes to ``tokenizers`` itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    letters = byte_letters(pre_tokenizers.ByteLevel.alphabet())
    vocabulary = {k: v for k, v in tokenizer.get_vocab().items() if k not in special}
    ranks = {bytes(letters[c] for c in k): v for k, v in vocabulary.items()}
    merges = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def coded(word: str) -> bytes:
        if len(word) > LONG:
            return array.array("I", tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        return array.array("I", merges.encode_ordinary(word)).tobytes()

    later = Memo(lambda word: coded(" " + word), keep)

    def of(text: str) -> bytes:
        if any(s in text for s in special):
            return array.array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        words = CUT.split(text) if AMBIGUOUS.search(text) else text.split(" ")
        return coded(words[0]) + b"".join(map(later.__getitem__, words[1:]))

    return of


def byte_letters(alphabet: list[str]) -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Letters of the alphabet below 256 that are printable stand for themselves; the other
    bytes have the letters from 256 on, in order.
    """
    known = {c: ord(c) for c in alphabet if ord(c) < 256}
    rest = iter(sorted(set(range(256)) - set(known.values())))
    return known | {c: next(rest) for c in sorted(c for c in alphabet if ord(c) >= 256)}


def harmonic_cut(length: int, capacity: int, classes: int) -> list[int]:
    """Sizes of a document's pieces, longest first: class sizes, then one short rest."""
    sizes = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if k >= classes:
            sizes.append(rest)
            break
        size = capacity // (k if capacity // k <= rest else k + 1)
        sizes.append(min(size, rest))
        rest -= sizes[-1]
    return sizes


def powers(length: int) -> list[int]:
    """*length* as powers of two, largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


class Bins:
    """Open bins of one task. A piece is (doc_id, start, ids as bytes, doc_tokens)."""

    def __init__(self, capacity: int, classes: int, first_id: int):
        self.capacity, self.classes, self.next_id = capacity, classes, first_id
        self.open: dict[int, tuple[list, int]] = {}

    def closed(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // ID_BYTES
            yield doc, start, n, zlib.crc32(ids), total, self.next_id, offset, ids
            offset += n
        self.next_id += 1

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        total = len(ids) // ID_BYTES
        at = 0
        for n in harmonic_cut(total, self.capacity, self.classes):
            piece = (doc, at, ids[at * ID_BYTES : (at + n) * ID_BYTES], total)
            at += n
            k = min(self.capacity // n, self.classes)
            held, filled = self.open.get(k, ([], 0))
            if held and (filled + n > self.capacity or k < self.classes and len(held) == k):
                yield from self.closed(held)
                held, filled = [], 0
            held.append(piece)
            filled += n
            if filled == self.capacity or k < self.classes and len(held) == k:
                yield from self.closed(held)
                held, filled = [], 0
            self.open[k] = (held, filled)

    def rest(self) -> Iterator[tuple]:
        """Chain what is open; the end goes into sequences of a power of two."""
        left = [p for k in sorted(self.open) for p in self.open[k][0]]
        self.open = {}
        total = sum(len(p[2]) for p in left) // ID_BYTES
        sizes = [self.capacity] * (total // self.capacity) + powers(total % self.capacity)
        i, used = 0, 0
        for size in sizes:
            held, room = [], size
            while room:
                doc, start, ids, n = left[i]
                take = min(room, len(ids) // ID_BYTES - used)
                held.append((doc, start + used, ids[used * ID_BYTES : (used + take) * ID_BYTES], n))
                used, room = used + take, room - take
                if used == len(ids) // ID_BYTES:
                    i, used = i + 1, 0
            yield from self.closed(held)


def pack(
    docs: DataFrame,
    path: str,
    pattern: str,
    capacity: int = 2048,
    end_id: int = 1,
    classes: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Sequences of at most *capacity* ids; one row per piece, with its ids as bytes.

    A document is its ids and then *end_id*, so a null or empty text is one piece of one
    id. Repeated rows and null ids are documents of their own; other columns are not read,
    so their names cannot clash; an empty table gives no rows. ``sequence_id`` is unique
    over all tasks (the task's partition in the upper bits), the same on a retry.
    *with_ids* leaves out the ids where only the layout is wanted.
    """
    end = end_id.to_bytes(ID_BYTES, "little")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern)
        bins = Bins(capacity, classes, TaskContext.get().partitionId() << 40)
        schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in (f.split()[0] for f in FIELDS.split(", "))])

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            if not with_ids:
                columns[-1] = [None] * len(rows)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

        for batch in it:
            rows: list[tuple] = []
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                for row in bins.add(doc, (encode(text) if text else b"") + end):
                    rows.append(row)
                    held += row[2]
                    if held > 1 << 22:
                        yield out(rows)
                        rows, held = [], 0
            if rows:
                yield out(rows)
        rows = list(bins.rest())
        if rows:
            yield out(rows)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    packed = chosen.mapInArrow(batches, FIELDS)
    return packed if with_ids else packed.drop("ids")

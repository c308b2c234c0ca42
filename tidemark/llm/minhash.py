"""Near-duplicate groups by min-max hashing, confirmed on full shingle sets.

Signatures: under each permutation both the minimum and the maximum of a document's
hashed shingles are kept, so a signature costs half the hash evaluations. Four
permutations make a band of eight values; the number of bands follows from the threshold
and from the accepted chance that a pair exactly at the threshold shares no band.

Documents with equal shingle sets are one class, found by an aggregation. Among classes,
pairs are made by stars only, never by expanding a bucket into all its pairs:

1. Each member of a bucket is compared with one member of it, the pivot; the shingles that
   it has more or less than the pivot are its difference. Members linked with the pivot
   are connected; no pair among them is needed.
2. Two members that are not both linked with the pivot can only be linked with each other
   if they share a large part of their differences (see :func:`_prefixes`). So, in a group
   whose members are not all connected yet, differences are ordered by how rare an element
   is in the group, and members that meet in a prefix of their differences form a smaller
   group, whose pivot is the member closest to the last pivot. Groups with the same members
   are one. Members that the shared element makes no pair with another component leave.

Steps 1 and 2 repeat until no group is left. Every pair of a bucket is thereby connected or
excluded, without a limit on sizes; a group gives one pair per member, loses its pivot and
all that is already connected in each round, and rare elements make groups small at once:
on families of thousands of edited copies the third round is the last.

Components are kept as a table of labels. The links of a round are contracted to pairs of
different labels first, so that later rounds work on the few components they still join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.memo import Memo
from tidemark.llm.shared import salted, written

P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
ROWS = 8
SLICE = 1024
#: Parts into which the members of one pivot are dealt.
WAYS = 64


def bands_for(threshold: float, miss: float = 1e-6) -> int:
    """Bands of eight values so that a pair at the threshold is missed with chance *miss* at most."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**ROWS))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * P1
    h = (h ^ (h >> np.uint64(29))) * P2
    return h ^ (h >> np.uint64(32))


class Shingles:
    """Sorted distinct 64-bit hashes of a text's *n*-word shingles.

    Words are what ASCII white space leaves, with A-Z in lower case. A text of fewer words
    has its whole sequence as its only shingle; one without words has none.
    """

    def __init__(self, n: int):
        self.n = n
        self.code = Memo(xxhash.xxh3_64_intdigest)

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        h = np.fromiter(map(self.code.__getitem__, words), np.uint64, len(words))
        width = min(self.n, len(words))
        if not width:
            return h
        out = np.full(len(words) - width + 1, np.uint64(width))
        for k in range(width):
            out = _mix(out) + h[k : k + len(out)]
        return np.unique(_mix(out))


class MinMax:
    """Bands of a shingle set."""

    def __init__(self, bands: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = bands * ROWS // 2
        self.bands = bands
        self.a = (rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)[:, None]
        self.weights = rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        high = np.zeros(len(self.a), np.uint32)
        for at in range(0, len(x), SLICE):
            h = self.a * x[None, at : at + SLICE] + self.b
            h ^= h >> np.uint32(15)
            np.minimum(low, h.min(axis=1), out=low)
            np.maximum(high, h.max(axis=1), out=high)
        values = np.concatenate([low.reshape(self.bands, -1), high.reshape(self.bands, -1)], axis=1).astype(np.uint64)
        keys = _mix((values * self.weights).sum(axis=1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64) * P1)
        return keys.view(np.int64)


def signatures(docs: DataFrame, words: int, bands: int) -> DataFrame:
    """(doc_id, text, *more*) to doc_id, n_shingles, set (a 128-bit digest of the shingle set; null if empty), bands, *more*."""
    more = docs.columns[2:]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, minmax = Shingles(words), MinMax(bands)
        for batch in it:
            sizes, digests, keys = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingles(text or b"")
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(minmax(s) if len(s) else None)
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "set", "bands", *more])

    kinds = "".join(f", {name} {docs.schema[name].dataType.simpleString()}" for name in more)
    return docs.mapInArrow(batches, f"doc_id long, n_shingles long, set binary, bands array<long>{kinds}")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, text) to (node, s), the sorted shingle hashes."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in it:
            sets = [shingles(text).view(np.int64) for text in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "s"])

    return texts.select("node", "text").mapInArrow(batches, "node long, s array<long>")


def _sift(docs: DataFrame, wanted: DataFrame, bits: int = 26) -> DataFrame:
    """The rows of *docs* whose ``node`` may be in *wanted*: all of these, and few others.

    A bit for each value of a hash of *bits* bits is broadcast, 8 MB at most however many
    rows there are. Beyond some hundred million wanted nodes it holds little back; what
    passes is joined afterwards in any case.
    """
    place = F.pmod(F.xxhash64("node"), F.lit(1 << bits))
    part, bit = F.floor(place / 32768).cast("int"), F.pmod(place, F.lit(32768))
    maps = written(wanted.groupBy(part.alias("_part")).agg(F.bitmap_construct_agg(bit).alias("_map")))
    near = docs.withColumn("_part", part).join(F.broadcast(maps), "_part")
    byte = F.conv(F.hex(F.substring(F.col("_map"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return near.filter(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1).drop("_part", "_map")


def _compared(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Add both sizes, the difference and whether they are linked to (node, pivot).

    A hot pivot's members are dealt over WAYS parts; its set is copied to those in use.
    """
    dealt = pairs.withColumn("way", F.pmod(F.xxhash64("node"), F.lit(WAYS)))
    parts = dealt.select(F.col("pivot").alias("node"), "way").distinct()
    copies = parts.join(sets, "node").select(F.col("node").alias("pivot"), "way", F.col("s").alias("_p"))  # one shuffle of sets serves both
    both = dealt.join(sets, "node").withColumnRenamed("s", "_a").join(copies, ["pivot", "way"])
    both = both.select("node", "pivot", F.size("_a").alias("n"), F.size("_p").alias("np"), F.array_except("_a", "_p").alias("_added"), F.array_except("_p", "_a").alias("_removed"))
    inter = F.col("n") - F.size("_added")
    linked = inter * den >= (F.col("np") + F.size("_added")) * num
    return both.select("node", "pivot", "n", "np", F.concat("_added", "_removed").alias("diff"), linked.alias("linked"))


def _first_stars(members: DataFrame) -> DataFrame:
    """(bucket, node) to distinct (node, pivot), the members of all buckets with that pivot.

    The pivot is the member with most mates over all its buckets: the closest to the middle
    of its group, so that most are linked with it.
    """
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("mates")).filter("mates > 1")
    shared = members.join(sizes, "bucket")
    weighted = shared.join(shared.groupBy("node").agg(F.sum("mates").alias("weight")), "node")
    pivots = weighted.groupBy("bucket").agg(F.max(F.struct("weight", "node"))["node"].alias("pivot"))
    return members.join(pivots, "bucket").filter("node <> pivot").select("node", "pivot").distinct()


def _floor(value: Column, by: int) -> Column:
    return ((value - F.pmod(value, F.lit(by))) / by).cast("long")


def _prefixes(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Per member of a group (g, label, diff, n, np, linked): the elements that it may meet others in.

    With s the threshold and c = (1 - s) / (1 + s), two sets A and B are linked when their
    symmetric difference is at most c * (|A| + |B|). With f = |difference from P| - c * size,
    that is: their differences from the pivot P share (f_A + f_B) / 2 elements at least. A
    member is linked with P itself when f <= c * |P|. Of a pair not known to be connected
    one member is not linked with P; take B as the one with the smaller f. Then B knows that
    (f_B + max(f_B, c * |P|)) / 2 elements are shared at least (more, if it is linked with
    P), and A knows (f_A + least f of the group) / 2. In one order of elements for the whole
    group, rare ones first, both have the first shared element among their first
    |difference| - shared + 1 ones; ``own`` marks those that hold for the smaller f.
    """
    d = F.size("diff")
    f = d * (den + num) - F.col("n") * (den - num)  # times den + num, so that bounds are whole numbers
    rows = rows.withColumn("d", d).withColumn("f", f)
    rows = salted(rows, rows.groupBy("g").agg(F.min("f").alias("f_least")), ["g"], "node")
    linked = _floor(F.col("f") + F.col("np") * (den - num), 2 * (den + num)) + 1
    shared = F.when(F.col("linked"), linked).otherwise(-_floor(-F.col("f"), den + num))
    rows = rows.withColumn("n_own", F.col("d") - F.greatest(shared, F.lit(1)) + 1)
    rows = rows.withColumn("n_any", F.col("d") - F.greatest(-_floor(-(F.col("f") + F.col("f_least")), 2 * (den + num)), F.lit(1)) + 1)
    elements = rows.select("g", "node", F.explode("diff").alias("e"))
    counts = elements.groupBy("g", "e").agg(F.count(F.lit(1)).alias("k"))
    ordered = elements.join(counts, ["g", "e"]).groupBy("g", "node").agg(F.array_sort(F.collect_list(F.struct("k", "e"))).alias("order"))
    met = rows.select("g", "node", "label", "d", "n_own", "n_any").join(ordered, ["g", "node"])
    met = met.withColumn("order", F.slice("order", 1, F.greatest("n_any", "n_own").cast("int")))
    return met.select("g", "node", "label", "d", "n_own", F.posexplode("order").alias("at", "x")).select("g", "node", "label", "d", F.col("x.e").alias("e"), F.col("x.k").alias("k"), (F.col("at") < F.col("n_own")).alias("own")).filter("k > 1")


def _next_stars(stars: DataFrame, compared: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """The groups (g, pivot, node) that are left after the comparisons of *stars*."""
    now = stars.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = now.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("g")
    met = written(_prefixes(written(salted(now, apart, ["g"], "node").join(compared, ["node", "pivot"])), num, den))
    own = F.col("own")
    lists = met.groupBy("g", "e").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"),
        F.min(F.when(own, F.col("label"))).alias("lo_own"), F.max(F.when(own, F.col("label"))).alias("hi_own"),
        F.min(F.when(own, F.struct("d", "node")))["node"].alias("q"),
        F.bit_xor(F.xxhash64("node")).alias("members"), F.count(F.lit(1)).alias("size"),
    )
    lists = lists.filter("lo < hi and q is not null")
    only = F.when(F.col("lo_own") == F.col("hi_own"), F.col("lo_own"))
    lists = lists.select("g", "e", "q", F.xxhash64("q", "members", "size").alias("next"), only.alias("only"))
    wanted = own | F.col("only").isNull() | (F.col("label") != F.col("only"))
    return met.join(lists, ["g", "e"]).filter(wanted & (F.col("node") != F.col("q"))).select(F.col("next").alias("g"), F.col("q").alias("pivot"), "node").distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and hash sum of the edges: equal for equal tables."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): the smallest node it reaches.

    Alternating large-star and small-star steps: each step hangs neighbours under the
    smallest one, which keeps the number of edges; written down after each round, until
    nothing changes.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = written(small.select("e.a", "e.b").filter("a > b").distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            return now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("label")), F.struct(F.col("b").alias("node"), F.col("b").alias("label")))).alias("e")).select("e.*").distinct()


def linked_labels(classes: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(node, label) of the classes (node, bands, key of a text) that are linked with another; *docs* have doc_id, text, key."""
    stars = written(_first_stars(classes.select("node", F.explode("bands").alias("bucket"))))
    wanted = stars.select("node").unionByName(stars.select(F.col("pivot").alias("node"))).distinct()
    wanted = written(classes.join(wanted, "node").select("node", "key"))
    texts = _sift(docs.withColumnRenamed("doc_id", "node"), wanted).join(wanted, ["node", "key"]).dropDuplicates(["node", "key"])
    sets = written(shingle_sets(texts, words))
    label = docs.sparkSession.createDataFrame([], "node long, label long")
    stars = stars.select(F.col("pivot").alias("g"), "pivot", "node")
    while not stars.isEmpty():
        compared = written(_compared(stars.select("node", "pivot").distinct(), sets, num, den))
        label = _merged(label, compared.filter("linked").select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        stars = written(_next_stars(stars, compared, label, num, den))
    return label


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, label) after new links (a, b); nodes without a row are their own label.

    Links are contracted to pairs of different labels before components are sought.
    """
    ends = links.join(label.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(label.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    pairs = ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a <> b").distinct()
    found = connected(pairs)
    moved = label.join(found.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return written(moved.unionByName(found.join(label, "node", "left_anti")))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document.

    Documents are linked when 100 * shared >= *percent* * united shingles; component_id is
    the smallest doc_id reachable over links, itself included. Null or wordless texts have
    no shingles and are linked with nothing. A row without an id joins its group but names
    none; alone, its component is null and it is kept. Repeated rows give a row each; where
    rows share an id but not the text, all are linked through equal sets, and one (the
    smallest digest) through similar ones. Other columns are not read, so their names
    cannot clash; an empty table gives none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("key"))
    component = F.coalesce("component", "doc_id")
    return _components(rows, words, percent, miss).select("doc_id", "n_shingles", component.alias("component_id"), kept(F.col("doc_id"), component).alias("kept"))


def text_key(text: Column) -> Column:
    """128 bits that tell texts apart; null for a null text."""
    return F.unhex(F.md5(text.cast("string").cast("binary")))


def _components(rows: DataFrame, words: int, percent: int, miss: float) -> DataFrame:
    """(doc_id, text, key) to doc_id, n_shingles, set, component (null without an id in the group), key."""
    signed = written(signatures(rows, words, bands_for(percent / 100, miss)))
    full = signed.filter("set is not null and doc_id is not null")
    classes = written(full.groupBy("set").agg(F.min("doc_id").alias("node")))
    single = classes.groupBy("node").agg(F.min("set").alias("set"))
    banded = full.select(F.col("doc_id").alias("node"), "set", "bands", "key").join(single, ["node", "set"]).dropDuplicates(["node", "set"])
    label = linked_labels(written(banded.select("node", "bands", "key")), rows, words, percent, 100)
    named = classes.join(label, "node", "left").select("set", F.coalesce("label", "node").alias("component"))
    return signed.drop("bands").join(named, "set", "left")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of *docs*, all columns, without all but one row of each near-duplicate group.

    Rows are told apart by id and text (its MD5), so that of rows with one id only those go
    whose own text is in a group that another row stands for. The row that stays has the
    smallest id (rows without one last), then the smallest MD5; repeated rows of it are one.
    Rows without words are in no group and all stay. Groups without any id are those of equal
    shingle sets.
    """
    key = text_key(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), key.alias("key"))
    found = _components(rows, words, percent, miss).filter("set is not null")
    group = F.coalesce(F.concat(F.lit("id "), F.col("component")), F.concat(F.lit("set "), F.hex("set")))
    found = found.select(group.alias("group"), "doc_id", "key").distinct()
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    gone = written(salted(found, first, ["group"], "key").filter(~stays).select(F.col("doc_id").alias("_id"), F.col("key").alias("_gone")))
    keyed = docs.withColumn("_key", key)
    left = keyed.join(gone, (keyed["_key"] == gone["_gone"]) & keyed[id_col].cast("long").eqNullSafe(gone["_id"]), "left_anti")
    said = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return left.filter(said).dropDuplicates([id_col, "_key"]).unionByName(left.filter(~said)).drop("_key")


def kept(doc_id: Column, component: Column) -> Column:
    """The group's first document stays; so does one without an id that is alone."""
    return F.coalesce(doc_id == component, component.isNull())

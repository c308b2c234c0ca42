"""A deterministic, sharded WARC writer and its reader.

Records are range-sorted by (id, payload digest): the id axis is cut into bins, bins are
joined to shards of about equal bytes, and each task writes its shard in order, so the
same rows give the same files on every run. A file is rolled before its compressed size
would pass the limit (a single larger record has a file of its own). Headers and digests
are made anew from the payload. Each task attempt writes under names of its own; only the
rows of attempts that succeeded reach the staged manifest, and only files it names are
moved to their final names and listed in the manifest that readers use.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BINS = 4096
CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STAGED = "shard long, seq long, staged string, name string, records long, bytes long, sha256 string"
ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"
HEADER_BYTES = 600


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, occurrence: int = 0) -> str:
    """The same record has the same id on every run, so a revisit can name its response unseen."""
    name = hashlib.sha256(f"{page_id}|{digest}|{occurrence}".encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=name[:16], version=5)}>"


def header_safe(text: str) -> str:
    """White space and control characters as percent codes, so a value cannot end its line."""
    return re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), text)


def member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member; no time or name in the gzip header."""
    fields = [*fields, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    head = CRLF.join([b"WARC/1.1", *(f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in fields), b"", b""])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head) + packer.compress(block) + packer.compress(CRLF + CRLF) + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, occurrence: int, date: str) -> bytes:
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest, occurrence)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", header_safe(url)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, digest))]
        if first is not None:
            fields.append(("X-Refers-To-Page-Id", str(first)))
    return member(fields, http if revisit else http + payload)


class Roller:
    """Files of one shard: opened when a record comes, closed when the next would not fit."""

    def __init__(self, folder: str, shard: int, limit: int, attempt: str, date: str):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.shard, self.limit, self.attempt, self.date = shard, limit, attempt, date
        self.seq, self.out = 0, None

    def add(self, data: bytes) -> Iterator[tuple]:
        if self.out is not None and self.size + len(data) > self.limit:
            yield self.close()
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.seq:06d}.warc.gz"
            self.staged = f"_temporary/{self.attempt}-{self.name}"
            self.fs.create_dir(f"{self.root}/_temporary")
            self.out = self.fs.open_output_stream(f"{self.root}/{self.staged}", compression=None)
            self.size, self.count, self.sha = 0, 0, hashlib.sha256()
            self._write(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name)), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._write(data)
        self.count += 1

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)
        self.sha.update(data)

    def close(self) -> tuple:
        self.out.close()
        self.out = None
        row = (self.shard, self.seq, self.staged, self.name, self.count, self.size, self.sha.hexdigest())
        self.seq += 1
        return row


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def revisits(slim: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, digest, first) of rows whose payload a smaller page_id has too.

    Counted before anything is joined, so a payload that a third of all pages share
    passes the shuffle as one row a task, and the join splits it where it is large.
    """
    firsts = slim.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return slim.filter(F.col("size") >= least_bytes).join(firsts, "digest").filter("not page_id <=> first").select("page_id", "digest", "first").distinct()


def shards(slim: DataFrame, shard_bytes: int) -> tuple[Column, DataFrame, int]:
    """The bin of an id, the shard of each bin (at most BINS + 1 rows), and the number of shards.

    Bins are fixed steps of the id axis; a bin is never split, files in it roll all the same.
    """
    ends = slim.agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi")).first()
    lo, hi = ends.lo or 0, ends.hi or 0
    width = (hi - lo) // BINS + 1
    place = F.when(F.col("page_id").isNull(), BINS).otherwise(F.floor((F.col("page_id") - F.lit(lo)) / F.lit(width))).cast("int")
    weights = sorted(tuple(r) for r in slim.groupBy(place.alias("bin")).agg(F.sum(F.col("size") + HEADER_BYTES)).collect())
    numbered, shard, held = [], 0, 0
    for at, weight in weights:
        if held and held + weight > shard_bytes:
            shard, held = shard + 1, 0
        held += weight
        numbered.append((at, shard))
    return place, slim.sparkSession.createDataFrame(numbered, "bin int, shard int"), shard + 1


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 0, shard_bytes: int = 32 << 20, file_bytes: int = 16 << 20, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of (page_id, url, html) below *folder*; returns the manifest.

    Null html is an empty payload, a null url leaves the target out, null ids sort last.
    Of equal payloads of *least_bytes* or more the smallest page_id is the response and
    the others revisit it; of repeated rows the first is the response. Other columns are
    not read, so their names cannot clash. An empty table gives an empty manifest.
    """
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    slim = keyed.select("page_id", "digest", F.octet_length("html").cast("long").alias("size"))
    place, numbered, count = shards(slim, shard_bytes)
    marks = revisits(slim, least_bytes).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "first", F.lit(0).alias("kind"))
    both = keyed.withColumns({"first": F.lit(None).cast("long"), "kind": F.lit(1)}).unionByName(marks)
    placed = both.withColumn("bin", place).join(F.broadcast(numbered), "bin").drop("bin")
    ordered = placed.repartitionById(count, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "digest", "kind", "url")

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = str(TaskContext.get().taskAttemptId())
        roller, mark, before, occurrence = None, None, None, 0
        for batch in it:
            done = []
            names = batch.schema.names
            for values in zip(*(batch.column(i) for i in range(batch.num_columns))):
                row = {n: v.as_py() for n, v in zip(names, values)}
                key = (row["page_id"], row["digest"])
                if row["kind"] == 0:
                    mark = (key, row["first"])
                    continue
                if roller is None or roller.shard != row["shard"]:
                    if roller is not None and roller.out is not None:
                        done.append(roller.close())
                    roller = Roller(folder, row["shard"], file_bytes, attempt, date)
                payload = row["html"].encode("utf-8", "surrogatepass")
                occurrence = occurrence + 1 if key == before else 0
                before = key
                if mark is not None and mark[0] == key:
                    first, again = mark[1], True
                else:
                    first, again = row["page_id"], occurrence > 0 and len(payload) >= least_bytes
                done += roller.add(page_record(row["page_id"], row["url"], payload, first, again, occurrence, date))
            if done:
                yield _batch(done, STAGED)
        if roller is not None and roller.out is not None:
            yield _batch([roller.close()], STAGED)

    spark = pages.sparkSession
    ordered.mapInArrow(write, STAGED).write.parquet(f"{folder}/_staged")

    def move(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in it:
            for staged, name, size in zip(*(batch.column(n).to_pylist() for n in ("staged", "name", "bytes"))):
                if fs.get_file_info(f"{root}/{staged}").type == pafs.FileType.File:
                    fs.move(f"{root}/{staged}", f"{root}/{name}")
                if fs.get_file_info(f"{root}/{name}").size != size:
                    raise OSError(f"{name}: not the {size} bytes that were written")
            yield batch

    spark.read.schema(STAGED).parquet(f"{folder}/_staged").mapInArrow(move, STAGED).drop("staged").write.parquet(f"{folder}/manifest")
    fs, root = pafs.FileSystem.from_uri(folder)
    if fs.get_file_info(f"{root}/_temporary").type == pafs.FileType.Directory:
        fs.delete_dir(f"{root}/_temporary")
    return spark.read.parquet(f"{folder}/manifest")


def members(stream) -> Iterator[bytes]:
    """Unpacked gzip members of a stream, one at a time."""
    data, opened, parts = b"", None, []
    while True:
        if not data:
            data = stream.read(1 << 20)
            if not data:
                if opened is not None:
                    raise ValueError("the last record is cut off")
                return
        opened = opened or zlib.decompressobj(31)
        parts.append(opened.decompress(data))
        data = opened.unused_data
        if opened.eof:
            yield b"".join(parts)
            opened, parts = None, []


def parse(record: bytes) -> tuple | None:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to); None for other types.

    Digests are computed again; a record that does not agree with its own raises an error.
    """
    head, _, rest = record.partition(CRLF + CRLF)
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != CRLF + CRLF or fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(CRLF + CRLF)
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if name in fields else None
    return number("X-Page-Id"), fields.get("WARC-Target-URI"), size, digest, kind, number("X-Refers-To-Page-Id")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every page record of the files that the manifest names; one record in memory at a time."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    files = manifest.count()

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in it:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for record in members(stream):
                        row = parse(record)
                        if row is not None:
                            rows.append((*row, name))
                        if len(rows) == 4096:
                            yield _batch(rows, ROWS)
                            rows = []
                yield _batch(rows, ROWS)

    return manifest.select("name").repartition(max(1, files)).mapInArrow(read, ROWS)

"""Archives: exact round trip, roles, rolling, determinism, damage."""

import base64
import gzip
import hashlib
import os

import duckdb
import pyarrow.fs as pafs
import pytest

from tidemark.llm import queries, warc
from tidemark.llm.shared import shared_folder

SF = "/root/testdata/sf0.001"
PAGES = [
    (3, "http://a/\r\nX: y", "same"), (1, None, "same"), (2, "http://b/ é", "other é🙂"), (2, "http://b/ é", "other é🙂"), (7, "u", None), (8, "u", ""),
    (None, "n", "same"), (None, "m", "lonely"), (None, "m", "lonely"), (9, "long", "x\r\n\r\n" * 50_000), (10**15, "far", "far"), (-5, "neg", "WARC/1.1\r\n"),
]


def files(folder):
    fs, root = pafs.FileSystem.from_uri(folder)
    return {n: hashlib.sha256(open(f"{root}/{n}", "rb").read()).hexdigest() for n in sorted(os.listdir(root)) if n.endswith(".gz")}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "clash") for r in PAGES], "page_id long, url string, html string, digest string")


def test_round_trip(spark, pages):
    folder = shared_folder(spark)
    manifest = warc.write_archive(pages, folder)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archive(spark, folder).collect()]
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    role = {3: ("revisit", 1), 1: ("response", None), 7: ("response", None), 8: ("revisit", 7), 9: ("response", None), 10**15: ("response", None), -5: ("response", None)}
    want = [(i, len((h or "").encode()), digest(h), *role[i]) for i, _, h in PAGES if i in role]
    want += [(2, 12, digest("other é🙂"), "response", None), (2, 12, digest("other é🙂"), "revisit", 2), (None, 4, digest("same"), "revisit", 1)]
    want += [(None, 6, digest("lonely"), k, None) for k in ("response", "revisit")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r.records for r in manifest.collect()) == len(PAGES)
    assert set(files(folder)) == {r.name for r in manifest.collect()}


def test_same_files_on_every_run_and_rolling(spark, pages):
    found = []
    for parts in (1, 5):
        folder = shared_folder(spark)
        warc.write_archive(pages.repartition(parts), folder, shard_bytes=20_000, file_bytes=1500)
        found.append(files(folder))
        _, root = pafs.FileSystem.from_uri(folder)
        for n in found[-1]:
            data = gzip.open(f"{root}/{n}").read()
            assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
            assert os.path.getsize(f"{root}/{n}") <= 1500 or data.count(b"\r\nX-Page-Id: ") == 1
    assert found[0] == found[1] and len(found[0]) > 3


def test_least_bytes(spark, pages):
    folder = shared_folder(spark)
    warc.write_archive(pages, folder, least_bytes=5)
    roles = sorted((r.payload_bytes, r.record_type) for r in warc.read_archive(spark, folder).collect())
    assert [k for n, k in roles if n < 5] == ["response"] * 6 and roles.count((12, "revisit")) == 1


def test_empty_and_damaged(spark, pages):
    folder = shared_folder(spark)
    assert warc.write_archive(pages.limit(0), folder).count() == 0
    assert warc.read_archive(spark, folder).count() == 0
    record = gzip.decompress(warc.page_record(1, "u", b"payload", 1, False, 0, "2000-01-01T00:00:00Z"))
    assert warc.parse(record)[0] == 1
    with pytest.raises(ValueError):
        warc.parse(record.replace(b"payload", b"pAyload"))
    assert "\r" not in warc.header_safe("a\r\nb c d")


def test_pages_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    cur = con.execute(queries.OP1_SQL)
    names = [d[0] for d in cur.description]
    assert sorted(queries.op1_warc(spark, SF).columns) == sorted(names)
    assert sorted(map(tuple, queries.op1_warc(spark, SF).select(*names).collect())) == sorted(cur.fetchall())

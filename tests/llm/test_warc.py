"""Archives: what is written is read back; records against a plain reader of the same bytes."""

import base64
import glob
import gzip
import hashlib
import re
from collections import Counter, defaultdict

import pytest

from reflexgrid.llm import warc as W


def want(pages):
    """Counter of (id, bytes, digest, type, refers to)."""
    groups = defaultdict(list)
    for id, _, html in pages:
        groups[(html or "").encode()].append(id)
    out = Counter()
    for payload, ids in groups.items():
        top = max(ids, key=lambda i: (i is not None, i))
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        rest = list(ids)
        rest.remove(top)
        out[(top, len(payload), digest, "response", None)] += 1
        for i in rest:
            out[(i, len(payload), digest, "revisit", top)] += 1
    return out


def got(df):
    rows = df.collect()
    assert all(r["intact"] for r in rows)
    return Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows)


def plain_records(data):
    """Offsets of the records of one archive, walked from its start."""
    at, out = 0, []
    while at < len(data):
        assert data[at:].startswith(b"WARC/1.1\r\n")
        end = data.index(b"\r\n\r\n", at) + 4
        length = int(re.search(rb"\r\nContent-Length: (\d+)", data[at:end])[1])
        assert data[end + length : end + length + 4] == b"\r\n\r\n"
        out.append(at)
        at = end + length + 4
    return out


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\nfake\r\n\r\n"
PAGES = [
    (1, "http://a/1", "<p>one</p>"),
    (2, "http://a/2", "<p>one</p>"),
    (2, "http://a/2", "<p>one</p>"),
    (3, "http://a/3", FAKE),
    (4, None, "before\r\n\r\n" + FAKE * 3 + "after"),
    (5, "http://a/\r\nWARC/1.1\r\n5", None),
    (6, "", ""),
    (7, "u", "\r\n\r\n"),
    (8, "u", "WARC/1." * 500 + "é\U0001f600"),
    (9, "u", "x" * 300_000 + FAKE + "y" * 300_000),
    (10, "u", "ends with magic WARC/1."),
    (11, "u", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"),
    (None, "u", "no id"),
    (None, "u", "<p>one</p>"),
    (12, "u", "WARC/1.0\r\nContent-Length: 99999999999999999999\r\n\r\n"),
    (14, "WARC/1.1", "\r\nWARC/1." * 5),
    (13, "u", "nul \x00 and \r lone"),
]
SCHEMA = "page_id bigint, url string, html string"


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_awkward_pages(spark, compression):
    df = spark.createDataFrame(PAGES, SCHEMA)
    assert got(W.archive(df, compression=compression)) == want(PAGES)
    clash = df.selectExpr("*", *[f"'x' as {c}" for c in ("file", "block", "seq", "off", "digest", "n", "id", "top", "to", "value", "record", "time")])
    assert got(W.archive(clash, compression=compression)) == want(PAGES)
    assert got(W.archive(df.where("false"), compression=compression)) == Counter()


def test_splits_meet_anywhere(spark, tmp_path):
    """Small splits cut heads, payloads and magic at every kind of place; offsets are those of a walk over the bytes."""
    rows = PAGES + [(100 + i, f"http://b/{i}", ("ab\r\n" * (i % 40) + FAKE * (i % 3) + "\r\n" * (i % 5)) * (1 + i % 4)) for i in range(400)]
    path = f"{tmp_path}/plain"
    W.write(spark.createDataFrame(rows, SCHEMA).coalesce(2), path, compression="none")
    truth = {}
    for f in glob.glob(path + "/part-*"):
        with open(f, "rb") as h:
            truth[f.rsplit("/", 1)[1]] = plain_records(h.read())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (2999, 100_000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            found = defaultdict(list)
            for r in W.read(spark, path).select("file", "off").collect():
                found[r["file"].rsplit("/", 1)[1]].append(r["off"])
            assert {f: sorted(v) for f, v in found.items()} == {f: v for f, v in truth.items() if v}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_broken_chain_ends(spark, tmp_path):
    good = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 22\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabc\r\n\r\n"
    bad = good.replace("Length: 22", "Length: 21")
    (tmp_path / "a.warc").write_bytes((good * 3 + bad + good).encode())
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(good.encode()) + gzip.compress(good.encode()))  # a member per record
    (tmp_path / "c.warc").write_bytes(b"junk before " + good.encode())
    (tmp_path / "d.warc").write_bytes(b"")
    inner = good * 2
    (tmp_path / "e.warc").write_bytes(f"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: {len(inner)}\r\n\r\n{inner}\r\n\r\n{good}".encode())  # an archive as a block
    found = {}
    for r in W.read(spark, str(tmp_path)).select("file", "off").collect():
        found.setdefault(r["file"].rsplit("/", 1)[1], []).append(r["off"])
    outer = (tmp_path / "e.warc").stat().st_size - len(good)
    assert {f: sorted(v) for f, v in found.items()} == {"a.warc": [len(good) * i for i in range(4)], "b.warc.gz": [0, len(good)], "e.warc": [0, outer]}


def test_given_pages(spark):
    import duckdb

    from reflexgrid.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    pages = duckdb.sql(f"select page_id, url, html from '{folder}/pages.parquet'").fetchall()
    assert got(QUERIES["op13_warc"](spark, folder)) == want(pages)

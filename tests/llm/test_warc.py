import gzip
import io
from collections import Counter

import duckdb
import pytest

from schemaloom.llm import oracle, warc

SCHEMA = "page_id long, url string, html string, payload string, digest int"
PAGES = [
    (1, "http://a/1", "same", "x", 1),
    (2, "http://a/2 \r\nX: y", "same", None, None),
    (3, None, "same", "x", 1),
    (3, None, "same", "x", 1),
    (4, "http://b", "", "x", 1),
    (5, "http://b", None, "x", 1),
    (6, "http://é", "<html>\r\n\r\nWARC/1.1\r\n" * 1000, "x", 1),
    (7, "u", "long " * 100_000, "x", 1),
    (None, "u", "same", "x", 1),
    (8, "u", "\x00日本", "x", 1),
]


def round_trip(spark, pages, folder, **options):
    files = warc.write_warc(warc.roles(pages, **options), folder)
    return warc.read_warc(spark, folder, files).collect()


@pytest.mark.parametrize("archive_bytes", [1, 256 << 20])
def test_round_trip(spark, tmp_path, monkeypatch, archive_bytes):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive_bytes)
    rows = round_trip(spark, spark.createDataFrame(PAGES, SCHEMA).repartition(3), f"file://{tmp_path}/w")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)
    largest = {}
    for p, _, html, *_ in PAGES:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if p is None else p)
    expected = Counter()
    for p, _, html, *_ in PAGES:
        raw, first = (html or "").encode(), largest[html or ""]
        expected[(p, len(raw), warc.sha1_of(raw), *(("response", None) if p == first else ("revisit", first)))] += 1
    assert got == expected
    texts = {p: (html or "").encode() for p, _, html, *_ in PAGES}
    assert all(r.payload == texts[r.page_id] for r in rows if r.record_type == "response")
    assert {r.url for r in rows if r.page_id == 2} == {"http://a/2%20%0D%0AX:%20y"}


def test_small_payloads_are_stored_each(spark, tmp_path):
    rows = round_trip(spark, spark.createDataFrame(PAGES, SCHEMA), f"file://{tmp_path}/w", smallest=1)
    assert {r.page_id: r.record_type for r in rows if r.page_id in (4, 5)} == {4: "response", 5: "response"}


def test_nothing(spark, tmp_path):
    assert round_trip(spark, spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/w") == []


def test_members_are_gzip_records():
    parts = [warc.record(i, "u", b"x" * i, "response", None) for i in range(3)]
    assert all(gzip.decompress(p).startswith(b"WARC/1.1\r\n") for p in parts)
    assert [r["payload_bytes"] for r in warc.records(io.BytesIO(b"".join(parts)))] == [0, 1, 2]


def test_damage_is_loud():
    good = warc.record(1, "u", b"payload " * 1000, "response", None)
    wrong = gzip.compress(gzip.decompress(good).replace(b"payload ", b"pAyload ", 1))
    short = gzip.compress(gzip.decompress(good)[:-3])
    for bad in (good[:-20], wrong, short, b"not gzip at all", gzip.compress(b"HTTP/1.1\r\n\r\n")):
        with pytest.raises(warc.DamagedArchive):
            list(warc.records(io.BytesIO(bad)))


def test_twin_knows_base32():
    db = duckdb.connect()
    db.sql("CREATE TABLE pages AS SELECT 1 AS page_id, 'abc' AS html")
    assert db.sql(oracle.SQL["op8_warc"]).df().payload_digest[0] == warc.sha1_of(b"abc")

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pytest
from corpus_fixtures import docs, folder  # noqa: F401

from shelfmark.llm import warc
from shelfmark.llm.queries import QUERIES


def plain(rows):
    bodies = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for page_id, body in bodies:
        ids = [i for i, b in bodies if b == body and i is not None]
        first = min(ids, default=None)
        revisit = first is not None and page_id != first
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((page_id, len(body), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_query(spark, folder, monkeypatch):
    monkeypatch.setattr(warc, "_FILE_BYTES", 2000)
    rows = [(i, f"http://x/{i}\r\nWARC/1.1", "é\r\n\r\nWARC/1.1\r\n" * (i % 7)) for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (None, "u", "x"), (None, "u", "lone"), (7, "u", rows[7][2]), (102, "u", "q" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = QUERIES["op6_warc_archives"](spark, folder(pages=pages)).collect()
    assert sorted(map(tuple, found), key=str) == plain(rows)


def test_empty_table(spark, folder):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert QUERIES["op6_warc_archives"](spark, folder(pages=pages)).count() == 0


def test_streams_of_any_number_of_members():
    records = [warc.make_record("response", {"X-Page": f"page:{i}"}, b"x" * i) for i in range(50)]
    whole = gzip.compress(b"".join(records))
    members = b"".join(map(gzip.compress, records))
    for data in (whole, members):
        assert [p for _, p in warc.records_of(io.BytesIO(data))] == [b"x" * i for i in range(50)]
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(gzip.compress(b"".join(records)[:-3]))))


def test_inflating_is_bounded_and_cut_streams_are_noticed():
    record = warc.make_record("response", {"X-Page": "page:1"}, b"x" * (200 << 20))
    small = warc.make_record("response", {"X-Page": "page:2"}, b"y")
    data = gzip.compress(small + record + small, 1)
    assert len(data) < 2 << 20
    pieces = [len(piece) for piece in warc._inflated(io.BytesIO(data))]
    assert max(pieces) <= warc._CHUNK and sum(pieces) == 2 * len(small) + len(record)
    assert [len(p) for _, p in warc.records_of(io.BytesIO(data))] == [1, 200 << 20, 1]
    whole = gzip.compress(small)
    for cut in (whole[:-1], whole[:-8], whole + whole[:-5]):  # every record is there, the member's end is not
        with pytest.raises(ValueError):
            list(warc.records_of(io.BytesIO(cut)))


def test_archives_of_empty_payloads_are_bounded(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "_FILE_BYTES", 10_000)
    pages = spark.createDataFrame([(i, None, "u") for i in range(300)], "page_id bigint, html string, url string").coalesce(1)
    manifest = warc.write_monolithic(pages, str(tmp_path / "w"))
    sizes = [r["count"] for r in manifest.groupBy("file").count().collect()]
    assert sum(sizes) == 300 and max(sizes) < 60

from __future__ import annotations

import gzip
import hashlib
import random

import pytest

from tidemark.llm import warc

BIG = "<p>" + "é" * 800
PAGES = "page_id long, url string, html string"


def _want(pages):
    top = {}
    for i, _, html in pages:
        raw = (html or "").encode()
        if len(raw) >= 1000 and i is not None:
            top[raw] = max(top.get(raw, i), i)
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        to = top.get(raw) if sum((h or "").encode() == raw for _, _, h in pages) > 1 else None
        revisit = len(raw) >= 1000 and to is not None and to != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def _got(frame):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted((tuple(r) for r in warc.pages_through_warc(frame).select(*names).collect()), key=str)


def test_round_trip_with_odd_rows(spark):
    rnd = random.Random(2)
    pages = [
        (1, "http://a/", BIG), (2, None, BIG), (3, "u v\n", None), (4, "http://c/", "s"), (5, "http://d/", "s"), (6, "http://a/", BIG), (None, "x", BIG), (None, None, "t"),
        (7, "http://e/", "\r\n\r\nWARC/1.1\r\n\x1f\x8b"), (8, "http://f/", ""), (9, "http://é/", "x" * 6_000_000), (10, "http://g/", "x" * 6_000_000), (8, "http://f/", ""),
    ]
    pages += [(100 + k, f"http://h{k}/", "".join(rnd.choices("abc <>", k=rnd.randrange(3000)))) for k in range(300)]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], PAGES + ", payload string")
    assert _got(frame) == _want(pages)


def test_empty_table(spark):
    assert _got(spark.createDataFrame([], PAGES)) == []


@pytest.mark.parametrize("version", [1, 2, None])
def test_legacy_archives_of_both_versions(spark, version):
    pages = [(k, f"http://h{k}/ a b", "\n" * (k % 5) + f"page {k}\r\n\r\n" + "y" * (k * 40_000 % 90_001)) for k in range(150)]
    archives = warc.pages_to_arc(spark.createDataFrame(pages, PAGES).coalesce(1), version)
    held = archives.collect()
    assert len(held) > 1 and len({r["name"] for r in held}) == len(held)
    lines = {bytes(r["content"]).split(b"\n")[1][:1] for r in held}
    assert lines == ({b"1", b"2"} if version is None else {str(version).encode()})
    rows = warc.arc_records(archives).collect()
    assert sorted((r["page_id"], r["payload"], r["payload_digest"]) for r in rows) == sorted((k, h, hashlib.sha1(h.encode()).hexdigest()) for k, _, h in pages)
    assert {r["url"] for r in rows} == {f"http://h{k}/%20a%20b" for k in range(150)}


def test_broken_legacy_archives():
    good = warc.arc_version_block("n.arc", 1) + warc.arc_record("n.arc", 1, 0, 1, "http://a/", "abc") + b"\n"
    assert [r["url"] for r in warc.parse_arc(good)] == ["http://a/"]
    for bad in (good[:-4], good.replace(b"http://a/ 0.0.0.0", b"http://a/"), b"3 0 x\n" + good, good.replace(b"text/html ", b"text/html -")):
        with pytest.raises(ValueError):
            list(warc.parse_arc(bad))


def _record(kind, block, **fields):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    records = [
        _record("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"),
        _record("request", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request"),
        _record("response", b"HTTP/1.1 200 OK\r\n\r\nhello", WARC_Target_URI="http://a/", WARC_Payload_Digest="sha1:" + "A" * 32),
        _record("response", b"HTTP/1.1 200 OK\r\nX-Page-Id: 4\r\n\r\nhello"),
        _record("revisit", b"", WARC_Payload_Digest="sha1:BASE32"),
        _record("resource", b"plain"),
    ]
    (tmp_path / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    rows = warc.read_warc(spark, str(tmp_path))
    own = hashlib.sha1(b"hello").hexdigest()
    assert rows.count() == 3 * len(records)
    responses = [tuple(r) for r in rows.filter("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest").collect()]
    assert sorted(responses, key=str) == sorted([(None, 5, own), (4, 5, own)] * 3, key=str)
    revisits = [tuple(r) for r in rows.filter("record_type = 'revisit'").select("payload_bytes", "payload_digest", "refers_to").collect()]
    assert revisits == [(None, "BASE32", None)] * 3


def test_damaged_records():
    good = _record("response", b"HTTP/1.1 200 OK\r\n\r\nhello", WARC_Block_Digest="sha1:" + hashlib.sha1(b"HTTP/1.1 200 OK\r\n\r\nhello").hexdigest())
    assert len(list(warc.parse_warc(good + good))) == 2
    for bad in (good.replace(b"hello", b"hallo"), good[:-8], good.replace(b"Content-Length: ", b"Content-Length: x"), b"WARC/1.0", b"junk\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse_warc(bad))
    for bad in (gzip.compress(good)[:-3], gzip.compress(good) + b"junk"):
        with pytest.raises(ValueError):
            list(warc.members(bad))

import hashlib

import pytest

from relaylens.llm import archives as A


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, value string"
                                 ).repartition(3)


LONG = "<p>" + "x" * 100


def slow(rows):
    """What contract and docstring ask for, row by row."""
    out = []
    for i, _, html, _ in rows:
        payload = (html or "").encode()
        same = [j for j, _, h, _ in rows if (h or "") == (html or "") and j is not None]
        again = len(payload) >= 100 and same and i != min(same)
        out.append((i, len(payload), hashlib.sha256(payload).hexdigest(),
                    "revisit" if again else "response", min(same) if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sent", [200_000, 0])
@pytest.mark.parametrize("file_bytes", [16 << 20, 1])
def test_round_trip(spark, monkeypatch, sent, file_bytes):
    monkeypatch.setattr(A, "SENT", sent)
    monkeypatch.setattr(A, "FILE_BYTES", file_bytes)
    rows = [(1, "http://a/1", LONG, "v"), (2, "http://a/2", LONG, "v"), (3, None, None, "v"),
            (4, "http://a/ b\n?x=é", "", None), (5, "", "short", "v"), (6, "x", "short", "v"),
            (7, "http://a/7", "WARC/1.1\r\n\r\n\r\nHTTP/1.1 200 OK\r\n\r\n1 0 x\n" * 9, "v"),
            (8, "http://a/8", "日本" * 70000, "v"), (9, "http://a/9", LONG, "v"),
            (None, "http://a/n", LONG, "v")]
    got = A.through_archives(pages(spark, rows))
    assert sorted((tuple(r) for r in got.select(
        "number", "payload_bytes", "payload_digest", "type", "refers_to_number").collect()),
        key=repr) == slow(rows)
    ids = {r["record_id"]: r for r in got.collect()}
    assert len(ids) == len(rows)
    for r in ids.values():
        assert (r["refers_to"] is not None) == (r["type"] == "revisit")
        if r["refers_to"]:
            assert ids[r["refers_to"]]["payload_digest"] == r["payload_digest"]


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "http://a/1", LONG, "v")] * 3
    kinds = [(r["type"], r["refers_to_number"])
             for r in A.through_archives(pages(spark, rows)).collect()]
    assert sorted(kinds, key=repr) == [("response", None), ("revisit", 1), ("revisit", 1)]
    assert A.through_archives(pages(spark, rows).limit(0)).count() == 0


def test_both_versions_are_parsed():
    for version in (1, 2):
        block = A.http_block(b"payload\nhttp://x 1 2 3 4\n", 5)
        data = A.version_block(version, "x.arc") + b"\n" + A.arc_record(
            version, "x.arc", "http://a/with blank", block, 9) + b"\n" + A.arc_record(
            version, "x.arc", "dns:a", b"20240101 a 1.2.3.4", 99) + b"\n"
        info, page, dns = A.arc_records(data)
        assert info[1]["URL"] == "filedesc://x.arc"
        assert page[1]["URL"] == "http://a/with blank" and page[2] == block
        assert A.described("x.arc", *page)["kind"] == "response"
        assert A.described("x.arc", *dns)["kind"] == "resource"
        assert A.described("x.arc", *info)["kind"] == "warcinfo"


def test_damaged_archives():
    good = A.arc_record(1, "x", "http://a", A.http_block(b"1", 1), 0)
    data = b"no header\n" + good + b"\n" + good[:-1]
    assert [r[1]["URL"] for r in A.arc_records(data)] == ["http://a"]
    assert list(A.arc_records(b"")) == [] and list(A.warc_records(b"junk")) == []


def test_dates():
    assert A.iso_date("20010203040506") == "2001-02-03T04:05:06Z"
    assert A.iso_date("200102030405") == "2001-02-03T04:05:00Z"
    assert A.iso_date("20011303040506") == A.iso_date("") == A.iso_date(A.CLOCK)


def test_headers_of_all_types():
    block = A.http_block(b"body", 3)
    r = A.described("f.arc", 7, {"URL": "http://a", "Archive-date": "19991231235959",
                                 "IP-address": "1.2.3.4", "Content-type": "text/html"}, block)
    to = {"record_id": "urn:uuid:1", "url": "http://b", "date": "d", "number": 1}
    (fields, back), = A.warc_records(A.warc_record(r, None) + b"\r\n\r\n")
    assert back == block and fields["WARC-Type"] == "response"
    assert fields["WARC-Date"] == "1999-12-31T23:59:59Z" and fields["WARC-IP-Address"] == "1.2.3.4"
    assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(b"body").hexdigest()
    (fields, back), = A.warc_records(A.warc_record(r, to) + b"\r\n\r\n")
    assert fields["WARC-Type"] == "revisit" and fields["WARC-Refers-To"] == "<urn:uuid:1>"
    assert back == r["head"] and fields["WARC-Profile"] == A.PROFILE

"""WARC archives: what is read back is what was written, in pieces of any size."""

import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from wattline.llm import warc
from wattline.llm.shipping import ship

SCHEMA = "page_id long, url string, html string, row long, chunk string, archive int, digest string"


def table():
    html = ["a" * 150, "a" * 150, None, "", "é" * 60, "é" * 60, "x\r\n\r\ny" * 60_000, "x\r\n\r\ny" * 60_000, "short", "short", "WARC/1.1\r\n" * 20]
    rows = [(i, f"http://x/{i}\r\nEvil: {i}" if i % 3 else None, h, 0, "c", 1, "d") for i, h in enumerate(html)]
    more = [(None, None, "a" * 150), (3, "u", ""), (1, "http://x", "a" * 150), (1, "http://x", "a" * 150), (None, None, None), (20, "é ü", "b" * 100), (19, "", "b" * 100)]
    return rows + [(*r, 0, "c", 1, "d") for r in more]


def brute(rows):
    first = {}
    for p, _, h, *_ in rows:
        key = (h or "").encode()
        first[key] = min(first.get(key, (True, 0)), (p is None, p or 0))
    out, seen = [], set()
    for p, _, h, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (h or "").encode()
        response = len(b) < 100 or b not in seen
        seen.add(b)
        to = None if response or first[b][0] else first[b][1]
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "response" if response else "revisit", to))
    return out


@pytest.fixture(scope="module")
def written(spark):
    ship(spark)
    return warc.write_archives(spark.createDataFrame(table(), SCHEMA).repartition(3), chunk_bytes=100, archive_bytes=3000)


def test_round_trip_agrees_with_brute_force(written):
    got = warc.pages_of(warc.read_archives(written, payload=False))
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, brute(table())))
    assert written.agg(F.sum("records")).first()[0] == len(table())


def test_chunks_are_bounded_and_carry_running_digests(written):
    chunks = warc.read_archives(written, chunk_bytes=77).where("record_type = 'response'")
    assert chunks.agg(F.max(F.octet_length("chunk"))).first()[0] <= 77
    of = {}
    for r in chunks.collect():
        of.setdefault((r["archive"], r["offset"]), []).append(r)
    payloads = []
    for rs in of.values():
        rs.sort(key=lambda r: r["chunk_no"])
        whole = b"".join(r["chunk"] for r in rs)
        assert [r["chunk_no"] for r in rs] == list(range(len(rs)))
        assert [r["bytes_so_far"] for r in rs] == [min(77 * (i + 1), len(whole)) for i in range(len(rs))]
        assert [r["payload_digest"] for r in rs[:-1]] == [None] * (len(rs) - 1)
        assert rs[-1]["payload_digest"] == hashlib.sha256(whole).hexdigest()
        payloads.append(whole)
    texts, seen = [], set()
    for b in ((r[2] or "").encode() for r in table()):
        if len(b) < 100 or b not in seen:
            texts.append(b)
        seen.add(b)
    assert sorted(payloads) == sorted(texts)
    joined = {bytes(r["payload"]) for r in warc.payload_of(chunks).collect()}
    assert joined == set(texts)


def test_headers_cannot_be_broken_and_revisits_name_their_response(written):
    back = warc.pages_of(warc.read_archives(written)).collect()
    ids = {r["record_id"] for r in back}
    assert len(ids) == len(back) == len(table())
    assert {r["url"] for r in back if r["page_id"] == 4} == {"http://x/4%0D%0AEvil:%204"}
    to = warc.read_archives(written, payload=False).where("record_type = 'revisit'").select("refers_to_id").collect()
    assert to and all(r[0] in ids for r in to)


def test_empty_table_and_damage(spark, written):
    ship(spark)
    none = warc.write_archives(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and warc.pages_of(warc.read_archives(none)).count() == 0
    path = written.where("payload_bytes > 100000").first()["archive"].removeprefix("file://")
    good = open(path, "rb").read()
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(good[: len(good) // 2])))


def test_plain_archives_and_other_record_types():
    body = b"software: x\r\n"
    plain = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\ncontent-length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + b"p" * 10
    plain += b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(http), http)
    for data in (plain, gzip.compress(plain)):
        rows = list(warc.records(io.BytesIO(data), 4))
        assert [(r[2], r[9], r[10]) for r in rows] == [
            ("warcinfo", 0, b"soft"), ("warcinfo", 1, b"ware"), ("warcinfo", 2, b": x\r"), ("warcinfo", 3, b"\n"),
            ("response", 0, b"pppp"), ("response", 1, b"pppp"), ("response", 2, b"pp"),
        ]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"not an archive\n")))

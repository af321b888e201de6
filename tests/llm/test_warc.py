import base64
import gzip
import hashlib
import io
import random

import pytest

from clonalyze.llm import warc as W


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(data, least=0):
    top = {}
    for i, _, h in data:
        p = (h or "").encode()
        if i is not None and len(p) >= least:
            top[p] = max(top.get(p, i), i)
    out = []
    for i, _, h in data:
        p = (h or "").encode()
        to = top[p] if i is not None and len(p) >= least and i < top[p] else None
        out.append((i, len(p), sha(p), "response" if to is None else "revisit", to, None))
    return sorted(out, key=repr)


def got(spark, df, **options):
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"]
    return sorted([tuple(r) for r in W.archive_pages(spark, df, **options).select(*cols).collect()], key=repr)


PAGES = [(1, "http://a/ä b\r\n", "<p>x</p>"), (2, None, "<p>x</p>"), (7, "http://c", "<p>x</p>"), (3, "u", None), (4, "v", ""), (5, "w", "é" * 10),
         (None, "n", "<p>x</p>"), (None, "n", "alone"), (8, "r", "rep"), (8, "r", "rep"), (6, "big", "long page " * 300_000), (-9, "neg", "WARC/1.1\r\n\r\n\r\n\r\nHTTP/1.1 200 OK\r\n\r\n")]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, rows, least):
    assert got(spark, rows("page_id long, url string, html string", PAGES), least_bytes=least) == brute(PAGES, least)


def test_payloads_come_back(spark, rows):
    out = W.archive_pages(spark, rows("page_id long, url string, html string", PAGES), keep_payload=True).filter("record_type = 'response'")
    for r in out.collect():
        assert sha(r["payload"]) == r["payload_digest"] and len(r["payload"]) == r["payload_bytes"] and "\r" not in r["target_uri"]


def test_hot_page_and_empty_table(spark, rows):
    data = [(i, "u", "hot" if i % 3 else f"page {i % 50}") for i in range(2000)]
    assert got(spark, rows("page_id long, url string, html string, _id string", [(*d, "x") for d in data], 6)) == brute(data)
    assert got(spark, rows("page_id long, url string, html string", [])) == []


def archive(n=5):
    rnd = random.Random(1)
    payloads = [bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 1, 1000, 300_000]))) for _ in range(n)]
    members = [W.gzip_member(W.record_bytes(i, "http://x", p, sha(p), None)) for i, p in enumerate(payloads)]
    return payloads, members


class Slow(io.BytesIO):
    """Gives a few bytes at a time, so that every boundary is crossed somewhere."""

    def read(self, n=-1):
        return super().read(min(n, 4099))


def test_one_gzip_member_per_record_and_standard_framing():
    payloads, members = archive()
    for p, m in zip(payloads, members, strict=True):
        raw = gzip.decompress(m)
        head, block = raw.split(b"\r\n\r\n", 1)
        length = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert raw.startswith(b"WARC/1.1\r\n") and block[length:] == b"\r\n\r\n" and block[:length].endswith(p)


def test_incremental_reader():
    payloads, members = archive(12)
    out = list(W.read_records(Slow(b"".join(members)), keep_payload=True))
    assert [r["payload"] for r in out] == payloads
    assert all(r["error"] is None and r["payload_digest"] == sha(p) for r, p in zip(out, payloads, strict=True))


def test_damage_is_reported():
    payloads, members = archive(4)
    assert [r["error"] for r in W.read_records(io.BytesIO(b"".join(members)[:-5]))][-1] == "truncated gzip member"
    wrong = gzip.decompress(members[1]).replace(b"sha1:" + sha(payloads[1]).encode(), b"sha1:" + b"A" * 32)
    out = list(W.read_records(io.BytesIO(members[0] + W.gzip_member(wrong) + members[2])))
    assert [r["error"] is None for r in out] == [True, False, True]
    short = gzip.decompress(members[3]).replace(b"Content-Length: ", b"Content-Length: 1", 1)
    assert "digest differs" in next(W.read_records(io.BytesIO(members[0][:0] + W.gzip_member(gzip.decompress(members[3]).replace(b"200 OK", b"404 OK"))))) ["error"]
    assert next(W.read_records(io.BytesIO(W.gzip_member(short))))["error"] is not None
    broken = bytearray(members[2])
    broken[len(broken) // 2] ^= 255
    assert list(W.read_records(io.BytesIO(bytes(broken))))[-1]["error"] is not None


def test_missing_response_is_an_error(spark, rows):
    schema = W._READ
    df = spark.createDataFrame([("<urn:x-page:1:A>", "revisit", "u", None, "A", "<urn:x-page:2:A>", None, None)], schema)
    assert W.resolve_revisits(df).first()["error"].startswith("the response")

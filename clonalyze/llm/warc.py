"""WARC archives: writing pages, one gzip member per record, and a sequential reader.

The reader never holds an archive or a record whole: it feeds chunks of the file to an
incremental zlib decompressor (a new one for every gzip member), frames records by
Content-Length and verifies block and payload digests on the way.

Archives live in a folder that driver and executors share; tasks open them through
``pyarrow.fs`` by URI, so any store that Arrow knows will do. A task writes under a name of
its own and reports it in the manifest; files of lost or repeated attempts are in no
manifest and never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonalyze.llm.common import bounded_batches, hot_aware_lookup, shared_path, staged

DATE = "2020-01-01T00:00:00Z"       # the tables hold no fetch time
ROLL_BYTES = 256 << 20              # a task starts another archive beyond this size
CHUNK = 1 << 20
LEVEL = 4
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_ID = re.compile(r"<urn:x-page:(-?\d*):\w*>")
_END = b"\r\n\r\n"


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or absolute path."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def base32_sha1(raw_digest: bytes) -> str:
    return base64.b32encode(raw_digest).decode()


def record_id(page_id, digest: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One uncompressed WARC record: a response, or a revisit of ``refers_to``."""
    http = _HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%-._~")),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(hashlib.sha1(block).digest())}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", record_id(refers_to, digest))]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + _END


def gzip_member(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def with_record_types(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url",
                      least_bytes: int = 0) -> DataFrame:
    """(_id, _url, _payload, _sha1, _refers_to): null ``_refers_to`` for responses.

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the largest
    identifier is the response (all rows that repeat this identifier are), the others revisit
    it. A null payload is empty; rows without identifier are responses and never referred to.
    """
    payload = F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").alias("_url"), payload.alias("_payload"))
    rows = rows.withColumn("_sha1", F.sha1("_payload"))
    # equal payloads have equal digest and length; SHA-1 is what WARC compares payloads by
    groups = staged(rows.filter(F.col("_id").isNotNull() & (F.octet_length("_payload") >= least_bytes))
                    .groupBy("_sha1").agg(F.max("_id").alias("_top"), F.min("_id").alias("_low"), F.count(F.lit(1)).alias("_n"))
                    .filter("_low <> _top").drop("_low"), "warc-groups")
    total = pages.count()
    marked = hot_aware_lookup(rows, groups, ["_sha1"], "_n", total)
    revisit = F.col("_id").isNotNull() & F.col("_top").isNotNull() & (F.col("_id") < F.col("_top"))
    return marked.select("_id", "_url", "_payload", "_sha1", F.when(revisit, F.col("_top")).alias("_refers_to"))


def _write(folder: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        out, name, n, size = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for b in batches:
            ids, urls, payloads, sha1s, refers = (b.column(i).to_pylist() for i in range(5))
            for page_id, url, payload, sha1, to in zip(ids, urls, payloads, sha1s, refers, strict=True):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                member = gzip_member(record_bytes(page_id, url, payload, base32_sha1(bytes.fromhex(sha1)), to))
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= ROLL_BYTES:
                    out.close()
                    done.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{d[0]}" for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()),
                                          pa.array([d[2] for d in done], pa.int64())], names=["path", "records", "bytes"])

    return rows


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write rows of ``with_record_types`` as archives below ``folder``; the manifest: path, records, bytes."""
    bounded_batches(records.sparkSession)
    store, base = open_store(folder)
    store.create_dir(base, recursive=True)
    return staged(records.mapInArrow(_write(folder), "path string, records bigint, bytes bigint"), "warc-manifest")


# ---- reading ----------------------------------------------------------------

@dataclass
class _Record:
    """One record as it comes in; its payload is hashed, and kept only on demand."""

    keep: bool
    head: bytes = b""
    fields: dict[str, str] = field(default_factory=dict)
    left: int = -1                      # bytes of the block still to come; -1: header not complete
    http: bytes | None = b""            # HTTP header so far; None: complete
    tail: bytes = b""
    size: int = 0
    payload: list[bytes] = field(default_factory=list)
    error: str | None = None

    def __post_init__(self) -> None:
        self.block_sha, self.payload_sha = hashlib.sha1(), hashlib.sha1()

    def feed(self, data: bytes) -> None:
        if self.left < 0:
            self.head += data
            cut = self.head.find(_END)
            if cut < 0:
                return
            data, head = self.head[cut + 4:], self.head[:cut]
            lines = head.decode("utf-8", "replace").split("\r\n")
            self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            length = self.fields.get("content-length", "")
            if not lines[0].startswith("WARC/") or not length.isdigit():
                self.error = "no WARC header"
            self.left, self.head = int(length) if length.isdigit() else 0, b""
        block, self.tail = data[:self.left], self.tail + data[self.left:]
        if not block:
            return
        self.left -= len(block)
        self.block_sha.update(block)
        if self.http is not None:
            self.http += block
            cut = self.http.find(_END)
            if cut < 0:
                return
            block, self.http = self.http[cut + 4:], None
        self.payload_sha.update(block)
        self.size += len(block)
        if self.keep and block:
            self.payload.append(block)

    def finish(self, complete: bool) -> dict:
        f = self.fields
        kind = f.get("warc-type")
        digest = base32_sha1(self.payload_sha.digest())
        stated = f.get("warc-payload-digest", "").removeprefix("sha1:")
        error = self.error
        if error is None and (not complete or self.left != 0):
            error = "truncated record"
        if error is None and self.tail != _END:
            error = "content length does not frame the record"
        if error is None and f.get("warc-block-digest", "").removeprefix("sha1:") != base32_sha1(self.block_sha.digest()):
            error = "block digest differs"
        if error is None and kind == "response" and stated != digest:
            error = "payload digest differs"
        is_revisit = kind == "revisit"
        return {"record_id": f.get("warc-record-id"), "record_type": kind, "target_uri": f.get("warc-target-uri"),
                "payload_bytes": None if is_revisit else self.size, "payload_digest": stated if is_revisit else digest,
                "refers_to_id": f.get("warc-refers-to"), "payload": b"".join(self.payload) if self.keep and not is_revisit else None, "error": error}


def read_records(stream, keep_payload: bool = False) -> Iterator[dict]:
    """Records of one archive in order, from a binary stream read chunk by chunk.

    A damaged record carries its ``error``; after a broken gzip member the rest of the archive
    can't be framed, so that record is the last.
    """
    member, record, data = None, None, b""
    while True:
        if not data:
            data = stream.read(CHUNK)
            if not data:
                break
        if member is None:
            member, record = zlib.decompressobj(31), _Record(keep_payload)
        try:
            got = member.decompress(data, CHUNK)
            record.feed(got)
            while not member.eof and (member.unconsumed_tail or len(got) == CHUNK):
                got = member.decompress(member.unconsumed_tail, CHUNK)
                record.feed(got)
        except zlib.error as e:
            record.error = f"broken gzip member: {e}"
            yield record.finish(False)
            return
        data = b""
        if member.eof:
            yield record.finish(True)
            data, member = member.unused_data, None
    if member is not None:
        record.error = record.error or "truncated gzip member"
        yield record.finish(False)


_READ = ("record_id string, record_type string, target_uri string, payload_bytes bigint, payload_digest string, "
         "refers_to_id string, payload binary, error string")
_NAMES = [c.strip().split(" ")[0] for c in _READ.split(",")]


def read_archives(manifest: DataFrame, keep_payload: bool = False) -> DataFrame:
    """All records of the archives in ``manifest.path``, one task reading an archive from front to back."""
    n = max(1, manifest.count())
    paths = manifest.select("path").repartitionByRange(n, "path")
    types = {"payload_bytes": pa.int64(), "payload": pa.binary()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(found):
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], types.get(c, pa.string())) for c in _NAMES], names=_NAMES)

        for b in batches:
            for path in b.column(0).to_pylist():
                store, name = open_store(path)
                held, size = [], 0
                with store.open_input_stream(name, compression=None) as stream:
                    for r in read_records(stream, keep_payload):
                        held.append(r)
                        size += len(r["payload"] or b"") + 300
                        if size >= 4 << 20:
                            yield batch(held)
                            held, size = [], 0
                if held:
                    yield batch(held)

    return paths.mapInArrow(rows, _READ)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Revisits get the ``payload_bytes`` of the response they refer to; without it, an ``error``."""
    revisits = records.filter("record_type = 'revisit'")
    rest = records.filter("record_type is distinct from 'revisit'")
    asked = revisits.groupBy("refers_to_id").agg(F.count(F.lit(1)).alias("_n"))
    responses = rest.filter("record_type = 'response'").groupBy(F.col("record_id").alias("_rid")).agg(
        F.max("payload_bytes").alias("_bytes"), F.max("payload_digest").alias("_digest"))
    lookup = staged(asked.join(responses, F.col("refers_to_id") == F.col("_rid")).drop("_rid"), "warc-referred")
    total = asked.agg(F.sum("_n")).first()[0] or 0
    found = hot_aware_lookup(revisits, lookup, ["refers_to_id"], "_n", total)
    ok = F.col("_digest") == F.col("payload_digest")
    return rest.unionByName(found.select(
        *[F.col(c) if c not in ("payload_bytes", "error") else
          (F.when(ok, F.col("_bytes")) if c == "payload_bytes" else
           F.coalesce("error", F.when(~F.coalesce(ok, F.lit(False)), "the response that it refers to is missing"))).alias(c) for c in records.columns]))


def page_id_of(record: str, kind: str = "bigint"):
    """The identifier in a record id column; null where there is none."""
    return F.expr(f"try_cast(nullif(regexp_extract({record}, '<urn:x-page:(-?[0-9]*):', 1), '') as {kind})")


def archive_pages(spark: SparkSession, pages: DataFrame, least_bytes: int = 0, folder: str | None = None,
                  keep_payload: bool = False) -> DataFrame:
    """Write all ``pages`` (page_id, url, html) as WARC and read them back from the archives.

    Returns page_id, target_uri, payload_bytes, payload_digest, record_type, refers_to, payload and error
    (null for sound records). An empty table writes no archive and gives an empty result.
    """
    manifest = write_archives(with_record_types(pages, least_bytes=least_bytes), folder or shared_path(spark, "warc"))
    records = read_archives(manifest, keep_payload)
    if not keep_payload:
        records = staged(records, "warc-records")
    found = resolve_revisits(records)
    return found.select(page_id_of("record_id").alias("page_id"), "target_uri", "payload_bytes", "payload_digest", "record_type",
                        page_id_of("refers_to_id").alias("refers_to"), "payload", "error")

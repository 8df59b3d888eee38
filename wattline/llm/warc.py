"""WARC archives from pages, and back, by way of a chunked record table.

A record is rows of (record, chunk number, chunk): a payload of any size passes tasks as chunks of bounded size
with a running SHA-256, and no task holds a whole record. Archives are gzip members, one per record, written to
the shared folder; a manifest that Spark commits names the files of the tasks that succeeded, so what a lost or
repeated attempt has left is never read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F

from .common import new_path, shuffle_partitions, staged
from .keyed import join_per_key

CHUNK_BYTES = 32_768
READ_BYTES = 65_536
#: A task begins another archive after so many payload bytes.
ARCHIVE_BYTES = 64 << 20
LEAST_SHARED_BYTES = 100
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 31

MANIFEST = "archive string, records long, payload_bytes long"
RECORD = (
    "archive string, offset long, record_id string, record_type string, page_id long, url string, refers_to_id string, "
    "refers_to long, declared_digest string, payload_length long, chunk_no long, chunk binary, bytes_so_far long, payload_digest string"
)


# Records as rows


def chunk_table(pages: DataFrame, page_id: str, url: str, html: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(row, chunk_no, chunk) and, on chunk 0 only, page_id, url, digest and payload_bytes; written once.

    An empty payload has one empty chunk.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        payload.alias("payload"),
    ).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    last = F.greatest(F.floor((F.col("payload_bytes") - 1) / chunk_bytes), F.lit(0))
    first = F.col("chunk_no") == 0
    cut = rows.withColumn("digest", F.unhex(F.sha2("payload", 256))).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_no")
    )
    chunk = F.substring(F.col("payload"), (F.col("chunk_no") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes))
    return staged(
        cut.select("row", "chunk_no", chunk.alias("chunk"), *[F.when(first, F.col(c)).alias(c) for c in ("page_id", "url", "digest", "payload_bytes")]),
        "warc-chunks",
    )


def label(heads: DataFrame, least: int = LEAST_SHARED_BYTES) -> DataFrame:
    """(row, refers_to, refers_row): which rows revisit another and which one; both null where the row is a response.

    ``heads`` has (row, page_id, digest, payload_bytes). Of equal payloads of at least ``least`` bytes that with
    the smallest page_id is the response (rows without page_id come last), of repeated rows one.
    """
    shared = heads.where(F.col("payload_bytes") >= least)
    order = F.struct(F.col("page_id").isNull(), "page_id", "row")
    groups = shared.groupBy("digest").agg(F.min(order).alias("o"), F.count("*").alias("n")).where("n > 1")
    firsts = groups.select("digest", F.col("o.page_id").alias("first_page"), F.col("o.row").alias("first_row"), "n")
    found = join_per_key(shared.select("row", "digest"), firsts, ["digest"], "n").where("row <> first_row")
    return found.select("row", F.col("first_page").alias("refers_to"), F.col("first_row").alias("refers_row"))


def record_id(row: int, archive_set: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{archive_set}/{row}')}>"


def _clean(url: str) -> str:
    """Characters that would end a header are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def head(row: int, page_id: int | None, url: str | None, digest: bytes, size: int, revisit: tuple | None, archive_set: str, date: str) -> tuple[bytes, bytes]:
    """WARC header and HTTP header of a record; ``revisit`` is (page_id, row) of the response or None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(row, archive_set)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines += [f"WARC-Payload-Digest: sha256:{digest.hex()}", f"X-Payload-Length: {size}", "Content-Type: application/http;msgtype=response"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(revisit[1], archive_set)}"]
        if revisit[0] is not None:
            lines.append(f"X-Refers-To-Page-ID: {revisit[0]}")
    lines.append(f"Content-Length: {len(http) + (0 if revisit else size)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


def _store(uri: str):
    """File system and path of a URI; Hadoop's short form file:/x included."""
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


class ArchiveWriter:
    """Archives of one task, one after the other; a record is a gzip member that is fed piece by piece."""

    def __init__(self, folder: str, limit: int):
        self.fs, self.folder = _store(folder)
        self.base, self.limit, self.out, self.done = folder, limit, None, []
        self.fs.create_dir(self.folder, recursive=True)

    def begin(self, *parts: bytes) -> None:
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.warc.gz"
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None)
            self.records = self.bytes = 0
        self.gz, self.sha, self.size = zlib.compressobj(6, zlib.DEFLATED, GZIP), hashlib.sha256(), 0
        for p in parts:
            self.out.write(self.gz.compress(p))

    def add(self, chunk) -> None:
        self.sha.update(chunk)
        self.size += len(chunk)
        self.out.write(self.gz.compress(chunk))

    def end(self, digest: bytes | None, size: int | None) -> None:
        """``digest`` and ``size`` are what the payload must have come to; None for records without one."""
        if digest is not None and (self.sha.digest() != digest or self.size != size):
            raise ValueError("a record's chunks do not add up to its payload")
        self.out.write(self.gz.compress(b"\r\n\r\n") + self.gz.flush())
        self.records, self.bytes = self.records + 1, self.bytes + self.size
        if self.bytes >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((f"{self.base}/{self.name}", self.records, self.bytes))
            self.out = None


def write_archives(
    pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html",
    chunk_bytes: int = CHUNK_BYTES, archive_bytes: int = ARCHIVE_BYTES, least: int = LEAST_SHARED_BYTES, date: str = DATE,
) -> DataFrame:
    """Write one record per row of ``pages`` to archives in ``folder``; returns the manifest (archive, records, payload_bytes).

    ``folder`` is a URI that all executors reach (default: a new one below spark.checkpoint.dir). Null html is an
    empty payload. Of payloads of at least ``least`` bytes that are equal, one is a response and the others are
    revisits without a payload. Rows without page_id or url have records without these headers. Other columns are
    ignored. An empty table writes nothing.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    archive_set = folder.rsplit("/", 1)[-1]
    table = chunk_table(pages, page_id, url, html, chunk_bytes)
    heads = table.where("chunk_no = 0").select("row", "page_id", "digest", "payload_bytes")
    labels = staged(label(heads, least), "warc-labels")
    none = {f.name: F.lit(None).cast(f.dataType) for f in table.schema}
    told = labels.select("row", F.lit(-1).cast("long").alias("chunk_no"), *[none[c].alias(c) for c in ("chunk", "url", "digest", "payload_bytes")], "refers_to", "refers_row", none["page_id"].alias("page_id"))
    rows = table.withColumns({"refers_to": F.lit(None).cast("long"), "refers_row": F.lit(None).cast("long")}).unionByName(told)
    # A label comes before the chunks of its record, so that a writer knows what to do with them.
    dealt = rows.repartition(shuffle_partitions(spark), "row").sortWithinPartitions("row", "chunk_no")
    cols = ["row", "chunk_no", "chunk", "page_id", "url", "digest", "payload_bytes", "refers_to", "refers_row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, revisit, now = ArchiveWriter(folder, archive_bytes), None, None
        for b in batches:
            row, no, page, link, digest, size, to, to_row = (b.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6, 7, 8))
            chunks = b.column(2)
            for i in range(b.num_rows):
                if no[i] == -1:
                    revisit = (to[i], to_row[i], row[i])
                    continue
                if no[i] == 0:
                    if now:
                        writer.end(*now)
                    mine = revisit[:2] if revisit and revisit[2] == row[i] else None
                    writer.begin(*head(row[i], page[i], link[i], digest[i], size[i], mine, archive_set, date))
                    now = (None, None) if mine else (digest[i], size[i])
                if now[0] is not None:
                    writer.add(chunks[i].as_buffer())
        if now:
            writer.end(*now)
        writer.close()
        if writer.done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*writer.done)], ["archive", "records", "payload_bytes"])

    return staged(dealt.select(*cols).mapInArrow(run, MANIFEST), "warc-manifest")


# Archives as rows


class Stream:
    """The bytes of an archive, decompressed in bounded pieces; plain archives and gzip ones."""

    def __init__(self, raw, piece: int = READ_BYTES):
        self.raw, self.piece, self.held, self.at, self.gz, self.left = raw, piece, b"", 0, None, b""
        self.left = raw.read(piece)
        self.packed = self.left[:2] == b"\x1f\x8b"

    def _more(self) -> bytes:
        while True:
            if not self.left:
                self.left = self.raw.read(self.piece)
            if not self.left:
                if self.gz is not None:
                    raise EOFError("the archive ends inside a gzip member")
                return b""
            if not self.packed:
                out, self.left = self.left, b""
                return out
            if self.gz is None:
                self.gz = zlib.decompressobj(GZIP)
            out = self.gz.decompress(self.left, self.piece)
            self.left = self.gz.unused_data if self.gz.eof else self.gz.unconsumed_tail
            if self.gz.eof:
                self.gz = None
            if out:
                return out

    def line(self, limit: int = 1 << 20) -> bytes | None:
        """A line without its end; None at the end of the archive."""
        while (k := self.held.find(b"\n")) < 0:
            more = self._more()
            if not more:
                if self.held:
                    raise EOFError("the archive ends inside a header")
                return None
            self.held += more
            if len(self.held) > limit + self.piece:
                raise ValueError("a header line is too long")
        out, self.held = self.held[:k], self.held[k + 1 :]
        self.at += k + 1
        return out.rstrip(b"\r")

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces."""
        while n:
            if not self.held:
                self.held = self._more()
                if not self.held:
                    raise EOFError("the archive ends inside a record")
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            self.at += len(out)
            yield out


def _headers(s: Stream) -> dict[str, str]:
    out = {}
    while line := s.line():
        k, _, v = line.decode("utf-8", "replace").partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def records(raw, chunk_bytes: int = CHUNK_BYTES, keep: bool = True) -> Iterator[tuple]:
    """Rows of RECORD without the archive: every chunk of every record, or only the last ones where ``keep`` is false.

    bytes_so_far counts the payload to the end of the chunk; payload_digest is there on a record's last chunk.
    The payload of an HTTP message is what follows its header, of other records the whole block.
    """
    s = Stream(raw)
    while True:
        at, line = s.at, s.line()
        while line == b"":
            at, line = s.at, s.line()
        if line is None:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        h = _headers(s)
        left = int(h["content-length"])
        if h.get("content-type", "").replace(" ", "").startswith("application/http") and left:
            from_ = s.at
            while s.line():
                pass
            left -= s.at - from_
        number = lambda k: int(h[k]) if k in h else None
        start = (
            at, h.get("warc-record-id"), h.get("warc-type"), number("x-page-id"), h.get("warc-target-uri"), h.get("warc-refers-to"),
            number("x-refers-to-page-id"), h.get("warc-payload-digest"), number("x-payload-length"),
        )
        sha, no, size, held = hashlib.sha256(), 0, 0, bytearray()
        for piece in s.take(left):
            sha.update(piece)
            size += len(piece)
            if keep:
                held += piece
                while len(held) > chunk_bytes:
                    yield (*start, no, bytes(held[:chunk_bytes]), no * chunk_bytes + chunk_bytes, None)
                    no, held = no + 1, held[chunk_bytes:]
        yield (*start, no if keep else max(0, (size - 1) // chunk_bytes), bytes(held) if keep else None, size, sha.hexdigest())


def read_archives(archives: DataFrame, chunk_bytes: int = CHUNK_BYTES, payload: bool = True) -> DataFrame:
    """The chunked record table of the archives named in column ``archive`` (RECORD); one task per few archives.

    With ``payload`` false only the last row of every record, without its bytes; digests still cover all bytes.
    A damaged archive raises.
    """
    n = shuffle_partitions(archives.sparkSession)
    dealt = archives.select("archive").repartition(n, "archive")
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = _store(uri)
                with fs.open_input_stream(path, compression=None) as raw:
                    rows, held = [], 0
                    for r in records(raw, chunk_bytes, payload):
                        rows.append((uri, *r))
                        held += 200 + len(r[-3] or b"")
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for c, n in zip(zip(*rows), names)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for c, n in zip(zip(*rows), names)], schema=schema)

    return dealt.mapInArrow(run, RECORD)


def payload_of(chunks: DataFrame) -> DataFrame:
    """(archive, offset, payload) of records small enough for one value, from all their chunks."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))), lambda x: x["chunk"])
    whole = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x))
    return chunks.groupBy("archive", "offset").agg(whole.alias("payload"))


def pages_of(table: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id, archive, offset.

    Size and digest of a response are of the bytes read, and an archive whose bytes differ from what their header
    declares raises. A revisit has no bytes of its own; its header gives size and digest.
    """
    last = table.where("payload_digest IS NOT NULL AND record_type IN ('response', 'revisit')")
    declared = F.regexp_replace("declared_digest", "^sha256:", "")
    own = F.col("record_type") == "response"
    wrong = own & (declared.isNotNull() & (declared != F.col("payload_digest")))
    digest = F.when(wrong, F.raise_error(F.concat(F.lit("payload differs from its digest: "), "record_id"))).when(own, F.col("payload_digest")).otherwise(declared)
    return last.select(
        "page_id", F.when(own, F.col("bytes_so_far")).otherwise(F.col("payload_length")).alias("payload_bytes"), digest.alias("payload_digest"),
        "record_type", "refers_to", "url", "record_id", "archive", "offset",
    )


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write archives of ``pages`` and read them back: one row per page, as :func:`pages_of`."""
    return pages_of(read_archives(write_archives(pages, **columns), payload=False))


SQL = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN octet_length(encode(coalesce(html, ''))) < 100 OR page_id = min(page_id) OVER g THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id <> min(page_id) OVER g THEN min(page_id) OVER g END AS refers_to
FROM pages WINDOW g AS (PARTITION BY coalesce(html, ''))
"""

"""WARC archives as a chunked record table.

Pages become WARC records, each cut into segments of at most ``chunk_bytes`` (the first a ``response``, further ones
``continuation`` records with WARC's own segment fields). A segment is one row; Spark's text writer puts the blank lines
that end a record between the rows, so the files are plain ``.warc`` streams in gzip. They are read back row by row: the
reader follows Content-Length over the rows and yields one row per segment, with record id, chunk number and the SHA-1
and length so far. No step holds more than one chunk of a record beside the page itself.

Of records with equal payloads of at least ``least_bytes`` the one with the largest page_id is stored, the others are
``revisit`` records that refer to it. The groups are counted and joined as (digest, page_id) rows without payloads.

Edge cases: a null html is an empty payload; a page without id is a response and its id is read back as null; rows that
repeat the largest page_id of a group are all responses; a null url is left out and line breaks in a url are escaped;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from viewtide.llm import common
from viewtide.session import scratch_path

END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROWS = ("page_id bigint, url string, record_type string, refers_to bigint, chunk int, last boolean, "
        "payload_bytes bigint, payload_digest string, data string")
OUT_BYTES = 8 << 20


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def cuts(payload: bytes, size: int) -> Iterator[memoryview]:
    """Pieces of at most ``size`` bytes that do not split a character."""
    view, at = memoryview(payload), 0
    while at < len(payload) or at == 0:
        end = min(at + size, len(payload))
        while end < len(payload) and payload[end] & 0xC0 == 0x80:
            end -= 1
        yield view[at:end]
        at = end
        if at == 0:
            return


def record(kind: bytes, own: bytes, fields: list[tuple[bytes, bytes]], block: bytes, date: bytes) -> bytes:
    lines = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: <" + own + b">", b"WARC-Date: " + date]
    lines += [a + b": " + b for a, b in fields] + [b"Content-Length: " + str(len(block)).encode()]
    return b"\r\n".join(lines) + END + block


def segments(page_id, url, payload: bytes, keeper, chunk_bytes: int, date: bytes) -> Iterator[bytes]:
    """The records of one page, without the blank lines that end them."""
    own = b"urn:page:" + (b"none" if page_id is None else str(page_id).encode())
    digest = base32(hashlib.sha1(payload).digest()).encode()
    about = [(b"WARC-Payload-Digest", b"sha1:" + digest), (b"X-Payload-Bytes", str(len(payload)).encode())]
    if url is not None:
        about.append((b"WARC-Target-URI", url.replace(b"\r", b"%0D").replace(b"\n", b"%0A")))
    if keeper is not None:
        about += [(b"WARC-Profile", PROFILE), (b"WARC-Refers-To", b"<urn:page:" + str(keeper).encode() + b">")]
        yield record(b"revisit", own, about, HTTP, date)
        return
    about.append((b"Content-Type", b"application/http; msgtype=response"))
    if len(payload) <= chunk_bytes:
        yield record(b"response", own, about, HTTP + payload, date)
        return
    done = 0
    for n, piece in enumerate(cuts(payload, chunk_bytes), 1):
        done += len(piece)
        number = [(b"WARC-Segment-Number", str(n).encode())]
        if n == 1:
            yield record(b"response", own, about + number, HTTP + bytes(piece), date)
            continue
        number.append((b"WARC-Segment-Origin-ID", b"<" + own + b">"))
        if done == len(payload):
            number.append((b"WARC-Segment-Total-Length", str(len(HTTP) + done).encode()))
        yield record(b"continuation", own + b":" + str(n).encode(), number, bytes(piece), date)


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, digest, keeper) of the pages whose payload a page with a larger id has too."""
    known = common.stage(pages.select("page_id", F.sha1("payload").alias("digest"),
                                      F.octet_length("payload").alias("bytes")), "warc-digests")
    shared = (known.where((F.col("bytes") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("digest")
              .agg(F.max("page_id").alias("keeper"), F.min("page_id").alias("first")).where("first < keeper"))
    return (known.join(shared.select("digest", "keeper"), "digest").where("page_id < keeper")
            .select("page_id", "digest", "keeper").distinct())


def write_archive(pages: DataFrame, path: str, chunk_bytes: int = 1 << 20, least_bytes: int = 0,
                  date: str = "2000-01-01T00:00:00Z") -> None:
    """Write ``pages`` (page_id, url, html) as gzipped WARC files below ``path``, one per task."""
    if chunk_bytes < 4:
        raise ValueError("a chunk must hold any character")
    stamp = date.encode()
    flat = common.pick(pages, "page_id", "url", "html").select(
        "page_id", "url", common.whole_text("html").cast("binary").alias("payload"))
    rows = (flat.withColumn("digest", F.sha1("payload"))
            .join(revisits(flat, least_bytes), ["page_id", "digest"], "left").select("page_id", "url", "payload", "keeper"))

    def run(batches):
        out, size = [], 0
        for batch in batches:
            ids, urls, keepers = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for page_id, url, payload, keeper in zip(ids, urls, batch.column(2), keepers):
                for x in segments(page_id, url and url.encode(), payload.as_py(), keeper, chunk_bytes, stamp):
                    out.append(x.decode())
                    size += len(x)
                    if size >= OUT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    rows.mapInArrow(run, "value string").write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


class Reader:
    """Follows the records over the rows of one file after the other."""

    def __init__(self, payloads: bool):
        self.payloads, self.left, self.over, self.head = payloads, -1, 0, None
        self.sha, self.total, self.page = hashlib.sha1(), 0, None

    def feed(self, row: bytes) -> tuple | None:
        """One row of the stream, between two blank lines; gives the segment that it ends, if any."""
        if self.left < 0:
            if self.over:  # the rest of the blank lines, whose begin was taken for the payload's own
                row, self.over = row[4 - self.over:] if row.startswith(END[self.over:]) else row, 0
            return self.begin(row) if row else None
        if self.left < 4 and self.started:  # the payload's end and the record's blank lines look like one separator
            self.block += END[:self.left]
            self.over, self.left = 4 - self.left, -1
            ended = self.end()
            self.feed(row)
            return ended
        if self.started:
            self.block += END
            self.left -= 4
        self.started = True
        self.block += row
        self.left -= len(row)
        if self.left < 0:
            raise ValueError("a WARC record is longer than it says")
        if self.left == 0:
            self.left = -1
            return self.end()
        return None

    def begin(self, row: bytes) -> None:
        lines = row.split(b"\r\n")
        if lines[0] != b"WARC/1.1":
            raise ValueError(f"no WARC record: {row[:80]!r}")
        self.head = dict(x.split(b": ", 1) for x in lines[1:])
        self.left, self.block, self.started = int(self.head[b"Content-Length"]), bytearray(), False

    def end(self) -> tuple:
        head, block = self.head, self.block
        kind = head[b"WARC-Type"]
        if kind != b"continuation":
            if not block.startswith(HTTP):
                raise ValueError("a WARC record has no HTTP head")
            del block[:len(HTTP)]
            self.sha, self.total, self.page = hashlib.sha1(), 0, head
        self.sha.update(block)
        self.total += len(block)
        first = self.page
        number = int(head.get(b"WARC-Segment-Number", b"1"))
        last = kind == b"revisit" or b"WARC-Segment-Number" not in head or b"WARC-Segment-Total-Length" in head
        said = first[b"WARC-Payload-Digest"][5:].decode()
        if kind == b"revisit":
            size, digest = int(first[b"X-Payload-Bytes"]), said
        else:
            size, digest = self.total, base32(self.sha.digest())
            if last and (digest != said or size != int(first[b"X-Payload-Bytes"])):
                raise ValueError("a WARC payload differs from its digest")
        own = first[b"WARC-Record-ID"][len(b"<urn:page:"):-1]
        other = first.get(b"WARC-Refers-To")
        url = first.get(b"WARC-Target-URI")
        return (None if own == b"none" else int(own), url and url.decode(), first[b"WARC-Type"].decode(),
                other and int(other[len(b"<urn:page:"):-1]), number, last, size, digest,
                block.decode() if self.payloads else None)


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per segment: record, chunk number, payload so far as length and digest, and the chunk itself.

    A gzip file is read by one task from its begin, so the rows come in the order of the file.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql import types as T
    target = to_arrow_schema(T.StructType.fromDDL(ROWS))

    def batch_of(rows):
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    def run(batches):
        reader, out, size = Reader(payloads), [], 0
        for batch in batches:
            for row in common.text_bytes(batch.column(0)):
                found = reader.feed(row)
                if found is not None:
                    out.append(found)
                    size += 200 + len(found[-1] or "")
                if size >= OUT_BYTES:
                    yield batch_of(out)
                    out, size = [], 0
        if reader.left >= 0:
            raise ValueError("a WARC file ends inside a record")
        if out:
            yield batch_of(out)

    return spark.read.option("lineSep", END.decode()).text(path).mapInArrow(run, ROWS)


def archive(pages: DataFrame, chunk_bytes: int = 1 << 20, least_bytes: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder and give the rows read back from them, one per record."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archive(pages, path, chunk_bytes, least_bytes)
    return (read_archive(pages.sparkSession, path, payloads=False).where("last")
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url",
                    F.col("chunk").alias("chunks")))

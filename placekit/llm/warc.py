"""Web archives: one gzip member per record, written and read sequentially.

The reader inflates a stream piece by piece, frames each record by its Content-Length, checks its digests, and checks
that a member holds exactly one record. Archives lie in the shared folder; a write is known by its manifest, which
names only the files of tasks that succeeded, so what a lost executor leaves behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placekit.llm.common import cut, folder, row_id

DATE = "1970-01-01T00:00:00Z"
SMALLEST_REVISIT = 100
ARCHIVE_BYTES = 64_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BrokenRecord(ValueError):
    """A record that isn't framed as it says, or whose digest differs."""


# ------------------------------------------------------------------ files
def _filesystem(path: str):
    """Local files are opened directly; other stores through Arrow."""
    if path.startswith("file:") or "://" not in path:
        return None, "/" + path.removeprefix("file:").lstrip("/")
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def open_in(path: str):
    store, name = _filesystem(path)
    return store.open_input_stream(name) if store else open(name, "rb")


class Archive:
    """A file that takes its name only once it is whole."""

    def __init__(self, path: str):
        self.path = path
        self.store, self.name = _filesystem(path)
        if self.store:
            self.store.create_dir(os.path.dirname(self.name), recursive=True)
            self.out = self.store.open_output_stream(self.name + ".part")
        else:
            os.makedirs(os.path.dirname(self.name), exist_ok=True)
            self.out = open(self.name + ".part", "wb")
        self.size = self.records = 0

    def add(self, record: bytes) -> None:
        self.out.write(record)
        self.size += len(record)
        self.records += 1

    def close(self) -> None:
        self.out.close()
        if self.store:
            self.store.move(self.name + ".part", self.name)
        else:
            os.replace(self.name + ".part", self.name)


# ------------------------------------------------------------------ one record
def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member of its own, always the same bytes for the same record."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {re.sub(chr(13) + '|' + chr(10), ' ', v)}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + squeeze.flush()


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def page_record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None) -> bytes:
    """A page as a response, or as a revisit of the page whose payload is the same."""
    sha = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_name(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{sha}"),
                ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_name(refers_to))]
    return member(headers, block)


# ------------------------------------------------------------------ reading
class Inflated:
    """The bytes of one gzip member after another, inflated as they are asked for."""

    def __init__(self, stream, piece: int = 1 << 16):
        self.stream, self.piece, self.raw, self.ended = stream, piece, b"", False
        self.left = b""
        self.inflate = None

    def begin(self) -> bool:
        """Go to the next member; False at the end of the stream."""
        if not self.raw:
            self.raw = self.stream.read(self.piece)
        if not self.raw:
            return False
        self.inflate, self.left, self.ended = zlib.decompressobj(31), b"", False
        return True

    def more(self) -> bytes:
        """The next inflated bytes of the member; empty at its end."""
        if self.left:
            out, self.left = self.left, b""
            return out
        while not self.ended:
            if not self.raw:
                self.raw = self.stream.read(self.piece)
                if not self.raw:
                    raise BrokenRecord("the archive ends inside a member")
            out = self.inflate.decompress(self.raw, self.piece)
            self.raw = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.ended, self.raw = True, self.inflate.unused_data
            if out:
                return out
        return b""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    def payload(self) -> bytes:
        """What follows the HTTP header, or the whole block of other records."""
        if self.headers.get("content-type", "").startswith("application/http"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block

    def http_length(self) -> int | None:
        found = re.search(rb"(?im)^Content-Length: *(\d+)", self.block.partition(b"\r\n\r\n")[0])
        return int(found[1]) if found else None


def _check(headers: dict[str, str], name: str, data: bytes) -> None:
    said = headers.get(name)
    if said is None:
        return
    kind, _, value = said.partition(":")
    if kind.lower() not in hashlib.algorithms_guaranteed or kind.lower().startswith("shake"):
        return  # not one that can be told
    digest = hashlib.new(kind.lower(), data).digest()
    # written in hex or, as many crawlers do, in base32
    if value.lower() != digest.hex() and value.upper().rstrip("=") != base64.b32encode(digest).decode().rstrip("="):
        raise BrokenRecord(f"{name} differs in {headers.get('warc-record-id')}")


def read_records(stream) -> Iterator[Record]:
    """Records of an archive, in order."""
    source = Inflated(stream)
    while source.begin():
        head = b""
        while b"\r\n\r\n" not in head:
            more = source.more()
            if not more:
                raise BrokenRecord("a member without a whole header")
            head += more
        top, _, rest = head.partition(b"\r\n\r\n")
        lines = top.decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise BrokenRecord(f"not a record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        try:
            length = int(headers["content-length"])
        except (KeyError, ValueError):
            raise BrokenRecord("a record without a length") from None
        pieces, have = [rest], len(rest)
        while more := source.more():  # to the member's end
            pieces.append(more)
            have += len(more)
            if have > length + 4:
                raise BrokenRecord("a member longer than its record")
        data = b"".join(pieces)
        if len(data) != length + 4 or data[length:] != b"\r\n\r\n":
            raise BrokenRecord("a record that isn't as long as it says")
        record = Record(headers, data[:length])
        _check(headers, "warc-block-digest", record.block)
        if headers.get("warc-type") == "response":
            _check(headers, "warc-payload-digest", record.payload())
        yield record


# ------------------------------------------------------------------ tables
def revisits(pages: DataFrame, smallest: int = SMALLEST_REVISIT) -> DataFrame:
    """``_row, refers_to`` of the pages whose payload another page has too, one with a smaller id (or an earlier row of one id)."""
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = row_id(pages.select("page_id", "html")).where(F.octet_length(raw) >= smallest).select("_row", "page_id", F.sha2(raw, 256).alias("sha"))
    first = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "_row")
    # partial minima: copies shrink to a row per task before they are shuffled
    best = keyed.groupBy("sha").agg(F.min(first).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(best.select("sha", "best"), "sha").where(F.col("_row") != F.col("best._row")).select("_row", F.col("best.page_id").alias("refers_to"))


def write_archives(pages: DataFrame, where: str, smallest: int = SMALLEST_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row of the stored table ``pages(page_id, url, html)`` under ``where``; returns the manifest."""
    again = cut(revisits(pages, smallest)).withColumn("revisit", F.lit(True))  # stored, so its size is known to the join
    rows = row_id(pages.select("page_id", "url", "html")).join(again, "_row", "left").select("page_id", "url", "html", "revisit", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "revisit", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, html, revisit, refers_to = (c[i].as_py() for c in columns)
                if archive is None:
                    archive = Archive(f"{where}/{uuid.uuid4().hex}.warc.gz")
                archive.add(page_record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), bool(revisit), refers_to))
                if archive.size >= archive_bytes:
                    archive.close()
                    done.append(archive)
                    archive = None
        if archive is not None:
            archive.close()
            done.append(archive)
        yield pa.RecordBatch.from_arrays([pa.array([a.path for a in done], pa.string()), pa.array([a.records for a in done], pa.int64()), pa.array([a.size for a in done], pa.int64())], ["path", "records", "bytes"])

    return cut(rows.mapInArrow(write, "path string, records long, bytes long"))


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives that ``manifest(path)`` names, read one after another in each task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with open_in(path) as stream:
                    for r in read_records(stream):
                        h, payload = r.headers, r.payload()
                        revisit = h.get("warc-type") == "revisit"
                        rows.append((page_of(h.get("warc-record-id")), h.get("warc-target-uri"), h.get("warc-type"), page_of(h.get("warc-refers-to")) if revisit else None,
                                     r.http_length() if revisit else len(payload), h.get("warc-payload-digest", "").partition(":")[2] or None, None if revisit else payload))
                        held += len(payload)
                        if held > 4_000_000 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    spark = manifest.sparkSession
    wide = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path").repartition(wide, "path").mapInArrow(read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to, url``.

    ``pages`` is a stored table with ``page_id, url, html``; other columns are ignored. A null html is an empty
    payload; a null url is left out of the record and comes back as null, as does a null page_id. Of rows that
    repeat, with one id and an equal payload of 100 bytes or more, the first is the response. An empty table writes
    no archive and gives an empty result.
    """
    manifest = write_archives(pages, f"{folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}")
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")

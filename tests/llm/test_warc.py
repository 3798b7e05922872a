import base64
import gzip
import hashlib
import io
import zlib

import pytest

from placekit.llm import warc

SCHEMA = "page_id long, url string, html string"


def brute(rows):
    first = {}
    for p, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 100 and p is not None:
            first[raw] = min(p, first.get(raw, p))
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and p != first.get(raw, p)
        out.append((p is None, p or 0, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[raw] if again else None))
    return sorted(out, key=str)


def test_round_trip(stored):
    big, other = "<p>é</p>" * 30, "x" * 99
    rows = [(4, "http://a/", big), (2, "http://b/ü", big), (9, None, big), (1, "u", other), (3, "u", other), (5, "u", None), (6, "", ""), (7, "line\r\nbreak", "y" * 100), (8, "z", "y" * 100),
            (10, "z", "long " * 100_000), (11, "z", "a\r\n\r\nb" * 30), (None, None, "only" * 50)]
    got = warc.round_trip(stored(rows, SCHEMA, extra=True)).collect()
    assert sorted(((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows)
    assert {r.page_id: r.url for r in got}[2] == "http://b/ü"


def test_repeated_rows_and_empty_table(stored):
    got = warc.round_trip(stored([(1, "u", "q" * 200)] * 3, SCHEMA)).collect()
    assert sorted(r.record_type for r in got) == ["response", "revisit", "revisit"] and {r.refers_to for r in got} == {None, 1}
    assert warc.round_trip(stored([], SCHEMA)).collect() == []


def test_a_member_per_record_and_small_archives(stored, tmp_path):
    pages = stored([(i, f"http://h/{i}", f"page {i} " * 50) for i in range(40)], SCHEMA, files=2)
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=1000)
    files = [r.path for r in manifest.collect()]
    assert len(files) > 2 and sum(r.records for r in manifest.collect()) == 40
    raw = open(files[0].removeprefix("file://"), "rb").read()
    members = 0
    while raw:
        d = zlib.decompressobj(31)
        text = d.decompress(raw)
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
        raw, members = d.unused_data, members + 1
    assert members == next(r.records for r in manifest.collect() if r.path == files[0])
    assert {r.page_id: bytes(r.payload) for r in warc.read_archives(manifest).collect()} == {i: (f"page {i} " * 50).encode() for i in range(40)}


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_reading_piece_by_piece(piece):
    data = b"".join(warc.page_record(i, "u", b"body %d" % i * 300, False, None) for i in range(3))

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(piece, n))

    assert [r.payload() for r in warc.read_records(Slow(data))] == [b"body %d" % i * 300 for i in range(3)]


def test_broken_records_are_refused():
    good = gzip.decompress(warc.page_record(1, "u", b"payload", False, None))
    for bad in (good.replace(b"payload\r", b"paylOad\r"), good.replace(b"payload\r", b"payloa\r"), good + b"x", good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"Content-Length", b"X-Length")):
        with pytest.raises(warc.BrokenRecord):
            list(warc.read_records(io.BytesIO(gzip.compress(bad))))
    with pytest.raises(warc.BrokenRecord):
        list(warc.read_records(io.BytesIO(gzip.compress(good)[:-20])))


@pytest.mark.parametrize("write", [lambda d: d.hex(), lambda d: base64.b32encode(d).decode(), lambda d: base64.b32encode(d).decode().lower().rstrip("=")])
def test_digests_in_hex_and_base32(write):
    body = b"payload of a record"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body

    def archive(payload, kind="sha1"):
        head = (f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:1>\r\nContent-Type: application/http;msgtype=response\r\n"
                f"WARC-Payload-Digest: {kind}:{write(hashlib.sha1(payload).digest())}\r\nContent-Length: {len(http)}\r\n\r\n").encode()
        info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nnote\r\n\r\n"
        return io.BytesIO(gzip.compress(info) + gzip.compress(head + http + b"\r\n\r\n"))

    records = list(warc.read_records(archive(body)))
    assert [r.headers["warc-type"] for r in records] == ["warcinfo", "response"] and records[1].payload() == body
    assert len(list(warc.read_records(archive(b"other", "blake9000")))) == 2  # an unknown algorithm tells nothing
    with pytest.raises(warc.BrokenRecord):
        list(warc.read_records(archive(b"other")))

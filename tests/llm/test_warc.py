import base64
import gzip
import hashlib
import io
import zlib

import pyarrow as pa

from panelmill.llm import warc


def test_archives_round_trip(spark):
    rows = [(5, "http://a b/\r\nX: y", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "u", None), (2, "u", ""), (None, "u", "<p>é</p>"), (7, "u", "\r\n\r\nWARC/1.1\r\n"), (5, "u", "same"), (5, "u", "same"), (11, "u", "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = warc.archived(df).collect()
    told = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in found), key=str)
    e = len("<p>é</p>".encode())
    expected = [(5, e, "revisit", 3), (3, e, "response", None), (9, 0, "revisit", 2), (2, 0, "response", None), (None, e, "revisit", 3), (7, 14, "response", None), (5, 4, "response", None), (5, 4, "revisit", 5), (11, 3_000_000, "response", None)]
    assert told == sorted(expected, key=str)
    digest = {r.page_id: r.payload_digest for r in found if r.page_id in (2, 3, 11)}
    assert digest[11] == base64.b32encode(hashlib.sha1(b"x" * 3_000_000).digest()).decode()
    assert warc.archived(df.limit(0)).count() == 0


def test_normaliser_makes_members_that_stand_alone(tmp_path):
    body = b"hello\r\n\r\n"
    head = warc.record_head([("WARC-Type", "response"), ("Page-Id", "1")], len(body))
    with gzip.open(tmp_path / "m.warc.gz", "wb") as file:
        for _ in range(3):
            file.write(head + body + b"\r\n\r\n")
    told = pa.table({
        "archive": ["m.warc.gz"] * 3, "ordinal": pa.array([2, 0, 1], pa.int64()), "page_id": pa.array([3, 1, 2], pa.int64()),
        "record_type": ["response", "response", "revisit"], "refers_to": pa.array([None, None, 1], pa.int64()),
        "refers_archive": [None, None, "m.warc.gz"], "refers_ordinal": pa.array([None, None, 0], pa.int64()),
    })
    index = warc._normalise(str(tmp_path), 6)((pa.scalar("m.warc.gz"),), told).to_pydict()
    raw = (tmp_path / index["archive"][0]).read_bytes()
    assert sum(index["length"]) == len(raw) and index["page_id"] == [1, 2, 3]
    for offset, length, kind in zip(index["offset"], index["length"], index["record_type"]):
        member = zlib.decompressobj(31)
        data = member.decompress(raw[offset : offset + length])
        assert member.eof and not member.unused_data and f"WARC-Type: {kind}".encode() in data
        assert (body in data) == (kind == "response")
    assert (tmp_path / f"{index['archive'][0]}.idx.parquet").exists()


def test_inflating_reads_many_members_in_pieces():
    data = b"".join(gzip.compress(bytes([i]) * 50_000) for i in range(5))
    stream = warc.Inflated(io.BytesIO(data))
    assert b"".join(stream.pieces(250_000)) == b"".join(bytes([i]) * 50_000 for i in range(5))

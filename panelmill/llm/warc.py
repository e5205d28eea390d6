"""WARC archives: writing, and a normaliser for archives that are one gzip stream.

A monolithic archive (one gzip stream over all records) cannot be read at an
offset. The normaliser inflates such a file once, front to back, and rewrites
every record as a gzip member of its own; a sidecar index lists offset and
length of each member. Records whose payload was seen before become revisits
without a block. Files are streamed: no task holds more than one record's
headers and a piece of its block.

Archives lie in a shared folder. A task writes under a name of its own and
reports it in its rows, so a repeated task leaves a spare file and never a
wrong one.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from panelmill.llm.stores import Stores

#: Bytes of payload after which a writer begins another archive.
ARCHIVE_BYTES = 32 << 20
_PIECE = 1 << 20
_VERSION = b"WARC/1.1\r\n"


def digest(payload: bytes) -> str:
    """Base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI or plain path, and the path in it."""
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def _header_value(text: str) -> str:
    """One line; white space and control characters are escaped as in URLs."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record_head(fields: list[tuple[str, str]], length: int) -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", str(length))])
    return _VERSION + lines.encode() + b"\r\n"


class _GzipWriter:
    """A file of one or more gzip members that counts its compressed bytes."""

    def __init__(self, file, level: int):
        self.file, self.level, self.size, self.member = file, level, 0, None

    def write(self, data: bytes) -> None:
        if self.member is None:
            self.member = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        self._put(self.member.compress(data))

    def end_member(self) -> None:
        if self.member is not None:
            self._put(self.member.flush())
            self.member = None

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)


_WRITTEN = pa.schema(
    [("archive", pa.string()), ("ordinal", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
)


def _write(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        writer, name, ordinal, held = None, "", 0, 0
        for batch in batches:
            rows = []
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if writer is not None and held > ARCHIVE_BYTES:
                    writer.end_member()
                    writer.file.close()
                    writer = None
                if writer is None:
                    name, ordinal, held = f"mono-{uuid.uuid4().hex}.warc.gz", 0, 0
                    writer = _GzipWriter(system.open_output_stream(f"{root}/{name}", compression=None), level)
                payload = (html or "").encode("utf-8", "surrogatepass")
                told = digest(payload)
                fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
                if url is not None:
                    fields.append(("WARC-Target-URI", _header_value(url)))
                if page is not None:
                    fields.append(("Page-Id", str(page)))
                fields += [("WARC-Payload-Digest", f"sha1:{told}"), ("Content-Type", "text/html")]
                writer.write(record_head(fields, len(payload)) + payload + b"\r\n\r\n")
                rows.append((name, ordinal, page, len(payload), told))
                ordinal, held = ordinal + 1, held + len(payload)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 5, _WRITTEN, strict=True)], schema=_WRITTEN)
        if writer is not None:
            writer.end_member()
            writer.file.close()

    return run


def write_monolithic(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write (page_id: long, url, html) as archives of one gzip stream each; one row per record.

    The result is lazy and writes anew each time it runs; store it before using it twice.
    """
    columns = "archive string, ordinal long, page_id long, payload_bytes long, payload_digest string"
    return pages.select("page_id", "url", "html").mapInArrow(_write(folder, level), columns)


class Record(NamedTuple):
    fields: list[tuple[str, str]]
    length: int

    def field(self, name: str) -> str | None:
        return next((v for n, v in self.fields if n.lower() == name.lower()), None)


class Inflated:
    """The bytes of a gzip file (one member or many), read front to back in bounded pieces."""

    def __init__(self, file):
        self.file, self.inflater, self.pending, self.raw = file, zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        while True:
            if self.inflater.eof:
                self.raw = self.inflater.unused_data or self.raw
                self.inflater = zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.file.read(_PIECE)
            if not self.raw:
                return False
            data = self.inflater.decompress(self.raw, _PIECE)
            self.raw = b"" if self.inflater.eof else self.inflater.unconsumed_tail
            if data:
                self.pending += data
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``, without line ends before them; None at the end of the file."""
        while not (stripped := self.pending.lstrip(b"\r\n")):
            if not self._more():
                return None
        self.pending = stripped
        while (at := self.pending.find(mark)) < 0:
            if not self._more():
                raise ValueError("the archive ends inside a record's header")
        found, self.pending = self.pending[: at + len(mark)], self.pending[at + len(mark) :]
        return found

    def pieces(self, length: int) -> Iterator[bytes]:
        """Exactly ``length`` bytes, piece by piece."""
        while length:
            if not self.pending and not self._more():
                raise ValueError("the archive ends inside a record's block")
            piece, self.pending = self.pending[:length], self.pending[length:]
            length -= len(piece)
            yield piece

    def records(self) -> Iterator[Record]:
        """Headers of each record; its block must be read before the next."""
        while (head := self.until(b"\r\n\r\n")) is not None:
            lines = head.decode("utf-8", "surrogatepass").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record begins with {lines[0][:40]!r}")
            fields = [tuple(p.strip() for p in line.split(":", 1)) for line in lines[1:] if line]
            length = int(next(v for n, v in fields if n.lower() == "content-length"))
            yield Record([f for f in fields if f[0].lower() != "content-length"], length)


_INDEX = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64())])
_INDEX_DDL = "archive string, offset long, length long, record_type string, page_id long"


def _record_id(archive: str, ordinal: int) -> str:
    """A name that follows from the record's first place, so that others can refer to it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{ordinal}')}>"


def _normalise(folder: str, level: int):
    """One task per archive: its decisions in record order beside the inflated stream."""

    def run(key, told):
        system, root = open_folder(folder)
        archive, told = key[0].as_py(), told.sort_by("ordinal")
        kinds, pages, refers, targets = (told.column(c).to_pylist() for c in ("record_type", "page_id", "refers_to", "refers_archive"))
        places = told.column("refers_ordinal").to_pylist()
        name = f"norm-{uuid.uuid4().hex}.warc.gz"
        rows = []
        with system.open_input_stream(f"{root}/{archive}", compression=None) as source, system.open_output_stream(f"{root}/{name}", compression=None) as sink:
            stream, out = Inflated(source), _GzipWriter(sink, level)
            count = 0
            for ordinal, record in enumerate(stream.records()):
                begin, count = out.size, count + 1
                kept = [f for f in record.fields if f[0] not in ("WARC-Type", "WARC-Record-ID")]
                ids = [("WARC-Type", kinds[ordinal]), ("WARC-Record-ID", _record_id(archive, ordinal))]
                if kinds[ordinal] == "revisit":
                    ids += [
                        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                        ("WARC-Refers-To", _record_id(targets[ordinal], places[ordinal])),
                        ("Payload-Length", str(record.length)),
                    ]
                    if refers[ordinal] is not None:
                        ids.append(("Refers-To-Page-Id", str(refers[ordinal])))
                    out.write(record_head(ids + kept, 0))
                    for _ in stream.pieces(record.length):
                        pass
                else:
                    out.write(record_head(ids + kept, record.length))
                    for piece in stream.pieces(record.length):
                        out.write(piece)
                out.write(b"\r\n\r\n")
                out.end_member()
                rows.append((name, begin, out.size - begin, kinds[ordinal], pages[ordinal]))
        if count != len(kinds):
            raise ValueError(f"{archive} holds {count} records, not {len(kinds)}")
        index = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX)
        from pyarrow import parquet

        parquet.write_table(index, f"{root}/{name}.idx.parquet", filesystem=system)
        return index

    return run


def normalise(decisions: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrite the archives named in ``decisions``, one member per record, each with a sidecar index beside it.

    ``decisions`` has per record archive, ordinal, page_id, record_type,
    refers_to, refers_archive and refers_ordinal. An archive's decisions are
    bounded by the archive's size; one partition per archive keeps adaptive
    execution from putting many small groups of decisions, and so many large files, into one task.
    """
    dealt = decisions.repartition(2 * max(1, decisions.select("archive").distinct().count()), "archive")
    return dealt.groupBy("archive").applyInArrow(_normalise(folder, level), _INDEX_DDL)


def deduplicated(written: DataFrame) -> DataFrame:
    """Of records with equal payloads the one with the smallest page_id is the response, the others revisit it.

    Records without page_id come last; equal page_ids are told apart by archive
    and position, so one response is left. Digests are counted before they are joined,
    so a payload that fills a third of the table stays one row on its side.
    """
    order = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "archive", "ordinal")
    first = written.groupBy("payload_digest", "payload_bytes").agg(F.min(order).alias("first"))
    both = written.join(first, ["payload_digest", "payload_bytes"])
    revisit = (F.col("archive") != F.col("first.archive")) | (F.col("ordinal") != F.col("first.ordinal"))
    target = lambda c: F.when(revisit, F.col(f"first.{c}"))
    return both.select(
        "archive",
        "ordinal",
        "page_id",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        target("page_id").alias("refers_to"),
        target("archive").alias("refers_archive"),
        target("ordinal").alias("refers_ordinal"),
    )


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        for batch in batches:
            rows = []
            for archive in batch.column(0).to_pylist():
                from pyarrow import parquet

                index = parquet.read_table(f"{root}/{archive}.idx.parquet", filesystem=system)
                with system.open_input_file(f"{root}/{archive}") as file:
                    for offset, length in zip(index.column("offset").to_pylist(), index.column("length").to_pylist(), strict=True):
                        file.seek(offset)
                        stream = Inflated(_Bounded(file, length))
                        record = next(stream.records())
                        page, refers = record.field("Page-Id"), record.field("Refers-To-Page-Id")
                        told = (record.field("WARC-Payload-Digest") or "").removeprefix("sha1:")
                        size, sha = 0, hashlib.sha1()
                        for piece in stream.pieces(record.length):
                            sha.update(piece)
                            size += len(piece)
                        kind = record.field("WARC-Type")
                        if kind == "response" and base64.b32encode(sha.digest()).decode() != told:
                            raise ValueError(f"{archive} at {offset}: the payload does not match its digest")
                        size = int(record.field("Payload-Length")) if kind == "revisit" else size
                        rows.append((page and int(page), size, told, kind, refers and int(refers)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 5, _READ, strict=True)], schema=_READ)

    return run


class _Bounded:
    """The next ``left`` bytes of an open file."""

    def __init__(self, file, left: int):
        self.file, self.left = file, left

    def read(self, n: int) -> bytes:
        data = self.file.read(min(n, self.left))
        self.left -= len(data)
        return data


def read_normalised(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives named in ``index``, each inflated at its own offset and checked against its digest."""
    names = index.select("archive").distinct()
    names = names.repartition(max(1, names.count()))
    return names.mapInArrow(_read(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame) -> DataFrame:
    """Write all ``pages`` (page_id: long, url, html), normalise the archives, and read them back.

    Returns page_id, payload_bytes, payload_digest, record_type and refers_to per
    page. A null html is an empty payload, a null url is left out, a null
    page_id is kept without a name. Repeated rows are records of their own. An
    empty table writes no archive. Other columns are ignored.
    """
    stores = Stores(pages.sparkSession)
    folder = stores.path("warc")
    system, root = open_folder(folder)
    system.create_dir(root, recursive=True)
    written = stores.keep(write_monolithic(pages, folder), "written")
    decisions = stores.keep(deduplicated(written), "decisions")
    index = stores.keep(normalise(decisions, folder), "index")
    return read_normalised(index, folder)

"""WARC archives as dictionary-compressed Zstandard: writing, and a reader that validates what it reads.

An archive starts with a skippable frame (magic 0x184D2A5D, little-endian length) that holds the dictionary, either raw or as a Zstandard frame of
its own. Each record is one frame, compressed with that dictionary. The reader loads the dictionary, decodes frame by frame
and checks the version line, the needed headers, lengths, the blank lines that end a record, and payload digests.

Of records with equal payloads the one with the smallest page id is a response; the others are revisits without a payload that name its
record in WARC-Refers-To. A revisit keeps its payload's length in WARC-Payload-Length, as there is no block to tell it from.

Archives are rows (archive_id, data), so they go to and come from any store that Spark has; a task holds one archive, at most ARCHIVE_BYTES of records
or one record. `export` writes them as *.warc.zst files.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES, DICTIONARY_SAMPLES = 64 << 10, 256
SKIPPABLE = 0x184D2A5D
_DATE = "2024-01-01T00:00:00Z"
_NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


class WarcError(ValueError):
    """An archive or record that isn't valid."""


def record_id(page_id: int | None, digest: str, alone: bool = True) -> str:
    """Made from the page's id and its payload's digest, so that a revisit knows its response's; where ids are null or repeated, random, as it must be unique."""
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'page:{page_id}:{digest}') if alone and page_id is not None else uuid.uuid4()}>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, alone: bool = True) -> bytes:
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    block = http if revisit else http + payload
    target = (url or "urn:x-page:none").replace("\r", "%0D").replace("\n", "%0A")
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest, alone)), ("WARC-Date", _DATE), ("WARC-Target-URI", target), ("WARC-Page-ID", "" if page_id is None else str(page_id)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(len(payload)))]
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Page-ID", str(refers_to))]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def make_dictionary(records: list[bytes]) -> bytes:
    """Trained from at most DICTIONARY_SAMPLES records of the archive; where training has too little, the heads of the records."""
    samples = [r[:16384] for r in records[:DICTIONARY_SAMPLES]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(r[:1024] for r in samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"


def build_archive(records: list[bytes]) -> bytes:
    dictionary = make_dictionary(records)
    held = zstandard.ZstdCompressor(level=9).compress(dictionary)
    out = [struct.pack("<II", SKIPPABLE, len(held)), held]
    compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True, write_checksum=True)
    out += [compressor.compress(r) for r in records]
    return b"".join(out)


def load_dictionary(data: bytes) -> tuple[bytes | None, int]:
    """The dictionary of the leading skippable frame, if there, and where the first record's frame starts."""
    if len(data) < 8:
        raise WarcError("an archive of fewer than 8 bytes")
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        return None, 0
    held = data[8 : 8 + size]
    if len(held) != size:
        raise WarcError("the dictionary's frame is cut short")
    if held[:4] == struct.pack("<I", zstandard.MAGIC_NUMBER):
        with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(held)) as reader:
            held = reader.read()
    return held, 8 + size


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, one frame after another."""
    dictionary, at = load_dictionary(data)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        frame = decompressor.decompressobj()
        view = memoryview(data)
        parts, fed = [], at
        try:
            while not frame.eof and fed < len(data):
                parts.append(frame.decompress(view[fed : fed + (1 << 16)]))
                fed = min(len(data), fed + (1 << 16))
        except zstandard.ZstdError as error:
            raise WarcError(f"frame at byte {at}: {error}") from error
        if not frame.eof:
            raise WarcError(f"the frame at byte {at} is cut short")
        at = fed - len(frame.unused_data)
        yield parse_record(b"".join(parts))


class Headers(dict):
    """Headers by name, whatever the case of its letters."""

    def __setitem__(self, name: str, value: str) -> None:
        super().__setitem__(name.lower(), value)

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def __contains__(self, name: object) -> bool:
        return super().__contains__(str(name).lower())

    def get(self, name: str, default=None):
        return super().get(name.lower(), default)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("no WARC version line or no end of headers")
    headers = Headers()
    folded: list[str] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and folded:  # a folded line goes on with the header before
            folded[-1] += " " + line.strip()
        else:
            folded.append(line)
    for line in folded:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"a header without a colon: {line[:80]}")
        headers[name.strip()] = value.strip()
    if missing := [k for k in _NEEDED if k not in headers]:
        raise WarcError(f"headers are missing: {missing}")
    if not headers["Content-Length"].isdigit():
        raise WarcError("Content-Length isn't a number")
    size = int(headers["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"a block of {len(rest) - 4} bytes where {size} are declared")
    block = rest[:size]
    if headers["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        said = headers.get("WARC-Payload-Digest", "")
        if said.startswith("sha1:") and said[5:] != payload_digest(payload):
            raise WarcError("the payload's digest differs")
        if headers.get("WARC-Payload-Length", str(len(payload))) != str(len(payload)):
            raise WarcError("the payload's length differs")
    return headers, block


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    records: list[bytes] = []
    size = 0

    def flush() -> pa.RecordBatch:
        data = build_archive(records)
        return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(data).hexdigest()]), pa.array([len(records)]), pa.array([data], pa.binary())], names=["archive_id", "n_records", "data"])

    for batch in batches:
        for page_id, url, html, refers, alone in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "html", "refers_to", "alone")), strict=True):
            payload = (html or "").encode()
            record = build_record(page_id, url, payload, payload_digest(payload), refers, alone)
            if records and size + len(record) > ARCHIVE_BYTES:
                yield flush()
                records, size = [], 0
            records.append(record)
            size += len(record)
    if records:
        yield flush()


def write_archives(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) to archives (archive_id, n_records, data), one record for each row.

    A null html is an empty payload; a null url gets a placeholder. Of rows that share a payload and the smallest page_id, those with the least url (nulls first) are responses and the others
    revisit them; only rows that are equal in all three columns can be several responses, as nothing tells which of them is first. Rows with null ids revisit a payload's response too; where all
    ids of a payload are null each row is a response. A hot payload pre-aggregates to one row for each task; joining it back is an equi-join
    that adaptive execution splits.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    ids = rows.select("page_id", "url", F.sha1(F.encode(F.coalesce("html", F.lit("")), "utf-8")).alias("sha"))
    each = ids.groupBy("sha", "page_id").agg(F.min(F.struct(F.col("url").isNotNull().alias("has"), "url")).alias("least"), F.count("*").alias("n"))
    firsts = each.groupBy("sha").agg(F.min("page_id").alias("first"))
    # only the ids and digests meet in this join; the pages themselves follow by page_id where they are revisits or share an id
    known = each.join(firsts, "sha").where("page_id is null or page_id > first or n > 1").select(F.col("page_id").alias("of_page"), F.col("sha").alias("of"), "first", "n", F.col("least.url").alias("least_url"))
    sha = F.sha1(F.encode(F.coalesce("html", F.lit("")), "utf-8"))
    later = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")) | ~F.col("url").eqNullSafe(F.col("least_url")))
    marked = rows.join(known, F.col("page_id").eqNullSafe(F.col("of_page")) & (sha == F.col("of")), "left")
    alone = F.col("n").isNull() | (F.col("n") == 1) | ~later
    marked = marked.select("page_id", "url", "html", F.when(later, F.col("first")).alias("refers_to"), F.coalesce(alone, F.lit(True)).alias("alone"))
    return marked.mapInArrow(_write, "archive_id string, n_records long, data binary")


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_READ_DDL = "page_id long, url string, record_type string, record_id string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                rows = []
                for headers, block in read_records(data.as_py()):
                    payload = block.partition(b"\r\n\r\n")[2]
                    kind = headers["WARC-Type"]
                    number = lambda k: int(headers[k]) if headers.get(k) else None  # noqa: B023, E731
                    size = len(payload) if kind == "response" else number("WARC-Payload-Length")
                    digest = payload_digest(payload) if kind == "response" else headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                    rows.append((number("WARC-Page-ID"), headers.get("WARC-Target-URI"), kind, headers["WARC-Record-ID"], size, digest, number("WARC-Refers-To-Page-ID"), payload if with_payload and kind == "response" else None))
                    if len(rows) >= 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)

    return run


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """archives (data binary, ...) to their records. An archive or record that isn't valid raises WarcError."""
    return archives.select("data").mapInArrow(_read(with_payload), _READ_DDL)


def read_files(spark, path: str, with_payload: bool = True) -> DataFrame:
    """Records of *.warc.zst files, from any store that Spark reads."""
    return read_archives(spark.read.format("binaryFile").load(path).select(F.col("content").alias("data")), with_payload)


def export(archives: DataFrame, folder: str) -> None:
    """Writes each archive as a file <archive_id>.warc.zst below folder, a URI that pyarrow's file systems know on every executor; a path without a scheme only where this machine is the only one.

    Repeated attempts write the same file.
    """
    if "://" not in folder:
        if not re.match(r"local(\[|$)", archives.sparkSession.sparkContext.master):
            raise ValueError("a path without a scheme is a folder of each executor's own")
        folder = Path(folder).resolve().as_uri()

    def run(rows) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for row in rows:
            with store.open_output_stream(f"{base}/{row.archive_id}.warc.zst", compression=None) as out:
                out.write(row.data)

    archives.select("archive_id", "data").foreachPartition(run)

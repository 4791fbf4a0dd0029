"""WARC archives compressed with Zstandard: a dictionary in a leading skippable frame, then one frame for each record.

Each task writes archives of bounded size to a folder that all executors share, under a name of its own attempt, and
returns what it wrote; only archives of attempts that were counted are read. Readers take one archive at a time and one
frame at a time, and check the frames, headers, lengths and digests they find.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.llm.common import broadcast_if_small, materialise, prepare, shared_dir

#: Payloads of fewer bytes are stored each time.
LEAST_SHARED_BYTES = 100
#: An archive is closed when so many bytes of records were put in it.
ARCHIVE_BYTES = 64 << 20
#: The dictionary is trained on the first records of its archive, as many as make so many bytes.
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 32 << 10
#: Groups of copies, each with a URL, that may be broadcast.
MOST_GROUPS = 50_000
# Magic numbers of the dictionary's skippable frame and of a Zstandard frame.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
_EPOCH = "1970-01-01T00:00:00Z"
_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _record_id(page_id, digest: str, url) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}')}>"


def _uri(url: str | None) -> str | None:
    """A URL as a header line can hold it."""
    return None if url is None else quote(url, safe="".join(chr(c) for c in range(0x21, 0x7F) if chr(c) != "%"))


def _record(page_id, url, payload: bytes, digest: str, refers_to, refers_url=None) -> bytes:
    """One WARC record. A revisit holds the HTTP header alone; its digest and size are those of the full payload, and it names
    the record id, URI and date of the response that it revisits."""
    head = _HEAD.format(len(payload)).encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest, url)),
        ("WARC-Date", _EPOCH),
        ("WARC-Target-URI", _uri(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("X-Page-Id", page_id),
        ("X-Payload-Length", len(payload)),
        ("X-Refers-To-Page-Id", refers_to),
        ("WARC-Refers-To", _record_id(refers_to, digest, refers_url) if revisit else None),
        ("WARC-Refers-To-Target-URI", _uri(refers_url) if revisit else None),
        ("WARC-Refers-To-Date", _EPOCH if revisit else None),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("Content-Length", len(block)),
    ]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


def _dictionary(sample: list[bytes]) -> bytes:
    """A dictionary trained on the records; for too few of them, their bytes serve as one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:DICTIONARY_BYTES]


class _Archive:
    def __init__(self, folder: str) -> None:
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.waiting: list[bytes] = []
        self.out = self.compressor = None
        self.size = self.records = 0

    def add(self, record: bytes) -> None:
        self.size += len(record)
        self.records += 1
        if self.out:
            self.out.write(self.compressor.compress(record))
            return
        self.waiting.append(record)
        if self.size >= SAMPLE_BYTES:
            self._open()

    def _open(self) -> None:
        found = _dictionary(self.waiting)
        raw = zstandard.ZstdCompressionDict(found)
        self.out = self.files.open_output_stream(f"{self.folder}/{self.name}")
        self.out.write(struct.pack("<II", SKIPPABLE, len(found)) + found)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=raw, write_checksum=True, write_content_size=True)
        for record in self.waiting:
            self.out.write(self.compressor.compress(record))
        self.waiting = []

    def close(self) -> tuple[str, int]:
        if not self.out:
            self._open()
        self.out.close()
        return self.name, self.records


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for page_id, url, payload, digest, *refers in zip(*(c.to_pylist() for c in part.columns)):
                    archive = archive or _Archive(folder)
                    archive.add(_record(page_id, url, payload or b"", digest, *refers))
                    if archive.size >= ARCHIVE_BYTES:
                        done.append(archive.close())
                        archive = None
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["name", "records"])

    return run


def _need(truth: bool, what: str) -> None:
    if not truth:
        raise ValueError(f"broken archive: {what}")


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open archive, one frame at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    _need(magic == SKIPPABLE, "no dictionary frame")
    dictionary = stream.read(size)
    _need(len(dictionary) == size, "the dictionary is cut short")
    if dictionary[:4] == struct.pack("<I", FRAME):  # a dictionary may be stored compressed
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    rest = b""
    while rest or (rest := stream.read(1 << 20)):
        frame, parts = decompressor.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            rest = stream.read(1 << 20)
            _need(bool(rest), "a frame is cut short")
        yield parse_record(b"".join(parts))


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record that fills its frame."""
    head, mark, body = data.partition(b"\r\n\r\n")
    _need(bool(mark), "a record has no end of headers")
    version, *lines = head.decode("utf-8").split("\r\n")
    _need(version in ("WARC/1.0", "WARC/1.1"), f"version {version[:20]}")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(":")
        _need(bool(colon) and bool(re.fullmatch(r"[\w-]+", name)), "a header line")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        _need(name in headers, f"no {name}")
    size = headers["content-length"]
    _need(size.isdigit() and len(body) == int(size) + 4 and body.endswith(b"\r\n\r\n"), "a block's length")
    block = body[:-4]
    stated = headers.get("warc-block-digest", "")
    _need(not stated.startswith("sha256:") or stated[7:] == hashlib.sha256(block).hexdigest(), "a block's digest")
    return headers, block


def _page(headers: dict[str, str], block: bytes) -> tuple:
    number = lambda name: int(headers[name]) if name in headers else None
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    head, mark, payload = block.partition(b"\r\n\r\n")
    _need(bool(mark) and head.startswith(b"HTTP/"), "an HTTP header")
    size, payload_out = number("x-payload-length"), None
    if headers["warc-type"] == "response":
        payload_out = payload
        _need(len(payload) == size and hashlib.sha256(payload).hexdigest() == digest, "a payload's length or digest")
    return number("x-page-id"), size, digest, headers["warc-type"], number("x-refers-to-page-id"), headers.get("warc-target-uri"), payload_out


def _read(folder: str, payloads: bool):
    names = [x.split()[0] for x in ROW.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, seen, held = [], 0, 0
                with files.open_input_stream(f"{root}/{name}") as stream:
                    for headers, block in read_records(stream):
                        page = _page(headers, block)
                        rows.append(page if payloads else (*page[:-1], None))
                        seen, held = seen + 1, held + (len(block) if payloads else 200)
                        if held >= 4 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                _need(seen == records, f"{seen} of {records} records")
                if rows:
                    yield pack(rows)

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each row to archives in folder, a URI that all executors can open; returns (name, records).

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads of at least LEAST_SHARED_BYTES, those with
    the smallest page_id are responses, the others revisit it; rows without an id are responses. Payloads don't move
    between executors unless the groups of copies are too many to broadcast. A URL is percent-encoded where a header line
    could not hold it. No rows give no archives.
    """
    prepare(pages.sparkSession)
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    source = source.withColumn("digest", F.sha2("payload", 256))
    groups = source.where((F.octet_length("payload") >= LEAST_SHARED_BYTES) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("least"), F.max("page_id").alias("most")).where("least.page_id <> most")
    groups = broadcast_if_small(materialise(groups.select("digest", F.col("least.page_id").alias("least"), F.col("least.url").alias("least_url"))), MOST_GROUPS)
    revisits = F.col("least") != F.col("page_id")
    records = source.join(groups, "digest", "left").select("page_id", "url", "payload", "digest", F.when(revisits, F.col("least")).alias("refers_to"), F.when(revisits, F.col("least_url")).alias("refers_url"))
    return materialise(records.mapInArrow(_write(folder), "name string, records long"))


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The pages of archives (name, records) in folder: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    The payload of a revisit is null: it is that of the page it refers to. payloads=False leaves payloads out of the
    result; they are decoded and checked all the same. A record that breaks a rule is an error.
    """
    prepare(archives.sparkSession)
    return archives.select("name", "records").mapInArrow(_read(folder, payloads), ROW)


def remove_archives(folder: str) -> None:
    """Removes a folder of archives with all that is in it, what failed attempts left there too."""
    files, root = fs.FileSystem.from_uri(folder)
    files.delete_dir(root)


def archive_folder(pages: DataFrame) -> str:
    """A new folder for archives below the one that driver and executors share."""
    base = shared_dir(pages.sparkSession)
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    path = f"{base.replace('file:/', 'file:///', 1) if re.match('file:/[^/]', base) else base}/warc-{uuid.uuid4().hex}"
    files, root = fs.FileSystem.from_uri(path)
    files.create_dir(root)
    return path

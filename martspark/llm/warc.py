"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Writer: records with equal payloads of at least ``min_bytes`` share one response,
the one with the largest page id; the others are revisits that name it and hold no
payload. Which is which is settled on digests and ids alone, combined per task
before the shuffle. Every record is a gzip member of its own. Archives are written
by tasks into the shared folder under names of their own per attempt; a manifest
that Spark commits names those of the attempts that succeeded.

Reader: each record must be a whole gzip member (its checksum holds), begin with a
version line, have a header block whose ``Content-Length`` equals the body, and, for
a response, a body with the digest that its header states. After a failed check
the reader looks for the next gzip magic or version line at which a whole valid
record starts, goes on there, and logs the bytes between as a quarantined gap.
Uncompressed records are read as well, so files of either kind or of both can be
salvaged. A file is read as a stream of bounded pieces; only one record, or one
damaged stretch up to the bound of a record, is held at a time.

Defined results: a missing html is an empty payload; pages with equal payload and
the same largest id, or without an id at all, are all responses; a page without id
counts as the smallest; other columns are not read; an empty table gives no
archive.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martspark.llm.common import batches
from martspark.llm.token_files import filesystem
from martspark.session import working_path, written

VERSION = b"WARC/1.1\r\n"
GZIP = b"\x1f\x8b\x08"
PIECE = 1 << 20
STEP = 1 << 14
MAX_HEADER = 1 << 16
LEVEL = 6

MAX_RECORD = 1 << 28

# ``largest``: a bound of the bytes of the archive's largest record, unpacked.
MANIFEST = "file string, n_records long, n_bytes long, largest long"
RECORDS = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
           "payload binary, file string, start long, length long")
GAPS = "file string, start long, length long, reason string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def _line(value: str | None) -> str:
    """A header value on one line; line ends and ``%`` are escaped."""
    return (value or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit states size and digest of the payload it leaves out."""
    body = b"" if revisit else payload
    lines = ["WARC-Type: " + ("revisit" if revisit else "response"), "WARC-Record-ID: " + _record_id(page_id, url)]
    if url is not None:
        lines.append("WARC-Target-URI: " + _line(url))
    lines += ["WARC-Payload-Digest: sha1:" + digest(payload), f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


class Damaged(Exception):
    """A record that fails a check."""


def parse_record(data: bytes, max_header: int = MAX_HEADER) -> tuple[dict[str, str], bytes, int]:
    """Headers, body and size of the record at the start of ``data``; a search in foreign bytes bounds the header."""
    if not data.startswith(b"WARC/1."):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", 0, max_header)
    if end < 0:
        raise Damaged("header without end")
    try:
        lines = data[:end].decode().split("\r\n")[1:]
        headers = {key.strip().lower(): value.strip() for key, value in (line.split(":", 1) for line in lines)}
        n = int(headers["content-length"])
    except (UnicodeDecodeError, ValueError, KeyError):
        raise Damaged("header not readable") from None
    body = bytes(data[end + 4:end + 4 + n])
    if n < 0 or len(body) < n or data[end + 4 + n:end + 8 + n] != b"\r\n\r\n":
        raise Damaged("content length does not fit")
    if headers.get("warc-type") == "response" and headers.get("warc-payload-digest") != "sha1:" + digest(body):
        raise Damaged("payload digest differs")
    return headers, body, end + 8 + n


class Salvager:
    """Valid records and gaps of one file, front to back."""

    def __init__(self, source, max_record: int = MAX_RECORD):
        self.source, self.max_record = source, max_record
        self.held, self.at, self.ended = bytearray(), 0, False

    def _more(self) -> bool:
        piece = b"" if self.ended else self.source.read(PIECE)
        self.ended = self.ended or not piece
        self.held += piece
        return bool(piece)

    def _member(self) -> tuple[dict, bytes, int]:
        """The gzip member at the start of what is held."""
        unpacker, out, used, size = zlib.decompressobj(31), [], 0, 0
        while not unpacker.eof:
            if used == len(self.held) and not self._more():
                raise Damaged("member without end")
            part = self.held[used:used + STEP]
            try:
                out.append(unpacker.decompress(part))
            except zlib.error:
                raise Damaged("member checksum or data") from None
            used += len(part)
            size += len(out[-1])
            if size > self.max_record:
                raise Damaged("record over the size bound")
            if len(out) == 1 and not b"WARC/1."[:len(out[0])] == out[0][:7]:
                raise Damaged("no version line")
        data = b"".join(out)
        headers, body, n = parse_record(data, len(data))  # a whole member has no longer header than itself
        if n != len(data):
            raise Damaged("member holds more than its record")
        return headers, body, used - len(unpacker.unused_data)

    def _plain(self) -> tuple[dict, bytes, int]:
        while True:
            try:
                return parse_record(self.held)
            except Damaged as failure:
                waits = str(failure) == "content length does not fit" or (
                    str(failure) == "header without end" and len(self.held) < MAX_HEADER)
                if not waits or len(self.held) > self.max_record or not self._more():
                    raise

    def _next(self) -> tuple[dict, bytes, int]:
        while len(self.held) < 7 and self._more():
            pass
        if self.held.startswith(GZIP):
            return self._member()
        return self._plain()

    def _drop(self, n: int) -> None:
        del self.held[:n]
        self.at += n

    def _search(self) -> bool:
        """Leave out bytes up to the next place that looks like a start."""
        while True:
            places = [p for p in (self.held.find(GZIP, 1), self.held.find(b"WARC/1.", 1)) if p > 0]
            if places:
                self._drop(min(places))
                return True
            self._drop(max(0, len(self.held) - 6))  # a start may be cut by the end of what is held
            if not self._more():
                self._drop(len(self.held))
                return False

    def __iter__(self) -> Iterator[tuple]:
        """``("record", start, length, headers, body)`` and ``("gap", start, length, reason)``."""
        gap = None
        while True:
            if not self.held and not self._more():
                break
            start = self.at
            try:
                headers, body, n = self._next()
            except Damaged as failure:
                gap = gap or (start, str(failure))
                if self._search():
                    continue
                break
            if gap:
                yield "gap", gap[0], start - gap[0], gap[1]
                gap = None
            self._drop(n)
            yield "record", start, n, headers, body
        if gap:
            yield "gap", gap[0], self.at - gap[0], gap[1]


def _payload(html: Column) -> Column:
    return F.coalesce(html.cast("string"), F.lit("")).cast("binary")


def with_record_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, revisit, refers_to`` per page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        _payload(F.col("html")).alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    large = F.octet_length("payload") >= min_bytes
    shared = written(rows.filter(large).groupBy("sha").agg(F.max("page_id").alias("leader"), F.count("*").alias("n"))
                     .filter("n > 1").select("sha", "leader"), "shared-payloads")
    joined = rows.join(shared, "sha", "left")
    revisit = F.col("leader").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader")) & large
    return joined.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("leader")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Archives of ``pages(page_id, url, html)`` below ``path``; returns the committed manifest."""
    spark = pages.sparkSession
    folder = posixpath.join(path, "archives")
    fs, local = filesystem(folder)
    fs.create_dir(local, recursive=True)

    def write(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"pages-{uuid.uuid4().hex}.warc.gz"
        sink, n, size, largest = None, 0, 0, 0
        for frame in batches(frames):
            if sink is None:
                out, base = filesystem(folder)
                sink = out.open_output_stream(f"{base}/{name}", compression=None)
            for page_id, url, payload, revisit, refers_to in zip(*(frame.column(k) for k in range(5))):
                record = encode_record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), revisit.as_py())
                sink.write(record)
                n, size = n + 1, size + len(record)
                largest = max(largest, len(payload.as_py()) + 3 * len((url.as_py() or "").encode()) + 4096)
        if sink is not None:
            sink.close()
            yield pa.record_batch([pa.array([name]), *(pa.array([x], pa.int64()) for x in (n, size, largest))],
                                  names=["file", "n_records", "n_bytes", "largest"])

    manifest = posixpath.join(path, "manifest")
    with_record_types(pages, min_bytes).mapInArrow(write, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def _files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """``file, n_records, largest`` once per file, spread over the session's tasks; unknown numbers are null.

    Ranges, unlike a hash of the file, are not what the grouping already gives, so Spark keeps
    this exchange, and a fixed number of partitions is not merged at run time.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = [F.max(c).alias(c) if c in files.columns else F.lit(None).cast("long").alias(c) for c in ("n_records", "largest")]
    return files.groupBy("file").agg(*known).repartitionByRange(n, "file")


def salvage(folder: str, name: str, max_record: int = MAX_RECORD) -> Iterator[tuple]:
    fs, base = filesystem(folder)
    with fs.open_input_stream(f"{base}/{name}", compression=None) as source:
        yield from Salvager(source, max_record)


def _whole(value: str | None) -> int | None:
    return int(value) if value and value.lstrip("-").isdigit() else None


def read_warc(spark: SparkSession, folder: str, files: DataFrame, payloads: bool = True, whole: bool = False) -> DataFrame:
    """All valid records of ``files(file)`` in ``folder``, in ``RECORDS`` columns.

    A manifest as ``files`` gives the bound of a record's size. With ``whole`` the read fails, and
    names the gaps, if an archive does not hold as many valid records as its manifest says.
    """

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(),
                 pa.int64(), pa.int64()]
        names = [part.split()[0] for part in RECORDS.split(", ")]

        def batch(rows):
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for frame in batches(frames):
            for name, expected, largest in zip(*(column.to_pylist() for column in frame.columns)):
                rows, size, found, gaps = [], 0, 0, []
                for what, start, length, *rest in salvage(folder, name, max(MAX_RECORD, largest or 0)):
                    if what != "record":
                        gaps.append((start, length, *rest))
                        continue
                    headers, body = rest
                    found += 1
                    kind = headers.get("warc-type")
                    n = len(body) if kind == "response" else _whole(headers.get("x-payload-length"))
                    uri = headers.get("warc-target-uri")
                    uri = uri and uri.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
                    rows.append((_whole(headers.get("x-page-id")), uri, kind, _whole(headers.get("x-refers-to-page-id")), n,
                                 headers.get("warc-payload-digest", "").removeprefix("sha1:"),
                                 body if payloads else None, name, start, length))
                    size += len(body)
                    if len(rows) >= 1000 or size >= 16 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)
                if whole and expected is not None and found != expected:
                    raise ValueError(f"{name}: {found} of {expected} records; gaps {gaps[:20]}")

    return _files(spark, folder, files).mapInArrow(read, RECORDS)


def read_gaps(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """The quarantined byte ranges of ``files(file)``."""

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            for name in frame.column(0).to_pylist():
                rows = [(name, *found[1:]) for found in salvage(folder, name) if found[0] == "gap"]
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                          names=[part.split()[0] for part in GAPS.split(", ")])

    return _files(spark, folder, files).mapInArrow(read, GAPS)


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read the records back."""
    spark = pages.sparkSession
    path = working_path(spark, "warc")
    manifest = write_warc(pages, path, min_bytes)
    return read_warc(spark, posixpath.join(path, "archives"), manifest, payloads=False, whole=True).drop("payload")

"""WARC archives with a two-level capture index.

Records are written as gzip members of .warc.gz files. The index sorts captures by
their reversed-host URL key into compressed blocks, and a sparse directory holds each
block's first key. A lookup searches the directory by halves, reads that one block by its
range, searches it by halves, and reads the record by its range.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Tables, as_id, scratch_path, slices

BLOCK_LINES = 3000
RANGE_BYTES, RANGE_ROWS = 8 << 20, 4000
ARCHIVE_BYTES = 256 << 20
SEPARATOR = "\x01"
DATE = "2024-01-01T00:00:00Z"


def capture_key(url: str | None, page_id: int | None) -> str:
    """Reversed host, path and query, then the page's number so that keys sort captures of one URL."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        parts, host, port = urlsplit(""), "", None
    host = re.sub(r"^www\d*\.", "", host)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + (parts.path or "/").lower()
    if parts.query:
        key += "?" + "&".join(sorted(parts.query.lower().split("&")))
    number = "-" if page_id is None else f"{page_id + (1 << 63):020d}"
    return re.sub(r"[\s\x00-\x1f]", "_", key) + SEPARATOR + number


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member with a response, or a revisit of the response of page ``refers_to``.

    Record ids are random and so unique; the pages' own ids go in extension fields.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    uri = re.sub(r"[\r\n]+", " ", url)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"X-Page-ID: {'none' if page_id is None else page_id}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    return gzip.compress(head + block + b"\r\n\r\n", 5, mtime=0)


def parse_record(member: bytes) -> dict:
    """Header fields in lower case, and ``http`` and ``payload`` as bytes."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {"version": head[: head.find(b"\r\n")].decode()}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.lower()] = value.strip()
    block = rest[: int(fields["content-length"])]
    fields["http"], _, fields["payload"] = block.partition(b"\r\n\r\n")
    return fields


class Files:
    """Reads ranges of files in the shared folder; keeps a few files open."""

    def __init__(self, most: int = 32):
        self.open: dict[str, object] = {}
        self.most = most

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri not in self.open:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open))).close()
            system, path = fs.FileSystem.from_uri(uri)
            self.open[uri] = system.open_input_file(path)
        return self.open[uri].read_at(length, offset)

    def close(self) -> None:
        for f in self.open.values():
            f.close()
        self.open.clear()


class Writer:
    """Appends blobs to files of bounded size under a folder; a retried task writes other files."""

    def __init__(self, folder: str, suffix: str, most: int):
        self.folder, self.suffix, self.most = folder, suffix, most
        self.uri, self.file, self.at = "", None, 0

    def add(self, blob: bytes) -> tuple[str, int, int]:
        if self.file is None or self.at >= self.most:
            self.close()
            self.uri = f"{self.folder}/{uuid.uuid4().hex}{self.suffix}"
            system, path = fs.FileSystem.from_uri(self.uri)
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            self.file, self.at = system.open_output_stream(path, buffer_size=1 << 20, compression=None), 0
        offset = self.at
        self.file.write(blob)
        self.at += len(blob)
        return self.uri, offset, len(blob)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def _write(folder: str):
    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("start", pa.int64()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = fs.FileSystem.from_uri(folder)
        info[0].create_dir(info[1], recursive=True)
        out = Writer(folder, ".warc.gz", ARCHIVE_BYTES)
        try:
            for batch in slices(batches, "html", 4 << 20):
                rows = []
                for page, url, html, keeper in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html", "keeper")), strict=True):
                    refers = keeper if keeper is not None and keeper != page else None
                    rows.append((capture_key(url, page), page, *out.add(record(page, url or "", (html or "").encode(), refers))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        finally:
            out.close()

    return run


DIRECTORY = pa.schema([("first", pa.string()), ("last", pa.string()), ("uri", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("n", pa.int64())])


def _index(folder: str, lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = fs.FileSystem.from_uri(folder)
        info[0].create_dir(info[1], recursive=True)
        out = Writer(folder, ".cdx.gz", ARCHIVE_BYTES)
        held: list[tuple] = []

        def block(rows: list[tuple]) -> pa.RecordBatch:
            text = "\n".join(f"{k} {u} {s} {n}" for k, u, s, n in rows)
            uri, start, size = out.add(gzip.compress(text.encode(), 6, mtime=0))
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (rows[0][0], rows[-1][0], uri, start, size, len(rows))], schema=DIRECTORY)

        try:
            for batch in batches:
                held += zip(*(batch.column(c).to_pylist() for c in ("key", "uri", "start", "size")), strict=True)
                while len(held) >= lines:
                    yield block(held[:lines])
                    held = held[lines:]
            if held:
                yield block(held)
        finally:
            out.close()

    return run


class CaptureIndex:
    """Lookups among captures with low <= key <= high; loads that part of the sparse directory."""

    def __init__(self, directory: str, low: str = "", high: str = "\U0010ffff"):
        system, path = fs.FileSystem.from_uri(directory)
        names = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")]
        part = dataset.dataset(names, DIRECTORY, format="parquet", filesystem=system).to_table(filter=(dataset.field("first") <= high) & (dataset.field("last") >= low))
        self.rows = sorted(part.to_pylist(), key=lambda r: (r["first"], r["last"]))
        self.firsts = [r["first"] for r in self.rows]
        self.files = Files()
        self._at, self._lines, self._keys = None, [], []

    def _block(self, i: int) -> None:
        if self._at != i:
            r = self.rows[i]
            self._lines = [x.split(" ") for x in gzip.decompress(self.files.read(r["uri"], r["start"], r["size"])).decode().split("\n")]
            self._keys = [x[0] for x in self._lines]
            self._at = i

    def entries(self, low: str, high: str) -> Iterator[tuple[str, str, int, int]]:
        """(key, file, offset, length) of the captures with low <= key <= high, in order."""
        i = max(0, bisect.bisect_left(self.firsts, low) - 1)
        while i < len(self.rows) and self.firsts[i] <= high:
            if self.rows[i]["last"] >= low:
                self._block(i)
                for j in range(bisect.bisect_left(self._keys, low), bisect.bisect_right(self._keys, high)):
                    key, uri, start, size = self._lines[j]
                    yield key, uri, int(start), int(size)
            i += 1

    def captures(self, url: str) -> list[dict]:
        """The records of all captures of a URL."""
        key = capture_key(url, None).split(SEPARATOR)[0] + SEPARATOR
        return [parse_record(self.files.read(u, s, n)) for _, u, s, n in self.entries(key, key + "\x7f")]


READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _page(number: str | None) -> int | None:
    return int(number) if number not in (None, "none") else None


def _by_key(captures: DataFrame) -> DataFrame:
    """Captures in ranges of their keys, one for every RANGE_BYTES of records (or RANGE_ROWS captures where sizes aren't known), however short the keys."""
    total = F.sum("size") / RANGE_BYTES if "size" in captures.columns else F.count("*") / RANGE_ROWS
    n = int(captures.agg(total.cast("long")).first()[0] or 0) + 1
    return captures.repartitionByRange(n, "key").sortWithinPartitions("key")


def _read(directory: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = sorted(batch.column("key").to_pylist())
            if not keys:
                continue
            index = CaptureIndex(directory, keys[0], keys[-1])
            for at in range(0, len(keys), 500):
                rows = []
                for key in keys[at : at + 500]:
                    for _, uri, start, size in index.entries(key, key):
                        r = parse_record(index.files.read(uri, start, size))
                        whole = r["warc-type"] == "response"
                        length = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", r["http"])[1])
                        digest = sha1_base32(r["payload"]) if whole else r["warc-payload-digest"].removeprefix("sha1:")
                        if whole and (length != len(r["payload"]) or r["warc-payload-digest"] != f"sha1:{digest}"):
                            raise ValueError(f"damaged record at {uri}:{start}")
                        rows.append((_page(r["x-page-id"]), r["warc-target-uri"], length, digest, r["warc-type"], _page(r.get("x-refers-to-page-id")), r["payload"] if whole else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), READ.types, strict=True)], schema=READ)
            index.files.close()

    return run


class Archive:
    """WARC files with their index under one shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @property
    def directory(self) -> str:
        return f"{self.folder}/directory"

    def index(self) -> CaptureIndex:
        """For lookups of single URLs, ``index().captures(url)``."""
        return CaptureIndex(self.directory)

    def read(self, keys: DataFrame) -> DataFrame:
        """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload): the captures with the keys in column ``key``.

        Keys are sorted into ranges, so a task reads few blocks of the index. A revisit
        has no payload; its bytes and digest are those of the payload that it saw.
        """
        own = keys.groupBy("key").agg(F.max("size").alias("size")) if "size" in keys.columns else keys.select("key").distinct()
        wanted = _by_key(own).select("key")
        return wanted.mapInArrow(_read(self.directory), "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def write_archive(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None, least_bytes: int = 0) -> tuple[Archive, DataFrame]:
    """Write a record for each row of ``pages``; return the archive and its captures (key, page_id, uri, start, size).

    The payload is the html in UTF-8, empty if null. Of rows with equal payloads of at least
    ``least_bytes`` bytes, those with the largest page_id are responses and the others
    revisits of it; smaller payloads are all responses. Rows without page_id are
    written too, as revisits if another row bears the payload. Rows that repeat a page_id are
    records of their own. A null url is empty. Other columns are not read.

    Digests are counted by a partial aggregation, and the rows of repeated ones
    are joined back by digest, where Spark splits hot ones. Files are
    written by tasks under random names; only those that a finished task returned are
    in the index, so what a lost task left behind is never read.
    """
    spark = pages.sparkSession
    tables = Tables(spark)
    folder = folder or scratch_path(spark, "warc")
    html = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    own = pages.select(as_id(pages, id_col).alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), html.alias("html"))
    own = own.withColumn("digest", F.when(F.octet_length("html") >= least_bytes, F.sha1(F.col("html").cast("binary"))))
    seen = own.groupBy("digest").agg(F.max("id").alias("keeper"), F.count("*").alias("n"))
    keepers = tables.write(seen.where("n > 1 and digest is not null").drop("n"), "keepers")
    written = own.join(keepers, "digest", "left").select("id", "url", "html", "keeper")
    captures = tables.write(written.mapInArrow(_write(f"{folder}/archive"), "key string, page_id bigint, uri string, start bigint, size bigint"), "captures")
    lines = _by_key(captures.select("key", "uri", "start", "size"))
    lines.mapInArrow(_index(f"{folder}/index", BLOCK_LINES), "first string, last string, uri string, start bigint, size bigint, n bigint").write.parquet(f"{folder}/directory")
    return Archive(spark, folder), captures

"""WARC archives as a Python data source, for reading and writing.

Reading plans partitions of whole files up to `split_bytes`. Predicates on header columns (record type, URI, digest, ids)
are pushed into the reader and tested on the headers of a record before anything of its payload is decompressed; a payload
is decoded only if the schema asks for it or `verify` is set, and its length is told from the headers. Archives are
compressed by record, and each gzip member says in its extra field 'sl' how long it is (the skip lengths of the format's
annex), so an unwanted payload is stepped over. Members without that field may hold any number of records, and
uncompressed archives are read too. Archives are opened through pyarrow's file systems, so they may stand in any store
that it knows; s3a:// and s3n:// name the same store as s3://. A URL that is no plain printable ASCII is written quoted,
under a header that says so, and read back as it was.

Writing gives files of at most about `file_bytes` for each task and a manifest once all tasks have succeeded; reading
follows the manifests, so files of failed or repeated attempts count for nothing.

Defined results: a null payload is empty; a null id or URI has no header; of equal payloads of at least `min_bytes`, rows
with the least page id are responses and all others revisit that id; an empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from gristmill.llm.common import materialise, shared_path

SPLIT_BYTES, FILE_BYTES = 64 << 20, 128 << 20
LEVEL = 1
BATCH = 2000
HEADER_COLUMNS = {"page_id": "WARC-Record-ID", "record_type": "WARC-Type", "url": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "date": "WARC-Date", "content_length": "Content-Length"}
SCHEMA = "page_id long, record_type string, url string, payload_digest string, payload_bytes long, refers_to long, date string, content_length long, headers map<string,string>, payload binary"
_IDS, _NUMBERS = {"page_id", "refers_to"}, {"content_length"}
# Fixed values of the format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
_QUOTED = "X-Target-URI-Quoted"
_PLAIN_URL = re.compile(r"[!-~]+")


def _id_uri(x: int) -> str:
    return f"<urn:page:{x}>"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member with its skip lengths."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(data)) if max(size, len(data)) < 1 << 32 else b"  " + struct.pack("<HII", 8, 0, 0)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(kind: str, page_id: int | None, url: str | None, digest: str, n: int, payload: bytes | None, refers_to: int | None) -> bytes:
    """A record: its headers and, as its block, an HTTP answer (of a revisit: its headers alone)."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: {_id_uri(page_id)}")
    head.append(f"WARC-Date: {_DATE}")
    if url is not None and _PLAIN_URL.fullmatch(url):
        head.append(f"WARC-Target-URI: {url}")
    elif url is not None:
        head += ["WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]~", errors="replace"), f"{_QUOTED}: utf-8"]
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_id_uri(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    return {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def value_of(column: str, headers: dict[str, str]):
    """A header column's value, or None."""
    v = headers.get(HEADER_COLUMNS[column])
    if v is None:
        return None
    if column in _IDS:
        v = v.strip("<>").rpartition(":")[2]
        return int(v) if v.lstrip("-").isdigit() else None
    if column in _NUMBERS:
        return int(v)
    if column == "url" and _QUOTED in headers:
        return unquote(v)
    return v.removeprefix("sha1:") if column == "payload_digest" else v


def _holds(f: Filter, headers: dict[str, str]) -> bool:
    v = value_of(f.attribute[0], headers)
    if isinstance(f, IsNotNull):
        return v is not None
    if v is None:
        return False
    if isinstance(f, EqualTo):
        return v == f.value
    if isinstance(f, In):
        return v in f.value
    return {StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__}[type(f)](v, f.value)


def _member_size(f: io.BufferedReader) -> int | None:
    """Reads the header of a gzip member: its whole size if it has skip lengths, else 0; None at the end of the file."""
    head = f.read(10)
    if len(head) < 10:
        return None
    if head[:2] != b"\x1f\x8b":
        raise ValueError("an archive has something else between its gzip members")
    flags, size = head[3], 0
    if flags & 4:
        extra = f.read(struct.unpack("<H", f.read(2))[0])
        size = struct.unpack("<I", extra[4:8])[0] if extra[:2] == b"sl" else 0
    for flag in (8, 16):  # a name, a comment
        while flags & flag and f.read(1) not in (b"\0", b""):
            pass
    if flags & 2:
        f.read(2)
    return size


class _Inflated(io.RawIOBase):
    """What a gzip member holds, from behind its header; once read, f stands behind the member."""

    def __init__(self, f: io.BufferedReader):
        self.f, self.opened, self.rest = f, zlib.decompressobj(-15), b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.rest and not self.opened.eof:
            chunk = self.opened.unconsumed_tail or self.f.read(4096)
            if not chunk:
                raise ValueError("an archive ends within a record")
            self.rest = self.opened.decompress(chunk, 1 << 16)
            if self.opened.eof:
                self.f.seek(8 - len(self.opened.unused_data), io.SEEK_CUR)
        n = min(len(into), len(self.rest))
        into[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def _passed_over(f: io.BufferedReader, n: int) -> None:
    while n > 0:
        part = len(f.read(min(n, 1 << 16)))
        if not part:
            raise ValueError("an archive ends within a record")
        n -= part


def _next_headers(f: io.BufferedReader) -> dict[str, str] | None:
    """The headers of the next record, empty lines before them passed over; None at the end."""
    lines = []
    while (line := f.readline()) not in (b"\r\n", b"") or not lines and line:
        if line != b"\r\n":
            lines.append(line)
    if lines and not line:
        raise ValueError("an archive ends within a record")
    return parse_headers(b"".join(lines)) if lines else None


def _block(f: io.BufferedReader, headers: dict[str, str], how: str) -> tuple[bytes | None, int]:
    """What of a record's block is wanted, and how much was read: nothing, the HTTP headers ('http') or all ('block')."""
    n = int(headers.get("Content-Length", 0))
    if how == "block":
        data = f.read(n)
        if len(data) < n:
            raise ValueError("an archive ends within a record")
        return data, n
    if how == "http":
        data = b""
        while len(data) < n and not data.endswith(b"\r\n\r\n") and (line := f.readline(n - len(data))):
            data += line
        return data, len(data)
    return None, 0


Found = tuple[dict[str, str], bytes | None]


def _compressed_records(f: io.BufferedReader, wanted) -> Iterator[Found]:
    while True:
        start = f.tell()
        size = _member_size(f)
        if size is None:
            return
        inside = io.BufferedReader(_Inflated(f), 4096 if size else 1 << 16)
        while (headers := _next_headers(inside)) is not None:
            how = wanted(headers)
            block, read = _block(inside, headers, how)
            if how:
                yield headers, block
            if size:  # a member with skip lengths is one record: the rest of it is stepped over
                break
            _passed_over(inside, int(headers.get("Content-Length", 0)) - read)
        if size:
            f.seek(start + size)


def _plain_records(f: io.BufferedReader, wanted) -> Iterator[Found]:
    while (headers := _next_headers(f)) is not None:
        how = wanted(headers)
        block, read = _block(f, headers, how)
        f.seek(int(headers.get("Content-Length", 0)) - read, io.SEEK_CUR)
        if how:
            yield headers, block


def uri_of(path: str) -> str:
    """path under the scheme that pyarrow knows its store by; Hadoop's connectors have others."""
    return re.sub(r"^s3[an]://", "s3://", path)


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    return fs.FileSystem.from_uri(uri_of(path))


def records(path: str, wanted) -> Iterator[Found]:
    """The records of an archive. wanted(headers): '' to pass over, else how much of the block: 'headers', 'http' or 'block'."""
    store, at = store_of(path)
    with io.BufferedReader(store.open_input_file(at), 1 << 18) as f:
        packed = f.peek(2)[:2] == b"\x1f\x8b"
        yield from (_compressed_records if packed else _plain_records)(f, wanted)


_MANIFEST = "_manifest-"


def _listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the archives in a folder that manifests name, or of all if there is none; or of one file."""
    store, at = store_of(path)
    path = uri_of(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    inside = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
    manifests = [x for x in inside if x.base_name.startswith(_MANIFEST)]
    named = set()
    for x in manifests:
        with store.open_input_stream(x.path) as f:
            named.update(json.loads(f.read()))
    return sorted((prefix + x.path, x.size) for x in inside if x.type == fs.FileType.File and ".warc" in x.base_name and (not manifests or x.base_name in named))


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.path = schema.names, options["path"]
        self.arrow = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in schema.fields])
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In | IsNotNull | StringStartsWith | StringEndsWith | StringContains) and f.attribute[0] in HEADER_COLUMNS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out, size = [], 0
        for path, n in _listed(self.path):
            if not out or size + n > self.split:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out or [Files([])]

    def _wanted(self, headers: dict[str, str]) -> str:
        if not all(_holds(f, headers) for f in self.filters):
            return ""
        if "payload" in self.columns or self.verify and headers.get("WARC-Type") != "revisit":
            return "block"
        return "http" if "payload_bytes" in self.columns else "headers"

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for path in partition.paths:
            for headers, block in records(path, self._wanted):
                rows.append(self._row(headers, block))
                if len(rows) >= BATCH or len(rows) > 50 and "payload" in self.columns:
                    yield pa.RecordBatch.from_pylist(rows, self.arrow)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, self.arrow)

    def _row(self, headers: dict[str, str], block: bytes | None) -> dict:
        row = {c: value_of(c, headers) for c in self.columns if c in HEADER_COLUMNS}
        if "headers" in self.columns:
            row["headers"] = list(headers.items())
        if block is not None:
            http, end, payload = block.partition(b"\r\n\r\n")
            revisit = headers.get("WARC-Type") == "revisit"
            held = int(headers.get("Content-Length", 0)) - len(http) - len(end)
            if "payload_bytes" in self.columns:  # a revisit has none of its own: its HTTP headers say how long it was
                row["payload_bytes"] = int(parse_headers(http).get("Content-Length", held)) if revisit else held
            if self.verify and not revisit and digest_of(payload) != value_of("payload_digest", headers):
                raise ValueError(f"the payload of {headers.get('WARC-Record-ID')} isn't what its digest says")
            if "payload" in self.columns:
                row["payload"] = None if revisit else payload
        return row


_ARROW = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}


class WarcWriter(DataSourceArrowWriter):
    """Rows of page_id, url, record_type, refers_to, payload_sha1 (hex), payload_bytes and payload (null for revisits)."""

    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.limit, self.overwrite = options["path"], int(options.get("file_bytes", FILE_BYTES)), overwrite

    def prepare(self) -> None:
        """Called once, before any task: from now on manifests say which archives count, so that files of a failed write don't."""
        store, at = store_of(self.path)
        store.create_dir(at, recursive=True)
        inside = [x.base_name for x in store.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File]
        if not any(x.startswith(_MANIFEST) for x in inside):
            self._name([x for x in inside if ".warc" in x])

    def _name(self, names: list[str]) -> str:
        """Write a manifest of these archives."""
        store, at = store_of(self.path)
        manifest = f"{_MANIFEST}{uuid.uuid4().hex}.json"
        with store.open_output_stream(posixpath.join(at, manifest)) as f:
            f.write(json.dumps(sorted(names)).encode())
        return manifest

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = store_of(self.path)
        store.create_dir(at, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                cols = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "record_type", "refers_to", "payload_sha1", "payload_bytes", "payload")]
                for page_id, url, kind, refers_to, sha1, n, payload in zip(*cols, strict=True):
                    if out is None or size >= self.limit:
                        if out:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = store.open_output_stream(posixpath.join(at, names[-1]), compression=None), 0
                    digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                    data = gzip_member(record(kind.as_py(), page_id.as_py(), url.as_py(), digest, n.as_py(), payload.as_py(), refers_to.as_py()))
                    out.write(data)
                    size += len(data)
        finally:
            if out:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = store_of(self.path)
        before = [x.path for x in store.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File]
        new = {x for m in messages if m for x in m.names}
        self._name(list(new))
        if self.overwrite:  # manifests first: archives that none names don't count
            for path in sorted(before, key=lambda x: not posixpath.basename(x).startswith(_MANIFEST)):
                if posixpath.basename(path) not in new:
                    store.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        store, at = store_of(self.path)
        for name in (x for m in messages if m for x in m.names):
            store.delete_file(posixpath.join(at, name))


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        out = WarcWriter(self.options, overwrite)
        out.prepare()
        return out


def register(spark: SparkSession) -> None:
    """Make the format 'warc' known to a session and let predicates reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, columns: str = SCHEMA, **options) -> DataFrame:
    """The records of the archives at path; columns names those wanted, and payloads are decoded only for them."""
    register(spark)
    return spark.read.format("warc").schema(columns).options(**options).load(path)


def to_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """A row for each page, as WarcWriter takes them. Payloads that occur once, the most, join nothing and stay in place."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", F.sha1(payload).alias("payload_sha1"), F.octet_length(payload).cast("long").alias("payload_bytes"), payload.alias("payload"))
    seen = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_sha1", "payload_bytes").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    repeated = materialise(seen.filter("n > 1").select("payload_sha1", "payload_bytes", "first_id"), "repeated")  # of known size, so the planner chooses the join
    rows = rows.join(repeated, ["payload_sha1", "payload_bytes"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.select(
        "page_id",
        "url",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
        "payload_sha1",
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record for each page to path."""
    register(pages.sparkSession)
    to_records(pages, min_bytes).write.format("warc").mode("append").save(path)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, read back from archives.

    Revisits are read by their headers alone, and the payloads of other records are stepped over; the payloads of responses
    are decoded and held against their digests, and revisits stepped over.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    archive(pages, path, min_bytes)
    columns = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return read(spark, path, columns).filter("record_type = 'revisit'").unionByName(read(spark, path, columns, verify="true").filter("record_type = 'response'"))

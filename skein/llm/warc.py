r"""WARC archives as a PySpark data source, ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading: the files below a path are planned into partitions of about ``partition_bytes``, and of less
where that is needed to have ``partitions`` of them; large files first, a file is read by one task. Filters on the header columns are pushed down. A record's header
is parsed first; where a predicate fails, or the schema asked for holds neither payload nor http,
the block is skipped: in a plain file by seeking past its Content-Length; in a compressed one by the
length of the record that its gzip member names (``sl`` field), and where none does, by inflating
without keeping. Only a block that is wanted is read, parted into HTTP header and payload and
decoded (chunked, gzip, deflate). Columns: those of ``SCHEMA``, or any of them by ``.schema(...)``.
A record whose content isn't ``application/http`` has all of its block as payload. A truncated record or one that
doesn't begin as a WARC record fails with its file and place.

Writing: files of about ``file_bytes`` at most, of one gzip member for each record (``compression``
none: plain); columns ``record_type, record_id, target_uri, date, headers, http, payload``, of which record_type
must be there. Files get their names when all tasks have ended, so what failed or ran twice leaves
nothing. Paths are any that pyarrow's file systems open: local, HDFS, S3, GCS.

``records`` makes records of pages, and revisits of those whose payload a later page also has.

Nulls and edge cases: null values give no header line; line breaks in header values become blanks;
a null or empty payload has length 0 and the digest of no bytes; an empty folder and an empty table
give no record. Pages: a null html is empty; of equal payloads all rows with the largest page_id are
responses (a null id is less than any); a null page_id has an id of its own kind; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from skein.functions.lines import let

SCHEMA = "record_type string, record_id string, target_uri string, date string, content_type string, content_length long, headers map<string,string>, http map<string,string>, payload binary, file string, offset long"
#: Header lines that have columns of their own.
NAMES = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type"}
KINDS = {"headers": pa.map_(pa.string(), pa.string()), "http": pa.map_(pa.string(), pa.string()), "payload": pa.binary(), "content_length": pa.int64(), "offset": pa.int64()}
#: Bytes of an Arrow batch, and of a look into a compressed member.
BATCH, LOOK = 8 << 20, 1 << 16
#: Bytes at hand with which a gzip member's own header can be read.
LEAST = 512
HEAD = re.compile(rb"WARC/\d+\.\d+\r?\n")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class Lines(dict):
    """Header lines by name, in lower case for asking."""

    def ask(self, name: str) -> str | None:
        return next((v for k, v in self.items() if k.lower() == name.lower()), None)


def header(data: bytes) -> Lines:
    """Lines of a header without its first; a line that begins with a blank goes on."""
    out, last = Lines(), None
    for line in data.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            out[last] = value.strip()
    return out


def http_parts(block: bytes) -> tuple[Lines, bytes]:
    """HTTP header and decoded payload of a block."""
    found = re.search(rb"\r?\n\r?\n", block)
    lines, body = header(block[: found.start()] if found else block), block[found.end() :] if found else b""
    if "chunked" in (lines.ask("Transfer-Encoding") or "").lower():
        body = unchunked(body)
    coding = (lines.ask("Content-Encoding") or "").lower()
    if body and coding in ("gzip", "x-gzip", "deflate"):
        body = zlib.decompress(body, zlib.MAX_WBITS | 32) if body[:2] == b"\x1f\x8b" or body[0] & 15 == 8 else zlib.decompress(body, -zlib.MAX_WBITS)
    return lines, body


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while at < len(body):
        end = body.index(b"\n", at)
        n = int(body[at:end].split(b";")[0].strip() or b"0", 16)
        out.append(body[end + 1 : end + 1 + n])
        at = end + 1 + n + (2 if body[end + 1 + n : end + 3 + n] == b"\r\n" else 1)
        if not n:
            break
    return b"".join(out)


class Member(io.RawIOBase):
    """A gzip member's content as a stream; ``finish`` goes to the member's end and ``left`` is what was read beyond it."""

    def __init__(self, file: Any, first: bytes) -> None:
        self.file, self.raw, self.inflate = file, first, zlib.decompressobj(zlib.MAX_WBITS | 16)

    def readable(self) -> bool:
        return True

    def readinto(self, into: Any) -> int:
        while not self.inflate.eof:
            self.raw = self.raw or self.file.read(LOOK)
            if not self.raw:
                raise EOFError("truncated")
            made = self.inflate.decompress(self.raw, len(into))
            self.raw = self.inflate.unconsumed_tail
            if made:
                into[: len(made)] = made
                return len(made)
        return 0

    def finish(self) -> bytes:
        while self.read(LOOK):
            pass
        return self.inflate.unused_data


def member_bytes(head: bytes) -> int | None:
    """Bytes of a whole gzip member, where its ``sl`` field tells them."""
    if len(head) < 12 or not head[3] & 4:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        n = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"sl" and n == 8:
            return struct.unpack_from("<I", head, at + 4)[0] or None
        at += 4 + n
    return None


def member(data: bytes) -> bytes:
    """``data`` as a gzip member that names its own length."""
    packed = zlib.compress(data, 6, -zlib.MAX_WBITS)
    total = 12 + 12 + len(packed) + 8
    field = b"sl" + struct.pack("<HII", 8, total if total < 1 << 32 else 0, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", len(field)) + field + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _head(stream: Any) -> tuple[int, Lines] | None:
    """Bytes of blank lines before the record at hand, and its header; None at the end."""
    first, blank = stream.readline(), 0
    while first in (b"\r\n", b"\n"):
        blank += len(first)
        first = stream.readline()
    if not first:
        return None
    if not HEAD.fullmatch(first):
        raise ValueError("no WARC record")
    data = [first]
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise EOFError("truncated")
        data.append(line)
    return blank, header(b"".join(data))


def walk(file: Any, compressed: bool, wants: Any) -> Iterator[tuple[int, Lines, bytes | None]]:
    """(place, header, block) of the records; ``wants`` of a header tells whether it comes at all, and whether with its block."""
    at = 0
    if not compressed:
        stream = io.BufferedReader(file) if isinstance(file, io.RawIOBase) else file
        while True:
            at = stream.tell()
            found = _head(stream)
            if found is None:
                return
            n, (comes, whole) = int(found[1].ask("Content-Length") or 0), wants(found[1])
            block = stream.read(n) if comes and whole else None
            if block is None:
                stream.seek(n, 1)
            elif len(block) < n:
                raise EOFError("truncated")
            if comes:
                yield at + found[0], found[1], block
    rest = memoryview(b"")
    while True:
        first = rest if len(rest) >= LEAST else memoryview(bytes(rest) + file.read(LOOK))
        if not first:
            return
        if first[:2] != b"\x1f\x8b":
            raise ValueError("no gzip member")
        total = member_bytes(first)
        inner = Member(file, first[:total] if total else first)
        stream = io.BufferedReader(inner, LOOK)
        found = _head(stream)
        if found is not None:
            n, (comes, whole) = int(found[1].ask("Content-Length") or 0), wants(found[1])
            block = stream.read(n) if comes and whole else None
            if block is not None and len(block) < n:
                raise EOFError("truncated")
            if comes:
                yield at, found[1], block
        if total is None:
            rest = memoryview(inner.finish())
            at = file.tell() - len(rest)
        else:
            at += total
            rest = first[total:]
            if total > len(first):
                file.seek(at)


def _passes(filters: list[Filter]) -> Any:
    def one(f: Filter) -> Any:
        name = NAMES[f.attribute[0]]
        tests = {
            EqualTo: lambda v: v == f.value, In: lambda v: v in f.value, GreaterThan: lambda v: v > f.value, GreaterThanOrEqual: lambda v: v >= f.value,
            LessThan: lambda v: v < f.value, LessThanOrEqual: lambda v: v <= f.value, StringStartsWith: lambda v: v.startswith(f.value), IsNotNull: lambda v: True,
        }
        test = tests[type(f)]
        return lambda lines: (v := lines.ask(name)) is not None and test(v)

    each = [one(f) for f in filters]
    return lambda lines: all(test(lines) for test in each)


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.size, self.least = options["path"], int(options.get("partition_bytes", 128 << 20)), int(options.get("partitions", 1))
        self.columns, self.filters = schema.names, []
        unknown = set(self.columns) - {x.split()[0] for x in SCHEMA.split(", ")}
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        known = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith, IsNotNull)
        for f in filters:
            if type(f) in known and len(f.attribute) == 1 and f.attribute[0] in NAMES:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, path = opened(self.path)
        info = fs.get_file_info(path)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        files = sorted(((f.size, f.path) for f in found if f.is_file and not f.base_name.startswith(("_", "."))), reverse=True)
        out: list[list[str]] = []
        most = min(self.size, sum(size for size, _ in files) // self.least)
        held = 0
        for size, name in files:
            if not out or held + size > most:
                out.append([])
                held = 0
            out[-1].append(name)
            held += size
        return [Files(x) for x in out or [[]]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, whole = opened(self.path)[0], bool({"payload", "http"} & set(self.columns))
        passes = _passes(self.filters)
        rows, held = [], 0
        for name in partition.paths:
            with fs.open_input_file(name) as file:
                with_gzip = file.read(2) == b"\x1f\x8b"
                file.seek(0)
                try:
                    for at, lines, block in walk(file if with_gzip else PlainFile(file), with_gzip, lambda x: (passes(x), whole)):
                        rows.append(self.row(name, at, lines, block))
                        held += len(block or b"") + 500
                        if held > BATCH:
                            yield self.batch(rows)
                            rows, held = [], 0
                except (ValueError, EOFError, zlib.error) as e:
                    raise ValueError(f"{name}, after byte {file.tell()}: {e}") from e
        yield self.batch(rows)

    def row(self, name: str, at: int, lines: Lines, block: bytes | None) -> tuple:
        talks = (lines.ask("Content-Type") or "").lower().startswith("application/http")
        http, payload = http_parts(block) if talks and block is not None else (Lines(), block)
        own = {c: lines.ask(n) for c, n in NAMES.items()}
        own |= {"content_length": int(lines.ask("Content-Length") or 0), "headers": list(lines.items()), "http": list(http.items()), "payload": payload, "file": name, "offset": at}
        return tuple(own[c] for c in self.columns)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [KINDS.get(c, pa.string()) for c in self.columns]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(zip(self.columns, kinds, strict=True))))


class PlainFile(io.RawIOBase):
    """A pyarrow file as Python's buffered readers want it."""

    def __init__(self, file: Any) -> None:
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, at: int, whence: int = 0) -> int:
        self.file.seek(at, whence)
        return self.file.tell()

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, into: Any) -> int:
        data = self.file.read(len(into))
        into[: len(data)] = data
        return len(data)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]) -> None:
        self.names = names


def record(row: dict) -> bytes:
    """The bytes of a record. Digest and length are those of the payload at hand unless ``headers`` names others."""
    payload, http = row.get("payload") or b"", row.get("http")
    block = ((http.encode() + b"\r\n\r\n") if http else b"") + payload
    given = dict(row.get("headers") or [])
    lines = {n: row.get(c) for c, n in NAMES.items() if row.get(c) is not None} | {"WARC-Payload-Digest": "sha1:" + base32_sha1(payload)} | given | {"Content-Length": len(block)}
    text = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', str(v))}\r\n" for k, v in lines.items() if v is not None)
    return b"WARC/1.1\r\n" + text.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.pack, self.size = options["path"].rstrip("/"), options.get("compression", "gzip") != "none", int(options.get("file_bytes", 1 << 30))
        if overwrite:
            raise ValueError("archives are never written over; choose a new folder")
        fs, path = opened(self.path)
        if fs.get_file_info(path).type != pafs.FileType.NotFound and any(f.is_file for f in fs.get_file_info(pafs.FileSelector(path))):
            raise ValueError(f"{self.path} already holds files")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, path = opened(self.path)
        fs.create_dir(f"{path}/_tmp", recursive=True)
        names, file, held = [], None, 0
        try:
            for batch in iterator:
                for i in range(batch.num_rows):
                    if file is None or held >= self.size:
                        if file:
                            file.close()
                        names.append(f"{uuid.uuid4().hex}.warc{'.gz' if self.pack else ''}")
                        file, held = fs.open_output_stream(f"{path}/_tmp/{names[-1]}", compression=None), 0
                    made = record({c: batch.column(c)[i].as_py() for c in batch.schema.names})
                    made = member(made) if self.pack else made
                    file.write(made)
                    held += len(made)
        finally:
            if file:
                file.close()
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = opened(self.path)
        fs.create_dir(path, recursive=True)
        for name in [x for m in messages if m is not None for x in m.names]:
            fs.move(f"{path}/_tmp/{name}", f"{path}/{name}")
        self.clean(fs, path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.clean(*opened(self.path))

    @staticmethod
    def clean(fs: pafs.FileSystem, path: str) -> None:
        if fs.get_file_info(f"{path}/_tmp").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{path}/_tmp")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets Spark hand filters to it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


#: Base-32 digits as Spark writes them, and as RFC 4648 does.
DIGITS, ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_digest(payload: Column) -> Column:
    """Upper-case base32 SHA-1: five digits of the hex digest at a time give four letters. The digest is bound: a payload is gone through once."""
    four = lambda h, i: F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0")
    return let(F.sha1(payload), lambda h: F.translate(F.concat(*[four(h, i) for i in range(8)]), DIGITS, ALPHABET))


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def page_of(record_id_: Column) -> Column:
    return F.nullif(F.regexp_extract(record_id_, r"^<urn:page:(-?\d+)>$", 1), F.lit("")).cast("long")


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """A record for each row of ``pages`` (page_id, url, html), as the writer takes them.

    Of pages whose payloads are equal and of ``least`` bytes or more, that with the largest page_id
    is a response and the others revisit it: their block is the HTTP header alone, whose length and
    whose digest are those of the full payload. Only payloads that occur more than once have a row
    in what is joined; it has one row for each, so a payload that many pages share can be split.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    told = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keyed = told.withColumn("_k", F.when(F.length("payload") >= least, F.unhex(F.sha2("payload", 256))))
    again = keyed.filter(F.col("_k").isNotNull()).groupBy("_k").agg(F.count("*").alias("_n"), F.max("page_id").alias("_last")).filter("_n > 1").select("_k", "_last")
    rows = keyed.join(again.withColumnRenamed("_k", "_a"), F.col("_k") == F.col("_a"), "left").drop("_a", "_k")
    later = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    length = F.length("payload").cast("string")
    digest = F.concat(F.lit("sha1:"), base32_digest(F.col("payload")))
    headers = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("WARC-Payload-Digest").alias("k"), digest.alias("v")),
        F.struct(F.lit("Content-Type").alias("k"), F.lit("application/http; msgtype=response").alias("v")),
        F.struct(F.lit("WARC-Refers-To").alias("k"), F.when(later, record_id(F.col("_last"))).alias("v")),
        F.struct(F.lit("WARC-Profile").alias("k"), F.when(later, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest").alias("v")),
    ), lambda x: x["v"].isNotNull()))
    return rows.select(
        F.when(later, "revisit").otherwise("response").alias("record_type"), record_id(F.col("page_id")).alias("record_id"), F.col("url").alias("target_uri"), headers.alias("headers"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length).alias("http"), F.when(~later, F.col("payload")).alias("payload"),
    )


def pages_of(archive: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the records that ``records`` made, read from their headers and payloads.

    The digest of a response is made of its payload as it was read, that of a revisit is its header's.
    """
    full = F.col("record_type") == "response"
    return archive.select(
        page_of(F.col("record_id")).alias("page_id"),
        F.when(full, F.length("payload")).otherwise(F.col("http")["Content-Length"].cast("long")).cast("long").alias("payload_bytes"),
        F.when(full, base32_digest(F.col("payload"))).otherwise(F.substring_index(F.col("headers")["WARC-Payload-Digest"], ":", -1)).alias("payload_digest"),
        "record_type", page_of(F.col("headers")["WARC-Refers-To"]).alias("refers_to"),
    )

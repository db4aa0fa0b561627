"""WARC 1.1 archives: a writer of gzipped records with revisits, and a Python data source that reads them.

Every record is a gzip member of its own, whose extra field 'sl' holds the member's size and the record's size, so that a
reader steps over a record it does not want without inflating it. Members without the field, and plain files, are read too.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from tidemark.llm.shared import spread

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to_id string, payload_digest string, "
    "headers map<string,string>, http_headers string, payload binary, file string, offset long"
)
#: Column: the header it comes from.
HEADER_OF = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "refers_to_id": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"
LEAST_SHARED = 100
CHUNK = 1 << 20


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def member(record: bytes, level: int = 1) -> bytes:
    """record as one gzip member with the 'sl' field."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    size = 10 + 2 + 20 + len(body) + 8
    extra = b"sl" + struct.pack("<HQQ", 16, size, len(record))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_uri(page_id: int | None, n: int = 0) -> str:
    return f"urn:x-page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, digest, first): the pages whose payload of at least `least` bytes is also that of a smaller page_id, `first`.

    Only ids and digests are shuffled; the group of each digest is reduced to its smallest id before the shuffle, and the join
    back is salted, so that one payload on many pages is dealt over many tasks."""
    salts = 32
    small = pages.where(F.length("payload") >= least).select("page_id", F.sha2("payload", 256).alias("digest"))
    firsts = small.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    dealt = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = small.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    return salted.join(dealt, ["digest", "salt"]).where("page_id > first").select("page_id", "digest", "first").distinct()


def write_warc(pages: DataFrame, path: str, least: int = LEAST_SHARED, files: int | None = None) -> None:
    """Writes a record for every row of pages (page_id, url, html) to gzipped archives in path.

    The payload is html in UTF-8 (null: empty). Of the pages whose payloads are equal and have at least `least` bytes, those with
    the smallest page_id are written whole and the others as revisits of it. A null page_id never revisits and gets a random
    record id; rows that share a page_id are each written; a null url gives a record without target; control characters in a
    url become spaces; other columns are ignored. An empty table gives a folder without archives, of which read_warc makes no rows."""
    where, root = _place(path)
    where.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, top = _place(path)
        out, rows, name = None, 0, f"{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    out = place.open_output_stream(f"{top}/_{name}", compression=None)
                    out.write(member(record([("WARC-Type", "warcinfo"), ("WARC-Date", EPOCH), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
                payload = r["payload"]
                headers = [("WARC-Type", "response" if r["first"] is None else "revisit"), ("WARC-Date", EPOCH), ("WARC-Record-ID", f"<{page_uri(r['page_id'])}>")]
                if r["url"] is not None:
                    headers.append(("WARC-Target-URI", "".join(c if c.isprintable() else " " for c in r["url"])))
                headers += [("WARC-Payload-Digest", f"sha256:{r['digest']}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
                if r["page_id"] is not None:
                    headers.append(("X-Page-ID", str(r["page_id"])))
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                if r["first"] is not None:
                    headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{page_uri(r['first'])}>")]
                out.write(member(record(headers, http if r["first"] is not None else http + payload)))
                rows += 1
        if out is not None:
            out.close()
            place.move(f"{top}/_{name}", f"{top}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([rows], pa.int64())})

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    found = revisits(rows, least).withColumnsRenamed({"page_id": "id", "digest": "same"})
    keyed = rows.withColumn("digest", F.sha2("payload", 256))
    # page_id is a key: no value of it can gather many rows but null, which is spread by the digest.
    dealt = keyed.repartition(files or spread(pages), "page_id", "digest")
    joined = dealt.join(found, (F.col("page_id") == F.col("id")) & (F.col("digest") == F.col("same")), "left").drop("id", "same")
    done = joined.mapInArrow(write, "file string, records long").collect()  # one row for each file
    kept = {r["file"] for r in done}
    # What tasks left that failed after their file was whole is not in the list.
    for f in where.get_file_info(fs.FileSelector(root)):
        if f.base_name.endswith(".warc.gz") and f.base_name not in kept:
            where.delete_file(f.path)


@dataclass
class FileRange(InputPartition):
    """Records that begin in [start, end) of a file."""

    path: str
    start: int
    end: int
    split: bool


class _Bytes:
    """A file read forward, with what is buffered ahead."""

    def __init__(self, f: pa.NativeFile, at: int):
        self.f, self.at, self.held = f, at, b""
        f.seek(at)

    def ahead(self, n: int) -> bytes:
        while len(self.held) < n and (more := self.f.read(max(CHUNK, n - len(self.held)))):
            self.held += more
        return self.held

    def skip(self, n: int) -> None:
        if n <= len(self.held):
            self.held = self.held[n:]
        else:
            self.f.seek(self.at + n)
            self.held = b""
        self.at += n


def parsed(head: bytes) -> dict[str, str]:
    """The headers of a record by their lower-case names; lines that go on are joined; {} if it is no WARC header."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        return {}
    found: dict[str, str] = {}
    key = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and key:
            found[key] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            key = name.strip().lower()
            found[key] = value.strip()
    return found


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split_bytes = int(options.get("splitbytes", 64 << 20))
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.tests: list[tuple[str, str, object]] = [(k[len("header.") :].lower(), "=", v) for k, v in options.items() if k.startswith("header.")]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Tests of header columns are done on a record's headers, before its payload is looked at; others are left to Spark."""
        for f in filters:
            name = HEADER_OF.get(f.attribute[0], "").lower() if len(getattr(f, "attribute", ())) == 1 else ""
            if name and isinstance(f, EqualTo):
                self.tests.append((name, "=", f.value))
            elif name and isinstance(f, In):
                self.tests.append((name, "in", frozenset(f.value)))
            elif name and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            elif name and isinstance(f, IsNotNull):
                self.tests.append((name, "there", None))
            else:
                yield f

    def partitions(self) -> list[FileRange]:
        where, root = _place(self.path)
        info = where.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(root, recursive=True))
        prefix = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        parts = []
        for f in sorted(files, key=lambda f: f.path):
            if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and f.base_name.endswith((".warc", ".warc.gz")):
                step = self.split_bytes if f.base_name.endswith(".gz") else f.size  # a payload may look like records: only members are split
                parts += [FileRange(prefix + f.path, lo, min(lo + step, f.size), lo > 0) for lo in range(0, f.size, max(1, step))]
        return parts

    def wanted(self, headers: dict[str, str]) -> bool:
        for name, how, value in self.tests:
            have = headers.get(name)
            if have is None or (how == "=" and have != value) or (how == "in" and have not in value) or (how == "starts" and not have.startswith(value)):
                return False
        return True

    def read(self, part: FileRange | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # a folder without archives
            return
        place, top = _place(part.path)
        with place.open_input_file(top) as f:
            rows, held = [], 0
            for offset, headers, block in (self._members if top.endswith(".gz") else self._plain)(f, part):
                rows.append(self._row(part.path, offset, headers, block))
                held += len(block)
                if held > 4 << 20 or len(rows) == 1000:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    def _members(self, f: pa.NativeFile, part: FileRange) -> Iterator[tuple[int, dict[str, str], bytes]]:
        b = _Bytes(f, part.start)
        if part.split and not self._to_member(b, part.end):
            return
        while b.at < part.end and b.ahead(32):
            at, size, z, out = b.at, None, zlib.decompressobj(31), b""
            head = b.held[:32]
            if head[3] & 4 and head[12:14] == b"sl":
                size = struct.unpack("<Q", head[16:24])[0]
            taken = 0
            while (end := out.find(b"\r\n\r\n")) < 0 and not z.eof:
                piece = b.ahead(taken + 4096)[taken : taken + 4096]
                if not piece:
                    break
                out += z.decompress(piece)
                taken += len(piece)
            headers = parsed(out[: max(end, 0)])
            want = bool(headers) and self.wanted(headers)
            body = [out[end + 4 :]]
            if (want and self.with_payload) or size is None:
                while not z.eof:
                    piece = b.ahead(taken + 65536)[taken : taken + 65536]
                    if not piece:
                        raise ValueError(f"{part.path}: the record at {at} is cut off")
                    body.append(z.decompress(piece))
                    taken += len(piece)
                size = taken - len(z.unused_data)
            b.skip(size)
            if want:
                yield at, headers, b"".join(body)[: int(headers.get("content-length", 0))] if self.with_payload else b""

    def _to_member(self, b: _Bytes, end: int) -> bool:
        """Moves to the first member from here that begins a WARC record."""
        while b.at < end:
            if not (held := b.ahead(CHUNK)):
                return False
            k = held.find(b"\x1f\x8b\x08")
            if k < 0:
                b.skip(max(1, len(held) - 2))
                continue
            b.skip(k)
            try:
                if zlib.decompressobj(31).decompress(b.ahead(4096)[:4096], 5) == b"WARC/":
                    return b.at < end
            except zlib.error:
                pass
            b.skip(1)
        return False

    def _plain(self, f: pa.NativeFile, part: FileRange) -> Iterator[tuple[int, dict[str, str], bytes]]:
        b, need = _Bytes(f, part.start), 4096
        while b.ahead(need):
            if (end := b.held.find(b"\r\n\r\n")) < 0:
                if len(b.held) < need:
                    return
                need *= 2
                continue
            at, headers = b.at, parsed(b.held[:end])
            size, need = int(headers.get("content-length", 0)), 4096
            b.skip(end + 4)
            if headers and self.wanted(headers):
                yield at, headers, b.ahead(size)[:size] if self.with_payload else b""
            b.skip(size + 4)

    def _row(self, path: str, offset: int, headers: dict[str, str], block: bytes) -> tuple:
        http, payload = None, block if self.with_payload else None
        if payload is not None and headers.get("content-type", "").startswith("application/http"):
            head, found, rest = block.partition(b"\r\n\r\n")
            if found:
                http, payload = head.decode("utf-8", "replace"), rest
        if headers.get("warc-type") == "revisit":
            payload = None
        return (*(headers.get(h.lower()) for h in HEADER_OF.values()), list(headers.items()), http, payload, path, offset)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    text = pa.string()
    kinds = [text] * 6 + [pa.map_(text, text), text, pa.binary(), text, pa.int64()]
    names = [*HEADER_OF, "headers", "http_headers", "payload", "file", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class WarcDataSource(DataSource):
    """spark.read.format("warc"): options path, splitBytes, payload (false: headers only), header.<Name> (a header to equal)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in dict(self.options).items()})


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The records of the archives in path. Filters on record_type, target_uri and the other header columns reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").options(**options).load(path)


def page_records(records: DataFrame) -> DataFrame:
    """What each page's record says: page_id, payload_bytes, payload_digest, record_type, refers_to. Of responses, length and
    digest are taken from the payload that was read."""
    there = records.where(F.col("record_type").isin("response", "revisit"))
    whole = F.col("record_type") == "response"
    return there.select(
        F.col("headers")["x-page-id"].cast("long").alias("page_id"),
        F.when(whole, F.length("payload").cast("long")).otherwise(F.col("headers")["x-payload-length"].cast("long")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.substring("payload_digest", 8, 64)).alias("payload_digest"),
        "record_type",
        F.regexp_extract("refers_to_id", "^<urn:x-page:(-?[0-9]+)>$", 1).try_cast("long").alias("refers_to"),
    )

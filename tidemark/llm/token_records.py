"""Token-ID output: length-delimited binary records with masked checksums, and an offset index beside each shard.

Shard file: records one after the other. A record is
    uint64 length | uint32 masked CRC-32 of those 8 bytes | payload | uint32 masked CRC-32 of the payload
and its payload is
    int64 doc_id | uint8 flags (1: doc_id is null) | uint8 width (2 or 4) | uint16 zero | the ids, width bytes each
all little-endian. The mask rotates a checksum right by 15 bits and adds 0xa282ead8, so that checksums of data which hold
checksums stay useful. Index file of a shard: pairs of uint64 (offset of the record, its bytes in all), one for each record.
`manifest.json` lists the shards in order with their records and ids; it is written last and names only files of tasks that
succeeded, so a retried or doubled task leaves at most a file that nobody reads.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import spread
from tidemark.llm.spans import blocks
from tidemark.llm.tokens import encoder

MASK_DELTA = 0xA282EAD8
_LENGTH, _HEAD = struct.Struct("<QI"), struct.Struct("<qBBH")
SHARD_SCHEMA = "shard int, file string, records long, tokens long"
READ_SCHEMA = "doc_id long, shard int, record long, start long, n_tokens long, ids_crc32 long, ids binary"


def masked(data: bytes) -> int:
    """The masked CRC-32 of data."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def framed(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    payload = _HEAD.pack(doc_id or 0, doc_id is None, width, 0) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframed(record: bytes) -> tuple[int | None, np.ndarray]:
    """The doc_id and ids of one whole record; ValueError if a length or checksum is wrong."""
    length, check = _LENGTH.unpack_from(record)
    payload = record[12:-4]
    if masked(record[:8]) != check or len(payload) != length or masked(payload) != struct.unpack("<I", record[-4:])[0]:
        raise ValueError("damaged record")
    doc_id, null, width, _ = _HEAD.unpack_from(payload)
    return (None if null else doc_id), np.frombuffer(payload, f"<u{width}", offset=_HEAD.size).astype("<u4")


def rest_of(head: bytes) -> int:
    """How many bytes of a record follow its first 12."""
    return _LENGTH.unpack(head)[0] + 4


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_token_records(docs: DataFrame, path: str, tokenizer: str, end_id: int, shards: int | None = None) -> None:
    """Writes the ids of every row of docs (doc_id, text) and end_id after each, in ascending doc_id order, to path.

    Null texts are empty (the record holds end_id alone); null doc_ids come first; rows with one doc_id follow each other by a
    hash of their text, then the text; repeated rows are each written; other columns are ignored. An empty table gives an empty
    manifest. The path must be one that pyarrow.fs and all executors reach.
    """
    spark = docs.sparkSession
    where, root = _place(path)
    where.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, name = TaskContext.get().partitionId(), f"shard-{uuid.uuid4().hex}"
        place, top = _place(path)
        encode, records, tokens, at, end = encoder(tokenizer).encode, 0, 0, 0, np.array([end_id], np.int64)
        out = index = None
        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, j, texts in blocks(batch.column(1)):
                ids, offsets = encode(texts)
                written, sizes = [], []
                for k in range(j - i):
                    written.append(framed(names[i + k], np.concatenate((ids[offsets[k] : offsets[k + 1]], end))))
                    sizes.append(len(written[-1]))
                if out is None:
                    out, index = place.open_output_stream(f"{top}/{name}.rec"), place.open_output_stream(f"{top}/{name}.idx")
                out.write(b"".join(written))
                size = np.array(sizes, "<u8")
                index.write(np.column_stack((np.cumsum(size) - size + np.uint64(at), size)).astype("<u8").tobytes())
                records, tokens, at = records + j - i, tokens + len(ids) + j - i, at + sum(sizes)
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [name], "records": [records], "tokens": [tokens]})

    # The hash keeps a doc_id that many rows share from landing in one shard.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = ["doc_id", "h", "text"]
    dealt = rows.repartitionByRange(shards or 2 * spread(docs), "doc_id", "h").sortWithinPartitions(*order)
    done = dealt.select("doc_id", "text").mapInArrow(write, SHARD_SCHEMA).collect()  # one row for each shard
    listed = [r.asDict() for r in sorted(done, key=lambda r: r["shard"])]
    with where.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"version": 1, "end_id": end_id, "shards": listed}).encode())


def _shards(spark: SparkSession, path: str) -> DataFrame:
    where, root = _place(path)
    with where.open_input_stream(f"{root}/manifest.json") as f:
        listed = json.loads(f.read())["shards"]
    before = 0
    for shard in listed:
        shard["base"], before = before, before + shard["tokens"]
    schema = f"{SHARD_SCHEMA}, base long"
    return spark.createDataFrame([tuple(s.values()) for s in listed], schema).repartition(max(1, len(listed)), "shard")


def read_token_records(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The records of path: doc_id, shard, record, start (ids of all records before it), n_tokens, ids_crc32 (of the ids as
    little-endian uint32), and the ids as such bytes where with_ids is set (else null). Lengths and checksums are verified."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, top = _place(path)
        for batch in batches:
            for shard in batch.to_pylist():
                start, rows = shard["base"], []
                with place.open_input_stream(f"{top}/{shard['file']}.rec") as f:
                    for record in range(shard["records"]):
                        head = f.read(12)
                        doc_id, ids = unframed(head + f.read(rest_of(head)))
                        raw = ids.tobytes()
                        rows.append((doc_id, shard["shard"], record, start, len(ids), zlib.crc32(raw), raw if with_ids else None))
                        start += len(ids)
                        if len(rows) == 1000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    return _shards(spark, path).mapInArrow(read, READ_SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = [x.split(" ")[0] for x in READ_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def shuffled_records(spark: SparkSession, path: str, seed: int, partitions: int | None = None) -> DataFrame:
    """All records in a pseudo-random order that seed fixes, each fetched by its place in the offset index: position, doc_id, ids.

    Only index entries are shuffled; a task then seeks its records in whatever shards hold them."""
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, top = _place(path)
        for batch in batches:
            for shard in batch.to_pylist():
                with place.open_input_stream(f"{top}/{shard['file']}.idx") as f:
                    at = np.frombuffer(f.read(), "<i8").reshape(-1, 2)
                files = pa.array([shard["file"]]).take(pa.array(np.zeros(len(at), np.int32)))
                yield pa.RecordBatch.from_arrays([files, pa.array(at[:, 0]), pa.array(at[:, 1])], names=["file", "at", "size"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, top = _place(path)
        files: dict[str, pa.NativeFile] = {}
        for batch in batches:
            rows = batch.to_pylist()
            got = []
            for r in rows:
                f = files.get(r["file"]) or files.setdefault(r["file"], place.open_input_file(f"{top}/{r['file']}.rec"))
                f.seek(r["at"])
                doc_id, ids = unframed(f.read(r["size"]))
                got.append((r["rank"], doc_id, ids.tobytes()))
            for lo in range(0, len(got), 1000):
                part = list(zip(*got[lo : lo + 1000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.binary())], names=["rank", "doc_id", "ids"])
            for f in files.values():
                f.close()
            files = {}

    index = _shards(spark, path).mapInArrow(entries, "file string, at long, size long")
    ranked = index.withColumn("rank", F.xxhash64(F.lit(seed), "file", "at"))
    dealt = ranked.repartitionByRange(n, "rank", "file", "at").sortWithinPartitions("rank", "file", "at")
    return dealt.mapInArrow(fetch, "rank long, doc_id long, ids binary")

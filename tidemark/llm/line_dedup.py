"""Lines that several documents share, found with two Bloom filters.

The 64-bit hashes of all lines that are long enough are streamed past a pair of filters: a hash that the filter of once-seen hashes knows
already goes into the filter of twice-seen ones. The filters are cut into slices of one size by the hash's first bits; how many there are
grows with the lines, and each is filled by one task. Only lines that the twice-seen filter knows are shuffled with their text, counted by
it and compared: a filter's mistake costs a line on the way and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, matched, spread, written

#: Bits of a slice's filter of once-seen hashes, and of twice-seen ones; hashes a slice is made for.
ONCE_BITS, TWICE_BITS, SLICE_HASHES = 1 << 22, 1 << 20, 1 << 18
#: Odd factors below 2**28, one for each bit that a hash sets: products with 33 bits stay within a long.
FACTORS = (0x9E3779B, 0x85EBCA7, 0xC2B2AE3)
#: Hashes that a worker sorts at once, before they are dealt to slices.
BLOCK = 1 << 18
#: The twice-seen filters are broadcast up to this size; beyond it hashes and places of lines are dealt to the slices.
BROADCAST_MB = 256

_BLANKS = "\t\n\x0b\x0c\r "
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS))


def lowered(line: Column) -> Column:
    """A-Z lower-cased; in a line of ASCII alone that is what lower() does, in one pass over bytes."""
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(F.translate(line, _UPPER, _LOWER))


def _slice(h: Column, slices: int) -> Column:
    """Which slice a hash belongs to: its upper 31 bits tell."""
    return F.pmod(F.shiftrightunsigned(h, 33), F.lit(slices)).cast("int")


def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The places of hashes in a filter, from their lower 33 bits. (_known says the same in Spark's terms.)"""
    low = h & 0x1FFFFFFFF
    return [((low * f) >> 24) & (bits - 1) for f in FACTORS]


def _known(h: Column, words: Column) -> Column:
    low, test = h.bitwiseAND(F.lit(0x1FFFFFFFF)), F.lit(True)
    for f in FACTORS:
        at = F.shiftright(low * F.lit(f), 24).bitwiseAND(F.lit(TWICE_BITS - 1))
        test = test & (F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return test


def twice_seen(hashes: DataFrame, slices: int) -> DataFrame:
    """slice and words (longs) of each slice's filter of twice-seen hashes. hashes: a row a document, h (its lines' hashes, each once).

    A worker sorts its hashes by blocks and sends a block's distinct hashes to their slices with a mark at those that came twice, so a
    hash weighs one record a block however often it comes."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            at = ((h.view(np.uint64) >> np.uint64(33)) % np.uint64(slices)).astype(np.int32)
            order = np.argsort(at, kind="stable")
            h, n, at = h[order], n[order], at[order]
            ends = np.flatnonzero(np.diff(at)) + 1
            cut = lambda a: [x.tobytes() for x in np.split(a, ends)]
            return pa.RecordBatch.from_arrays([pa.array(at[np.concatenate(([0], ends))], pa.int32()), pa.array(cut(h), pa.binary()), pa.array(cut(n > 1), pa.binary())], names=["slice", "h", "more"])

        held: list[np.ndarray] = []
        for b in batches:
            h = b.column("h").flatten().to_numpy().astype(np.int64, copy=False)
            for at in range(0, len(h), BLOCK):
                held.append(h[at : at + BLOCK])
                if sum(map(len, held)) >= BLOCK:
                    yield told()
                    held = []
        if sum(map(len, held)):
            yield told()

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            words = np.packbits(twice, bitorder="little").view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([words], pa.list_(pa.int64()))], names=["slice", "words"])

        now, once, twice = None, None, None
        for b in batches:
            for s, h, more in zip(b.column("slice").to_pylist(), b.column("h"), b.column("more"), strict=True):
                if s != now:
                    if now is not None:
                        yield told()
                    now, once, twice = s, np.zeros(ONCE_BITS, bool), np.zeros(TWICE_BITS, bool)
                hashes = np.frombuffer(h.as_buffer(), np.int64)
                places = probes(hashes, ONCE_BITS)
                again = np.frombuffer(more.as_buffer(), bool) | np.logical_and.reduce([once[p] for p in places])
                for p in places:
                    once[p] = True
                for p in probes(hashes[again], TWICE_BITS):
                    twice[p] = True
        if now is not None:
            yield told()

    sent = hashes.mapInArrow(dealt, "slice int, h binary, more binary")
    n = min(slices, spread(hashes))
    return sent.repartition(n, "slice").sortWithinPartitions("slice").mapInArrow(filled, "slice int, words array<bigint>")


def shared_lines(df: DataFrame, least_chars: int = 20, least_documents: int = 3, broadcast_mb: int = BROADCAST_MB) -> DataFrame:
    """doc_id, tag and place of each line to drop: its key stands in at least least_documents documents, and its document is not the
    largest of them. A written table; tag is a hash of the text, which tells rows of one doc_id apart."""
    docs = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    keys = F.filter(F.transform(lines_of(F.col("text")), stripped), lambda k: F.char_length(k) >= least_chars)
    hashed = docs.select(F.array_distinct(F.transform(keys, lambda k: F.xxhash64(lowered(k)))).alias("h")).where(F.size("h") > 0)
    # Line ends are counted to size the filters: more lines than have keys, which makes the filters a little larger.
    n = docs.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    slices = max(1, -(-n // SLICE_HASHES))
    filters = written(twice_seen(hashed, slices), "twice-seen")
    each = docs.select("doc_id", "tag", F.posexplode(lines_of(F.col("text"))).alias("place", "line")).select("doc_id", "tag", "place", stripped(F.col("line")).alias("line"))
    each = each.where(F.char_length("line") >= least_chars).select("doc_id", "tag", "place", lowered(F.col("line")).alias("key"))
    each = each.withColumn("h", F.xxhash64("key"))
    tested = filters.withColumnRenamed("slice", "of_slice")
    if slices * TWICE_BITS // 8 <= broadcast_mb << 20:
        met = each.join(F.broadcast(tested), _slice(F.col("h"), slices) == F.col("of_slice"))
        suspects = met.where(_known(F.col("h"), F.col("words"))).select("doc_id", "tag", "place", "key")
    else:
        light = each.select("doc_id", "tag", "place", "h")
        met = light.join(tested.hint("merge"), _slice(F.col("h"), slices) == F.col("of_slice"))
        found = met.where(_known(F.col("h"), F.col("words"))).groupBy(F.col("doc_id").alias("of_doc"), F.col("tag").alias("of_tag")).agg(F.collect_set("place").alias("places"))
        back = docs.join(found, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("tag") == F.col("of_tag"))).withColumn("lines", lines_of(F.col("text")))
        suspects = back.select("doc_id", "tag", "lines", F.explode("places").alias("place")).select("doc_id", "tag", "place", lowered(stripped(F.get("lines", F.col("place")))).alias("key"))
    suspects = written(suspects, "suspects")
    discard(filters)
    # Exact from here: by the key's text. A null doc_id is a document below all others.
    document = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"))
    by_document = suspects.groupBy("key", "doc_id").agg(F.count("*").alias("lines"))
    repeated = by_document.groupBy("key").agg(F.count("*").alias("documents"), F.max(document).alias("last"), F.sum("lines").alias("n"))
    repeated = written(repeated.where(F.col("documents") >= least_documents).select("key", "last", "n"), "repeated")
    gone = written(matched(suspects, repeated, ["key"], "n").where(document < F.col("last")).select("doc_id", "tag", "place"), "gone-lines")
    discard(suspects, repeated)
    return gone


def without_shared_lines(df: DataFrame, least_chars: int = 20, least_documents: int = 3, broadcast_mb: int = BROADCAST_MB) -> DataFrame:
    """doc_id, text (what stays), n_lines and n_dropped for each row.

    A text is split at \\n; null and empty texts are one empty line. A line's key is the line without white space (of ASCII) at its ends,
    A-Z lower-cased. Keys of least_chars code points in at least least_documents documents lose their lines everywhere but in the largest
    doc_id that holds them. A doc_id is a document: rows that repeat one count once and keep or lose a line together; rows without a
    doc_id are one document, smaller than all others. Other columns are left out. An empty table gives no rows."""
    gone = shared_lines(df, least_chars, least_documents, broadcast_mb)
    by_row = gone.distinct().groupBy(F.col("doc_id").alias("of_doc"), F.col("tag").alias("of_tag")).agg(F.sort_array(F.collect_list("place")).alias("gone"))
    docs = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))
    met = docs.join(by_row, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("tag") == F.col("of_tag")), "left")
    lines = lines_of(F.col("text"))
    n = F.size(lines)
    # the stretches between lines that go
    starts, ends = F.concat(F.array(F.lit(-1)), F.col("gone")), F.concat(F.col("gone"), F.array(n))
    kept = F.array_join(F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 2, b - a - 1))), "\n")
    return met.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"), n.cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"))

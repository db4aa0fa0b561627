"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

Packing only depends on how many pieces have each length, and there are at most `capacity` lengths. So the lengths are counted
by Spark, the counts (capacity rows at most) are packed on the driver into patterns "these lengths together, so many times",
and each piece finds its pattern by its rank among the pieces of its length. No list of pieces or bins passes through one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import written
from tidemark.llm.spans import blocks
from tidemark.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
#: Rows of one length whose rank one task finds; a length with more is cut into more groups.
RANK_GROUP = 20_000


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """The ids of each row of docs (doc_id, text; null text is empty) and end_id, cut into pieces of capacity ids where they
    are longer; the first piece takes the remainder. ids holds uint16 or, for large vocabularies, uint32, little-endian."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        width = 2 if len(encode.opens) <= 1 << 16 else 4
        for batch in batches:
            names = batch.column(0)
            for i, j, texts in blocks(batch.column(1)):
                ids, offsets = encode.encode(texts)
                # end_id goes behind each text's ids
                ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
                offsets = offsets + np.arange(j - i + 1)
                lengths = np.diff(offsets)
                pieces = -(-lengths // capacity)
                first = lengths - (pieces - 1) * capacity
                doc = np.repeat(np.arange(j - i), pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.where(number == 0, 0, first[doc] + (number - 1) * capacity)
                length = np.where(number == 0, first[doc], capacity)
                at = (offsets[doc] + start).tolist()
                ends = (offsets[doc] + start + length).tolist()
                wide, stored = ids.tobytes(), ids.astype(f"<u{width}").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        names.take(pa.array(doc + i)),
                        pa.array(number, pa.int32()),
                        pa.array(start),
                        pa.array(length),
                        pa.array([zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(at, ends, strict=True)], pa.int64()),
                        pa.array([stored[width * a : width * b] for a, b in zip(at, ends, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packs counts[length] pieces of each length: (times, [(length, how many in one sequence), ...]) for each pattern.

    A sequence takes the longest piece left, then again and again the longest that fits. If it then holds more than one piece,
    its smallest is put back when two other pieces left fit the widened gap more tightly; of such pairs the one that leaves the
    least goes in, and of equal ones that with the longest piece. A pattern repeats as long as its pieces last, which gives the
    sequences that packing piece by piece would give.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        left[length] += n
    patterns = []
    while left.any():
        room, used, sizes = capacity, {}, np.flatnonzero(left)[::-1]
        for size in sizes.tolist():
            n = min(int(left[size]), room // size)
            if n:
                used[size] = n
                room -= n * size
        if room and sum(used.values()) > 1:
            smallest = min(used)
            gap = room + smallest
            spare = left.copy()
            for size, n in used.items():
                spare[size] -= n
            # The piece put back is not one of the pair.
            fits = np.flatnonzero(spare[: gap + 1])
            if len(fits):
                largest = np.zeros(gap + 1, np.int64)
                largest[fits] = fits
                largest = np.maximum.accumulate(largest)
                second = largest[gap - fits]
                alone = (second == fits) & (spare[fits] < 2)
                if alone.any():  # one piece cannot be both of a pair
                    below = np.concatenate(([0], largest[:-1]))
                    second = np.where(alone, below[fits], second)
                total = np.where(second > 0, fits + second, 0)
                best = int(total.max())
                if best > smallest:
                    k = int(np.flatnonzero(total == best)[-1])
                    used[smallest] -= 1
                    for size in (int(fits[k]), int(second[k])):
                        used[size] = used.get(size, 0) + 1
        used = {size: n for size, n in sorted(used.items(), reverse=True) if n}
        times = min(int(left[size]) // n for size, n in used.items())
        for size, n in used.items():
            left[size] -= times * n
        patterns.append((times, list(used.items())))
    return patterns


def _places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> pd.DataFrame:
    """For each pattern and length: the ranks [low, high) of that length, the first sequence, and the offset of the first of its n places."""
    rows, sequence, taken = [], 0, {}
    for times, sizes in patterns:
        offset = 0
        for size, n in sizes:
            low = taken.get(size, 0)
            taken[size] = low + times * n
            rows.append((size, low, taken[size], sequence, offset, n))
            offset += size * n
        sequence += times
    frame = pd.DataFrame(rows, columns=["length", "low", "high", "sequence", "offset", "n"], dtype="int64")
    return frame.sort_values(["length", "low"], ignore_index=True)


def ranked(pieces: DataFrame) -> DataFrame:
    """pieces with `rank`, from 0, among those of their length. A length that many pieces share is split into groups by a hash."""
    counts = pieces.groupBy("length").count()
    groups = counts.select("length", F.ceil(F.col("count") / RANK_GROUP).alias("groups"))
    keyed = pieces.join(F.broadcast(groups), "length")  # at most `capacity` rows
    keyed = keyed.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("groups"))).drop("groups")
    sizes = keyed.groupBy("length", "group").count()
    by = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "group", F.coalesce(F.sum("count").over(by), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "group").orderBy("doc_id", "piece", "ids_crc32")
    numbered = keyed.withColumn("own", F.row_number().over(own) - 1)
    return numbered.join(before, ["length", "group"]).withColumn("rank", F.col("before") + F.col("own")).drop("own", "before", "group")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (a table that can be read again, with doc_id, piece, length and ids_crc32) with sequence_id and offset. Every
    piece gets one place, places of a sequence leave no gap from 0, and equal or repeated rows each get their own."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    places = _places(best_two_fit(counts, capacity))
    shared = spark.sparkContext.broadcast({c: places[c].to_numpy() for c in places})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        key = p["length"] * (1 << 44) + p["low"]
        for f in batches:
            length, rank = f.column("length").to_numpy(), f.column("rank").to_numpy()
            k = np.searchsorted(key, length * (1 << 44) + rank, "right") - 1
            nth, slot = np.divmod(rank - p["low"][k], p["n"][k])
            kept = f.drop_columns("rank")
            yield kept.append_column("sequence_id", pa.array(p["sequence"][k] + nth)).append_column("offset", pa.array(p["offset"][k] + slot * length))

    numbered = ranked(pieces)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.drop("rank").schema)
    return numbered.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text) tokenised, cut and packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, where
    with_ids is set, ids. A null text is empty and a piece of end_id alone; rows that repeat are packed each; an empty table
    gives no rows; other columns are ignored. Tokens are made once and written to the shared folder."""
    pieces = written(token_pieces(docs, tokenizer, end_id, capacity), "token-pieces")
    kept = pieces if with_ids else pieces.drop("ids")
    return pack(kept, capacity)

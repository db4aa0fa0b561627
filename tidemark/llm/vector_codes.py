"""Product codes of vectors, learned from the distinct values of their parts.

Components become integers, vectors are cut into equal parts, and the equal parts of a position are counted into one weighted row each.
Lloyd's rounds run over those rows; their codes and errors are joined back to the vectors. A part that very many vectors share weighs
much and is one row all the same. Codebooks (parts x entries x width numbers) are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, matched, written

#: Rows that a worker compares with a codebook at once.
BLOCK = 4096


@dataclass(frozen=True)
class Coded:
    """vectors: one row for each kept vector, with its id, label, code and error; codebooks: parts x entries x width integers."""

    vectors: DataFrame
    codebooks: list[list[list[int]]]

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.codebooks for entry in part for x in entry).encode()).hexdigest()


def _limit(width: int) -> int:
    """Integers saturate here, at a power of two so small that a vector's squared distance is within a long: 2**27 for 64 components."""
    bits = 27
    while width * (2 << bits) ** 2 >= 1 << 63:
        bits -= 1
    return 1 << bits


def integers(vector: Column, scale: int, limit: int) -> Column:
    """floor(scale * x) of each component, within limit."""
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(float(-limit))), F.lit(float(limit)))).cast("int"))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry nearest to each row and its squared distance, exact; the lower index of equal ones. Both of int64."""
    entry, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    small = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0))) <= 1 << 20 and x.shape[1] <= 1 << 9
    for at in range(0, len(x), BLOCK):
        some = x[at : at + BLOCK]
        if small:  # all sums are whole numbers below 2**53, which doubles hold
            a, b = some.astype(float), book.astype(float)
            d = (b * b).sum(1) - 2 * (a @ b.T)
            e = d.argmin(1)
            entry[at : at + BLOCK], distance[at : at + BLOCK] = e, (d[np.arange(len(a)), e] + (a * a).sum(1)).astype(np.int64)
        else:
            best, e = np.full(len(some), np.iinfo(np.int64).max), np.zeros(len(some), np.int64)
            for k, row in enumerate(book):
                d = ((some - row) ** 2).sum(1)
                e, best = np.where(d < best, k, e), np.minimum(d, best)
            entry[at : at + BLOCK], distance[at : at + BLOCK] = e, best
    return entry, distance


def _blocks(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Each batch with its parts, positions, entries and distances."""
    for b in batches:
        if not b.num_rows:
            continue
        x = b.column("part").flatten().to_numpy().astype(np.int64).reshape(b.num_rows, -1)
        pos, entry, distance = b.column("pos").to_numpy(), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
        for p in np.unique(pos):
            here = np.flatnonzero(pos == p)
            entry[here], distance[here] = nearest(x[here], books[p])
        yield b, x, pos, entry, distance


def _moved(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry is the floor of its parts' weighted mean. A task adds up its rows and sends a row for each
    entry and component."""
    count, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros((count, entries, width), object), np.zeros((count, entries), object)
        for b, x, pos, entry, _ in _blocks(batches, books):
            n = b.column("n").to_numpy()
            weigh = n if int(np.abs(x).max(initial=0)) * int(n.sum()) < 1 << 62 else n.astype(object)
            part = np.zeros((count, entries, width), weigh.dtype)
            np.add.at(part, (pos, entry), x * weigh[:, None])
            each = np.zeros((count, entries), weigh.dtype)
            np.add.at(each, (pos, entry), weigh)
            total, held = total + part.astype(object), held + each.astype(object)
        rows = [(p, e, j, str(total[p, e, j]), str(held[p, e])) for p in range(count) for e in range(entries) if held[p, e] for j in range(width)]
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["pos", "entry", "j", "total", "held"])

    told = distinct.mapInArrow(sums, "pos int, entry int, j int, total string, held string")
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    out = books.copy()
    for r in told.groupBy("pos", "entry", "j").agg(whole("total").alias("total"), whole("held").alias("held")).collect():  # as many as the codebooks hold
        out[r["pos"], r["entry"], r["j"]] = int(r["total"]) // int(r["held"])
    return out


def encode(df: DataFrame, vector: str, id: str, label: str, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Coded:
    """Codes for the rows whose vector is there and holds finite components alone.

    Each component x becomes floor(scale * x). A position's codebook starts as that part of the vectors with the `entries` smallest ids
    (null ids last; equal ids by their integers), and moves `rounds` times; unused entries stay. code has two hexadecimal digits a part,
    error sums the parts' squared distances. The length of the vectors is the commonest one that `parts` divides, of equally common ones
    the least; rows of another length are dropped, too. Integers saturate at 2**27 for up to 64 components (a quarter of that for up to
    1024, and so on), where distances would leave a long. Equal rows each have their own result. No kept row: no rows, no codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hexadecimal digits tells up to 256 entries apart")
    spark = df.sparkSession
    given = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("x"))
    sound = F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    sound = sound & (F.size("x") % parts == 0)
    sizes = given.where(sound).groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    size = sizes[0]["size"] if sizes else parts
    width = size // parts
    kept = given.where(sound & (F.size("x") == size)).select(F.monotonically_increasing_id().alias("row"), "id", "label", integers(F.col("x"), scale, _limit(size)).alias("v"))
    kept = written(kept, "vectors")
    first = [r["v"] for r in kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    books = np.array(first, np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("v", p * width + 1, F.lit(width)))
    distinct = written(kept.select(F.posexplode(cut).alias("pos", "part")).groupBy("pos", "part").agg(F.count("*").alias("n")), "parts")
    for _ in range(rounds if first else 0):
        books = _moved(distinct, books)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, _, entry, distance in _blocks(batches, books):
            yield pa.RecordBatch.from_arrays([b.column("pos"), b.column("part"), b.column("n"), pa.array(entry, pa.int32()), pa.array(distance, pa.int64())], names=["pos", "part", "n", "entry", "distance"])

    told = written(distinct.mapInArrow(assigned, "pos int, part array<int>, n bigint, entry int, distance bigint"), "codes")
    discard(distinct)
    each = matched(kept.select("row", F.posexplode(cut).alias("pos", "part")), told, ["pos", "part"], "n").drop("part")
    digits = [F.max(F.when(F.col("pos") == p, F.col("entry"))).alias(f"e{p}") for p in range(parts)]
    code = F.concat(*(F.lpad(F.lower(F.hex(f"e{p}")), 2, "0") for p in range(parts)))
    by_row = each.groupBy(F.col("row").alias("of")).agg(F.sum("distance").alias("error"), *digits).select("of", code.alias("code"), "error")
    vectors = written(kept.select("row", "id", "label").join(by_row, F.col("row") == F.col("of")).select("id", "label", "code", "error"), "coded")
    discard(told, kept)
    return Coded(vectors, books.tolist() if first else [])


def label_errors(coded: Coded) -> DataFrame:
    """The vectors with label_error: the error summed over the vectors of one label (those without a label together), at most what a long
    holds."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("bigint")
    sums = written(coded.vectors.groupBy("label").agg(total.alias("label_error"), F.count("*").alias("n")), "label-errors")
    return matched(coded.vectors, sums, ["label"], "n")

"""Near-duplicates by SuperMinHash: signatures, banding, verification on the full sets, union-find grouping.

Documents with equal shingle sets form a class; only one set of each class is compared, so a group of copies costs one.
A class is named by 16 bytes that its set determines.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import discard, written
from tidemark.llm.spans import NONSPACE, Texts, blocks, mix, pair

BANDS, ROWS = 30, 5
#: Buckets of so many classes are compared pair by pair; larger ones with a centre first, then block by block.
SMALL_BUCKET = 16
#: Shingles of a block of a larger bucket.
BLOCK_SHINGLES = 1 << 18
_GOLDEN = 0x9E3779B97F4A7C15
_STEP = np.uint64(_GOLDEN)
_LEVEL = np.uint64(52)
_NONE = np.uint64(2**64 - 1)


def shingle_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, ascending, text after text, and where each text's start (one more at the end).

    Words are runs of bytes other than 0x20 and 0x09-0x0D with A-Z lowered; a text with fewer words than size has one shingle of
    them all, one without words none."""
    starts, ends, first = texts.words(NONSPACE)
    words = texts.lower().hashes(starts, ends)
    count = np.diff(first)
    run = words
    for _ in range(size - 1):
        run = pair(run[: len(run) - 1], words[len(words) - len(run) + 1 :]) if len(run) > 1 else run[:0]
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    offsets = np.concatenate(([0], np.cumsum(n)))
    keys = np.empty(int(offsets[-1]), np.uint64)
    fresh = np.zeros(len(keys), bool)
    for k in range(len(count)):
        lo, hi = offsets[k], offsets[k + 1]
        if count[k] >= size:
            keys[lo:hi] = np.sort(run[first[k] : first[k] + n[k]])
            fresh[lo] = True
            fresh[lo + 1 : hi] = keys[lo + 1 : hi] != keys[lo : hi - 1]
        elif count[k]:
            keys[lo] = reduce(lambda a, b: pair(a, b), [words[i : i + 1] for i in range(first[k], first[k + 1])], np.full(1, count[k], np.uint64))[0]
            fresh[lo] = True
    places = np.concatenate(([0], np.cumsum(fresh)))
    return keys[fresh], places[offsets]


def superminhash(keys: np.ndarray, offsets: np.ndarray, registers: int) -> np.ndarray:
    """A row of registers for each set. Register p holds the smallest of j + u over the elements, where p is the j-th place of the
    element's own random permutation and u its j-th random fraction. A set whose registers are all below j + 1 needs no further
    step: no later value can be smaller."""
    n = len(offsets) - 1
    out = np.full(n * registers, _NONE)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    order = None
    for j in range(registers):
        if not len(keys):
            break
        draw = mix(keys + np.uint64((j + 1) * _GOLDEN % 2**64))
        k = j + (mix(draw ^ _STEP) % np.uint64(registers - j)).astype(np.int64)
        if j == 0:
            place = k
        else:
            rows = np.arange(len(keys))
            place = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, j]
        np.minimum.at(out, doc * registers + place, (np.uint64(j) << _LEVEL) | (draw >> np.uint64(12)))
        open_docs = out.reshape(n, registers).max(axis=1) >= (np.uint64(j + 1) << _LEVEL)
        live = open_docs[doc]
        if j == 0:
            first = k[live]
            order = np.tile(np.arange(registers, dtype=np.uint16), (len(first), 1))
            order[np.arange(len(first)), first] = 0
        else:
            order = order[live]
        keys, doc = keys[live], doc[live]
    return out.reshape(n, registers)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band, which the band's number is part of."""
    keys = np.empty((len(signatures), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(signatures), b + 1, np.uint64)
        for r in range(rows):
            h = pair(h, signatures[:, b * rows + r])
        keys[:, b] = h
    return keys


def set_names(keys: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """16 bytes for each set, None for an empty one."""
    halves = []
    for salt in (0x1F83D9AB, 0x5BE0CD19):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(keys ^ mix(np.full(1, salt, np.uint64))))))
        halves.append(sums[offsets[1:]] - sums[offsets[:-1]])
    raw = np.column_stack(halves).astype(">u8").tobytes()
    return [raw[16 * i : 16 * i + 16] if offsets[i] < offsets[i + 1] else None for i in range(len(offsets) - 1)]


def signed(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles, node (its class, null for an empty set) and keys (of its bands) for each row of docs
    (doc_id, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in blocks(batch.column(2)):
                keys, offsets = shingle_sets(texts, size)
                bucket = band_keys(superminhash(keys, offsets, bands * rows), bands, rows).view(np.int64)
                n = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(1).slice(i, j - i),
                        pa.array(n),
                        pa.array(set_names(keys, offsets), pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0)))), pa.int32()), pa.array(bucket[n > 0].ravel())),
                    ],
                    names=["doc_id", "th", "n_shingles", "node", "keys"],
                )

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return named.mapInArrow(sign, "doc_id long, th long, n_shingles long, node binary, keys array<long>")


def class_sets(docs: DataFrame, size: int) -> DataFrame:
    """node and its set (the hashes, ascending, little-endian uint64) for each row of docs."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in blocks(batch.column(0)):
                keys, offsets = shingle_sets(texts, size)
                rows = [keys[a:b].astype("<u8").tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(set_names(keys, offsets), pa.binary()), pa.array(rows, pa.binary())], names=["node", "members"])

    return docs.select("text").mapInArrow(build, "node binary, members binary").where("node is not null")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets have 100 * intersection >= percent * union."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                small, large = (a, b) if len(a) < len(b) else (b, a)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int(np.count_nonzero(large[at] == small))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(confirm, "a binary, b binary")


def similar_sizes(n: str, m: str, percent: int):
    """What two sets of n and m members must satisfy to be similar enough."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _within(members: DataFrame, percent: int) -> DataFrame:
    """All pairs of buckets that hold SMALL_BUCKET classes at most."""
    a = members.select("key", F.col("node").alias("a"), F.col("n").alias("n"))
    b = members.select("key", F.col("node").alias("b"), F.col("n").alias("m"))
    return a.join(b, "key").where((F.col("a") < F.col("b")) & similar_sizes("n", "m", percent)).select("a", "b").distinct()


def joining(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Similar pairs of a left and a right set (places in sets) that join all that such pairs join; label is what is joined so far.

    Sets are compared where they share one of their rarest shingles, as sets that are similar enough must."""
    n = np.array([len(x) for x in sets])
    start = np.concatenate(([0], np.cumsum(n)))
    owner = np.repeat(np.arange(len(sets)), n)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    token = rank[token]
    token = token[np.lexsort((token, owner))]
    prefix = n + (-percent * n) // 100 + 1
    listed = np.isin(owner, left) & (np.arange(len(token)) - start[owner] < prefix[owner])
    order = np.argsort(token[listed], kind="stable")
    key, holder = token[listed][order], owner[listed][order]
    marked, found = np.zeros(len(count), bool), []
    for u in right.tolist():
        own = token[start[u] : start[u + 1]]
        lo, hi = np.searchsorted(key, own[: prefix[u]]), np.searchsorted(key, own[: prefix[u]], "right")
        near = np.unique(np.concatenate([holder[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]))
        near = near[(label[near] != label[u]) & (100 * np.minimum(n[near], n[u]) >= percent * np.maximum(n[near], n[u]))]
        if not len(near):
            continue
        marked[own] = True
        first = np.cumsum(n[near]) - n[near]
        at = np.arange(int(n[near].sum())) + np.repeat(start[near] - first, n[near])
        both = np.add.reduceat(marked[token[at]].astype(np.int64), first)
        marked[own] = False
        near = near[100 * both >= percent * (n[near] + n[u] - both)]
        joined, one = np.unique(label[near], return_index=True)
        found += [(k, u) for k in near[one].tolist()]
        label[np.isin(label, joined)] = label[u]
    return found


def _blockwise(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join what similar pairs of a bucket join, for rows (key, node, n, with_centre) without the buckets' centres.

    Those linked with the centre are one group already, so they are only compared with the others, and the others among themselves:
    each pair of blocks is a cell (key, i, j) that one task compares; i is below zero in cells with the centre's group."""
    sums = rows.groupBy("key").agg(F.sum(F.when(F.col("with_centre"), F.col("n"))).alias("inner"), F.sum(F.when(~F.col("with_centre"), F.col("n"))).alias("outer"))
    blocks_of = lambda c: F.ceil(F.coalesce(F.col(c), F.lit(0)) / BLOCK_SHINGLES).cast("int")
    sums = sums.where("outer > 0").select("key", blocks_of("inner").alias("inner"), blocks_of("outer").alias("outer"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("with_centre"), F.col("inner")).otherwise(F.col("outer"))).cast("int")
    placed = rows.join(sums, "key").withColumn("own", own)
    cells = F.expr("""explode(if(with_centre,
        transform(filter(sequence(0, outer), x -> x < outer), x -> struct(-1 - own as i, x as j, 0 as role)),
        concat(transform(filter(sequence(0, inner), x -> x < inner), x -> struct(-1 - x as i, own as j, 1 as role)),
               transform(filter(sequence(0, outer), x -> x < outer), x -> struct(least(x, own) as i, greatest(x, own) as j, if(x = own, 2, int(x < own)) as role)))))""")
    dealt = placed.select("key", "node", cells.alias("cell")).select("key", "cell.*", "node").join(sets, "node").select("key", "i", "j", "role", "node", "members")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(cell: tuple[int, int, int], held: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
            role = np.array([x[0] for x in held])
            label = np.arange(len(held))
            if cell[1] < 0:
                label[role == 0] = len(held)
            left, right = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
            if len(left) and len(right):
                found = joining([np.frombuffer(x[2], "<u8") for x in held], left, right, label, percent)
                yield pa.RecordBatch.from_arrays([pa.array([held[a][1] for a, _ in found], pa.binary()), pa.array([held[b][1] for _, b in found], pa.binary())], names=["a", "b"])

        last, held = None, []
        for batch in batches:
            for *cell, role, node, members in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if cell != last and held:
                    yield from out(last, held)
                    held = []
                last = cell
                held.append((role, node, members))
        if held:
            yield from out(last, held)

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, "a binary, b binary")


def labelled(docs: DataFrame, size: int, percent: int, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, th, n_shingles, node) of docs (doc_id, text), and for each node the component: component_id, and (id, th) of the
    document that stays, the one with the smallest id (nulls last) and hash.

    Candidates share a band of their SuperMinHash signatures and have sets of similar size. Buckets of up to SMALL_BUCKET classes are
    compared pair by pair. The classes of a larger one are compared with its centre, the class that shares most buckets; those that
    are not linked with it are then compared with all others of the bucket, block by block. So every similar pair of a bucket ends in
    one group."""
    rows_of = written(signed(docs, size, bands, rows), "signed")
    some = rows_of.where("node is not null")
    classes = written(some.groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("keys").alias("keys")), "classes")
    keyed = classes.select("node", "n", F.posexplode("keys").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = written(keyed.join(shared, "key"), "buckets")
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))

    # One row of documents for each class that shares a bucket, and its set.
    wanted = some.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("one")).join(weight.select("node"), "node", "left_semi")
    wanted = wanted.select(F.col("one.doc_id").alias("wanted_id"), F.col("one.th").alias("wanted_th")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.xxhash64("text") == F.col("wanted_th")), "left_semi")
    sets = written(class_sets(texts, size).dropDuplicates(["node"]), "sets")

    big = members.where(F.col("size") > SMALL_BUCKET).join(weight, "node")
    centre = big.groupBy("key").agg(F.max(F.struct("weight", "node", "n")).alias("c")).select("key", F.col("c.node").alias("b"), F.col("c.n").alias("m"))
    against = written(big.join(centre, "key").where("node != b").select("key", "node", "n", "b", "m"), "against")
    pairs = _within(members.where(F.col("size") <= SMALL_BUCKET), percent)
    star = against.where(similar_sizes("n", "m", percent)).select(F.col("node").alias("a"), "b")
    found = written(linked(pairs.union(star).distinct(), sets, percent), "links")
    done = found.select(F.col("a").alias("node"), "b", F.lit(True).alias("with_centre")).distinct()
    rest = written(against.join(done, ["node", "b"], "left").select("key", "node", "n", F.coalesce("with_centre", F.lit(False)).alias("with_centre")), "rest")
    more = written(_blockwise(rest, sets, percent), "links")
    label = components(found.union(more))
    discard(classes, members, sets, against, found, rest, more)

    # Nulls sort first in a struct, so a flag puts documents without an id behind the others.
    of_class = some.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th")).alias("first")).join(label, "node", "left")
    of_class = of_class.withColumn("label", F.coalesce("label", "node"))
    smallest = of_class.groupBy("label").agg(F.min("first").alias("stays"))
    component = of_class.join(smallest, "label").select("node", F.col("stays.doc_id").alias("component_id"), F.col("stays.th").alias("stays_th"))
    return rows_of.drop("keys"), component


def groups(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that similar documents lead to) and kept for each row of docs (doc_id, text).

    Two documents are similar when 100 * intersection >= percent * union of their distinct shingles of `size` words.
    A null or wordless text has no shingles and is linked with nothing; rows that repeat a doc_id are rows of their own, and each
    is kept if its id is the smallest; a null doc_id is never kept and, where all ids of a component are null, its id is null.
    Other columns are ignored; an empty table gives no rows."""
    rows_of, component = labelled(docs, size, percent, bands, rows)
    found = rows_of.join(component, "node", "left")
    smallest = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", smallest.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of docs: that with the smallest doc_id, nulls being last, and of documents with one id that with the
    smallest hash. Rows with equal ids and equal texts are one document, and stay or go together; documents without words stay. Other
    columns stay as they are, whatever their names."""
    rows_of, component = labelled(docs, size, percent)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("stays_th"))
    gone = rows_of.join(component, "node").where(~stays).select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_th"]), "left_anti")

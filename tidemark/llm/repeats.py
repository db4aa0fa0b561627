"""Removes every byte that a string of `length` bytes covers which also starts earlier in the corpus.

The suffixes that matter are those of `length` bytes. Buckets of them are refined, by sorting on bucket numbers of other offsets, until a
bucket holds equal suffixes alone:
1. A suffix is first put in the bucket of one of its q-grams, the smallest by hash, which its content alone decides. Neighbouring
   suffixes choose the same gram, so a whole run of them enters a bucket as one row, with the number of all bytes the run spans.
2. Only buckets with several spans stay open. Their suffixes are dealt again by the number of the long core of bytes that up to STEP
   neighbours have in common (which their distance from the gram decides), and sorted by the few bytes on either side of it.
3. Where a core has several surroundings, each suffix gets a bucket of its own: the number of its core, which is used again, and
   its own bytes beside it. The text is not needed any more.
A bucket with one row is final: none of its suffixes occurs twice. Of equal rows of a bucket all but the first are repeats. A number is
a hash of the bytes it stands for, not a rank: ranks would have to be joined back by place for each step. Equality is decided by two
independent ones, of 62 bits each (of 62 and 57 in the first step). Rows are reduced to the first of their bucket within a task before
they are shuffled, so copies cost no more than one text a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import written
from tidemark.llm.spans import Texts, blocks, mix, pair

GRAM = 40
#: Suffixes of a run that have a core in common: those whose distances from the gram agree when divided by this.
STEP = 8
_PLACE, _RUN = np.int64(31), np.int64(7)
_GONE = np.int64(1) << np.int64(62)
_TIE_BITS = 24
_PENDING_ROWS = 1_000_000
_NO_ID = -(2**63)
_SHIFT = np.uint64(127)
#: Rows of the three steps: bucket, what tells its members apart (second number and bytes on either side), place.
ROWS = "h long, u long, doc long, pos long"
CORES = "h long, u long, before long, after long, doc long, pos long"
FOUND = "doc long, pos long, open boolean, u long"


def packed(tie: np.ndarray, place: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Which text of a doc_id, where a run of suffixes starts and how many it has (127 at most), in one number that sorts so."""
    return (tie << (_PLACE + _RUN)) | (place << _RUN) | run


def unpacked(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (pos >> (_PLACE + _RUN)) & np.int64((1 << _TIE_BITS) - 1), (pos >> _RUN) & np.int64((1 << 31) - 1), pos & np.int64(127)


def runs(texts: Texts, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, number of the span (its lowest 7 bits: where the gram begins), text, start in the text and number of suffixes of each
    run of suffixes that choose the same gram."""
    n, ends = len(texts.data), texts.offsets[1:]
    none = np.zeros(0, np.int64)
    if n < length:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    grams = texts.windows(gram)
    low = np.int64(31)
    key = ((grams >> np.uint64(31)) << np.uint64(31)) | np.arange(len(grams), dtype=np.uint64)
    width, least = length - gram + 1, key
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(key) - width + 1], least[width - size : width - size + len(key) - width + 1])
    chosen = (least & np.uint64((1 << int(low)) - 1)).astype(np.int64)
    # suffixes that end within their text
    text = np.repeat(np.arange(len(texts)), np.diff(texts.offsets))[: len(chosen)]
    inside = np.arange(len(chosen)) + length <= ends[text]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    pick = chosen[starts]
    head = np.concatenate(([True], (pick[1:] != pick[:-1]) | (starts[1:] != starts[:-1] + 1)))
    at = np.flatnonzero(head)
    first, count = starts[at], np.diff(np.append(at, len(starts)))
    anchor = pick[at]
    span = texts.hashes(first, first + count - 1 + length, second=True)
    shift = (anchor - first).astype(np.uint64)
    return grams[anchor], (pair(span, shift) & ~_SHIFT) | shift, text[first], first - texts.offsets[text[first]], count


def _side(texts: Texts, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sizes[i] < STEP bytes from starts[i] on, in one number: the first lowest, and how many they are in the highest byte."""
    out = sizes << np.int64(56)
    for k in range(STEP - 1):
        there = np.flatnonzero(sizes > k)
        out[there] |= texts.data[starts[there] + k].astype(np.int64) << np.int64(8 * k)
    return out


def cores(texts: Texts, text: np.ndarray, place: np.ndarray, count: np.ndarray, shift: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Cores of the runs: number, second number, bytes before and after, run, first suffix and number of suffixes of each. The run's
    gram begins `shift` bytes after its first suffix, so i suffixes later it is at shift - i; suffixes for which that is the same when
    divided by STEP share all but STEP - 1 bytes."""
    far = shift // STEP
    classes = far - (shift - count + 1) // STEP + 1
    run = np.repeat(np.arange(len(text)), classes)
    j = far[run] - (np.arange(len(run)) - np.repeat(np.cumsum(classes) - classes, classes))
    high, low = np.minimum(shift[run], STEP * j + STEP - 1), np.maximum((shift - count + 1)[run], STEP * j)
    anchor = texts.offsets[text[run]] + place[run] + shift[run]
    start, end = anchor - STEP * j, anchor - STEP * j - STEP + 1 + length
    number = pair(texts.hashes(start, end), j.astype(np.uint64))
    before = _side(texts, anchor - high, high - STEP * j)
    after = _side(texts, end, STEP * j + STEP - 1 - low)
    return number, texts.hashes(start, end, second=True), before, after, run, place[run] + shift[run] - high, high - low + 1


def suffixes(h: np.ndarray, u: np.ndarray, before: np.ndarray, after: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows (ROWS) of the suffixes of cores: the numbers of the core and the suffix's own bytes beside it make its number."""
    tie, place, count = unpacked(pos)
    row = np.repeat(np.arange(len(h)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)  # the core's k-th suffix
    behind = (before >> np.int64(56))[row]
    low = np.int64(0xFF_FFFF_FFFF_FFFF)
    left = (before[row] & low) >> (8 * k)  # bytes before the core that the suffix has
    n_left = behind - k
    n_right = STEP - 1 - n_left
    right = after[row] & ((np.int64(1) << (8 * n_right)) - 1)
    own = (left | (right << (8 * n_left)) | (n_left << np.int64(56))).view(np.uint64)
    return pair(h.view(np.uint64)[row], own), pair(own, u.view(np.uint64)[row]), doc[row], packed(tie[row], place[row] + k, np.ones(len(row), np.int64))


def _fresh(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before. Rows that agree in all are one run, sent by rows that repeat a text of one doc_id."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


class _Reducer:
    """Gathers rows of a task (columns; the last two are doc and pos); sends on the first of those that agree in all others, and marks
    the rest as repeats."""

    def __init__(self, fields: str) -> None:
        self.names = [x.split()[0] for x in fields.split(", ")]
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(columns)
        self.rows += len(columns[0])
        if self.rows >= _PENDING_ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        columns = [np.concatenate(c).view(np.int64) for c in zip(*self.parts, strict=True)]
        self.parts, self.rows = [], 0
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        fresh = _fresh(*columns)
        columns = [c[fresh] for c in columns]
        later = ~_fresh(*columns[:-2])
        doc, pos = columns[-2:]
        # A repeat needs no bucket any more; its row is dealt by its own place.
        columns[0] = np.where(later, mix(doc.view(np.uint64) ^ mix(pos.view(np.uint64))).view(np.int64), columns[0])
        columns[-1] = np.where(later, pos | _GONE, pos)
        for lo in range(0, len(doc), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 100_000]) for c in columns], names=self.names)


def _keyed(docs: DataFrame, ties: DataFrame, rest: bool = False) -> DataFrame:
    """doc, tie (tells texts with one doc_id apart), text and, where asked for, rest: the row as it is."""
    rows = docs.select(*_row_key(), "text", *[F.struct(*docs.drop("text").columns).alias("rest")] * rest)
    return rows.join(ties, ["doc", "hash", "size"], "left").select("doc", F.coalesce("tie", F.lit(0)).cast("long").alias("tie"), "text", *["rest"] * rest)


def _row_key() -> list[Column]:
    """What rows of one document agree in: doc, hash and size."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64("text").alias("hash"), F.coalesce(F.octet_length("text"), F.lit(-1)).alias("size")]


def numbered(docs: DataFrame) -> DataFrame:
    """doc, hash, size and tie (from 0 by hash) for each text of a doc_id that has several."""
    texts = docs.select(*_row_key()).distinct()
    several = texts.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    ties = texts.join(several, "doc", "left_semi").withColumn("tie", F.row_number().over(Window.partitionBy("doc").orderBy("hash", "size")) - 1)
    ties = written(ties, "ties")
    if ties.where(F.col("tie") >= 1 << _TIE_BITS).limit(1).count():
        raise ValueError(f"over {1 << _TIE_BITS} texts share a doc_id, or have none")
    return ties


def _sifted(batches: Iterator[pa.RecordBatch], bucket: int) -> Iterator[tuple[tuple[np.ndarray, ...], np.ndarray]]:
    """Sorted rows that are repeats or undecided, column by column, and which are undecided. Rows of a bucket agree in the first
    `bucket` columns, equal ones in all but doc and pos; the first rows of several that differ are undecided."""
    last: tuple | None = None  # the row before, while its bucket goes on
    classes, held = 0, None  # of that bucket: how many differ so far, its first row if not yet sent
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        fresh = _fresh(*columns)
        if last is not None:
            fresh[0] = tuple(c[0] for c in columns) != last
        if not fresh.any():
            continue
        columns = [c[fresh] for c in columns]
        pos = columns[-1]
        marked = (pos & _GONE) != 0
        new_bucket = _fresh(*columns[:bucket]) | marked
        new_bucket[1:] |= marked[:-1]
        same = last is not None and not marked[0] and tuple(c[0] for c in columns[:bucket]) == last[:bucket]
        new_bucket[0] = not same
        new_class = _fresh(*columns[:-2]) | new_bucket
        new_class[0] = not same or tuple(c[0] for c in columns[:-2]) != last[:-2]
        number = np.cumsum(new_bucket)  # 0: the one that goes on
        differ = np.bincount(number[new_class], minlength=number[-1] + 1)
        differ[0] += classes
        undecided = new_class & ~marked & (differ[number] > 1)
        out, is_open = [c[marked | ~new_class | undecided] for c in columns], undecided[marked | ~new_class | undecided]
        if held is not None and differ[0] > 1:
            out, is_open = [np.concatenate(([x], c)) for x, c in zip(held, out, strict=True)], np.concatenate(([True], is_open))
            held = None
        final = int(number[-1])
        if final > 0:
            held = None
        if differ[final] == 1 and held is None and not marked[-1] and (final or not classes):
            k = int(np.flatnonzero((number == final) & new_class)[0])
            held = tuple(c[k] for c in columns)
        last, classes = (None, 0) if marked[-1] else (tuple(c[-1] for c in columns), int(differ[final]))
        if len(is_open):
            yield tuple(out[:-1]) + (out[-1] & ~_GONE,), is_open


def _sorted(rows: DataFrame, *bucket: str) -> DataFrame:
    return rows.repartition(*bucket).sortWithinPartitions(*rows.columns)


def _found(columns: tuple[np.ndarray, ...], is_open: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[-2]), pa.array(columns[-1]), pa.array(is_open), pa.array(columns[1])], names=["doc", "pos", "open", "u"])


def repeats(keyed: DataFrame, length: int = 100, gram: int = GRAM) -> DataFrame:
    """doc, pos (packed) of runs of suffixes that occur earlier, for keyed (doc, tie, text)."""

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Reducer(ROWS)
        for batch in batches:
            docs, ties = (batch.column(k).to_numpy() for k in (0, 1))
            for i, _, texts in blocks(batch.column(2)):
                h, u, text, place, count = runs(texts, length, gram)
                yield from kept.add(h, u, docs[text + i], packed(ties[text + i], place, count))
        yield from kept.flush()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, is_open in _sifted(batches, 1):
            yield _found(columns, is_open)

    def cored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Reducer(CORES)
        for batch in batches:
            docs, ties, places, shifts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3), batch.column(4)
            for i, j, texts in blocks(batch.column(2)):
                some = [k for k in range(i, j) if places[k].is_valid]
                if not some:
                    continue
                text = np.repeat(some, [len(places[k]) for k in some])
                _, place, count = unpacked(np.concatenate([places[k].values.to_numpy() for k in some]))
                shift = np.concatenate([shifts[k].values.to_numpy() for k in some]).astype(np.int64)
                h, u, before, after, run, start, n = cores(texts, text - i, place, count, shift, length)
                yield from kept.add(h, u, before, after, docs[text[run]], packed(ties[text[run]], start, n))
        yield from kept.flush()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, none = _Reducer(ROWS), np.zeros(0, np.int64)
        for columns, is_open in _sifted(batches, 2):
            done, rest = tuple(c[~is_open] for c in columns), tuple(c[is_open] for c in columns)
            if len(done[0]):
                h = mix(done[-2].view(np.uint64) ^ mix(done[-1].view(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(done[1]), pa.array(done[-2]), pa.array(done[-1] | _GONE)], names=["h", "u", "doc", "pos"])
            if len(rest[0]):
                yield from kept.add(*suffixes(*rest))
        yield from kept.flush()

    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, is_open in _sifted(batches, 2):
            yield _found(columns, is_open)

    if not max(gram, STEP) < length <= gram + 126:
        raise ValueError("length must be over gram, by 126 at most")
    found = written(_sorted(keyed.mapInArrow(bucketed, ROWS), "h").mapInArrow(first, FOUND), "repeats")
    undecided = found.where("open").distinct().groupBy("doc", _tie().alias("tie")).agg(F.collect_list(F.struct("pos", F.expr("int(u & 127)").alias("shift"))).alias("runs"))
    again = keyed.join(undecided, ["doc", "tie"]).select("doc", "tie", "text", "runs.pos", "runs.shift")
    again = _sorted(again.mapInArrow(cored, CORES), "h").mapInArrow(second, ROWS)
    return found.where("not open").select("doc", "pos").union(_sorted(again, "h").mapInArrow(third, FOUND).where("not open").select("doc", "pos"))


def _tie() -> Column:
    """tie of a packed place."""
    return F.shiftright("pos", int(_PLACE + _RUN)).bitwiseAND(F.lit((1 << _TIE_BITS) - 1))


CUT = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def without_repeats(docs: DataFrame, length: int = 100, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (with_text: also kept, the text, and rest, the row's other columns) for each
    row of docs.

    A byte goes if a string of `length` bytes covers it that also starts earlier: in a smaller doc_id or earlier in the same text;
    strings do not cross rows and are judged on the input. A null doc_id is smaller than all others. Texts that share a doc_id are
    ordered by a hash, and equal texts of one doc_id count as one document, whose rows come out alike; over 2**24 texts of one doc_id
    are an error. A null text is empty. Characters of kept that lose a
    part of their bytes go altogether. Other columns are ignored; an empty table gives no rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(3)
            for i, j, texts in blocks(batch.column(2)):
                rows = []
                for k in range(i, j):
                    data = texts.data[texts.offsets[k - i] : texts.offsets[k - i + 1]]
                    spans, kept = 0, data
                    if places[k].is_valid:
                        _, place, count = unpacked(places[k].values.to_numpy())
                        change = np.zeros(len(data) + 1, np.int64)
                        np.add.at(change, place, 1)
                        np.add.at(change, place + count - 1 + length, -1)
                        gone = np.cumsum(change[:-1]) > 0
                        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
                        kept = data[~gone]
                    raw = kept.tobytes()
                    rows.append((len(data), len(data) - len(raw), spans, hashlib.sha256(raw).hexdigest(), raw.decode("utf-8", "ignore") if with_text else None))
                columns = list(zip(*rows, strict=True))
                arrays = [batch.column(0).slice(i, j - i), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())]
                names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    arrays, names = [*arrays, pa.array(columns[4], pa.string()), batch.column(4).slice(i, j - i)], [*names, "kept", "rest"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    ties = numbered(docs)
    gone = repeats(_keyed(docs, ties), length, gram).groupBy("doc", _tie().alias("tie")).agg(F.collect_list("pos").alias("places"))
    joined = _keyed(docs, ties, with_text).join(gone, ["doc", "tie"], "left").select("doc", "tie", "text", "places", *["rest"] * with_text)
    schema = f"{CUT}, kept string, rest {joined.schema['rest'].dataType.simpleString()}" if with_text else CUT
    return joined.mapInArrow(cut, schema).withColumn("doc", F.when(F.col("doc") != _NO_ID, F.col("doc"))).withColumnRenamed("doc", "doc_id")


def cut_documents(docs: DataFrame, length: int = 100, gram: int = GRAM) -> DataFrame:
    """docs with what is left of their texts, other columns as they are. A null text comes out empty, and a row whose text was
    taken as a whole stays with an empty text."""
    found = without_repeats(docs, length, gram, with_text=True)
    return found.select(*(F.col("kept").alias("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns))

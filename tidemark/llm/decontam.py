"""Benchmark decontamination on templates: texts are compared after numbers, names and units have become typed placeholders.

Windows of the benchmark's templates are joined by hash with windows of the documents'. Matches of a document and an item are
taken together by diagonal (how far apart the two windows stand), and a window counts only if its slots are consistent: what
stands in a slot of the item corresponds to the same thing in the document all along the diagonal. Windows of the same words
count in any case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.spans import ALNUM, Texts, blocks, mix, pair

WINDOW = 5
#: Share of an item's windows that a document must hold.
COVERAGE = 0.6
#: A window with fewer plain words says too little as a template; only its exact words are compared.
LEAST_PLAIN = 2

# Word lists of the typed slots.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half twice dozen"
UNIT_WORDS = "mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres mg g kg gram grams kilogram kilograms ounce ounces oz pound pounds lb lbs ton tons tonne tonnes ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur percent degree degrees kmh mph"
NAME_WORDS = "james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica sarah karen alice bob carol emma olivia liam noah tom tim sam ben max anna maria peter paul mark lisa laura mike jack kate emily daniel"

_bits = 24
_EXACT = np.uint64(0x9B05688C2B3E6C1F)
_SLOT = [mix(np.full(1, 0x510E527F + k, np.uint64))[0] for k in range(3)]  # number, unit, name


def _hashes(words: str) -> np.ndarray:
    data = np.frombuffer(words.encode(), np.uint8)
    t = Texts(data, np.array([0, len(data)]))
    starts, ends, _ = t.words(ALNUM)
    return np.sort(t.hashes(starts, ends))


@dataclass
class Lists:
    """Words, lower-case and with spaces between them, that fill slots whatever their shape."""

    numbers: str = NUMBER_WORDS
    units: str = UNIT_WORDS
    names: str = NAME_WORDS


@lru_cache(maxsize=16)
def _listed(numbers: str, units: str, names: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _hashes(numbers), _hashes(units), _hashes(names)


_DIGIT, _UPPER, _STOP = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_UPPER[0x41:0x5B] = True
_STOP[[0x0A, 0x0D, 0x21, 0x2E, 0x3A, 0x3F]] = True


def _among(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return np.zeros(len(keys), bool) if not len(known) else known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def templates(texts: Texts, lists: Lists) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word (a run of ASCII letters, digits and bytes over 0x7F): its hash with A-Z lowered, the hash that stands for it in
    the template, and whether it fills a slot; and each text's first word.

    Numbers are words of digits, or listed; units are listed words; names are listed words with a capital, and words with a capital that do not
    begin a sentence."""
    numbers, units, names = _listed(lists.numbers, lists.units, lists.names)
    starts, ends, first = texts.words(ALNUM)
    word = texts.lower().hashes(starts, ends)
    if not len(word):
        return word, word, np.zeros(0, bool), first
    digits = np.concatenate(([0], np.cumsum(_DIGIT[texts.data])))
    number = (digits[ends] - digits[starts] == ends - starts) | _among(numbers, word)
    stops = np.concatenate(([0], np.cumsum(_STOP[texts.data])))
    opens = np.concatenate(([True], stops[starts[1:]] > stops[ends[:-1]]))
    opens[first[:-1][first[:-1] < len(opens)]] = True
    capital = _UPPER[texts.data[starts]]
    # Where every word has a capital (titles, shouting), capitals say nothing.
    follows = np.concatenate(([False], capital[:-1])) & ~opens
    follows[first[:-1][first[:-1] < len(opens)]] = False
    after = np.concatenate((capital[1:], [False]))
    after[first[1:][first[1:] > first[:-1]] - 1] = False
    name = capital & ((~opens & ~(follows & after)) | _among(names, word))
    unit = _among(units, word)
    slot = np.select([number, unit, name], [1, 2, 3], 0)
    stands = np.where(slot > 0, np.array([0, *_SLOT], np.uint64)[slot], word)
    return word, stands, slot > 0, first


def windows(texts: Texts, lengths: list[int], size: int, lists: Lists) -> tuple[np.ndarray, ...]:
    """Text, place, number of words, hash, whether the hash is of the words themselves (else of the template) and whether the template
    counts, for each window of so many words; and the words in all, which of them fill slots, and the first word of each text.

    Windows with LEAST_PLAIN plain words have both hashes, others that of their words; a text of fewer than size words has one of
    its whole template too."""
    word, stands, slot, first = templates(texts, lists)
    count = np.diff(first)
    text = np.repeat(np.arange(len(texts)), count)
    plain = np.concatenate(([0], np.cumsum(~slot)))
    none = np.zeros(0, np.int64)
    found = [(none, none, none, none.view(np.uint64), none.astype(bool), none.astype(bool))]
    for exact, source in ((False, stands), (True, word)):
        run = source
        for length in range(1, max(lengths) + 1):
            if length > 1:
                run = pair(run[: len(run) - 1], source[len(source) - len(run) + 1 :]) if len(run) > 1 else run[:0]
            if length not in lengths or not len(run):
                continue
            at = np.arange(len(run))
            telling = plain[at + length] - plain[at] >= LEAST_PLAIN
            at = at[(at + length <= first[1:][text[: len(at)]]) & (telling | exact)]
            h = run[at] if length == size else pair(np.full(len(at), length, np.uint64), run[at])
            found.append((text[at], at - first[text[at]], np.full(len(at), length), mix(h ^ _EXACT) if exact else h, np.full(len(at), exact), telling[at]))
    for k in np.flatnonzero((count > 0) & (count < size)):
        h = np.full(1, count[k], np.uint64)
        for w in stands[first[k] : first[k + 1]]:
            h = pair(h, np.full(1, w))
        found.append((np.array([k]), np.zeros(1, np.int64), count[k : k + 1], h, np.zeros(1, bool), np.ones(1, bool)))
    return *(np.concatenate(x) for x in zip(*found, strict=True)), word, slot, first


def _slots(word: np.ndarray, slot: np.ndarray, lo: int, hi: int) -> list[int]:
    """The words in a window's slots, in order."""
    return word[lo:hi][slot[lo:hi]].view(np.int64).tolist()


def item_windows(benchmark: DataFrame, size: int, lists: Lists) -> DataFrame:
    """item_id, n_windows, n_plain (windows whose template counts), place, length, h, exact, plain and slots for each hash of a window
    of benchmark (item_id, text), an item of fewer than size words being one window; null texts have none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in blocks(batch.column(1)):
                t, p, length, h, exact, plain, word, slot, first = windows(texts, list(range(1, size + 1)), size, lists)
                count = np.diff(first)
                own = length == np.minimum(count, size)[t]
                t, p, length, h, exact, plain = (x[own] for x in (t, p, length, h, exact, plain))
                n = np.maximum(count - size + 1, 1)
                n_plain = np.where(count < size, 1, np.bincount(t[~exact], minlength=j - i))
                lo = first[t] + p
                slots = [_slots(word, slot, a, b) for a, b in zip(lo.tolist(), (lo + length).tolist(), strict=True)]
                arrays = [batch.column(0).slice(i, j - i).take(pa.array(t)), *(pa.array(x) for x in (n[t], n_plain[t], p, length, h.view(np.int64), exact, plain)), pa.array(slots, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["item_id", "n_windows", "n_plain", "place", "length", "h", "exact", "plain", "slots"])

    fields = "item_id long, n_windows long, n_plain long, place long, length long, h long, exact boolean, plain boolean, slots array<long>"
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(cut, fields)


def _filter_bits(items: DataFrame) -> np.ndarray:
    """A bit for the lowest 24 bits of each hash: 2 MB for a benchmark of any size. It only spares the join rows that cannot match."""
    words = items.select(F.expr(f"h & {(1 << _bits) - 1}").alias("b")).distinct()
    rows = words.groupBy(F.expr("b >> 6").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(b & 63)))").alias("bits"))  # 2 ** 18 rows at most
    frame = rows.toPandas()
    table = np.zeros(1 << (_bits - 6), np.uint64)
    table[frame["word"].to_numpy(np.int64)] = frame["bits"].to_numpy(np.int64).view(np.uint64)
    return table


HITS = "doc_id long, th long, place long, h long, slots array<long>"


def document_hits(docs: DataFrame, bits: np.ndarray, lengths: list[int], size: int, lists: Lists) -> DataFrame:
    """doc_id, th (a hash of the text), place, h and slots for each window of docs (doc_id, text) of so many words whose hash may be in
    the benchmark."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for i, j, texts in blocks(batch.column(2)):
                t, p, length, h, _, _, word, slot, first = windows(texts, lengths, size, lists)
                low = h & np.uint64((1 << _bits) - 1)
                may = (table[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) > 0
                t, p, length, h = t[may], p[may], length[may], h[may]
                lo = first[t] + p
                slots = [_slots(word, slot, a, b) for a, b in zip(lo.tolist(), (lo + length).tolist(), strict=True)]
                arrays = [batch.column(k).slice(i, j - i).take(pa.array(t)) for k in (0, 1)]
                arrays += [pa.array(p), pa.array(h.view(np.int64)), pa.array(slots, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "th", "place", "h", "slots"])

    return docs.select(*_named(), "text").mapInArrow(look, HITS)


def _named() -> list[Column]:
    """What a document is known by: its id and a hash of its text."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th")]


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, coverage: float = COVERAGE, lists: Lists | None = None) -> DataFrame:
    """doc_id, th (a hash of the text), contaminated, item_id (the item of which most is there, the smallest of equal ones), coverage
    (share of its windows, or of those whose template counts if that is more; 0 where no window matches) and n_items (how many reach
    `coverage`) for each row of docs (doc_id, text).

    Null, empty and wordless texts hold nothing; rows that repeat come out each; items without words and null item ids match nothing;
    other columns are ignored; an empty benchmark leaves every document clean."""
    lists = lists or Lists()
    items = item_windows(benchmark.where("item_id is not null"), size, lists)
    lengths = sorted({size, *(r["length"] for r in items.select("length").distinct().collect())})  # size of them at most
    rows = document_hits(docs, _filter_bits(items), lengths, size, lists)
    own = items.select("item_id", "n_windows", "n_plain", F.col("place").alias("at"), F.col("h").alias("hash"), "exact", "plain", F.col("slots").alias("own"))
    # Where the words agree, what stands in the item's slots stands there in the document, whatever counts as a slot there.
    found = rows.join(own, F.col("h") == F.col("hash"))
    diagonal = found.groupBy("doc_id", "th", "item_id", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.first("n_windows").alias("n_windows"),
        F.first("n_plain").alias("n_plain"),
        F.collect_set(F.struct("at", "exact", "plain", F.arrays_zip("own", F.when(F.col("exact"), F.col("own")).otherwise(F.col("slots")).alias("slots")).alias("pairs"))).alias("matched"),
    )
    diagonal = diagonal.withColumn("pairs", F.expr("array_distinct(flatten(transform(matched, w -> w.pairs)))"))
    torn = "array_distinct(transform(filter(pairs, x -> exists(pairs, y -> y.own = x.own and y.slots <> x.slots)), x -> x.own))"
    diagonal = diagonal.withColumn("torn", F.expr(f"if(size(pairs) = size(array_distinct(transform(pairs, x -> x.own))), cast(array() as array<bigint>), {torn})"))
    diagonal = diagonal.withColumn("matched", F.expr("if(size(torn) = 0, matched, filter(matched, w -> w.exact or not exists(w.pairs, x -> array_contains(torn, x.own))))"))
    at = lambda which: F.size(F.array_distinct(F.flatten(F.collect_list(F.expr(f"transform({which}, w -> w.at)")))))
    n, n_plain = F.first("n_windows"), F.first("n_plain")
    share = F.greatest(at("matched") / n, F.when(n_plain > 0, at("filter(matched, w -> w.plain)") / n_plain))
    item = diagonal.groupBy("doc_id", "th", "item_id").agg(share.alias("share"))
    best = item.groupBy("doc_id", "th").agg(F.max(F.struct("share", (-F.col("item_id")).alias("less"))).alias("best"), F.count_if(F.col("share") >= coverage).alias("n_items"))
    best = best.select(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th"), "best", "n_items")
    each = docs.select(*_named()).join(best, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th")), "left")
    return each.select(
        "doc_id",
        "th",
        (F.coalesce("n_items", F.lit(0)) > 0).alias("contaminated"),
        (-F.col("best.less")).alias("item_id"),
        F.coalesce("best.share", F.lit(0.0)).alias("coverage"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold an item, whatever their ids and the names of their other columns."""
    gone = contaminated(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_th"]), "left_anti")

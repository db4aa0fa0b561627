"""A Katz backoff bigram model: Good-Turing discounted counts with exactly normalised backoff weights.

Tokens are words (runs of bytes other than 0x20 and 0x09-0x0D, A-Z lowered) and one end for each text. Every word is a context and
a successor of its own, and all words that training has not seen are one event, so that probabilities sum to one. The `named` most
frequent words have short numbers, and what is known of them as contexts is sent to every task; the others go by their hashes. That
changes what is sent and no result.

Bigram counts are a table in parts; a part is merged and later looked up by one task. Bigrams of two named words are dealt by a hash
of both, so that a frequent context is spread over all parts; with one other word, by a hash of that; with two, to the part of each.
So the part of an other word has its count (that of its bigrams as a successor) and all its successors with their counts. Scoring
sends each distinct bigram of a chunk of texts to its parts and gets back one row of sums for each text.

With a `vocabulary`, a smaller model is fitted: words outside the so many most frequent share one class as contexts and successors,
within which a word has its share of the unigram probability of the class.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, freed, spread, written
from tidemark.llm.spans import NONSPACE, Texts, blocks, group_starts, mix

#: Words with numbers of their own where bigrams are sent.
NAMED = 65_000
#: Counts up to this are discounted.
DISCOUNTED = 5
CHUNK_BYTES, CHUNK_TEXTS = 8 << 20, 50_000
PART_TOKENS = 2_500_000
END = np.uint64(0x6A09E667F3BCC908)
RARE = 0
MESSAGE = "part int, kind int, chunk long, payload binary"
#: Codes from here on are hashes of words without a number.
OTHER = np.uint64(1 << 20)
#: Bigrams of two named words, of a named and an other, of an other and a named, of two others (dealt by the second, and by the first).
_PAIRS, _TO_OTHER, _FROM_OTHER, _OTHERS, _OTHERS_BY_FIRST, _WORDS, _STATS = range(7)
_FORMS = {_PAIRS: ("<i4", "<i4"), _TO_OTHER: ("<i4", "<u8"), _FROM_OTHER: ("<u8", "<i4"), _OTHERS: ("<u8", "<u8"), _OTHERS_BY_FIRST: ("<u8", "<u8")}
#: Kinds that are sent in the order of their successors, and otherwise of their contexts.
_BY_SECOND = (_TO_OTHER, _OTHERS)
#: Of what a part knows of a context with an id: the id, its count, probability of its successors, successors of each low count.
_STATS_FORMS = ("<i4", "<i8", "<f8", *["<i4"] * (DISCOUNTED + 1))
#: A question has this added to its kind.
_ASK = 8
#: Sums of logarithms are sent as whole multiples of 1 / _UNIT, whatever the order they are added in.
_UNIT = float(1 << 30)


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of each text, its end last, and the text each is in."""
    starts, ends, first = texts.words(NONSPACE)
    words = texts.lower().hashes(starts, ends)
    count = np.diff(first)
    return np.insert(words, first[1:], END), np.repeat(np.arange(len(texts)), count + 1)


def discounts(counts: dict[int, int]) -> np.ndarray:
    """Katz's Good-Turing factor for each count 0 to DISCOUNTED, from how many types have each count. Where the formula gives no
    factor between 0 and 1 (gaps or rises in the counts of counts), half a count is taken off."""
    k, n = DISCOUNTED, [counts.get(r, 0) for r in range(DISCOUNTED + 2)]
    out = np.ones(k + 1)
    tail = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        out[r] = d if 0 < d < 1 else 1 - 0.5 / r
    return out


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second, and so on: most of those are alike, which packs them."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _zip(*arrays: np.ndarray, runs: bool = False) -> bytes:
    """Arrays of one length. runs: the first two are integers in ascending order; each number of the first is sent once, with how often
    it stands there, and those of both as distances from the one before (any other order comes back as well, in more bytes). Long
    numbers of the second go by their places in a list of them."""
    n, heads = len(arrays[0]), 0
    if runs and n:
        first, second, *more = arrays
        if second.itemsize == 8:
            known, second = np.unique(second, return_inverse=True)
            second = second.astype("<u4")
            more.append(np.diff(known, prepend=known.dtype.type(0)))
        at = group_starts(first)
        heads, steps = len(at), np.diff(second, prepend=second[:1])
        steps[at] = second[at]
        arrays = np.diff(first[at], prepend=first.dtype.type(0)), np.diff(np.append(at, n)).astype("<u4"), steps, *more
    raw = b"".join(map(_planes, arrays))
    return np.array([len(raw), n, heads], "<u4").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unzip(payload: bytes, *kinds: str) -> list[np.ndarray]:
    size, n, heads = (int(x) for x in np.frombuffer(payload, "<u4", 3))
    raw, at = pa.decompress(payload[12:], decompressed_size=size, codec="zstd", asbytes=True), 0

    def read(kind: str, count: int = n) -> np.ndarray:
        nonlocal at
        planes = np.frombuffer(raw, np.uint8, count * np.dtype(kind).itemsize, at).reshape(-1, count) if count else np.zeros((np.dtype(kind).itemsize, 0), np.uint8)
        at += planes.size
        return np.ascontiguousarray(planes.T).view(kind).ravel()

    if not heads:
        return [read(kind) for kind in kinds]
    listed = np.dtype(kinds[1]).itemsize == 8
    first, count, second = read(kinds[0], heads), read("<u4", heads), read("<u4" if listed else kinds[1])
    start = np.cumsum(count) - count
    sums = np.cumsum(second, dtype=second.dtype)  # wraps round and back
    sums -= np.repeat(sums[start] - second[start], count)
    more = [read(kind) for kind in kinds[2:]]
    if listed:
        known = read(kinds[1], int(sums.max()) + 1)
        sums = np.cumsum(known, dtype=known.dtype)[sums]
    return [np.repeat(np.cumsum(first, dtype=first.dtype), count), sums, *more]


def _zip_pairs(kind: int, v: np.ndarray, w: np.ndarray, *more: np.ndarray) -> bytes:
    """Bigrams and what is told of each."""
    v, w = v.astype(_FORMS[kind][0]), w.astype(_FORMS[kind][1])
    return _zip(*((w, v) if kind in _BY_SECOND else (v, w)), *more, runs=True)


def _unzip_pairs(kind: int, payload: bytes, *more: str) -> list[np.ndarray]:
    if kind not in _BY_SECOND:
        return _unzip(payload, *_FORMS[kind], *more)
    w, v, *rest = _unzip(payload, *_FORMS[kind][::-1], *more)
    return [v, w, *rest]


def _row(part: int, kind: int, chunk: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([chunk], pa.int64()), pa.array([payload], pa.binary())], names=["part", "kind", "chunk", "payload"])


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix(keys ^ np.uint64(0x3C6EF372FE94F82B)) % np.uint64(parts)).astype(np.int64)


def _counted(*keys: np.ndarray, by: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct tuples in ascending order and how often each occurs (or the sum of `by`)."""
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    head = np.zeros(len(order), bool)
    head[:1] = True
    for k in keys:
        head[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(head)
    if by is None:
        n = np.diff(np.append(at, len(order)))
    else:
        n = np.add.reduceat(by[order], at) if len(at) else by[:0]
    return [k[at] for k in keys], n


@dataclass
class Katz:
    """A fitted model: what the vocabulary bounds, and the tables."""

    whole: bool  # words without an id are told apart; otherwise they share the class RARE
    words: np.ndarray  # hashes of the words with ids, ascending
    ids: np.ndarray  # their ids, from 1 by falling count
    unigram: np.ndarray  # probability of each id; RARE: of all other words and of unseen ones
    word_counts: np.ndarray  # count of each id
    total: int
    types: int
    word_discount: np.ndarray
    unseen: float
    pair_discount: np.ndarray
    context: np.ndarray  # count of each id as a context
    scale: np.ndarray  # what seen successors of a context are multiplied with
    backoff: np.ndarray
    parts: int
    table: DataFrame  # MESSAGE: counts of bigrams, and in a model with a class those of its words

    def word_probability(self, counts: np.ndarray) -> np.ndarray:
        """Unigram probability of words with these counts in training."""
        return np.where(counts > 0, self.word_discount[np.minimum(counts, DISCOUNTED + 1)] * counts / max(self.total, 1), self.unseen)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.types + 1)))

    def code_of(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of words that have one; others keep their hashes, or are RARE in a model with a class."""
        others = np.where(hashes < OTHER, hashes | np.uint64(1 << 63), hashes) if self.whole else np.full(len(hashes), RARE, np.uint64)
        if not len(self.words):
            return others
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.ids[at], others)

    def pairs(self, hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context and successor of each token; a text's first token follows an id of its own."""
        w = self.code_of(hashes)
        v = np.concatenate((w[:1], w[:-1]))
        v[np.concatenate(([True], text[1:] != text[:-1]))[: len(v)]] = len(self.unigram) - 1
        return v, w


def _dealt(v: np.ndarray, w: np.ndarray, parts: int, both: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """kind, part and places of bigrams; both: those of two other words go to the part of the first, too."""
    for kind, at in enumerate((v < OTHER, v < OTHER, v >= OTHER, v >= OTHER, v >= OTHER)[: 4 + both]):
        at = np.flatnonzero(at & (w >= OTHER if kind in (_TO_OTHER, _OTHERS, _OTHERS_BY_FIRST) else w < OTHER))
        key = (v[at] << np.uint64(32)) | w[at] if kind == _PAIRS else w[at] if kind in _BY_SECOND else v[at]
        if kind in _BY_SECOND:
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
        for p, some in _by_part(_part_of(key, parts), parts):
            yield kind, p, at[some]


def _words_of(met: dict[int, tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """The other words of a part and their counts: those of all bigrams that end in them."""
    w, n = (np.concatenate([np.zeros(0, t), *(met[kind][k] for kind in (_TO_OTHER, _OTHERS) if kind in met)]) for k, t in ((1, np.uint64), (2, np.int64)))
    (w,), n = _counted(w, by=n)
    return w, n


def _weights(n: np.ndarray, reached: np.ndarray, low: np.ndarray, discount: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For contexts of n tokens, whose successors have the unigram probability `reached` and of which `low` have counts from 1: what
    their seen successors are multiplied with, and their backoff weights."""
    left = (low[:, :DISCOUNTED] * (1 - discount[1 : DISCOUNTED + 1]) * np.arange(1, DISCOUNTED + 1)).sum(axis=1) / n
    scale = np.where(left > 1e-12, 1.0, n / (n + 1))  # a context without low counts gives one count away
    left = np.where(left > 1e-12, left, 1 / (n + 1))
    free = 1 - reached
    full = free < 1e-12  # every successor is seen: nothing to back off to
    return np.where(full, scale / np.maximum(1 - left, 1e-300), scale), np.where(full, 0.0, left / np.where(full, 1, free))


def _word_counts(docs: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            (h,), n = _counted(np.concatenate([x[0] for x in held]), by=np.concatenate([x[1] for x in held]))
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["h", "c"])

        for batch in batches:
            for _, _, texts in blocks(batch.column(0)):
                (h,), n = _counted(tokens(texts)[0])
                held.append((h, n))
                size += len(h)
                if size > 2_000_000:
                    merged = out()
                    held, size = [(merged.column(0).to_numpy().view(np.uint64), merged.column(1).to_numpy())], merged.num_rows
                    if size > 1_000_000:
                        yield merged
                        held, size = [], 0
        if held:
            yield out()

    return docs.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Rows, token hashes and the text of each, for runs of about CHUNK_BYTES."""
    rows, parts, size, texts_so_far = [], [], 0, 0
    for batch in batches:
        for i, j, texts in blocks(batch.column(column)):
            h, text = tokens(texts)
            rows.append(batch.slice(i, j - i))
            parts.append((h, text + texts_so_far))
            size, texts_so_far = size + len(texts.data), texts_so_far + len(texts)
            if size > CHUNK_BYTES or texts_so_far > CHUNK_TEXTS:
                yield rows, *(np.concatenate(x) for x in zip(*parts, strict=True))
                rows, parts, size, texts_so_far = [], [], 0, 0
    if rows:
        yield rows, *(np.concatenate(x) for x in zip(*parts, strict=True))


def _by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    edge = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if edge[p] < edge[p + 1]:
            yield p, order[edge[p] : edge[p + 1]]


def fit(docs: DataFrame, vocabulary: int | None = None, named: int = NAMED) -> Katz:
    """Learns from every row of docs (text; null is empty; repeated rows count again; other columns are ignored): a model of all words,
    or with `vocabulary` one of so many and a class. Without rows all probability goes to unseen words."""
    with freed(docs.sparkSession):
        return _fit(docs, vocabulary, named)


def _fit(docs: DataFrame, vocabulary: int | None, named: int) -> Katz:
    whole, top = vocabulary is None, named if vocabulary is None else vocabulary
    if top > int(OTHER) - 2:
        raise ValueError(f"at most {int(OTHER) - 2} words can have numbers of their own, not {top}")
    spark = docs.sparkSession
    counts = written(_word_counts(docs), "word-counts")
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    counts_of = {r["c"]: r["count"] for r in counts.where(F.col("c") <= DISCOUNTED + 1).groupBy("c").count().collect()}
    top = counts.orderBy(F.desc("c"), "h").limit(top).toPandas()  # as many rows as have numbers
    h, c = top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    by = np.argsort(h)
    discount = np.append(discounts(counts_of), 1.0)
    taken = sum((1 - discount[r]) * r * n for r, n in counts_of.items()) / max(total, 1)
    unseen = max(taken, 1 / (total + 1))  # no count may be small enough to be discounted
    discount *= (1 - unseen) / (1 - taken) if taken < 1 else 1
    seen = discount[np.minimum(c, DISCOUNTED + 1)] * c / max(total, 1)
    unigram = np.concatenate(([max(0.0, 1 - seen.sum())], seen, [0.0]))  # the last id stands before a text's first token
    parts = max(spread(docs), math.ceil(total / PART_TOKENS))
    m = Katz(whole, h[by], (by + 1).astype(np.uint64), unigram, np.concatenate(([0], c, [0])), total, types, discount, unseen, None, None, None, None, parts, None)
    shared = spark.sparkContext.broadcast(m)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for _, hashes, text in _chunks(batches, 0):
            (v, w), n = _counted(*model.pairs(hashes, text))
            for kind, p, at in _dealt(v, w, parts, False):
                yield _row(p, kind, 0, _zip_pairs(kind, v[at], w[at], n[at].astype("<i4")))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        size = len(model.unigram)

        def merged(pieces: list) -> list[np.ndarray]:
            v, w, n = (np.concatenate(x) for x in zip(*pieces, strict=True))
            (v, w), n = _counted(v, w, by=n.astype(np.int64))
            return [v, w, n]

        def out(part: int, held: dict[int, list]) -> Iterator[pa.RecordBatch]:
            met = {kind: merged(held.pop(kind)) for kind in sorted(held)}
            words = _words_of(met)
            # for each context with an id: its count, probability of its successors, successors of each low count
            sums = np.zeros((size, 3 + DISCOUNTED))
            for kind, (v, w, n) in met.items():
                by = np.argsort(w, kind="stable") if kind in _BY_SECOND else slice(None)
                yield _row(part, kind, 0, _zip_pairs(kind, v[by], w[by], n[by].astype("<i8")))
                if kind in (_PAIRS, _TO_OTHER):
                    probability = model.unigram[w] if kind == _PAIRS else model.word_probability(_looked_up(*words, w))
                    sums[:, :2] += np.column_stack([np.bincount(v, n, size), np.bincount(v, probability, size)])
                else:
                    v = np.full(len(w), RARE)  # all that is known at the driver of others
                sums[:, 2:] += np.column_stack([np.bincount(v[n == r], minlength=size) for r in range(1, DISCOUNTED + 2)])
            have = np.flatnonzero(sums.any(axis=1))
            yield _row(part, _STATS, 0, _zip(*(x.astype(form) for x, form in zip((have, *sums[have].T), _STATS_FORMS, strict=True))))
            if _OTHERS in met:
                v, w, n = met[_OTHERS]
                count = _looked_up(*words, w)
                for p, at in _by_part(_part_of(v, parts), parts):
                    yield _row(p, _OTHERS_BY_FIRST, 0, _zip_pairs(_OTHERS_BY_FIRST, v[at], w[at], n[at].astype("<i8"), count[at].astype("<i8")))

        part, held = None, {}
        for batch in batches:
            for p, kind, payload in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if p != part and held:
                    yield from out(part, held)
                    held = {}
                part = p
                held.setdefault(kind, []).append(_unzip_pairs(kind, payload, "<i4"))
                if len(held[kind]) > 64:  # keeps what is held near the size of the result
                    held[kind] = [merged(held[kind])]
        if held:
            yield from out(part, held)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for p, at in _by_part(_part_of(h, parts), parts):
                yield _row(p, _WORDS, 0, _zip(h[at].astype("<u8"), c[at].astype("<i8")))

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, names = len(shared.value.unigram), ["v", "total", "reached", *(f"n{r}" for r in range(1, DISCOUNTED + 2))]
        sums = np.zeros((size, len(names) - 1))
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                have, *columns = _unzip(payload, *_STATS_FORMS)
                sums[have] += np.column_stack(columns)
        have = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), *(pa.array(x) for x in sums[have].T)], names=names)

    pairs = docs.select("text").mapInArrow(send, MESSAGE).repartition(parts, "part").sortWithinPartitions("part").mapInArrow(merge, MESSAGE)
    pairs = written(pairs, "bigrams", "none")
    m.table = pairs.where(f"kind <> {_STATS}")
    if not whole:
        rare = counts.repartition(parts, F.pmod(F.col("h"), F.lit(parts))).sortWithinPartitions("h").mapInArrow(pack, MESSAGE)
        m.table = m.table.union(written(rare, "words", "none"))
    discard(counts)
    fields = ["total double", "reached double", *(f"n{r} double" for r in range(1, DISCOUNTED + 2))]
    by_context = pairs.where(f"kind = {_STATS}").select("payload").mapInArrow(stats, "v int, " + ", ".join(fields))
    by_context = by_context.groupBy("v").agg(*(F.sum(x.split()[0]).alias(x.split()[0]) for x in fields)).toPandas().sort_values("v")  # a row for each id
    low = by_context[[f"n{r}" for r in range(1, DISCOUNTED + 2)]].to_numpy(float)
    m.pair_discount = np.append(discounts({r: int(n) for r, n in enumerate(low.sum(axis=0), 1)}), 1.0)
    is_context = by_context["total"].to_numpy(float) > 0
    v, n, reached = (by_context[x].to_numpy(kind)[is_context] for x, kind in (("v", int), ("total", float), ("reached", float)))
    m.context, m.scale, m.backoff = np.zeros(len(unigram)), np.ones(len(unigram)), np.ones(len(unigram))
    m.context[v] = n
    m.scale[v], m.backoff[v] = _weights(n, reached, low[is_context], m.pair_discount)
    return m


def _looked_up(known: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], 0)


def _code(kind: int, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One number for a bigram of a kind; where a word goes by its hash, a hash of both."""
    v, w = v.astype(np.uint64), w.astype(np.uint64)
    return (v << np.uint64(32)) | w if kind == _PAIRS else mix(v ^ mix(w))


class _Part:
    """The tables of one part, as they are looked up."""

    def __init__(self, m: Katz, pieces: dict[int, list[list[np.ndarray]]]):
        self.m, self.counts = m, {}
        met = {kind: [np.concatenate(x) for x in zip(*some, strict=True)] for kind, some in pieces.items()}
        self.words = _words_of(met)
        if _WORDS in met:
            h, n = met.pop(_WORDS)
            by = np.argsort(h)
            self.words = h[by], n[by]
        for kind, (v, w, n, *_) in met.items():
            code = _code(kind, v, w)
            by = np.argsort(code)
            self.counts[kind] = code[by], n[by]
        # what is known of contexts without an id
        v, n, p = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for kind in (_FROM_OTHER, _OTHERS_BY_FIRST):
            if kind in met:
                v.append(met[kind][0])
                n.append(met[kind][2])
                p.append(m.unigram[met[kind][1]] if kind == _FROM_OTHER else m.word_probability(met[kind][3]))
        v, n, p = map(np.concatenate, (v, n, p))
        (self.contexts,), total = _counted(v, by=n)
        at, size = np.searchsorted(self.contexts, v), len(total)
        low = np.column_stack([np.bincount(at[n == r], minlength=size) for r in range(1, DISCOUNTED + 2)])
        self.known = np.column_stack([total, *_weights(total, np.bincount(at, p, size), low, m.pair_discount)])

    def count(self, kind: int, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return _looked_up(*self.counts.get(kind, (np.zeros(0, np.uint64), np.zeros(0, np.int64))), _code(kind, v, w))

    def context(self, kind: int, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, scale and backoff of contexts."""
        if kind in (_PAIRS, _TO_OTHER):
            return self.m.context[v], self.m.scale[v], self.m.backoff[v]
        if not len(self.contexts):
            return np.zeros(len(v)), np.ones(len(v)), np.ones(len(v))
        at = np.minimum(np.searchsorted(self.contexts, v), len(self.contexts) - 1)
        return tuple(np.where((self.contexts[at] == v)[:, None], self.known[at], (0.0, 1.0, 1.0)).T)

    def told(self, kind: int, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The text of each question, and its share of the score and, where a word without an id is looked up, of the base score and of
        the known tokens."""
        log = lambda x: np.log10(np.maximum(x, 1e-300))
        if kind == _WORDS:
            h, doc, n = columns
            c = _looked_up(*self.words, h)
            return doc, [n * log(self.m.word_probability(c) / max(self.m.unigram[RARE], 1e-300)), n * self.m.base(c), n * (c > 0.0)]
        v, w, doc, n = columns
        c, to_other = self.count(kind, v, w), kind in (_TO_OTHER, _OTHERS)
        of_word = _looked_up(*self.words, w) if to_other else None
        if kind == _OTHERS:  # the part of the context tells the rest
            score = np.where(c > 0, 0.0, log(self.m.word_probability(of_word)))
        else:
            total, scale, backoff = self.context(kind, v)
            seen = self.m.pair_discount[np.minimum(c, DISCOUNTED + 1)] * c / np.maximum(total, 1) * scale
            after = self.m.word_probability(of_word) if to_other else 1.0 if kind == _OTHERS_BY_FIRST else self.m.unigram[w]
            score = log(np.where(c > 0, seen, backoff * after))
        return doc, [n * score, *((n * self.m.base(of_word), n * (of_word > 0.0)) if to_other else ())]


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(m: Katz, docs: DataFrame) -> DataFrame:
    """doc_id, held_out (as given), n_tokens, n_known, train_tokens, base_score and score (log10 of the text's probability) for each
    row of docs (doc_id, held_out, text). A null text is empty and holds its end alone; rows that repeat are scored each; an empty
    table gives no rows."""
    spark = docs.sparkSession
    table, parts = m.table, m.parts
    m.table = None
    shared = spark.sparkContext.broadcast(m)
    m.table = table

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, number = shared.value, TaskContext.get().partitionId() << 24
        for rows, hashes, text in _chunks(batches, 2):
            number += 1
            v, w = model.pairs(hashes, text)
            n_texts = sum(r.num_rows for r in rows)
            common = (w != RARE) & (w < OTHER)
            known = np.bincount(text[common], minlength=n_texts)
            base = np.bincount(text[common], model.base(model.word_counts[w[common]]), n_texts)
            ids = pa.concat_arrays([r.column(0) for r in rows])
            held = np.concatenate([r.column(1).to_numpy(zero_copy_only=False) for r in rows]).astype("<i8")
            null = ids.is_null().to_numpy(zero_copy_only=False).astype("<i8")
            yield _row(-1, -1, number, _zip(ids.fill_null(0).to_numpy().astype("<i8"), null, held, np.bincount(text, minlength=n_texts).astype("<i8"), known.astype("<i8"), base.astype("<f8")))
            (pv, pw, doc), n = _counted(v, w, text.astype("<i4"))
            for kind, p, at in _dealt(pv, pw, parts, True):
                yield _row(p, _ASK + kind, number, _zip_pairs(kind, pv[at], pw[at], doc[at], n[at].astype("<i4")))
            if not model.whole:
                (h, doc), n = _counted(hashes[~common], text[~common])
                for p, at in _by_part(_part_of(h, parts), parts):
                    yield _row(p, _ASK + _WORDS, number, _zip(h[at].astype("<u8"), doc[at].astype("<i4"), n[at].astype("<i4")))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tables, ready = None, {}, None
        asked, sums = None, []

        def out() -> Iterator[pa.RecordBatch]:
            """What a part has to say of a chunk, once."""
            if sums:
                told = np.zeros((3, max(len(x) for _, x in sums)))
                for k, x in sums:
                    told[k, : len(x)] -= x  # logarithms are below zero
                sums.clear()
                yield _row(0, 0, asked, _zip(*np.rint(told * _UNIT).astype("<i8")))

        for batch in batches:
            for p, kind, chunk, payload in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (p, chunk) != (part, asked):
                    yield from out()
                if p != part:
                    tables, ready = {}, None
                part, asked = p, chunk
                if p < 0:
                    yield _row(-1, -1, chunk, payload)
                elif kind < _ASK:
                    columns = _unzip(payload, "<u8", "<i8") if kind == _WORDS else _unzip_pairs(kind, payload, "<i8", *(["<i8"] if kind == _OTHERS_BY_FIRST else []))
                    tables.setdefault(kind, []).append(columns)
                else:
                    if ready is None:
                        ready, tables = _Part(shared.value, tables), {}
                    kind -= _ASK
                    doc, columns = ready.told(kind, _unzip(payload, "<u8", "<i4", "<i4") if kind == _WORDS else _unzip_pairs(kind, payload, "<i4", "<i4"))
                    sums += [(k, np.bincount(doc, x)) for k, x in enumerate(columns)]
        yield from out()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCORED.split(", ")]
        chunk, head, sums = None, None, None

        def out() -> pa.RecordBatch:
            ids, null, held, n_tokens, known, base = head
            of_score, of_base, of_known = sums / -_UNIT
            arrays = [pa.array(ids, mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(n_tokens), pa.array(known + np.rint(of_known).astype(np.int64)), pa.array(base + of_base), pa.array(of_score)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for kind, number, payload in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if number != chunk:
                    if head is not None:
                        yield out()
                    chunk, head = number, None
                if kind == -1:
                    head = _unzip(payload, "<i8", "<i8", "<i8", "<i8", "<i8", "<f8")
                    sums = np.zeros((3, len(head[0])), np.int64)
                else:
                    for k, x in enumerate(_unzip(payload, "<i8", "<i8", "<i8")):
                        sums[k, : len(x)] += x
        if head is not None:
            yield out()

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(ask, MESSAGE)
    # What a chunk's texts are goes past the parts, dealt by its chunk.
    place = F.when(F.col("part") < 0, F.pmod(F.col("chunk"), F.lit(parts))).otherwise(F.col("part"))
    met = table.union(asked).repartition(parts, place).sortWithinPartitions("part", "chunk", "kind")  # tables are chunk 0
    answers = met.mapInArrow(answer, MESSAGE)
    done = answers.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(total, SCORED)
    return done.withColumn("train_tokens", F.lit(m.total).cast("long"))


def scored(docs: DataFrame, held_out: Callable[[Column], Column], vocabulary: int | None = None, named: int = NAMED) -> DataFrame:
    """Learns from the rows of docs (doc_id, text) whose id is not held out, and scores all."""
    split = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return score(fit(split.where("not held_out"), vocabulary, named), split)

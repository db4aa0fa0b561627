"""Language identification by rank order: a document's most frequent letter n-grams against the profile of each language.

N-grams have one to three letters; words are lower-cased runs of letters with a mark at either end. The distance to a language is the
sum, over the document's `depth` most frequent n-grams, of how far out of place each is in the language's profile.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.spans import Texts, blocks

DEPTH = 400
#: The classifier is fitted on about so many rows of each language at most.
FIT_ROWS = 4000
UNKNOWN = "und"
_BLOCK = 1 << 19


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Lower-case letter of each code point under 2**16, 0 for what is no letter."""
    table = np.zeros(1 << 16, np.uint16)
    for c in range(1 << 16):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return table


def letters(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of a block (0: no letter) and where each text's start (one more at the end)."""
    raw = texts.data.tobytes()
    try:
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        offsets = np.concatenate(([0], np.cumsum((texts.data & 0xC0) != 0x80)))[texts.offsets]
    except UnicodeDecodeError:  # a text may hold any bytes
        parts = [np.frombuffer(raw[a:b].decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(texts.offsets[:-1], texts.offsets[1:], strict=True)]
        points, offsets = np.concatenate([*parts, np.zeros(0, np.uint32)]), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    out = _folded()[np.minimum(points, 0xFFFF)]
    for c in np.unique(points[points > 0xFFFF]).tolist():  # letters beyond are folded onto the private area
        out[points == c] = 0xE000 + (ord(chr(c).lower()[0]) % 0x1900) if chr(c).isalpha() else 0
    return out, offsets


def grams(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, n-gram and count, by text and then by falling count (equal ones by code)."""
    point, offsets = letters(texts)
    n = len(texts)
    # one mark before and after each word
    text = np.repeat(np.arange(n), np.diff(offsets) + 2)
    flat = np.zeros(len(point) + 2 * n, np.uint64)
    inner = np.arange(len(point)) + np.repeat(2 * np.arange(n) + 1, np.diff(offsets))
    flat[inner] = point
    letter = flat > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:]
    flat, text = flat[keep], text[keep].astype(np.uint64)
    if not len(flat):
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none
    a, b, c = flat, flat[1:], flat[2:]
    one = a[a > 0]
    same2, same3 = text[1:] == text[:-1], text[2:] == text[:-2]
    two = same2 & ((a[:-1] > 0) | (b > 0))
    # a mark in the middle would join two words
    three = same3 & (b[:-1] > 0) & ((a[:-2] > 0) | (c > 0))
    s = np.uint64
    # a pair is told from a triple that begins with a mark by its highest bit
    codes = [one, (a[:-1][two] << s(16)) | b[two] | s(1 << 47), (a[:-2][three] << s(32)) | (b[:-1][three] << s(16)) | c[three]]
    owner = [text[a > 0], text[:-1][two], text[:-2][three]]
    key = np.sort(np.concatenate([(o << s(48)) | (x & s((1 << 48) - 1)) for o, x in zip(owner, codes, strict=True)]))
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    owner = (key >> s(48)).astype(np.int64)
    by = np.lexsort((key, -count, owner))
    return owner[by], key[by] & s((1 << 48) - 1), count[by]


@dataclass
class Profiles:
    languages: list[str]
    codes: np.ndarray  # ascending
    ranks: np.ndarray  # (codes, languages): place in the profile, depth where it is not in it
    depth: int


def fit(labelled: DataFrame, depth: int = DEPTH, rows: int = FIT_ROWS) -> Profiles:
    """Profiles from the rows of labelled (text, lang, both not null), about `rows` of each language at most, chosen by a hash."""
    labelled = labelled.where("text is not null and lang is not null").select("text", "lang")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return Profiles([], np.zeros(0, np.uint64), np.zeros((0, 0)), depth)
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, rows / n))))
    sample = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in blocks(batch.column(0), _BLOCK):
                owner, code, n = grams(texts)
                names = np.array(batch.column(1).slice(i, j - i).to_pylist(), object)
                frame = pd.DataFrame({"lang": names[owner] if len(owner) else [], "gram": code.view(np.int64), "n": n})
                frame = frame.groupby(["lang", "gram"], as_index=False)["n"].sum()
                yield pa.RecordBatch.from_arrays([pa.array(frame["lang"].tolist(), pa.string()), pa.array(frame["gram"].to_numpy(np.int64)), pa.array(frame["n"].to_numpy(np.int64))], names=["lang", "gram", "n"])

    total = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = total.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < depth).select("lang", "gram", "rank").toPandas()  # depth rows for each language
    languages = sorted(counts)
    code = np.unique(top["gram"].to_numpy(np.int64).view(np.uint64))
    ranks = np.full((len(code), len(languages)), depth)
    ranks[np.searchsorted(code, top["gram"].to_numpy(np.int64).view(np.uint64)), np.searchsorted(np.array(languages), top["lang"].to_numpy(str))] = top["rank"]
    return Profiles(languages, code, ranks, depth)


def predict(profiles: Profiles, docs: DataFrame) -> DataFrame:
    """docs with lang_pred and score, from `text` alone.

    lang_pred is the language that is least out of place (of equal ones the first by name), or `und` where the text is null, has no
    letter, or there is no profile. score is 1 less the distance over the largest that is possible; 0 for `und`. A column of docs named
    lang_pred or score is replaced; others stay as they are; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        languages = np.array([*p.languages, UNKNOWN], object)
        for batch in batches:
            for i, j, texts in blocks(batch.column(0), _BLOCK):
                owner, code, _ = grams(texts)
                n = j - i
                first = np.searchsorted(owner, np.arange(n))
                rank = np.arange(len(owner)) - first[owner]
                use = rank < p.depth
                owner, code, rank = owner[use], code[use], rank[use]
                size = np.bincount(owner, minlength=n)
                pick, best = np.full(n, len(p.languages)), np.zeros(n)
                if len(p.codes):
                    at = np.minimum(np.searchsorted(p.codes, code), len(p.codes) - 1)
                    hit = p.codes[at] == code
                    misses = size - np.bincount(owner[hit], minlength=n)
                    at, owner, rank = at[hit], owner[hit], rank[hit]
                    distance = np.empty((n, len(p.languages)))
                    for k in range(len(p.languages)):
                        place = p.ranks[at, k]
                        out = np.where(place < p.depth, np.abs(place - rank), p.depth)
                        distance[:, k] = np.bincount(owner, out, n) + misses * p.depth
                    there = size > 0
                    pick[there] = distance[there].argmin(axis=1)
                    best[there] = np.clip(1 - distance[there].min(axis=1) / (size[there] * p.depth), 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), pa.array(languages[pick], pa.string()), pa.array(best)], names=["row", "lang_pred", "score"])

    rest = docs.select("text", F.struct(*docs.columns).alias("row"))
    found = rest.mapInArrow(judge, f"row {rest.schema['row'].dataType.simpleString()}, lang_pred string, score double")
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return found.select(*(F.col("row").getField(c).alias(c) for c in kept), "lang_pred", "score")


def keep_identified(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """docs without the rows that are in no learned language (`und`)."""
    judged = predict(fit(labelled), docs.select(F.struct(*docs.columns).alias("whole"), "text"))
    return judged.where(F.col("lang_pred") != UNKNOWN).select("whole.*")

"""Token ids of whole texts by a public tokenizer file, each distinct piece of text between spaces encoded once per worker.

A text is cut before a single space that stands between two visible characters. No pre-tokenizer of the two supported kinds
lets a token cross such a place, so the ids of the pieces, joined, are the ids of the text. tests/llm compare both. A piece of up to
WHOLE bytes is known by all its bytes, in two numbers, and its length; longer ones are found again within a block alone. A text that holds one of the vocabulary's special strings is encoded as a whole, as the
tokenizer reads it.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from tidemark.llm.spans import Texts, group_starts, pair

CACHED_PIECES, CACHED_IDS = 500_000, 8_000_000
WHOLE = 16
_JOIN = 400


def _ok_tables() -> tuple[np.ndarray, np.ndarray]:
    lead = np.zeros(256, bool)
    lead[0xC3:0xDC] = True
    lead[[0xCC, 0xCD]] = False
    shown = np.zeros(256, bool)
    shown[0x21:0x7F] = True
    return shown, lead


_SHOWN, _LEAD = _ok_tables()


def cuts(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of the texts that have bytes, and each text's first place among them (one more at the end)."""
    d, n = texts.data, len(texts.data)
    at = np.flatnonzero(d == 0x20)
    at = at[(at > 0) & (at < n - 1)]
    before, after = d[at - 1], d[at + 1]
    good = (_SHOWN[before] | ((before >= 0x80) & _LEAD[d[np.maximum(at - 2, 0)]])) & (_SHOWN[after] | _LEAD[after])
    first = texts.offsets[:-1][np.diff(texts.offsets) > 0]
    # the space, the byte before and the byte after belong to one text
    at = at[good]
    text = np.searchsorted(texts.offsets, at, "right") - 1
    at = at[(at > texts.offsets[text]) & (at + 1 < texts.offsets[text + 1])]
    starts = np.sort(np.concatenate((first, at)), kind="stable")  # the two have no place in common
    ends = np.concatenate((starts[1:], [n])) if len(starts) else starts
    return starts, ends, np.searchsorted(starts, texts.offsets)


class Encoder:
    """Encodes blocks of texts with one tokenizer file; keeps the ids of up to CACHED_PIECES pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        # A byte-level vocabulary without end-of-word marks shows where a piece starts by its space; else pieces are joined by a mark.
        self.spaced = not self.tokenizer.model.end_of_word_suffix
        self.opens = np.zeros(size, bool)
        if self.spaced:
            for word, i in self.tokenizer.get_vocab().items():
                self.opens[i] = word.startswith("Ġ")
        else:
            mark = self.tokenizer.encode("|", add_special_tokens=False).ids
            if len(mark) != 1:
                raise ValueError("the vocabulary has no single id for the joining mark")
            self.mark = mark[0]
        self._clear()

    def _clear(self) -> None:
        none = np.zeros(0, np.int64)
        empty = np.zeros(0, np.uint64)
        self.levels = [(empty, none, none, empty, empty, none), (empty, none, none, empty, empty, none)]
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def _keep(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Starts in the pool and lengths of the pieces' ids."""
        starts, lengths = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        joined, odd = [], []
        for k, p in enumerate(pieces):
            if self.spaced:
                plain = p[:1] == b" " and p.rfind(b" ") == 0 and 0x21 <= p[-1] <= 0x7E
            else:
                plain = b"|" not in p
            (joined if plain else odd).append(k)
        for lo in range(0, len(joined), _JOIN):
            part = joined[lo : lo + _JOIN]
            text = (b"" if self.spaced else b" | ").join([pieces[k] for k in part]).decode("utf-8", "replace")
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            if self.spaced:
                first = np.flatnonzero(self.opens[ids])
                counts = np.diff(np.append(first, len(ids)))
            else:
                marks = ids == self.mark
                ends = np.append(np.flatnonzero(marks), len(ids))
                counts = np.diff(np.concatenate(([-1], ends))) - 1
                ids = ids[~marks]
                first = np.cumsum(counts) - counts
            if len(counts) != len(part):
                odd.extend(part)
                continue
            starts[part], lengths[part] = first + self._keep(ids), counts
        for lo in range(0, len(odd), _JOIN):
            part = odd[lo : lo + _JOIN]
            got = self.tokenizer.encode_batch_fast([pieces[k].decode("utf-8", "replace") for k in part], add_special_tokens=False)
            for k, e in zip(part, got, strict=True):
                ids = np.array(e.ids, np.int32)
                starts[k], lengths[k] = self._keep(ids), len(ids)
        return starts, lengths

    def _whole(self, texts: Texts) -> list[int]:
        """Which texts hold a special string."""
        raw, found = texts.data.tobytes(), set()
        for content in self.special:
            at = raw.find(content)
            while at >= 0:
                k = int(np.searchsorted(texts.offsets, at, "right")) - 1
                if at + len(content) <= texts.offsets[k + 1]:
                    found.add(k)
                at = raw.find(content, at + 1)
        return sorted(found)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and where each text's ids start (one more at the end)."""
        ids, offsets = self._by_piece(texts)
        for k in self._whole(texts):
            text = texts.data[texts.offsets[k] : texts.offsets[k + 1]].tobytes().decode("utf-8", "replace")
            own = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
            ids = np.concatenate((ids[: offsets[k]], own, ids[offsets[k + 1] :]))
            offsets[k + 1 :] += len(own) - (offsets[k + 1] - offsets[k])
        return ids, offsets

    def _by_piece(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, firsts = cuts(texts)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        if len(self.levels[0][0]) + len(self.levels[1][0]) > CACHED_PIECES or self.used > CACHED_IDS:
            self._clear()
        sizes, n = ends - starts, len(texts.data)
        at, length = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        raw = texts.data.tobytes() + bytes(8)
        short = np.flatnonzero(sizes <= WHOLE)
        self._short(raw, np.ndarray((n + 1,), "<u8", raw, strides=(1,)), starts, ends, sizes, short, at, length)
        if len(short) < len(starts):
            odd = np.flatnonzero(sizes > WHOLE)
            pieces = [raw[a:b] for a, b in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)]
            different = list(dict.fromkeys(pieces))
            found = dict(zip(different, zip(*self._encode(different), strict=True), strict=True))
            at[odd], length[odd] = np.array([found[p] for p in pieces]).T
        before = np.cumsum(length) - length
        ids = self.pool[np.repeat(at - before, length) + np.arange(int(length.sum()))]
        return ids, np.append(before, len(ids))[firsts]

    def _short(self, raw: bytes, eight: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray, rows: np.ndarray, at: np.ndarray, length: np.ndarray) -> None:
        """Sets where the ids of the pieces in rows start in the pool, and how many they are. eight holds the eight bytes from each place on."""
        if not len(rows):
            return
        start, end, size = starts[rows], ends[rows], sizes[rows]
        low = eight[start] & _MASKS[np.minimum(size, 8)]
        high = np.where(size > 8, eight[np.maximum(end - 8, 0)], np.uint64(0))
        keys = piece_keys(low, high, size)
        order = np.argsort(keys)
        heads = group_starts(keys[order])
        inverse = np.empty(len(keys), np.int64)
        inverse[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(keys))))
        sample = order[heads]
        unique, where, count = keys[sample], np.full(len(sample), -1, np.int64), np.zeros(len(sample), np.int64)
        for known, place, ids, a, b, n in self.levels:
            if len(known):
                i = np.minimum(np.searchsorted(known, unique), len(known) - 1)
                hit = (known[i] == unique) & (a[i] == low[sample]) & (b[i] == high[sample]) & (n[i] == size[sample])
                where[hit], count[hit] = place[i[hit]], ids[i[hit]]
        new = np.flatnonzero(where < 0)
        if len(new):
            s = sample[new]
            where[new], count[new] = self._encode([raw[a:b] for a, b in zip(start[s].tolist(), end[s].tolist(), strict=True)])
            recent = tuple(np.concatenate(x) for x in zip(self.levels[1], (unique[new], where[new], count[new], low[s], high[s], size[s]), strict=True))
            if len(recent[0]) > 150_000:
                recent, base = tuple(x[:0] for x in recent), tuple(np.concatenate(x) for x in zip(self.levels[0], recent, strict=True))
                by = np.argsort(base[0])
                self.levels[0] = tuple(x[by] for x in base)
            by = np.argsort(recent[0])
            self.levels[1] = tuple(x[by] for x in recent)
        at[rows], length[rows] = where[inverse], count[inverse]
        like = sample[inverse]
        other = np.flatnonzero((low[like] != low) | (high[like] != high) | (size[like] != size))  # unlike pieces with one key
        if len(other):
            at[rows[other]], length[rows[other]] = self._encode([raw[a:b] for a, b in zip(start[other].tolist(), end[other].tolist(), strict=True)])


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def piece_keys(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number to look a piece up by."""
    return pair(low, high + size.astype(np.uint64))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """This process's encoder of the file."""
    return Encoder(path)

"""What SQL cannot express, against plain Python on small tables: fingerprints, Katz scores, languages, decontamination, packing, the pipeline."""

import collections
import math
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_operators import brute_groups, brute_repeats, crc, spaced
from tidemark.llm import decontam, fingerprints, katz, langid, licenses, near_dup, packing, repeats, token_records, warc

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def hash64(data):
    """Spark's xxhash64 of a string or binary."""
    return xxhash.xxh64(data, seed=42).intdigest()


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def brute_print(text, k=fingerprints.K, s=fingerprints.S):
    """Entry (hash, place) of each bin."""
    b, bins = text.encode(), {}
    width = k - s + 1
    if len(b) < k + width - 1:
        found = [(1, hash64(b) & 0x7FFFFFFF)]
    else:
        found = []
        for i in range(len(b) - k + 1):
            inner = [signed(hash64(b[i + j : i + j + s])) for j in range(width)]
            if min(inner[0], inner[-1]) <= min(inner[1:-1]):
                found.append((i + 1, hash64(b[i : i + k]) & 0x7FFFFFFF))
    for at, h in found:
        e = h << 32 | at
        bins[h % fingerprints.BINS] = min(e, bins.get(h % fingerprints.BINS, e))
    return bins


def brute_likeness(a, b):
    filled = set(a) | set(b)
    shifts = [b[i] - a[i] for i in set(a) & set(b) if a[i] >> 32 == b[i] >> 32]
    return max((sum(abs(x - y) <= fingerprints.SHIFT for y in shifts) for x in shifts), default=0) / len(filled)


def test_fingerprints_are_closed_syncmers(spark):
    rng = np.random.default_rng(8)
    texts = {i: " ".join(f"wörd{x}" for x in rng.integers(0, 400, int(rng.integers(1, 90)))) for i in range(25)} | {30: "", 31: "ab"}
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    order = sorted(texts, reverse=True)
    as_text = lambda bins: "".join(f"{bins[i]:016X}" for i in sorted(bins))
    for k, d in enumerate(order):
        t, after = texts[d], texts[order[(k + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, other, following = brute_print(t), brute_print(edited), brute_print(after)
        assert (got[d].fingerprint, got[d].edited_fingerprint) == (as_text(own), as_text(other))
        assert got[d].near_edited == pytest.approx(brute_likeness(own, other)) and got[d].near_next == pytest.approx(brute_likeness(own, following))


def brute_katz(train, vocabulary):
    """log10 probability of a text under a bigram model, by dictionaries."""
    tokens = [[*spaced(t), "</s>"] for t in train]
    counts = collections.Counter(w for t in tokens for w in t)
    total = sum(counts.values())
    factor = lambda of: np.append(katz.discounts(collections.Counter(of)), 1.0)
    d1 = factor(counts.values())
    taken = sum((1 - d1[min(c, 6)]) * c for c in counts.values() if c <= 6) / total
    unseen = max(taken, 1 / (total + 1))
    d1 = d1 * (1 - unseen) / (1 - taken)
    prob = {w: d1[min(c, 6)] * c / total for w, c in counts.items()}
    cut = sorted(counts.values(), reverse=True)[vocabulary - 1] if len(counts) > vocabulary else 0
    common = {w for w, c in counts.items() if c >= cut}
    assert not cut or len(common) == vocabulary, "choose a vocabulary at which no counts tie"
    name = lambda w: w if w in common else "<rare>"
    rest = 1 - sum(prob[w] for w in common)
    unigram = {w: prob[w] for w in common} | {"<rare>": rest}
    pairs = collections.Counter((v, w) for t in tokens for v, w in zip(["<s>", *map(name, t[:-1])], map(name, t), strict=True))
    of = collections.defaultdict(dict)
    for (v, w), c in pairs.items():
        of[v][w] = c
    d2 = factor(pairs.values())

    def given(v, w):
        after = of.get(v)
        if not after:
            return unigram[w]
        n = sum(after.values())
        left = sum((1 - d2[c]) * c for c in after.values() if c <= 5) / n
        scale, free = (1.0, 1 - sum(unigram[x] for x in after)) if left > 1e-12 else (n / (n + 1), 1 - sum(unigram[x] for x in after))
        left = left if left > 1e-12 else 1 / (n + 1)
        if free < 1e-12:
            scale, left, free = scale / (1 - left), 0.0, 1.0
        return d2[min(after[w], 6)] * after[w] / n * scale if w in after else left / free * unigram[w]

    def score(text):
        t = [*spaced(text), "</s>"]
        out = 0.0
        for v, w in zip(["<s>", *map(name, t[:-1])], t, strict=True):
            share = 1.0 if w in common else (prob[w] if w in counts else unseen) / rest
            out += math.log10(given(v, name(w)) * share)
        return out

    return score


@pytest.mark.parametrize("rows_a_batch", ["10000", "100000"])
def test_katz_scores(spark, rows_a_batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        rng = np.random.default_rng(3)
        words = [f"w{i}" for i in range(60)]
        chance = 1 / np.arange(1, 61) ** 1.1
        texts = [" ".join(rng.choice(words, int(rng.integers(0, 25)), p=chance / chance.sum())) for _ in range(400)]
        held = ["w1 w2 never seen w1", "", "w59 w58 w0 w0 w0"]
        counts = collections.Counter(w for t in texts for w in [*spaced(t), "</s>"])
        ranked = sorted(counts.values(), reverse=True)
        vocabulary = next(k for k in range(20, 50) if ranked[k - 1] > ranked[k])
        rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(held)] * 30000
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
        for size in (vocabulary, 10**4):
            score = brute_katz(texts, size)
            found = katz.scored(docs, lambda i: i >= 1000, size).groupBy("doc_id").agg(F.min("score").alias("a"), F.max("score").alias("b")).collect()
            assert len(found) == 403
            for r in found:
                assert r.a == pytest.approx(score(texts[r.doc_id] if r.doc_id < 1000 else held[r.doc_id - 1000]), abs=1e-6) and r.b == pytest.approx(r.a, abs=1e-6)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


@pytest.mark.parametrize("named", [0, 7, 60, None])
def test_katz_tells_all_words_apart(spark, named):
    """A word beyond those with short numbers is a context and a successor of its own."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    chance = 1 / np.arange(1, 401) ** 0.9
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 30)), p=chance / chance.sum())) for _ in range(300)]
    if named is None:  # as the query has it, with more words than that
        texts += [" ".join(f"x{i + j % 500}" for j in range(1000)) for i in range(0, 70_000, 500)]
    held = ["w1 w2 never seen w1", "", "w59 w58 w0 w0 w0", "x0 x5 x69999 w399 w398 new x3 x4", texts[3]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10**6 + i, t) for i, t in enumerate(held)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts, score = collections.Counter(w for t in texts for w in [*spaced(t), "</s>"]), brute_katz(texts, 10**9)
    n, types = sum(counts.values()), len(counts)
    assert named is not None or types > 65_000
    found = katz.scored(docs, lambda i: i >= 10**6, **({} if named is None else {"named": named})).collect()
    assert len(found) == len(rows)
    for r in found:
        t = texts[r.doc_id] if r.doc_id < 10**6 else held[r.doc_id - 10**6]
        assert r.score == pytest.approx(score(t), abs=1e-6)
        assert r.n_known == sum(counts[w] > 0 for w in [*spaced(t), "</s>"])
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (types + 1))) for w in [*spaced(t), "</s>"]))


def brute_grams(text):
    out = collections.Counter()
    for word in re.findall(r"[^\W\d_]+", text or ""):
        w = f"\0{''.join(c.lower() if len(c.lower()) == 1 else c for c in word)}\0"
        out.update(c for c in w if c != "\0")
        out.update(w[i : i + 2] for i in range(len(w) - 1))
        out.update(w[i : i + 3] for i in range(len(w) - 2) if len(w) > 3)
    return out


def code(g):
    c = [ord(x) for x in g]
    return c[0] if len(c) == 1 else (c[0] << 16 | c[1] | 1 << 47) if len(c) == 2 else c[0] << 32 | c[1] << 16 | c[2]


def test_languages_are_told_by_rank_order(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()][:80] + [(900, None, "en"), (901, "12 34", "fr")]
    ordered = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))]
    total = collections.defaultdict(collections.Counter)
    for _, t, lang in rows:
        if t is not None and lang is not None:
            total[lang].update(brute_grams(t))
    depth = 60
    profiles = {lang: {g: i for i, g in enumerate(ordered(c)[:depth])} for lang, c in total.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for r in langid.predict(langid.fit(docs, depth), docs).collect():
        own = ordered(brute_grams(r.text))[:depth]
        apart = {lang: sum(abs(p[g] - i) if g in p else depth for i, g in enumerate(own)) for lang, p in profiles.items()}
        want = min(sorted(apart), key=apart.get) if own else "und"
        assert r.lang_pred == want and r.score == pytest.approx(1 - apart[want] / (len(own) * depth) if own else 0.0)


def brute_template(text):
    """Words, and what stands for each in the template."""
    data, numbers, units, names = text.encode(), *(x.split() for x in (decontam.NUMBER_WORDS, decontam.UNIT_WORDS, decontam.NAME_WORDS))
    found = [(m.start(), m.end(), m.group().decode("utf-8", "replace")) for m in WORD.finditer(data)]
    low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for _, _, w in found]
    capital = ["A" <= w[0] <= "Z" for _, _, w in found]
    opens = [i == 0 or bool(re.search(rb"[\n\r!.:?]", data[found[i - 1][1] : found[i][0]])) for i in range(len(found))]
    out = []
    for i, w in enumerate(low):
        before = i > 0 and capital[i - 1] and not opens[i]
        after = i + 1 < len(low) and capital[i + 1]
        kind = "#" if w.isascii() and w.isdigit() or w in numbers else "%" if w in units else "@" if capital[i] and (not opens[i] and not (before and after) or w in names) else None
        out.append(kind or w)
    return low, out, [o in ("#", "%", "@") for o in out]


def brute_coverage(text, item, size=decontam.WINDOW):
    """Share of the item's windows that the text holds."""
    words, stands, slot = brute_template(text or "")
    own, own_stands, own_slot = brute_template(item)
    if not own:
        return 0.0
    n = min(len(own), size)
    windows = max(len(own) - size + 1, 1)
    telling = lambda slots, at, k: k < size and len(slots) == k or sum(not x for x in slots[at : at + k]) >= decontam.LEAST_PLAIN
    diagonals = collections.defaultdict(list)
    for at in range(windows):
        for place in range(len(words) - n + 1):
            exact = words[place : place + n] == own[at : at + n]
            short = len(own) < size and len(words) != len(own) and sum(not x for x in own_slot) < decontam.LEAST_PLAIN
            like = stands[place : place + n] == own_stands[at : at + n] and telling(own_slot, at, n) and not short
            if exact or like:
                pairs = [(own[at + i], words[place + i]) for i in range(n) if own_slot[at + i]]
                diagonals[place - at].append((at, exact, like, pairs))
    matched, plain = set(), set()
    for found in diagonals.values():
        seen = collections.defaultdict(set)
        for _, _, _, pairs in found:
            for a, b in pairs:
                seen[a].add(b)
        for at, exact, _, pairs in found:
            if exact or all(len(seen[a]) == 1 for a, _ in pairs):
                matched.add(at)
                if telling(own_slot, at, n):
                    plain.add(at)
    n_plain = 1 if len(own) < size else sum(telling(own_slot, at, n) for at in range(windows))
    return max(len(matched) / windows, len(plain) / n_plain if n_plain else 0.0)


def test_decontamination_by_templates(spark):
    rng = np.random.default_rng(11)
    items = [
        "Yesterday Tom bought 12 apples and 7 pears for 30 dollars at the market, then Tom gave 12 apples away.",
        "A train leaves at 9 and travels 80 km in the first hour and 60 km in the second hour. How far is it?",
        "Compute 12 + 35 + 7 + 9 + 11", "Solve this one by hand", "The quick brown fox jumps over the lazy dog near the old river bank",
    ]
    names, texts = ["Anna", "Paul", "Quentin"], ["", None, "nothing of the kind at all here"]
    for k in range(60):
        words = str(items[k % len(items)]).split()
        for i, w in enumerate(words):
            if w.strip(".,?").isdigit() and rng.random() < 0.7:
                words[i] = w.replace(w.strip(".,?"), str(int(w.strip(".,?")) * 3 + int(rng.integers(2))))
            elif w == "Tom" and k % 3:
                words[i] = names[k % 3]
        lo, hi = (0, len(words)) if k % 2 else sorted(rng.integers(0, len(words) + 1, 2))
        texts.append(f"before that, {' '.join(words[lo:hi])} and after it came more of the text")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()}
    for d, t in enumerate(texts):
        shares = [brute_coverage(t, x) for x in items]
        assert got[d].coverage == pytest.approx(max(shares)) and got[d].contaminated == (max(shares) >= decontam.COVERAGE), (t, shares)
        assert got[d].n_items == sum(x >= decontam.COVERAGE for x in shares)


def brute_pack(lengths, capacity):
    """Sequences (sorted lengths), one piece after the other."""
    left = sorted(lengths, reverse=True)
    out = []
    while left:
        used, room = [], capacity
        for x in list(left):
            if x <= room:
                used.append(x)
                left.remove(x)
                room -= x
        if room and len(used) > 1:
            smallest, gap = used[-1], room + used[-1]
            best = (0,)
            for i, a in enumerate(left):
                b = next((x for j, x in enumerate(left) if j != i and a + x <= gap and x <= a), None)
                if b is not None:
                    best = max(best, (a + b, a, b))
            if best[0] > smallest:
                used[-1:] = best[1:]
                for x in best[1:]:
                    left.remove(x)
                left.append(smallest)
                left.sort(reverse=True)
        out.append(tuple(sorted(used, reverse=True)))
    return sorted(out)


def test_packing_is_best_two_fit():
    rng = np.random.default_rng(2)
    for capacity, n in ((50, 120), (31, 200), (100, 60)):
        lengths = rng.integers(1, capacity + 1, n).tolist()
        made = packing.best_two_fit(collections.Counter(lengths), capacity)
        got = sorted(tuple(sorted((x for x, k in sizes for _ in range(k)), reverse=True)) for times, sizes in made for _ in range(times))
        assert got == brute_pack(lengths, capacity)


def test_pipeline_equals_plain_python(spark, tmp_path):
    """Every stage must take something out, and no stage anything else."""
    import corpus_pipeline

    rng = np.random.default_rng(6)
    fresh = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnoprstuv"), int(rng.integers(2, 9)))) for _ in range(n))
    base, passage, item = fresh(80), fresh(70), "What is the sum of all the odd numbers between one place and another in this list of things?"
    near = " ".join("zz" if i == 40 else w for i, w in enumerate(base.split()))
    rows = [(1, base, "en"), (2, near, "en"), (3, base, None), (4, fresh(60), "de"), (5, None, "en"), (6, "123 456", "en"), (7, "", None)]
    rows += [(8, f"{fresh(30)} {passage} {fresh(30)}", "en"), (9, f"{fresh(30)} {passage} {fresh(40)}", "en"), (10, f"{fresh(40)} {item} {fresh(30)}", "en"), (11, fresh(3000), "de"), (12, passage, "en"), (13, "ab", "de"), (13, fresh(20), "de"), (None, base, "en")]
    rows += [(20 + i, fresh(int(rng.integers(5, 400))), "en") for i in range(20)]
    full = [(d, t, lang, "s", len(t or ""), "own", i) for i, (d, t, lang) in enumerate(rows)]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, th string, gone_id int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = [(d, t) for d, t, _ in rows if re.search(r"[^\W\d_]", t or "")]
    assert len(kept) == len(rows) - 3
    key = lambda i: (kept[i][0] is None, kept[i][0] or 0, signed(hash64(kept[i][1].encode())))
    order = sorted(range(len(kept)), key=key)
    groups = brute_groups([(n, kept[i][1]) for n, i in enumerate(order)], 5)
    kept = [kept[i] for n, i in enumerate(order) if groups[n][2]]
    assert {d for d, _ in kept} == {d for d, t, _ in rows if d not in (2, 3, 5, 6, 7, None)}
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is not None, kept[i][0] or 0, signed(hash64(kept[i][1].encode()))))
    texts = cut_texts([kept[i] for i in first], 100)
    kept = [(d, t) for d, t in texts if t]
    assert 12 not in {d for d, _ in kept} and all(passage[:200] not in t for d, t in kept if d != 8)
    kept = [(d, t) for d, t in kept if brute_coverage(t, item) < decontam.COVERAGE]
    assert 10 not in {d for d, _ in kept}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for (d, _), e in zip(kept, t.encode_batch([x for _, x in kept], add_special_tokens=False), strict=True):
        ids = [*e.ids, 0]
        cut = [len(ids) % 2048 or 2048, *[2048] * ((len(ids) - 1) // 2048)]
        at = 0
        for k, n in enumerate(cut):
            want.append((d, k, at, n, crc(ids[at : at + n])))
            at += n
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(tuple(sorted((n for _, n in s), reverse=True)) for s in sequences.values()) == brute_pack([w[3] for w in want], 2048)
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "th", "gone_id"]
    none = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def cut_texts(rows, length):
    """Texts without what an earlier text, or an earlier place, holds."""
    seen, out = set(), []
    for d, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(b[s : s + length])
        out.append((d, bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")))
    assert brute_repeats(rows, length)
    return out


def test_very_long_texts_and_empty_tables(spark, tmp_path):
    rng = np.random.default_rng(9)
    long = " ".join(f"word{x}" for x in rng.integers(0, 10**6, 160_000))  # 1.6 MB
    rows = [(1, long, "en", "<p>" + long), (2, long + " end", "en", long), (3, "short one", "en", "x"), (4, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, html string")
    bench = spark.createDataFrame([(1, " ".join(long.split()[1000:1020]))], "item_id long, text string")
    path, byte = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    token_records.write_token_records(docs, str(tmp_path / "t"), path, 2)
    assert {r.doc_id: r.n_tokens > 160_000 for r in token_records.read_token_records(spark, str(tmp_path / "t")).collect()} == {1: True, 2: True, 3: False, 4: False}
    assert {r.doc_id: r.n_words for r in licenses.scan(docs).collect()} == {1: 160_000, 2: 160_001, 3: 2, 4: 0}
    assert {r.doc_id: r.n_bytes - r.n_removed for r in repeats.without_repeats(docs).collect()} == {1: len(long), 2: 4, 3: 9, 4: 0}
    warc.write_warc(docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), "html"), str(tmp_path / "w"))
    assert {r.page_id: r.payload_bytes for r in warc.page_records(warc.read_warc(spark, str(tmp_path / "w"))).collect()} == {1: len(long) + 3, 2: len(long), 3: 1, 4: 0}
    assert {r.doc_id: r.component_id for r in near_dup.groups(docs, size=2).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.doc_id: r.n_chars for r in fingerprints.fingerprints(docs).collect()} == {1: len(long), 2: len(long) + 4, 3: 9, 4: 0}
    assert {r.doc_id: r.n_tokens for r in katz.scored(docs, lambda i: i > 2).collect()} == {1: 160_001, 2: 160_002, 3: 3, 4: 1}
    assert {r.doc_id for r in langid.predict(langid.fit(docs), docs).where("lang_pred = 'en'").collect()} == {1, 2, 3}
    assert {r.doc_id for r in decontam.contaminated(docs, bench).where("contaminated").collect()} == {1, 2}
    assert packing.pack_documents(docs, byte, 0, 2048).agg(F.sum("length")).first()[0] > 320_000
    none = docs.limit(0)
    assert decontam.contaminated(none, bench).count() == 0 and packing.pack_documents(none, byte, 0, 2048).count() == 0
    assert decontam.contaminated(docs, bench.limit(0)).where("contaminated").count() == 0

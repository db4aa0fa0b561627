"""The ten operators against brute force on small tables, with gaps, empty and repeated rows, and columns with clashing names."""

import collections
import hashlib
import math
import os
import re
import time
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import decontam, fingerprints, katz, langid, licenses, near_dup, packing, repeats, token_records, warc
from tidemark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
ODD = "doc_id long, text string, lang string, pos string, h string, part int"
LONG = "The quick brown fox jumps over the lazy dog near the river bank and runs away from all the noise. " * 3


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "en", "x", "y", 1), (2, "", None, None, None, None), (3, "a", "en", "x", "y", 2), (None, LONG, "en", "x", "y", 3), (4, LONG, "en", "x", "y", 4), (4, LONG, "en", "x", "y", 4), (5, LONG.upper(), "de", "x", "y", 5), (5, " \t\n", "de", "x", "y", 5)]
    return spark.createDataFrame(rows, ODD)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def spaced(t):
    return [x for x in re.split(r"[\x20\x09-\x0d]+", low(t)) if x]


def by_id(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, DATA).collect()}


def ids_of(path, texts, end):
    t = Tokenizer.from_file(public_tokenizers.path(path))
    return [e.ids + [end] for e in t.encode_batch(texts, add_special_tokens=False)]


def thue_morse(n):
    """Two strings of a and b, one the other's complement, on which polynomial hashes modulo a power of two meet."""
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


SPECIAL = ["say <|endoftext|> now", "<|startoftext|><|endoftext|>x <|endoftext|>", *thue_morse(2048), "a b " + " ".join(thue_morse(2048)) + " c", "", " ", "x <|endoftext|", "|>"]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_records(spark, docs, odd, tmp_path):
    got, start = by_id(spark, "op1_token_records"), 0
    for d, ids in zip(sorted(docs), ids_of("word_bpe_49k.json", [docs[d] for d in sorted(docs)], 2), strict=True):
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    path = str(tmp_path / "odd")
    token_records.write_token_records(odd, path, public_tokenizers.path("word_bpe_49k.json"), 2)
    kept = token_records.read_token_records(spark, path, True).collect()
    assert len(kept) == 8 and [r.doc_id for r in sorted(kept, key=lambda r: r.start)] == [None, 1, 2, 3, 4, 4, 5, 5]
    assert token_records.shuffled_records(spark, path, 1).count() == 8
    token_records.write_token_records(odd.limit(0), path + "0", public_tokenizers.path("word_bpe_49k.json"), 2)
    assert token_records.read_token_records(spark, path + "0").count() == 0


@pytest.mark.parametrize("path", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_special_strings_and_of_texts_with_one_weak_hash(spark, path):
    rows = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    got = packing.token_pieces(rows.coalesce(1), public_tokenizers.path(path), 0, 1 << 20).collect()
    assert {r.doc_id: r.ids_crc32 for r in got} == {k: crc(ids) for k, ids in enumerate(ids_of(path, SPECIAL, 0))}


def test_pieces_with_one_hash_keep_their_own_ids(monkeypatch):
    import pyarrow as pa

    from tidemark.llm import spans, tokens

    monkeypatch.setattr(tokens, "piece_keys", lambda low, high, size: np.full(len(low), 7, np.uint64))
    texts = ["all of the pieces meet", "under one hash", "all of them", "and averyveryverylongpiece1 and averyveryverylongpiece2"]
    made = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(2):
        for _, _, block in spans.blocks(pa.array(texts)):
            ids, offsets = made.encode(block)
            assert [ids[a:b].tolist() + [0] for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == ids_of("byte_bpe_50k.json", texts, 0)


def test_license_scan(spark, docs, odd):
    got = by_id(spark, "op2_license_scan")
    for d, t in docs.items():
        w, places, labels = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
    mit = licenses.NOTICES["mit"].replace("free of charge", "entirely free of charge")
    one = licenses.scan(spark.createDataFrame([(1, mit, "x"), (1, mit, "x"), (2, None, "y")], "doc_id long, text string, label string")).collect()
    assert sorted((r.doc_id, r.labels, r.score > 0.9) for r in one) == [(1, "mit", True), (1, "mit", True), (2, "", False)]
    assert licenses.scan(odd).count() == 8 and licenses.scan(odd.limit(0)).count() == 0


def longest_rising(hits):
    best = {}
    for pos, at in sorted(hits):
        best[pos, at] = 1 + max((n for (p, a), n in best.items() if p < pos and a < at), default=0)
    return max(best.values(), default=0)


def test_license_notices_are_verified_in_order(spark):
    w = licenses.NOTICES["mit"].split()
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
    texts = [" ".join(reversed(grams)), " ".join(w), " ".join(x + (" extra" if i % 12 == 5 else "") for i, x in enumerate(w)), " ".join(w[:10] + w[40:] + w[10:40]), "x y " + " ".join(w) + " z " + " ".join(w), " ".join(w[:20])]
    texts += [" ".join(licenses.NOTICES[a].split()[:k] + licenses.NOTICES[b].split()[k:]) for a, b, k in (("gpl", "lgpl", 9), ("isc", "mit", 5), ("bsd", "mpl", 30))]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for d, t in enumerate(texts):
        words, labels = t.split(), set()
        phrases = {label for phrase, label in licenses.PHRASES.items() if f" {phrase} " in f" {t} "}
        for label, notice in licenses.NOTICES.items():
            n = notice.split()
            hits = [(p, a) for p in range(len(words) - 3) for a in range(len(n) - 3) if words[p : p + 4] == n[a : a + 4]]
            share = max((longest_rising([(p, a) for p, a in hits if 0 <= p - a - d0 <= licenses.DRIFT]) for d0 in {p - a for p, a in hits}), default=0) / (len(n) - 3)
            labels |= {label} if share >= licenses.SHARE else set()
        assert got[d].labels == ",".join(sorted(labels | phrases))
    assert got[0].labels == "" and got[1].score == 1 and [(x.first, x.last) for x in got[4].notices] == [(2, len(w) + 1), (len(w) + 3, 2 * len(w) + 2)]


def test_license_names_are_whole(spark):
    texts = {
        "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by", "under the Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
        "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License": "cc-by-nc-nd", "CC BY-NC-SA 4.0": "cc-by-nc-sa", "CC-BY-NC 4.0": "cc-by-nc", "CC BY 3.0, CC BY-SA 2.5": "cc-by,cc-by-sa",
        "Creative Commons Attribution Non-Commercial Share Alike 3.0 Unported": "cc-by-nc-sa", "CC BY": "", "Creative Commons Attribution": "", "licensed under a Creative Commons license 4.0 International License": "", "CC BY x 4.0": "",
    }
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        assert (got[d].labels, got[d].score, got[d].base_labels, got[d].n_base) == (texts[t], float(texts[t] != ""), "", 0), t
    assert [tuple(x) for x in got[5].notices] == [("cc-by", 0, 3), ("cc-by-sa", 4, 8)]
    for d, t in rows:  # against the words themselves
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        want = {(label, i, i + len(n.split()) - 1) for n, label in licenses.NAMES.items() for i in range(len(words)) if words[i : i + len(n.split())] == n.split()}
        assert {tuple(x) for x in got[d].notices} == want


def brute_repeats(rows, length):
    seen, out = set(), {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), len(b) - len(kept), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(spark, docs, odd):
    got = {d: tuple(r)[1:] for d, r in by_id(spark, "op3_repeats").items()}
    assert got == brute_repeats(sorted(docs.items()), 100)
    found = repeats.without_repeats(odd).collect()
    assert len(found) == 8 and repeats.without_repeats(odd.limit(0)).count() == 0
    assert {r.n_removed for r in found if r.doc_id is None} == {len(LONG) - len(LONG) // 3}
    cut = repeats.cut_documents(odd)
    assert cut.columns == odd.columns and cut.count() == 8


def test_repeats_of_rows_that_repeat(spark):
    rng = np.random.default_rng(5)
    alone, shared, early = (" ".join(f"w{x}" for x in rng.integers(0, 99999, 60)) for _ in range(3))
    rows = [(None, shared), (None, shared), (2, early), (7, alone), (7, alone), (8, early), (8, early), (8, alone + "x"), (9, alone * 2)]
    rows += [(None, f"{k} " + " ".join(f"v{x}" for x in rng.integers(0, 10**9, 25))) for k in range(3000)]
    found = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), with_text=True).collect()
    texts = collections.defaultdict(list)
    for r in found:
        texts[r.doc_id].append(r.kept)
    assert sorted(texts.pop(None)) == sorted(t for d, t in rows if d is None)
    assert {d: sorted(t) for d, t in texts.items()} == {2: [early], 7: [alone, alone], 8: ["", "", "x"], 9: [""]}


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(3, "u", "x" * 200, 1), (1, None, "x" * 200, 1), (2, "a\nb", "x" * 99, 2), (5, "c", "x" * 99, 2), (4, "d", None, 3), (None, "e", "x" * 200, 4)], "page_id long, url string, html string, payload int")
    warc.write_warc(pages, str(tmp_path / "w"))
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.page_records(warc.read_warc(spark, str(tmp_path / "w"))).collect()}
    assert got == {1: (200, "response", None), 3: (200, "revisit", 1), 2: (99, "response", None), 5: (99, "response", None), 4: (0, "response", None), None: (200, "response", None)}
    assert warc.read_warc(spark, str(tmp_path / "w"), splitBytes="64").where("record_type = 'revisit'").count() == 1
    warc.write_warc(pages.limit(0), str(tmp_path / "none"))
    assert warc.page_records(warc.read_warc(spark, str(tmp_path / "none"))).count() == 0


def brute_groups(rows, size=2):
    sets, parent, index = {}, {}, collections.defaultdict(list)
    for d, t in rows:
        w = spaced(t or "")
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
        parent[d] = d

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d in sorted(sets):
        both = collections.Counter()
        for s in sets[d]:
            both.update(index[s])
            index[s].append(d)
        for e, k in both.items():
            if 100 * k >= 80 * (len(sets[d]) + len(sets[e]) - k):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


def test_near_duplicates(spark, docs, odd):
    got = {d: tuple(r)[1:] for d, r in by_id(spark, "op5_near_duplicates").items()}
    assert got == brute_groups(docs.items())
    found = sorted(near_dup.groups(odd, size=2).collect(), key=str)
    assert len(found) == 8 and near_dup.groups(odd.limit(0), size=2).count() == 0
    assert {r.component_id for r in found if r.doc_id == 5} == {4, 5}


def test_large_groups_of_near_copies(spark):
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 3000, 150)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(int(rng.integers(1, 7))):
            w[int(rng.integers(150))] = f"q{rng.integers(9999)}"
        rows.append((2 * i + 1, " ".join(w)))
    rows += [(2 * i, " ".join(base[:90] + [f"z{x}" for x in rng.integers(0, 9999, int(rng.integers(20, 90)))])) for i in range(80)]
    got = {r.doc_id: tuple(r)[1:] for r in near_dup.groups(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()}
    assert got == brute_groups(rows)


def test_rows_and_not_ids_are_dropped(spark):
    far = " ".join(f"v{i}" for i in range(60))
    rows = [(4, LONG, "a", 1), (5, LONG, "b", 2), (5, far, "c", 3), (None, LONG, "d", 4), (None, far + " x", "e", 5), (None, "alone", "f", 6), (7, "", "g", 7), (8, None, "h", 8), (5, far, "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th string, gone_id int")
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.th for r in kept.collect()) == ["a", "c", "c", "f", "g", "h"]
    bench = spark.createDataFrame([(1, LONG[:98])], "item_id long, text string")
    assert sorted(r.th for r in decontam.drop_contaminated(docs, bench).collect()) == ["c", "c", "e", "f", "g", "h"]


def test_unlike_words_with_one_weak_hash_are_not_linked(spark):
    a, b = thue_morse(2048)
    found = near_dup.groups(spark.createDataFrame([(1, a), (2, b), (3, f"{a} {b}"), (4, f"{b} {a}")], "doc_id long, text string"), size=2).collect()
    assert all(r.kept for r in found)


@pytest.mark.parametrize("block", [near_dup.BLOCK_SHINGLES, 3000])
def test_edits_of_edits_of_a_hot_text(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", block)
    rng = np.random.default_rng(3)
    fresh = iter(range(10**6))

    def edited(words, at):
        return [f"q{next(fresh)}" if i in at else w for i, w in enumerate(words)]

    base, rows = [f"w{x}" for x in rng.integers(0, 3000, 150)], []
    rows.append((0, " ".join(base)))
    for i in range(500):
        light = edited(base, set(range(i % 146, i % 146 + 4)))
        rows.append((1000 + i, " ".join(light)))
        if i % 4 == 0:  # like its parent, not like the hot text
            at = 10 + i % 50 if i % 146 > 75 else 80 + i % 50
            rows.append((2000 + i, " ".join(edited(light, set(range(at, at + 15))))))
    got = {r.doc_id: tuple(r)[1:] for r in near_dup.groups(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()}
    assert got == brute_groups(rows)


def test_joining_finds_what_pairs_join():
    rng = np.random.default_rng(2)
    sets = [np.sort(rng.choice(40, int(rng.integers(1, 12)), False)).astype(np.uint64) for _ in range(200)]
    like = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))

    def parts(links):
        label = list(range(len(sets)))
        for a, b in links:
            label = [label[b] if x == label[a] else x for x in label]
        return {frozenset(i for i, x in enumerate(label) if x == y) for y in label}

    every, half = np.arange(200), np.arange(100)
    found = near_dup.joining(sets, every, every, np.arange(200), 80)
    assert all(like(sets[a], sets[b]) for a, b in found) and parts(found) == parts((a, b) for a in every for b in every if like(sets[a], sets[b]))
    found = near_dup.joining(sets, half, half + 100, np.arange(200), 80)
    assert parts(found) == parts((a, b) for a in half for b in half + 100 if like(sets[a], sets[b]))


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sigs = near_dup.superminhash(np.concatenate((np.sort(keys[:200]), np.sort(keys[50:250]))), np.array([0, 200, 400]), 256)
    assert abs(np.mean(sigs[0] == sigs[1]) - 150 / 250) < 0.12


def test_fingerprints(spark, docs, odd):
    got, order = by_id(spark, "op6_fingerprints"), sorted(docs, reverse=True)
    for k, d in enumerate(order):
        t, after = docs[d], docs[order[(k + 1) % len(order)]]
        half = len(t) // 2
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())
    assert sum(r.near_edited for r in got.values()) > 20 * sum(r.near_next for r in got.values())
    prints = collections.defaultdict(set)
    for d, t in docs.items():
        prints[t].add(got[d].fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert fingerprints.fingerprints(odd).count() == 8 and fingerprints.fingerprints(odd.limit(0)).count() == 0


def test_katz(spark, docs, odd):
    got, counts = by_id(spark, "op7_katz"), collections.Counter()
    tokens = lambda t: [*spaced(t), None]
    for d, t in docs.items():
        if zlib.crc32(str(d).encode()) % 10:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    for d, t in docs.items():
        w, r = tokens(t), got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert katz.scored(odd, lambda i: katz.remainder(i, 10) == 0, 50).count() == 8
    assert katz.scored(odd.limit(0), lambda i: katz.remainder(i, 10) == 0).count() == 0


def test_katz_sums_to_one(spark):
    rows = [(i, " ".join(f"w{(i * j * j) % 23}" for j in range(1, 40))) for i in range(40)]
    m = katz.fit(spark.createDataFrame(rows, "doc_id long, text string"), 12)
    seen = collections.defaultdict(dict)
    for r in m.table.where("kind = 0").collect():
        for v, w, c in zip(*katz._unzip(r.payload, "<i4", "<i4", "<i8"), strict=True):
            seen[v][w] = c
    ids = range(len(m.unigram) - 1)
    assert sum(m.unigram) == pytest.approx(1)
    for v, after in seen.items():
        total = 0.0
        for w in ids:
            c = after.get(w, 0)
            total += m.pair_discount[min(c, katz.DISCOUNTED + 1)] * c / m.context[v] * m.scale[v] if c else m.backoff[v] * m.unigram[w]
        assert total == pytest.approx(1)


def shuffle_files(spark):
    return set(Path(spark.sparkContext.getConf().get("spark.local.dir")).rglob("shuffle_*.data"))


def test_katz_frees_the_shuffles_of_its_fit(spark, docs):
    """What learning dealt out is gone, before the collector runs, when scoring deals out as much again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffle_files(spark), spark.conf.get(key, None)
    m = katz.fit(spark.read.parquet(f"{DATA}/documents.parquet"))
    until = time.time() + 10  # executors delete files a little later
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.1)
    assert not left and spark.conf.get(key, None) == setting
    assert katz.score(m, spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.lit(False).alias("held_out"), "text")).count() == len(docs)


@pytest.mark.parametrize("kind", sorted(katz._FORMS))
def test_katz_packs_bigrams(kind):
    """A bigram takes little more than what tells it from the others of its message, and comes back as it was."""
    rng = np.random.default_rng(kind)
    n, hashes = 20_000, rng.integers(1 << 63, 2**64 - 1, 4000, dtype=np.uint64)
    v, w = (((rng.pareto(1, n) * 20) % 4000).astype(int) for _ in range(2))
    v, w = (x.astype("<i4") if form == "<i4" else hashes[x] for x, form in zip((v, w), katz._FORMS[kind], strict=True))
    by = np.lexsort((v, w) if kind in (katz._TO_OTHER, katz._OTHERS) else (w, v))
    columns = v[by], w[by], rng.integers(0, 2600, n).astype("<i4"), np.minimum(rng.geometric(0.9, n), 9).astype("<i4")
    sent = katz._zip_pairs(kind, *columns)
    for got, want in zip(katz._unzip_pairs(kind, sent, "<i4", "<i4"), columns, strict=True):
        assert got.dtype == want.dtype and (got == want).all()
    plain = len(pa.compress(b"".join(x.tobytes() for x in columns), codec="zstd", asbytes=True))
    assert len(sent) < 0.85 * plain


def test_language(spark, docs, odd):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    held = [r.lang_pred == truth[d] for d, r in by_id(spark, "op8_language").items() if r.held_out]
    assert sum(held) >= 0.97 * len(held)
    judged = langid.predict(langid.fit(odd), odd).collect()
    assert [r.lang_pred for r in judged if not r.text or not r.text.strip()] == ["und"] * 3 and len(judged) == 8
    assert langid.predict(langid.fit(odd.limit(0)), odd).where("lang_pred <> 'und'").count() == 0
    clash = odd.withColumnsRenamed({"pos": "score", "h": "lang_pred"})
    assert [r.score for r in langid.predict(langid.fit(odd), clash).where("doc_id = 2").collect()] == [0.0]
    assert langid.keep_identified(clash, odd).columns == clash.columns


def test_decontamination(spark, docs):
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = by_id(spark, "op9_decontaminate")
    assert all(got[d].contaminated == any(x in t for x in items) for d, t in docs.items())
    bench = spark.createDataFrame([(7, "Yesterday Tom bought 12 apples and 7 pears for 30 dollars at the market, then Tom gave 12 apples away.", "x"), (8, None, "y"), (9, "", "z")], "item_id long, text string, place string")
    other = "Before that, Yesterday Anna bought 15 apples and 9 pears for 44 euros at the market, then Anna gave 15 apples away."
    wrong = "Yesterday Anna bought 15 apples and 9 pears for 44 euros at the market, then Paul gave 18 apples away."
    rows = [(1, other, 0), (1, other, 0), (2, wrong, 0), (3, None, 0), (None, other, 0), (4, "nothing of the kind", 0)]
    found = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string, place int"), bench)
    assert sorted((r.doc_id or 0, r.contaminated) for r in found.collect()) == [(0, True), (1, True), (1, True), (2, False), (3, False), (4, False)]


def test_decontamination_of_short_and_number_heavy_items(spark):
    items = ["What is 12 + 35?", "Compute 12 + 35 + 7 + 9 + 11", "Tom has 5 apples and 5 oranges in the old basket that stands under the big table by the door of the barn", "Solve this one by hand"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    reset = items[2].replace("5 apples", "7 apples").replace("5 oranges", "9 oranges")
    texts = [f"they say, {items[0]} and so on and on", f"a list, {items[1]}; and so on", reset, f"he said, {items[3]}", "Compute 1 + 2 + 3 + 4 + 5", "what is it and why is it so", None]
    found = decontam.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()
    assert {r.doc_id: r.item_id if r.contaminated else None for r in found} == {0: 0, 1: 1, 2: 2, 3: 3, 4: None, 5: None, 6: None}


def test_packing(spark, docs, odd):
    rows = collections.defaultdict(list)
    places = collections.defaultdict(list)
    for r in QUERIES["op10_best_two_fit"](spark, DATA).collect():
        rows[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for d, ids in zip(docs, ids_of("byte_bpe_50k.json", list(docs.values()), 0), strict=True):
        at = 0
        for r in sorted(rows[d], key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(length for p in places.values() for _, length in p)
    assert len(places) <= 1.02 * total / 2048 + 1
    assert packing.pack_documents(odd, public_tokenizers.path("byte_bpe_50k.json"), 0, 2048).count() == 8


def test_pipeline_keeps_clean_documents(spark, docs):
    import corpus_pipeline

    whole = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = whole
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, DATA).collect(), whole.schema)
        assert kept.columns == whole.columns
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    groups = brute_groups(docs.items(), 5)
    one = {d for d, g in groups.items() if g[2]}
    assert {r.doc_id for r in kept.select("doc_id").collect()} >= {d for d in one if len(docs[d]) > 200 and not any(x in docs[d] for x in items) and len(set(docs[d].split())) > 30} - {d for d, r in brute_repeats(sorted((d, docs[d]) for d in one), 100).items() if r[1] == r[0]}
    assert corpus_pipeline.run(spark, DATA).agg(F.countDistinct("doc_id")).first()[0] == kept.select("doc_id").distinct().count()

"""Vector codes, line dedup and the filter audit, against plain Python and DuckDB."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import filter_audit, line_dedup, vector_codes
from tidemark.llm.queries import ORACLE_SQL, QUERIES
from tidemark.llm.shared import matched, written

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_line_dedup", "op13_filter_audit"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, cur = QUERIES[name](spark, DATA), con.execute(ORACLE_SQL[name])
    names = sorted(df.columns)
    assert sorted(d[0] for d in cur.description) == names
    at = [[d[0] for d in cur.description].index(c) for c in names]
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in cur.fetchall())


def test_matched_broadcasts_hot_keys_and_deals_the_others(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, None).otherwise(F.col("id") % 5001).alias("k"))
    table = written(rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("k is null or k < 4000"), "tops")
    told = {r["k"]: r["top"] for r in table.collect()}
    assert table.where("n * 1024 > 20000").count() == 1
    inner = {r["id"]: r["top"] for r in matched(rows, table, ["k"], "n").collect()}
    left = {r["id"]: r["top"] for r in matched(rows, table, ["k"], "n", "left").collect()}
    every = {r["id"]: r["k"] for r in rows.collect()}
    assert inner == {i: told[k] for i, k in every.items() if k in told}
    assert left == {i: told.get(k) for i, k in every.items()}


# -- vector codes


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    sizes = Counter(len(v) for _, v, _ in kept)
    size = min((s for s in sizes), key=lambda s: (-sizes[s], s), default=parts)
    kept = [r for r in kept if len(r[1]) == size]
    width = size // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * width : (p + 1) * width] for _, v, _ in first] for p in range(parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, row, strict=True)), k) for k, row in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            met = defaultdict(list)
            for _, v, _ in kept:
                part = v[p * width : (p + 1) * width]
                met[near(part, books[p])[1]].append(part)
            for k, some in met.items():
                books[p][k] = [sum(c) // len(some) for c in zip(*some, strict=True)]
    out = []
    for i, v, label in kept:
        told = [near(v[p * width : (p + 1) * width], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in told), sum(d for d, _ in told), label))
    by = defaultdict(int)
    for _, _, error, label in out:
        by[label] += error
    sha = hashlib.sha256(",".join(str(x) for book in books for row in book for x in row).encode()).hexdigest()
    return sorted(((i, code, error, min(by[label], 2**63 - 1), sha) for i, code, error, label in out), key=repr)


def told_codes(spark, rows, parts=4, entries=3, rounds=2):
    df = spark.createDataFrame(rows, "row int, pos string, vec_id bigint, entry int, embedding array<float>, label int")
    coded = vector_codes.encode(df, "embedding", "vec_id", "label", parts, entries, rounds)
    found = vector_codes.label_errors(coded).withColumn("sha", F.lit(coded.sha256()))
    return sorted((tuple(r[c] for c in ("id", "code", "error", "label_error", "sha")) for r in found.collect()), key=repr)


def test_codes_of_odd_rows(spark):
    base = [0.5, -0.25, 0.125, 1.0, -0.001, 0.0, 0.3, -0.3]
    rows = [(i, [x + i % 7 / 10 for x in base], i % 3 if i % 4 else None) for i in range(40)]
    rows += [(3, base, 1), (3, base, 1), (None, base, None), (50, None, 1), (51, [], 1), (52, [float("nan")] * 8, 1), (53, [None] + base[1:], 2), (54, [float("inf")] + base[1:], 2), (55, base[:7], 1), (56, base[:4], 1)]
    rows += [(100 + i, [0.25] * 8, 9) for i in range(60)]  # a hot vector
    want = plain_codes([(i, v and [None if x is None else float(__import__("numpy").float32(x)) for x in v], label) for i, v, label in rows], 4, 3, 2)
    assert told_codes(spark, [(0, "x", i, 0, v, label) for i, v, label in rows]) == want


def test_codes_with_few_rows_ties_and_large_numbers(spark):
    rows = [(1, [1e6, 0.0, 0.0, 0.0], 1), (2, [-1e5, 2e5, 0.0, 0.0], 1), (3, [3e38, -3e38, 1.0, 1.0], 2)]
    told = told_codes(spark, [(0, "x", i, 0, v, label) for i, v, label in rows], parts=2, entries=8)
    assert [r[1] for r in told] == ["0000", "0100", "0202"] and [r[2] for r in told] == [0, 0, 0]
    two = [(1, [0.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1)]  # the third is as near to either
    assert told_codes(spark, [(0, "x", i, 0, v, label) for i, v, label in two], parts=2, entries=2, rounds=0)[2][1] == "0000"
    assert told_codes(spark, []) == []


def test_nearest_is_exact_for_any_size():
    import numpy as np

    rng = np.random.default_rng(5)
    for top in (1 << 10, 1 << 26):
        x, book = rng.integers(-top, top, (200, 4)), rng.integers(-top, top, (17, 4))
        entry, distance = vector_codes.nearest(x, book)
        d = ((x[:, None, :].astype(object) - book[None].astype(object)) ** 2).sum(2)
        assert (entry == d.argmin(1)).all() and (distance == d.min(1)).all()


# -- lines


def plain_lines(rows, least=20, documents=3):
    key = lambda line: re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    below = lambda i: (i is not None, i or 0)
    met = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                met[key(line)].add(below(i))
    gone = {k: max(v) for k, v in met.items() if len(v) >= documents}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (key(x) in gone and below(i) < gone[key(x)])]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


LONG = "A line that Many documents hold"
ROWS = [
    (1, f"first\n  {LONG}\t\nonly here and nowhere else, first"), (2, f"{LONG.upper()}\n{LONG}\nend\n"), (3, f"{LONG}"), (4, f"\n\n{LONG}\r\nx"), (5, None), (6, ""),
    (7, "\n"), (7, f"{LONG}\nother text of one doc_id"), (7, f"{LONG}\nother text of one doc_id"), (None, f"{LONG}\nno id"), (None, "no id two documents say this\n"),
    (8, "no id two documents say this"), (9, "exactly twenty chars"), (10, "exactly twenty chars"), (11, "EXACTLY TWENTY CHARS"), (12, "only nineteen chars"), (13, "only nineteen chars"),
    (14, "only nineteen chars"), (15, "ÄÖÜ straße zwölf Boxkämpfer"), (16, "ÄÖÜ straße zwölf Boxkämpfer"), (17, "äöü straße zwölf Boxkämpfer"), (18, "z" * 200_000 + "\n" + "\n".join([LONG] * 500)),
]


@pytest.mark.parametrize("broadcast_mb", [256, -1])
def test_lines_like_plain_python(spark, broadcast_mb):
    rows = ROWS + [(100 + i, f"{LONG}\nthe same foot line below every page\nnumber {i} of these lines is its own") for i in range(200)]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id bigint, text string, key string, place int").repartition(7)
    found = line_dedup.without_shared_lines(df, broadcast_mb=broadcast_mb)
    assert sorted((tuple(r) for r in found.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr) == plain_lines(rows)


def test_lines_of_an_empty_table(spark):
    assert line_dedup.without_shared_lines(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_filters_know_every_repeated_hash(spark):
    rows = [([i % 70_000 * 2_654_435_761_987 % 2**62],) for i in range(100_000)]
    filters = line_dedup.twice_seen(spark.createDataFrame(rows, "h array<bigint>").repartition(5), 3)
    each = spark.range(140_000).select((F.col("id") * 2_654_435_761_987 % 2**62).alias("h"), "id")
    met = each.join(F.broadcast(filters), line_dedup._slice(F.col("h"), 3) == F.col("slice"))
    known = {r["id"] for r in met.where(line_dedup._known(F.col("h"), F.col("words"))).select("id").collect()}
    assert known >= set(range(30_000)) and len(known) < 40_000


# -- filter audit


def plain_audit(rows, labels):
    says = lambda i, k: i is not None and any(x[0] == i and x[k] == 1 for x in labels)
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    met = []
    for i, text, lang in rows:
        text, fails = text or "", set()
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails |= {"A"} if len(words) < 100 else set()
        fails |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
        fails |= {"D"} if re.search("[#$%&*|]", text) else set()
        fails |= {"E"} if i is not None and i > first[text] else set()
        met.append((lang or "", fails, says(i, 1), says(i, 2)))
    out = []
    for part in {m[0] for m in met}:
        own, shapley, told = [m for m in met if m[0] == part], Counter(), []
        for order in permutations("ABCDE"):
            before = set()
            for step, f in enumerate(order, 1):
                removed = [m for m in own if f in m[1] and not m[1] & before]
                shapley[f] += len(removed)
                kept = sum(not m[1] & (before | {f}) for m in own)
                told.append(("".join(order), step, f, kept, len(removed), sum(f in m[1] and bool(m[1] & before) for m in own), sum(m[1] == {f} for m in own), sum(m[2] for m in removed), sum(m[3] for m in removed)))
                before.add(f)
        out += [(part, order, step, *rest, shapley[f]) for order, step, f, *rest in told]
    return sorted(out)


def test_audit_like_plain_python(spark):
    plain = " ".join(f"word{i}" for i in range(120))
    rows = [
        (1, plain, "en"), (2, plain, "en"), (3, plain, "de"), (3, plain, "de"), (4, "UPPER Case text #1", "en"), (5, None, None), (6, "", ""), (7, "", "en"), (None, plain, "en"), (None, plain, None),
        (8, "same word " * 200, "en"), (8, "other text of one doc_id $", "en"), (9, "\t\x0b a\x0cb \r\n" * 90, "fr"), (10, "Ä ÖÜ ß€ A", "fr"), (11, "x" * 300_000 + " | " + plain, "fr"), (12, plain.upper(), "en"),
        *((100 + i, "a page that is copied a lot " * 20, "en") for i in range(150)),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, None), (3, 0, 1), (4, None, None), (8, 1, 1), (100, 1, 0), (101, 1, 1), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame([(i, t, lang, 1, "x") for i, t, lang in rows], "doc_id bigint, text string, lang string, n int, digest string").repartition(5)
    told = filter_audit.audit(docs, spark.createDataFrame([(*r, 1) for r in labels], "doc_id bigint, quality int, toxic int, good int"))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert told.columns == names
    assert sorted(tuple(r) for r in told.collect()) == plain_audit(rows, labels)


def test_audit_of_an_empty_table(spark):
    docs, labels = spark.createDataFrame([], "doc_id bigint, text string, lang string"), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(docs, labels).collect() == []

"""How filters over documents act on each other: what each removes in every order of them, what it alone removes, and its Shapley value.

The words of all documents are exploded, counted by (document, word), and by document into totals and distinct words. Flags of the other
filters are joined to them, and one aggregation counts the documents of each of the 32 ways to fail, as 32 columns for a part. All orders
are answered from these counts; no order is run.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import matched, written

FILTERS = "ABCDE"
WAYS = 1 << len(FILTERS)
BLANKS = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, tag, words and different (distinct words) of documents (doc_id, tag, text) that hold a word.

    Texts are dealt by document before they are exploded, so both counts are taken where the words are; rows that are alike in doc_id
    and tag have met in one before."""
    one = docs.groupBy("doc_id", "tag").agg(F.first("text").alias("text"))
    words = one.select("doc_id", "tag", F.explode(F.split("text", BLANKS)).alias("word")).where("word <> ''")
    by_word = words.groupBy("doc_id", "tag", "word").agg(F.count("*").alias("n"))
    return by_word.groupBy("doc_id", "tag").agg(F.sum("n").alias("words"), F.count("*").alias("different"))


def copies(docs: DataFrame) -> DataFrame:
    """digest, first (the smallest doc_id that holds the text) and n for texts of two rows or more."""
    return docs.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")


def failing(df: DataFrame, labels: DataFrame, least_words: int = 100, distinct_percent: int = 80, capital_percent: int = 10) -> DataFrame:
    """part, fails (the sum of 1, 2, 4, 8, 16 for the filters A to E that the document fails), good, toxic and n (equal rows).

    Failure: A fewer than least_words words; B 100 * distinct words < distinct_percent * words; C 100 * capitals (A-Z) > capital_percent *
    code points; D holds one of #$%&*|; E the text is that of a smaller doc_id. part is lang, the empty string where that is null. Null
    texts are empty. Every row is a document of its own; rows of one doc_id are no copies of each other, and one without a doc_id is no
    copy and has none. A document is good (toxic) if any of its labels says quality (toxic) 1; null labels say nothing."""
    text = F.coalesce("text", F.lit(""))
    part = F.coalesce("lang", F.lit(""))
    docs = df.select("doc_id", part.alias("part"), text.alias("text"), F.xxhash64(text, part).alias("tag"), F.sha2(F.encode(text, "UTF-8"), 256).alias("digest"))
    capitals = F.octet_length("text") - F.octet_length(F.translate("text", _UPPER, ""))
    c = 100 * capitals.cast("bigint") > capital_percent * F.char_length("text").cast("bigint")
    own = docs.select("doc_id", "tag", "part", "digest", F.when(c, 4).otherwise(0).alias("c"), F.when(F.col("text").rlike("[#$%&*|]"), 8).otherwise(0).alias("d"))
    flags = own.groupBy("doc_id", "tag", "part", "digest", "c", "d").agg(F.count("*").alias("n"))
    counted = word_counts(docs.select("doc_id", "tag", "text")).withColumnsRenamed({"doc_id": "of_doc", "tag": "of_tag"})
    met = flags.join(counted, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("tag") == F.col("of_tag")), "left_outer")
    words, different = F.coalesce("words", F.lit(0)), F.coalesce("different", F.lit(0))
    a, b = F.when(words < least_words, 1).otherwise(0), F.when(100 * different < distinct_percent * words, 2).otherwise(0)
    said = lambda column: F.max(F.when(F.col(column) == 1, 1).otherwise(0))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    met = met.select("doc_id", "part", "digest", "n", (a + b + F.col("c") + F.col("d")).alias("fails")).join(told, F.col("doc_id") == F.col("labelled"), "left_outer")
    met = written(met.select("doc_id", "part", "digest", "n", "fails", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")), "flags")
    twice = written(copies(docs.select("doc_id", "digest")), "copies")
    e = F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)
    return matched(met, twice, ["digest"], "n", "left_outer").select("part", (F.col("fails") + e).alias("fails"), "good", "toxic", "n")


def ways(failed: DataFrame) -> DataFrame:
    """part, and three arrays of 32 counts (total, good, toxic): the documents of each way to fail, from 32 conditional counts each."""
    count = lambda k, also: F.sum(F.when((F.col("fails") == k) & also, F.col("n")).otherwise(0))
    kinds = {"total": F.lit(True), "good": F.col("good") == 1, "toxic": F.col("toxic") == 1}
    wide = failed.groupBy("part").agg(*(count(k, also).alias(f"{name}{k}") for name, also in kinds.items() for k in range(WAYS)))
    return wide.select("part", *(F.array(*(f"{name}{k}" for k in range(WAYS))).alias(name) for name in kinds))


def _over(counts: Column, test) -> Column:
    """The sum of the counts of the ways that pass the test."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(WAYS - 1)), F.lit(0).cast("bigint"), lambda s, k: s + F.when(test(k), F.get(counts, k)).otherwise(0))


def orders(counts: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, for each part of ways()."""
    all_orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    each = counts.select("*", F.explode(all_orders).alias("filter_order"))
    each = each.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda place: F.expr(f"shiftleft(1, instr('{FILTERS}', substring(filter_order, {place}, 1)) - 1)")
    before = reduce(lambda x, y: x + y, [F.when(F.col("step") > k, bit(k)).otherwise(0) for k in range(1, len(FILTERS))])
    own = bit("step")
    each = each.withColumns({"before": before, "own": own})
    both = F.col("before") + F.col("own")
    none, hit = (lambda k, mask: k.bitwiseAND(mask) == 0), (lambda k, mask: k.bitwiseAND(mask) != 0)
    here = lambda k: none(k, F.col("before")) & hit(k, F.col("own"))
    share = F.array(*(F.lit(factorial(len(FILTERS)) // max(1, bin(k).count("1"))).cast("bigint") for k in range(WAYS)))  # the orders in which one of so many filters comes first
    shapley = F.aggregate(F.sequence(F.lit(0), F.lit(WAYS - 1)), F.lit(0).cast("bigint"), lambda s, k: s + F.when(hit(k, F.col("own")), F.get(F.col("total"), k) * F.get(share, k)).otherwise(0))
    return each.select(
        "part", "filter_order", "step",
        _over(F.col("total"), lambda k: none(k, both)).alias("kept"),
        _over(F.col("total"), here).alias("removed"),
        _over(F.col("total"), lambda k: hit(k, F.col("own")) & hit(k, F.col("before"))).alias("redundant"),
        F.get("total", F.col("own")).alias("unique_fails"),
        _over(F.col("good"), here).alias("good_lost"),
        _over(F.col("toxic"), here).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def audit(df: DataFrame, labels: DataFrame, least_words: int = 100, distinct_percent: int = 80, capital_percent: int = 10) -> DataFrame:
    """A row for each part, each of the 120 orders of the filters A to E (see failing) and each step of it; no documents, no rows.

    kept: documents that pass all filters so far; removed: those that this one takes; redundant: those that fail it and had gone; the
    unique_fails fail it alone; good_lost and toxic_lost are of the removed ones; shapley is what the filter removes, over all orders."""
    return orders(ways(failing(df, labels, least_words, distinct_percent, capital_percent)))

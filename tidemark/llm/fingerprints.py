"""Document fingerprints from closed syncmers, in DataFrame operations alone.

A run of K bytes is an anchor if the smallest (by hash) of the inner substrings of S bytes stands at either edge of it. That depends on
nothing outside the run, so an edit only changes anchors it touches. Of the anchors of each of BINS hash classes the fingerprint keeps
the one with the smallest hash, and where it stands. Two fingerprints are compared by position: what counts are equal anchors that are
all shifted by about the same distance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import spread

K, S, BINS = 16, 12, 64
#: How far the shifts of two equal anchors may differ.
SHIFT = 16
_STRETCH = 4096
_NO_ID = -(2**63)


def _anchors(texts: DataFrame, keys: list[str], column: str, k: int, s: int) -> DataFrame:
    """keys, bin and entry (hash above, place below) of each anchor of the binary column. A text too short to be sure of an anchor is one."""
    n, at = F.octet_length(column), F.col("at")
    width = k - s + 1
    stretches = texts.withColumn("stretch", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(n - k, F.lit(0)) / _STRETCH).cast("int"))))
    lo = F.col("stretch") * _STRETCH + 1
    hi = F.greatest(F.least(lo + (_STRETCH - 1), n - k + 1), lo)
    placed = stretches.withColumn("at", F.explode(F.sequence(lo, hi)))
    whole = n < k + width - 1
    inner = [F.xxhash64(F.substring(column, at + i, F.lit(s))) for i in range(width)]
    hashed = placed.where(~whole | (at == 1)).select(*keys, column, "at", whole.alias("whole"), *(x.alias(f"h{i}") for i, x in enumerate(inner)))
    edge, between = F.least("h0", f"h{width - 1}"), [F.col(f"h{i}") for i in range(1, width - 1)]
    closed = reduce(lambda a, b: a & b, (edge <= x for x in between))
    chosen = hashed.where(F.col("whole") | closed)
    h = F.xxhash64(F.when(F.col("whole"), F.col(column)).otherwise(F.substring(column, at, F.lit(k)))).bitwiseAND(F.lit(0x7FFFFFFF))
    entry = F.shiftleft(h.cast("long"), 32).bitwiseOR(at.cast("long"))
    return chosen.select(*keys, entry.alias("entry")).withColumn("bin", F.shiftright("entry", 32).bitwiseAND(F.lit(BINS - 1)).cast("int"))


def as_text(entries: Column) -> Column:
    """Entries in the order of their bins, 16 hexadecimal digits each."""
    return F.array_join(F.transform(F.filter(entries, lambda e: e.isNotNull()), lambda e: F.lpad(F.hex(e), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: of the bins that either side has filled, how many hold equal anchors with about the most common shift. a and b are
    entries by bin."""
    both = F.filter(F.zip_with(a, b, lambda x, y: F.when(F.shiftright(x, 32) == F.shiftright(y, 32), y - x)), lambda d: d.isNotNull())
    filled = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x, y)), lambda e: e.isNotNull()))
    votes = F.transform(both, lambda d: F.size(F.filter(both, lambda e: F.abs(e - d) <= SHIFT)))
    return F.when(filled > 0, F.coalesce(F.array_max(votes), F.lit(0)) / filled).otherwise(F.lit(1.0))


def in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """docs (doc_id, text) in buckets of neighbouring ids: bucket, id, th, text, ghost. Each bucket also has, as a ghost, the first row
    of the one that follows it by falling id (the last one: of the first), so that every row's follower is in its bucket."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = rows.agg(F.percentile_approx("id", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0] or []
    bounds = sorted(set(bounds))
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("id"))) if bounds else F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    # one row for each bucket
    heads = [r for r in rows.groupBy("bucket").agg(F.max(F.struct("id", "th")).alias("head")).orderBy(F.desc("bucket")).collect()]
    if not heads:
        return rows.withColumn("ghost", F.lit(False))
    after = heads[1:] + heads[:1]
    targets = docs.sparkSession.createDataFrame([(h["bucket"], n["head"]["id"], n["head"]["th"]) for h, n in zip(heads, after, strict=True)], "bucket int, id long, th long")
    ghosts = rows.drop("bucket").join(F.broadcast(targets), ["id", "th"]).dropDuplicates(["bucket"])  # targets has a row for each bucket
    return rows.withColumn("ghost", F.lit(False)).unionByName(ghosts.withColumn("ghost", F.lit(True)))


def fingerprints(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for each row of docs (doc_id, text).

    The edited text is the text whose last floor(n_chars / 2) characters are replaced by the first as many of the row that follows by
    falling doc_id (equal ids by falling hash of the text; null ids are last; the last row is followed by the first). A null text is
    empty; equal texts have equal fingerprints; two empty texts are alike (1). Rows that repeat come out each; other columns are
    ignored; an empty table gives no rows. Texts are shuffled once, into buckets of neighbouring ids, and all else happens there."""
    ordered = in_order(docs, 4 * spread(docs))
    by = Window.partitionBy("bucket").orderBy("ghost", F.desc("id"), F.desc("th"))
    rows = ordered.select("bucket", "id", "ghost", "text", F.row_number().over(by).alias("nth"), F.lead("text").over(by).alias("after"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left(F.coalesce("after", F.lit("")), half))
    told = rows.select("bucket", "nth", "id", "ghost", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    keys = ["bucket", "nth", "id", "ghost", "n_chars", "sha", "own"]
    # Ghosts only lend their own fingerprint.
    sides = F.array(F.struct(F.lit(True).alias("own"), F.col("text").alias("t")), F.struct(F.lit(False).alias("own"), F.col("edited").alias("t")))
    told = told.select("bucket", "nth", "id", "ghost", "n_chars", F.sha2("edited", 256).alias("sha"), F.explode(sides).alias("side"))
    told = told.select(*keys[:-1], "side.own", F.encode("side.t", "UTF-8").alias("bytes")).where("own or not ghost")
    found = _anchors(told, keys, "bytes", k, s)
    least = found.groupBy(*keys[:-1], "bin").agg(F.min(F.when(F.col("own"), F.col("entry"))).alias("a"), F.min(F.when(~F.col("own"), F.col("entry"))).alias("b"))
    each = least.groupBy(*keys[:-1]).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("a", "b")))).alias("bins"))
    spots = F.array(*(F.try_element_at("bins", F.lit(i)) for i in range(BINS)))
    each = each.withColumn("spots", spots).withColumn("a", F.col("spots.a")).withColumn("b", F.col("spots.b")).drop("bins", "spots")
    follow = Window.partitionBy("bucket").orderBy("nth")
    each = each.withColumn("next", F.lead("a").over(follow)).where("not ghost")
    return each.select(
        F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"),
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        as_text(F.col("a")).alias("fingerprint"),
        as_text(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("a"), F.col("next")).alias("near_next"),
    )

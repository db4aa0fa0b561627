"""Connected components of a link table, as Spark jobs: alternating large-star and small-star steps until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, written


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(links: DataFrame) -> DataFrame:
    """links (a, b; any orderable type, no nulls) as (node, label): the smallest node that each node reaches.

    Links of a node to itself and repeated links are ignored; an empty table gives no rows. Every step writes its links to the
    shared folder, so no lineage grows; a step shuffles links by node, with minima combined before the shuffle. A node that very many
    links share is a skewed side of a join whose result is dealt anew by distinct(), which adaptive execution splits."""
    edges = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "links")
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large.where("a != b"), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hooked = large.join(low.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = low.select("a", F.col("m").alias("b")).union(hooked)
        older = edges, large
        edges = written(small.distinct(), "small-star")
        discard(*older)
        now = _state(edges)
        if now == before:
            break
        before = now
    # each node has one link now, to its smallest
    own = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(own)

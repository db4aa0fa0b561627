"""Splits by time, at random and stratified, as column expressions over a few cut values.

A split deals rows by their place in an order. No row is numbered for it: what a part begins with is the value at a place, found by
counting, and a row's part follows from comparing its own value. Equal values (copies, one moment) go where the first of them falls.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.keys import rank_number
from tidemark.operators.evidence import running
from tidemark.operators.quantiles import At, places
from tidemark.session import kept_table

ORDER = ("train", "validation", "calibration", "test", "predict")
#: A stratum is a word of a category; more of them than this are refused.
MOST_STRATA = 100_000


@dataclass(frozen=True)
class Shares:
    train: float = 0.7
    validation: float = 0.15
    test: float = 0.15
    predict: float = 0.0
    calibration: float = 0.0

    def __post_init__(self) -> None:
        if min(self.of().values()) < 0 or abs(sum(self.of().values()) - 1) > 1e-9:
            raise ValueError("shares must be at least 0 and sum to 1")

    def of(self) -> dict[str, float]:
        return {p: getattr(self, p) for p in ORDER}

    def edges(self, n: int) -> list[tuple[str, int]]:
        """Where each part ends; the last one takes what rounding leaves."""
        given = [p for p in ORDER if p != ("predict" if self.predict else "test")]
        counts = {p: math.floor(n * self.of()[p] + 0.5) for p in given}
        last = "predict" if self.predict else "test"
        at, out = 0, []
        for p in ORDER:
            at = n if p == last else min(n, at + counts.get(p, 0))
            out.append((p, at))
        return out


def values_at(df: DataFrame, value: str, places: Iterable[int] | dict[object, list[int]], group: str | None = None) -> dict[tuple[object, int], tuple[int, int, int]]:
    """For each place (from 0) in the order of the long column `value`: the value there, how many rows are below it and how many hold it.
    With a group (of few values), places is a list for each of them. Distinct values are added up by ranges; only as many rows as
    places come to the driver."""
    wanted = places if isinstance(places, dict) else {None: sorted(set(places))}
    if not any(wanted.values()):
        return {}
    by = [group] if group else []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).count()
    placed = running(counts, value, {"upto": "count"}, by).withColumn("below", F.col("upto") - F.col("count"))
    asked = df.sparkSession.createDataFrame([(g, sorted(set(p))) for g, p in wanted.items() if p], "asked_of string, asked array<long>")  # a row for each group
    met = placed.join(F.broadcast(asked), F.col(group).eqNullSafe(F.col("asked_of")) if group else F.lit(True))
    hit = met.withColumn("place", F.explode(F.filter("asked", lambda p: (p >= F.col("below")) & (p < F.col("upto")))))
    return {(r["asked_of"], r["place"]): (r[value], r["below"], r["count"]) for r in hit.select("asked_of", "place", value, "below", "count").collect()}


def _dealt(value: Column, edges: list[tuple[str, int]], at: dict[int, At], n: int) -> Column:
    """The part of a row by its value: it is past an edge if no row below its value would be before the edge. The value is bound once, as
    a filter on the part would else evaluate it for each edge."""
    return F.transform(F.array(value), lambda v: _by_edges(v, edges, at, n))[0]


def _by_edges(value: Column, edges: list[tuple[str, int]], at: dict[int, At], n: int) -> Column:
    part, before = None, 0
    for name, edge in edges:
        if edge <= before:
            continue
        if edge >= n:
            test = F.lit(True)
        else:
            test = value <= at[edge].value if at[edge].below < edge else value < at[edge].value
        part = F.when(test, name) if part is None else part.when(test, name)
        before = edge
    return part if part is not None else F.lit("train")


def _blocks(n: int, k: int) -> list[int]:
    """The first place of each of k slices of n rows."""
    return [-(-i * n // k) for i in range(1, k)]


def micros(column: str) -> Column:
    return F.unix_micros(F.col(f"`{column}`").cast("timestamp"))


def by_time(df: DataFrame, column: str, shares: Shares, gap: int = 0, origins: int | None = None, origin: int = 0) -> DataFrame:
    """df with _part by the moments of column. With origins, train and validation are one stretch of origins + 1 blocks: those up to
    `origin` train, the next validates, later ones are left out. The last `gap` moments of each part are left out too."""
    v = micros(column)
    blocks = lambda n: _blocks(dict(shares.edges(n))["validation"], origins + 1) if origins else []
    n, gaps, at = places(df.select(v.alias("v")), F.col("v"), lambda n: [*(e for _, e in shares.edges(n)), *blocks(n)])
    if gaps:
        raise ValueError(f"split.byTime: {column} has gaps")
    part = _dealt(v, shares.edges(n), at, n)
    if origins:
        number = _dealt(v, [(str(i), s) for i, s in enumerate([*blocks(n), n])], at, n).cast("int")
        told = F.when(number <= origin, "train").when(number == origin + 1, "validation").otherwise("gap")
        part = F.when(part.isin("train", "validation"), told).otherwise(part)
    dealt = df.withColumn("_part", part)
    if gap:
        # the gap-th last distinct moment of each part: a handful of rows a part
        last = dealt.where("_part <> 'gap'").select("_part", v.alias("v")).distinct()
        window = Window.partitionBy("_part").orderBy(F.desc("v"))
        edge = {r["_part"]: r["v"] for r in last.withColumn("nth", F.row_number().over(window)).where(F.col("nth") == gap).collect()}
        there = {r[0] for r in dealt.select("_part").distinct().collect()}
        final = [p for p in ORDER if p in there][-1:]  # nothing follows the last part
        tests = [(F.col("_part") == p) & (v >= e) for p, e in edge.items() if p not in final]
        short = [p for p in there & {"train", "validation", "calibration", "test"} if p not in edge and p not in final]
        if short:
            raise ValueError(f"split.byTime: the gap takes all of {', '.join(sorted(short))}")
        for t in tests:
            dealt = dealt.withColumn("_part", F.when(t, "gap").otherwise(F.col("_part")))
        if not dealt.where("_part = 'train'").limit(1).count():
            raise ValueError("split.byTime: the gap takes all of train")
    return dealt


def at_random(df: DataFrame, key: Column, shares: Shares, seed: int, test_seed: int | None = None, folds: int | None = None, fold: int = 0) -> DataFrame:
    """df with _part by the rank of key (hexadecimal) under the seed; rows with one key stay together. test_seed deals test and predict
    first, and seed the rest anew. With folds, train and validation are one stretch of slices, of which slice `fold` validates."""
    ranked = df.withColumn("_rank", rank_number(key, test_seed if test_seed is not None else seed))
    rank = F.col("_rank")
    n, _, at = places(ranked, rank, lambda n: [e for _, e in shares.edges(n)])
    edges = shares.edges(n)
    dealt = ranked.withColumn("_part", _dealt(rank, edges, at, n))
    if test_seed is None and not folds:
        return dealt.drop("_rank")
    kinds = ("train", "validation", "calibration") if test_seed is not None else ("train", "validation")
    again = dealt.withColumn("_rank", F.when(F.col("_part").isin(*kinds), rank_number(key, seed)))
    if test_seed is not None:
        first = {p: e / max(1, n) for p, e in edges}
        inner = lambda m: [*((p, min(m, e) if m <= n else round(m * first[p] / max(first[k] for k in kinds))) for p, e in edges if p in kinds[:-1]), (kinds[-1], m)]
        m, _, at = places(again, rank, lambda m: [e for _, e in inner(m)])
        again = again.withColumn("_part", F.when(rank.isNotNull(), _dealt(rank, inner(m), at, m)).otherwise(F.col("_part")))
    if folds:
        again = again.withColumn("_rank", F.when(F.col("_part").isin("train", "validation"), rank_number(key, seed)))
        m, _, at = places(again, rank, lambda m: _blocks(m, folds))
        number = _dealt(rank, [(str(i), e) for i, e in enumerate([*_blocks(m, folds), m])], at, m).cast("int")
        told = F.when(number == fold, "validation").otherwise("train")
        again = again.withColumn("_part", F.when(rank.isNotNull(), told).otherwise(F.col("_part")))
    return again.drop("_rank")


def stratified(df: DataFrame, column: str, key: Column, shares: Shares, seed: int, folds: int | None = None, fold: int = 0) -> DataFrame:
    """df with _part, dealt as at_random within each group of the column (a gap is a group). The ranks at which the parts of each group
    end are found by counting, and each row is compared with those of its group; MOST_STRATA groups at most."""
    ranked = df.withColumn("_rank", rank_number(key, seed)).withColumn("_group", F.col(f"`{column}`").cast("string"))
    ranks = kept_table(ranked.select("_group", "_rank"), "ranks")
    sizes = {r["_group"]: r["count"] for r in ranks.groupBy("_group").count().limit(MOST_STRATA + 1).collect()}
    if len(sizes) > MOST_STRATA:
        raise ValueError(f"split.stratified: {column} has more than {MOST_STRATA} values")
    last = "predict" if shares.predict else "test"
    edges: dict[object, list[tuple[str, int]]] = {}
    for g, n in sizes.items():
        at, edges[g] = 0, []
        for p in ORDER:
            if p != last and shares.of()[p]:
                at += math.floor(n * shares.of()[p] + 0.5)
                edges[g].append((p, at))
    found = values_at(ranks, "_rank", {g: [e for _, e in some if e < sizes[g]] for g, some in edges.items()}, "_group")
    if folds:
        again = {}
        for g, some in edges.items():
            both = max((e for p, e in some if p in ("train", "validation")), default=0)
            if both >= sizes[g]:
                m = sizes[g]
            else:  # copies go where the first of them falls
                _, below, held = found[(g, both)]
                m = below + held if below < both else both
            low, high = -(-fold * m // folds), -(-(fold + 1) * m // folds)
            again[g] = [("train", low), ("validation", high), ("train", m), *((p, e) for p, e in some if p not in ("train", "validation"))]
        edges = again
        found |= values_at(ranks, "_rank", {g: [e for _, e in some if e < sizes[g]] for g, some in edges.items()}, "_group")
    rows = []
    for g, some in edges.items():
        tests = [(p, *((None, True) if e >= sizes[g] else (found[(g, e)][0], found[(g, e)][1] < e))) for p, e in some if e > 0]
        rows.append((g, tests))
    told = df.sparkSession.createDataFrame(rows, "_of string, _tests array<struct<part:string,cut:bigint,with_cut:boolean>>")  # a row for each stratum
    met = ranked.join(F.broadcast(told), F.col("_group").eqNullSafe(F.col("_of")))
    first = lambda rank: F.filter("_tests", lambda t: t["cut"].isNull() | (rank < t["cut"]) | ((rank == t["cut"]) & t["with_cut"]))
    part = F.transform(F.array("_rank"), lambda rank: F.coalesce(F.try_element_at(first(rank), F.lit(1))["part"], F.lit(last)))[0]
    return met.withColumn("_part", part).drop("_rank", "_group", "_of", "_tests")

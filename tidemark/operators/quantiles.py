"""Exact values at places of an order, for many columns at once, without ordering any of them.

One aggregation takes, for each place asked for, approximate quantiles a little below and above it. One pass then counts how many rows lie
between those bounds, value by value, and how many outside, without regard to their values: what is shuffled is the few rows around the
places. Bounds that miss their place are widened and counted again, so approximation costs time and never a result.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Approximate quantiles are within this share of the rows of their place.
NEAR = 1 / 4000
#: Counts of so many values at most are looked through by the driver; more of them are summed up where they are.
MOST_HERE = 100_000


#: The stretch of all values of a type.
_ALL = {"double": [(-math.inf, math.inf)], "bigint": [(-(1 << 63), (1 << 63) - 1)]}


@dataclass(frozen=True)
class At:
    """What stands at a place: its value, how many rows have a smaller one, and how many have it."""

    value: float | int
    below: int
    held: int


def around(x: Column, shares: list[float]) -> Column:
    """An aggregate: approximate quantiles below and above each share (from 0 to 1), to be given to bounds(). x: doubles or longs, no NaN."""
    asked = [min(1.0, max(0.0, s + d)) for s in shares for d in (-2 * NEAR, 2 * NEAR)]
    return F.percentile_approx(x, asked, round(1 / NEAR))


def range_of(value: Column, cuts: list) -> Column:
    """How many of the rising cuts are at most value; none are for a null. The value is worked out once, as the argument of a function, and
    then searched for: where it stands in a function over all cuts, Spark may work it out anew for each of them."""
    def search(v: Column, low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(v >= F.lit(cuts[middle]), search(v, middle + 1, high)).otherwise(search(v, low, middle))

    return F.transform(F.array(value), lambda v: search(v, 0, len(cuts)))[0] if cuts else F.lit(0)


def at_hand(x: Column, shares: list[float]) -> Column:
    """Spark's own exact quantiles, whose last task holds all distinct values: for small tables."""
    return F.percentile(x, F.array(*map(F.lit, shares)))


def _stretches(found: list | None) -> list[tuple]:
    """Pairs of bounds, those that touch made one."""
    out: list[tuple] = []
    for low, high in sorted(zip(found[::2], found[1::2], strict=True)) if found else []:
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _counted(df: DataFrame, asked: dict[int, tuple[Column, list[tuple], str]]) -> DataFrame:
    """i (the column's number), slot, whole or part (the value, within stretches alone) and n, for all columns in one pass. Slot 0 is below
    the first stretch, 1 within it, 2 between it and the second, 3 within that, and so on: each batch looks its values up by binary
    search and sends its counts, so the plan does not grow with the stretches."""
    ends = {i: (np.array([s[0] for s in stretches]), np.array([s[1] for s in stretches]), kind) for i, (_, stretches, kind) in asked.items()}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (lows, highs, kind) in ends.items():
                x = pc.drop_null(b.column(f"c{i}")).to_numpy(zero_copy_only=False)
                if not len(x):
                    continue
                v, n = np.unique(x, return_counts=True)
                at = np.searchsorted(lows, v, "right") - 1  # the stretch that begins at or before v
                inside = (at >= 0) & (v <= highs[np.maximum(at, 0)])
                slot = np.where(inside, 2 * at + 1, 2 * at + 2)
                others = np.unique(slot[~inside])
                more = np.array([n[~inside & (slot == k)].sum() for k in others], np.int64)
                held, none = pa.array(v[inside]), pa.nulls(int(inside.sum()) + len(others))
                held = pa.concat_arrays([held, pa.nulls(len(others), held.type)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(held), i, np.int32)), pa.array(np.concatenate([slot[inside], others]).astype(np.int32)),
                        held if kind == "bigint" else none.cast(pa.int64()), none.cast(pa.float64()) if kind == "bigint" else held,
                        pa.array(np.concatenate([n[inside], more]).astype(np.int64)),
                    ],
                    names=["i", "slot", "whole", "part", "n"],
                )

    sent = df.select(*(x.cast(kind).alias(f"c{i}") for i, (x, _, kind) in asked.items())).mapInArrow(counted, "i int, slot int, whole bigint, part double, n bigint")
    return sent.groupBy("i", "slot", "whole", "part").agg(F.sum("n").alias("n"))


def _placed_here(counts: DataFrame, asked: dict) -> list[dict]:
    """The counted values at which places stand, where few have been counted."""
    told = sorted((r["i"], r["slot"], r["whole"] if r["part"] is None else r["part"], r["n"]) for r in counts.select("i", "slot", "whole", "part", "n").na.fill(0, ["whole"]).collect())
    out, below = [], dict.fromkeys(asked, 0)
    for i, slot, value, n in told:
        places = asked[i][1]
        if slot % 2 == 1:
            some = places[bisect_left(places, below[i]) : bisect_left(places, below[i] + n)]
            if some:
                whole = isinstance(asked[i][0][0][0], int)
                out.append({"i": i, "places": some, "whole": value if whole else None, "part": None if whole else value, "below": below[i], "n": n})
        below[i] += n
    return out


def _placed(counts: DataFrame, asked: dict) -> list:
    """The same where many have been counted: summed up slot by slot, and only rows that a place stands at come to the driver."""
    # Within a slot by value (few rows: 4 * NEAR of all for each place), and what lies in the slots below from a row a slot.
    upto = F.sum("n").over(Window.partitionBy("i", "slot").orderBy("whole", "part").rowsBetween(Window.unboundedPreceding, 0))
    totals = counts.groupBy(F.col("i").alias("of_i"), F.col("slot").alias("of_slot")).agg(F.sum("n").alias("t"))
    earlier = F.sum("t").over(Window.partitionBy("of_i").orderBy("of_slot").rowsBetween(Window.unboundedPreceding, -1))
    based = totals.select("of_i", "of_slot", F.coalesce(earlier, F.lit(0)).alias("base"))
    inner = counts.where(F.col("slot") % 2 == 1).withColumn("upto", upto)
    placed = inner.join(F.broadcast(based), (F.col("i") == F.col("of_i")) & (F.col("slot") == F.col("of_slot"))).withColumn("below", F.col("base") + F.col("upto") - F.col("n"))
    ask = F.from_json(F.lit(json.dumps({str(i): some for i, (_, some) in asked.items()})), "map<string,array<bigint>>")  # a constant
    met = placed.withColumn("places", F.filter(F.try_element_at(ask, F.col("i").cast("string")), lambda p: (p >= F.col("below")) & (p < F.col("below") + F.col("n"))))
    return met.where(F.size("places") > 0).select("i", "places", "whole", "part", "below", "n").collect()  # a row a place


def places_at(df: DataFrame, columns: list[Column], found: list[list | None], wanted: list[list[int]], rows: list[int]) -> list[dict[int, At]]:
    """For each column the value at each wanted place (from 0) in its rising order of values that are no nulls; found: what around() gave
    for it, rows: how many values it has. Places beyond the last value are left out."""
    out: list[dict[int, At]] = [{} for _ in columns]
    asked = {i: (_stretches(found[i]), sorted(set(w))) for i, w in enumerate(wanted) if w and found[i]}
    kinds = {i: "bigint" if isinstance(found[i][0], int) else "double" for i in asked}
    while asked:
        counts = _counted(df, {i: (columns[i], stretches, kinds[i]) for i, (stretches, _) in asked.items()})
        expected = sum(rows[i] if stretches == _ALL[kinds[i]] else 2 * len(some) * 4 * NEAR * rows[i] for i, (stretches, some) in asked.items())
        hit = _placed_here(counts, asked) if expected <= MOST_HERE else _placed(counts, asked)
        for r in hit:
            value = r["whole"] if kinds[r["i"]] == "bigint" else r["part"]
            out[r["i"]] |= {p: At(value, r["below"], r["n"]) for p in r["places"]}
        # What the bounds have missed is counted again over all values, once.
        missed = {i: [p for p in some if p not in out[i]] for i, (stretches, some) in asked.items() if stretches != _ALL[kinds[i]]}
        asked = {i: (_ALL[kinds[i]], some) for i, some in missed.items() if some}
    return out


def between(n: int, share: float) -> tuple[int, int, float]:
    """The two places that a quantile lies between, and how far it is from the first: share * (n - 1)."""
    at = share * (n - 1)
    low = min(math.floor(at), n - 1)
    return low, min(low + 1, n - 1), at - low


def interpolated(n: int, shares: list[float], at: dict[int, At]) -> list[float]:
    out = []
    for share in shares:
        low, high, rest = between(n, share)
        a, b = at[low].value, at[high].value
        out.append(float(a) if a == b or rest == 0 else (1 - rest) * a + rest * b)
    return out


def exact(df: DataFrame, columns: list[Column], shares: list[list[float]], n: list[int], found: list[list | None]) -> list[list[float] | None]:
    """The quantiles of each column, interpolated between neighbouring values; None where it has none. n and found come from an aggregation
    over the same rows (count and around)."""
    wanted = [sorted({p for s in some for p in between(k, s)[:2]}) if k else [] for some, k in zip(shares, n, strict=True)]
    at = places_at(df, columns, found, wanted, n)
    return [interpolated(k, some, here) if k else None for some, k, here in zip(shares, n, at, strict=True)]


def quantiles(df: DataFrame, columns: list[Column], shares: list[float]) -> list[list[float] | None]:
    """The same where nothing else is aggregated: two passes for all columns."""
    if not columns:
        return []
    row = df.agg(*(c for i, x in enumerate(columns) for c in (F.count(x).alias(f"n{i}"), around(x, shares).alias(f"q{i}")))).first()
    return exact(df, columns, [shares] * len(columns), [row[f"n{i}"] for i in range(len(columns))], [row[f"q{i}"] for i in range(len(columns))])


def places(df: DataFrame, x: Column, wanted: Callable[[int], list[int]]) -> tuple[int, int, dict[int, At]]:
    """How many values x has, how many nulls, and what stands at the places that the first number asks for. The places are shares of that
    number but for rounding: the shares are taken from those of 2**40 rows."""
    many = 1 << 40
    shares = [p / many for p in wanted(many)]
    row = df.agg(F.count(x).alias("n"), F.count_if(x.isNull()).alias("gaps"), (around(x, shares) if shares else F.lit(None)).alias("q")).first()
    n = row["n"]
    return n, row["gaps"], places_at(df, [x], [row["q"]], [[p for p in wanted(n) if p < n]], [n])[0]

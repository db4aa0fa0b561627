"""One long series in many tasks: its rows are cut into stretches of the order, and what a stretch needs of the others is carried to it.

Frames of so many rows get copies of the last rows before their stretch (or the first after it). Running sums get what earlier stretches
sum to, carried values the last one before. Averages that feed on themselves, v -> (1 - w) v + w x, are composed: a stretch is one such step
of its own, so the value it begins with follows from one row a stretch, and all stretches then run at once.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidemark.operators.quantiles import range_of

#: Stretches at most.
MOST = 256
STRETCH, EDGE = "_stretch", "_edge"


def _place(df: DataFrame, order: list[str]) -> Column | None:
    """The first column of the order as a number; words have none."""
    kind = df.schema[order[0]].dataType.typeName()
    if kind in ("timestamp", "date", "timestamp_ntz"):
        return F.unix_micros(F.col(f"`{order[0]}`").cast("timestamp"))
    return F.col(f"`{order[0]}`").cast("double") if kind in ("double", "float", "long", "integer", "short", "byte", "decimal") else None


def stretched(df: DataFrame, order: list[str], most: int = MOST) -> DataFrame:
    """df with _stretch, which rises along the order: cut at approximate quantiles of its first column, so rows that are equal there share
    a stretch. A series ordered by words first is one stretch."""
    n, place = min(most, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), _place(df, order)
    cuts = df.agg(F.percentile_approx(place, [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 and place is not None else None
    cuts = sorted({c for c in cuts or [] if c is not None})
    return df.withColumn(STRETCH, range_of(place, cuts) if cuts else F.lit(0))


def along(order: list[str], by: Iterable[str] = (STRETCH,)) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def edged(df: DataFrame, order: list[str], rows: int, ahead: bool = False) -> DataFrame:
    """The rows of stretched() with _edge false, and with _edge true copies of the last `rows` rows before each stretch (or with ahead the
    first rows after it), which stand in that stretch. Stretches of fewer rows pass on what stands before them."""
    sort = [F.asc(c) if ahead else F.desc(c) for c in order]
    ends = df.withColumn("_nth", F.row_number().over(Window.partitionBy(STRETCH).orderBy(*sort))).where(F.col("_nth") <= rows)
    held = sorted(((r[STRETCH], r["n"]) for r in ends.groupBy(STRETCH).agg(F.count("*").alias("n")).collect()), reverse=ahead)  # a row a stretch
    # The ends of all stretches in order: a stretch takes the `rows` of them that stand nearest before it.
    sent = []
    for k, (stretch, _) in enumerate(held):
        need = rows
        for other, m in reversed(held[:k]):
            if need <= 0:
                break
            sent.append((other, min(m, need), stretch))
            need -= m
    if not sent:
        return df.withColumn(EDGE, F.lit(False))
    to = df.sparkSession.createDataFrame(sent, "_from int, _upto int, _to int")  # a few rows a stretch
    copies = ends.join(F.broadcast(to), (F.col(STRETCH) == F.col("_from")) & (F.col("_nth") <= F.col("_upto")))
    return df.withColumn(EDGE, F.lit(False)).unionByName(copies.withColumn(STRETCH, F.col("_to")).withColumn(EDGE, F.lit(True)).drop("_nth", "_from", "_upto", "_to"))


def without_edges(df: DataFrame) -> DataFrame:
    return df.where(~F.col(EDGE)).drop(EDGE)


def summed(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """The rows of stretched() with running sums: a stretch's own, and what the earlier ones come to."""
    own = df.withColumns({f"_own_{n}": c for n, c in sums.items()})
    total = own.groupBy(F.col(STRETCH).alias("_at")).agg(*(F.sum(f"_own_{n}").alias(f"_t_{n}") for n in sums))  # a row a stretch
    below = Window.partitionBy().orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select("_at", *(F.coalesce(F.sum(f"_t_{n}").over(below), F.lit(0.0)).alias(f"_b_{n}") for n in sums))
    window = along(order).rowsBetween(Window.unboundedPreceding, 0)
    met = own.withColumns({f"_own_{n}": F.sum(f"_own_{n}").over(window) for n in sums}).join(F.broadcast(base), F.col(STRETCH) == F.col("_at"))
    return met.select(*df.columns, *((F.col(f"_own_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums))


def carried(df: DataFrame, order: list[str], column: str) -> DataFrame:
    """The rows of stretched() with the gaps of a column filled by the last value before them."""
    c = F.col(f"`{column}`")
    last = df.where(c.isNotNull()).groupBy(F.col(STRETCH).alias("_of")).agg(F.max_by(c, F.struct(*(f"`{o}`" for o in order))).alias("_last"))  # a row a stretch
    every = df.select(F.col(STRETCH).alias("_at")).distinct().join(last, F.col("_at") == F.col("_of"), "left")
    base = every.select("_at", F.last("_last", ignorenulls=True).over(Window.partitionBy().orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = df.withColumn(column, F.last(c, ignorenulls=True).over(along(order).rowsBetween(Window.unboundedPreceding, 0)))
    return own.join(F.broadcast(base), F.col(STRETCH) == F.col("_at")).withColumn(column, F.coalesce(c, F.col("_before"))).drop("_at", "_before")


def _fed(x: np.ndarray, before: float, weight: float) -> np.ndarray:
    """v -> v + weight * (x - v) from `before` on; what follows a value that is no number is none."""
    out = pd.Series(np.concatenate(([before], x))).ewm(alpha=weight, adjust=False).mean().to_numpy()[1:].copy()
    odd = np.flatnonzero(np.isnan(x))
    if len(odd) or np.isnan(before):
        out[odd[0] if not np.isnan(before) else 0 :] = np.nan
    return out


def smoothed(df: DataFrame, order: list[str], columns: dict[str, tuple[str, int, float]]) -> DataFrame:
    """The rows of stretched() with averages that feed on themselves, by name: (column, period, weight). The first is the mean of the
    first `period` values; rows before have none."""
    kinds = {c: df.schema[c].dataType for c in order}
    place = F.struct(*(F.col(f"`{c}`").alias(c) for c in order))
    plans: dict[str, tuple[str, float, tuple | None, float]] = {}
    for name, (x, period, weight) in columns.items():
        known = df.where(F.col(x).isNotNull() & ~F.isnan(x)).agg(F.min(place)).first()[0]
        if known is None:
            plans[name] = (x, weight, None, np.nan)
            continue
        first = F.struct(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, known, strict=True)))
        head = df.where(place >= first).orderBy(*order).limit(period).select(x, *order).collect()  # a period's rows
        values = [np.nan if r[x] is None else r[x] for r in head]
        plans[name] = (x, weight, tuple(head[-1][c] for c in order) if len(head) == period else None, float(np.mean(values)))
    after = lambda seed: place > F.struct(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, seed, strict=True)))
    told = df.withColumns({f"_after_{n}": after(p[2]) if p[2] else F.lit(False) for n, p in plans.items()})

    def composed(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order, kind="stable")
        out = {STRETCH: f[STRETCH].iloc[0]}
        for n, (x, weight, _, _) in plans.items():
            v = f[x].to_numpy(float)[f[f"_after_{n}"].to_numpy(bool)]
            out |= {f"a_{n}": (1 - weight) ** len(v), f"b_{n}": _fed(v, 0.0, weight)[-1] if len(v) else 0.0}
        return pd.DataFrame([out])

    needed = told.select(STRETCH, *order, *dict.fromkeys(p[0] for p in plans.values()), *(f"_after_{n}" for n in plans))
    steps = sorted(needed.groupBy(STRETCH).applyInPandas(composed, ", ".join([f"{STRETCH} int", *(f"`a_{n}` double, `b_{n}` double" for n in plans)])).collect(), key=lambda r: r[STRETCH])  # a row a stretch
    begins: dict[str, dict[int, float]] = {n: {} for n in plans}
    for n, (_, _, _, seed) in plans.items():
        v = seed
        for r in steps:
            begins[n][r[STRETCH]] = v
            v = r[f"a_{n}"] * v + (np.nan if r[f"b_{n}"] is None else r[f"b_{n}"])

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order, kind="stable")
        for n, (x, weight, seed, start) in plans.items():
            later, out = f[f"_after_{n}"].to_numpy(bool), np.full(len(f), np.nan)
            out[later] = _fed(f[x].to_numpy(float)[later], begins[n][f[STRETCH].iloc[0]], weight)
            if seed is not None and not later.all() and (~later).any():
                at = np.flatnonzero(~later)[-1]  # the last row before is the one that has begun it, if it is in this stretch
                if tuple(f[c].iloc[at] for c in order) == tuple(pd.Timestamp(s) if isinstance(f[c].iloc[at], pd.Timestamp) else s for c, s in zip(order, seed, strict=True)):
                    out[at] = start
            f[n] = np.where(np.isnan(out), None, out)
        return f[names]

    names = [*df.columns, *plans]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", `{n}` double" for n in plans)
    return told.groupBy(STRETCH).applyInPandas(run, schema)

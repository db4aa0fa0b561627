"""Twelve indicators of a series, all looking backwards only: a row's value never depends on a later row.

The definitions are the usual textbook ones. Values before an indicator has seen enough rows are gaps. Sums over a fixed span are
window frames, averages that feed on themselves (exponential and Wilder's) recursions. `by` names the columns that tell series apart,
each of which one task runs along; a table that is one series is cut into stretches of its order (operators/series.py) and run by many.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.series import STRETCH, along, edged, smoothed, stretched, summed, without_edges

#: Columns that each takes, and the endings of what it makes.
INDICATORS = {
    "sma": (1, [""]), "ema": (1, [""]), "rsi": (1, [""]), "atr": (3, [""]), "adx": (3, [""]), "cci": (3, [""]), "williamsr": (3, [""]),
    "obv": (2, [""]), "macd": (1, ["_line", "_signal", "_histogram"]), "bollingerbands": (1, ["_upper", "_middle", "_lower"]),
    "stochastic": (3, ["_k", "_d"]), "vwap": (4, [""]),
}
RECURSIVE = ("ema", "rsi", "atr", "adx", "macd")


def exponential(x: np.ndarray, period: int) -> np.ndarray:
    """Starts as the mean of the first `period` values."""
    return _run(x, period, 2 / (period + 1))


def wilder(x: np.ndarray, period: int) -> np.ndarray:
    return _run(x, period, 1 / period)


def _run(x: np.ndarray, period: int, weight: float) -> np.ndarray:
    out = np.full(len(x), np.nan)
    there = np.flatnonzero(~np.isnan(x))
    if len(there) and len(x) - there[0] >= period:
        first = there[0] + period - 1
        out[first] = value = x[there[0] : first + 1].mean()
        for i in range(first + 1, len(x)):
            value += weight * (x[i] - value)
            out[i] = value
    return out


def _true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.concatenate(([np.nan], close[:-1]))
    return np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))


def recursive(name: str, period: int, *x: np.ndarray) -> list[np.ndarray]:
    """The columns of a recursive indicator over one series."""
    if name == "ema":
        return [exponential(x[0], period)]
    if name == "rsi":
        step = np.concatenate(([np.nan], np.diff(x[0])))
        up, down = wilder(np.where(np.isnan(step), np.nan, np.maximum(step, 0)), period), wilder(np.where(np.isnan(step), np.nan, np.maximum(-step, 0)), period)
        with np.errstate(divide="ignore", invalid="ignore"):
            return [np.where(np.isnan(up), np.nan, np.where(down == 0, np.where(up == 0, 50.0, 100.0), 100 - 100 / (1 + up / down)))]
    if name == "macd":
        line = exponential(x[0], 12) - exponential(x[0], 26)
        signal = exponential(line, period)
        return [line, signal, line - signal]
    reach = wilder(_true_range(*x), period)
    if name == "atr":
        return [reach]
    up, down = np.concatenate(([np.nan], np.diff(x[0]))), np.concatenate(([np.nan], -np.diff(x[1])))
    plus = wilder(np.where(np.isnan(up), np.nan, np.where((up > down) & (up > 0), up, 0)), period)
    minus = wilder(np.where(np.isnan(up), np.nan, np.where((down > up) & (down > 0), down, 0)), period)
    with np.errstate(divide="ignore", invalid="ignore"):
        return [wilder(np.where(np.isnan(plus), np.nan, np.where(plus + minus == 0, 0.0, 100 * np.abs(plus - minus) / (plus + minus))), period)]


def framed(name: str, period: int, x: list[Column], window: Window) -> list[Column]:
    """The columns of an indicator that window frames express; `window` is ordered."""
    span = window.rowsBetween(1 - period, 0)
    so_far = window.rowsBetween(Window.unboundedPreceding, 0)
    enough = F.count(F.lit(1)).over(span) >= period
    over = lambda c, w=span: F.when(enough, c.over(w))
    if name == "sma":
        return [over(F.avg(x[0]))]
    if name == "bollingerbands":
        middle, width = over(F.avg(x[0])), over(F.stddev_pop(x[0]))
        return [middle + 2 * width, middle, middle - 2 * width]
    if name in ("williamsr", "stochastic"):
        top, bottom = over(F.max(x[0])), over(F.min(x[1]))
        if name == "williamsr":
            return [-100 * F.coalesce(F.try_divide(top - x[2], top - bottom), F.when(enough, F.lit(0.0)))]
        return [100 * F.coalesce(F.try_divide(x[2] - bottom, top - bottom), F.when(enough, F.lit(0.0)))]
    if name == "cci":
        typical = (x[0] + x[1] + x[2]) / 3
        mean = F.avg(typical).over(span)
        apart = F.aggregate(F.collect_list(typical).over(span), F.lit(0.0), lambda s, v: s + F.abs(v - mean)) / period
        return [F.when(enough, F.coalesce(F.try_divide(typical - mean, 0.015 * apart), F.lit(0.0)))]
    if name == "obv":
        return [F.sum(F.signum(F.coalesce(x[0] - F.lag(x[0]).over(window), F.lit(0.0))) * x[1]).over(so_far)]
    if name == "vwap":
        typical = (x[0] + x[1] + x[2]) / 3
        return [F.try_divide(F.sum(typical * x[3]).over(so_far), F.sum(x[3]).over(so_far))]
    raise ValueError(f"unknown indicator {name}")


def _long(df: DataFrame, names: list[str], indicator: str, period: int, columns: list[str], order: list[str]) -> DataFrame:
    """An indicator of a table that is one series."""
    there = stretched(df, order)
    window, x = along(order), [F.col(f"`{c}`").cast("double") for c in columns]
    if indicator in ("obv", "vwap"):
        typical = (x[0] + x[1] + x[2]) / 3 if indicator == "vwap" else None
        if indicator == "vwap":
            made = summed(there, order, {"_pv": typical * x[3], "_v": x[3]}).withColumn(names[0], F.try_divide("_pv", "_v"))
        else:
            step = F.signum(F.coalesce(x[0] - F.lag(x[0]).over(window), F.lit(0.0))) * x[1]
            made = summed(without_edges(edged(there, order, 1).withColumn("_step", step)), order, {names[0]: F.col("_step")})
        return made.select(*df.columns, names[0])
    if indicator not in RECURSIVE:
        made = edged(there, order, period + 1).withColumns(dict(zip(names, framed(indicator, period, x, window), strict=False)))
        if indicator == "stochastic":
            span = window.rowsBetween(-2, 0)
            made = made.withColumn(names[1], F.when(F.count(names[0]).over(span) >= 3, F.avg(names[0]).over(span)))
        return without_edges(made).drop(STRETCH)
    before = lambda c: F.lag(c).over(window)
    if indicator in ("ema", "macd"):
        made = there.withColumn("_x", x[0])
        if indicator == "ema":
            return smoothed(made, order, {names[0]: ("_x", period, 2 / (period + 1))}).select(*df.columns, *names)
        made = smoothed(made, order, {"_fast": ("_x", 12, 2 / 13), "_slow": ("_x", 26, 2 / 27)}).withColumn(names[0], F.col("_fast") - F.col("_slow"))
        made = smoothed(made, order, {names[1]: (names[0], period, 2 / (period + 1))})
        return made.withColumn(names[2], F.col(names[0]) - F.col(names[1])).select(*df.columns, *names)
    made = edged(there, order, 1)
    if indicator == "rsi":
        step = x[0] - before(x[0])
        made = without_edges(made.withColumns({"_up": F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))), "_down": F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0)))}))
        made = smoothed(made, order, {"_u": ("_up", period, 1 / period), "_d": ("_down", period, 1 / period)})
        told = F.when(F.col("_d") == 0, F.when(F.col("_u") == 0, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + F.try_divide("_u", "_d")))
        return made.withColumn(names[0], F.when(F.col("_u").isNotNull(), told)).select(*df.columns, *names)
    if indicator == "atr":
        reach = F.greatest(x[0] - x[1], F.abs(x[0] - before(x[2])), F.abs(x[1] - before(x[2])))
        return smoothed(without_edges(made.withColumn("_reach", reach)), order, {names[0]: ("_reach", period, 1 / period)}).select(*df.columns, *names)
    up, down = x[0] - before(x[0]), before(x[1]) - x[1]
    moved = lambda a, b: F.when(a.isNotNull(), F.when((a > b) & (a > 0), a).otherwise(0.0))
    made = without_edges(made.withColumns({"_up": moved(up, down), "_down": moved(down, up)}))
    made = smoothed(made, order, {"_p": ("_up", period, 1 / period), "_m": ("_down", period, 1 / period)})
    apart = F.when(F.col("_p") + F.col("_m") == 0, 0.0).otherwise(F.try_divide(100 * F.abs(F.col("_p") - F.col("_m")), F.col("_p") + F.col("_m")))
    made = made.withColumn("_dx", F.when(F.col("_p").isNotNull(), apart))
    return smoothed(made, order, {names[0]: ("_dx", period, 1 / period)}).select(*df.columns, *names)


def add_indicator(df: DataFrame, column: str, indicator: str, period: int, columns: list[str], order: list[str], by: list[str] | None = None) -> DataFrame:
    """df with the indicator's columns, named column and its endings. With no `by` the table is one series. Ordering columns must tell the
    rows of a series apart."""
    takes, endings = INDICATORS[indicator]
    if len(columns) != takes:
        raise ValueError(f"{indicator} takes {takes} columns, not {len(columns)}")
    names = [column + e for e in endings]
    if not by:
        return _long(df, names, indicator, period, columns, order)
    if indicator not in RECURSIVE:
        window = Window.partitionBy(*by).orderBy(*order)
        made = df.withColumns(dict(zip(names, framed(indicator, period, [F.col(f"`{c}`").cast("double") for c in columns], window), strict=False)))
        if indicator == "stochastic":
            span = window.rowsBetween(-2, 0)
            return made.withColumn(names[1], F.when(F.count(names[0]).over(span) >= 3, F.avg(names[0]).over(span)))
        return made

    def along(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order, kind="stable")
        made = recursive(indicator, period, *(f[c].to_numpy(float) for c in columns))
        return f.assign(**{n: np.where(np.isnan(v), None, v) for n, v in zip(names, made, strict=True)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", `{n}` double" for n in names)
    return df.groupBy(*by).applyInPandas(along, schema)



"""Features that a row alone determines: arithmetic, cycles, parts of moments, maths, given scales, settled gaps, row norms."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARITHMETIC = ("plus", "minus", "times", "dividedby")
PERIODS = ("hourofday", "dayofweek", "dayofmonth", "monthofyear", "dayofyear", "season")
PARTS = ("minute", "hour", "dayofweek", "dayofmonth", "month", "quarter", "season", "year")
MATHS = ("log", "log1p", "reciprocal", "sqrt", "square", "arcsin", "abs", "sign")
_SEASONS = ("winter", "spring", "summer", "autumn")


def number(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


def arithmetic(left: Column, how: str, right: Column) -> Column:
    """A gap where either side is one; division by zero gives a gap."""
    return {"plus": left + right, "minus": left - right, "times": left * right, "dividedby": F.try_divide(left, right)}[how]


def formed(values: dict[str, Column], form: str) -> dict[str, Column]:
    """Values in [-1, 1] as they are (signed), in [0, 1] (unit), or as two columns for either sign (splitsign)."""
    if form == "signed":
        return values
    if form == "unit":
        return {k: (v + 1) / 2 for k, v in values.items()}
    zero = F.lit(0.0)
    both = {}
    for k, v in values.items():
        both |= {f"{k}_pos": F.when(v.isNotNull(), F.greatest(v, zero)), f"{k}_neg": F.when(v.isNotNull(), F.greatest(-v, zero))}
    return both


def cycle(column: str, length: float, form: str = "signed") -> dict[str, Column]:
    v = number(column)
    angle = 2 * math.pi * (v - length * F.floor(v / length)) / length
    name = f"{column}_cycle{length:g}"
    return formed({f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}, form)


def season(moment: Column) -> Column:
    """0 winter (December to February) to 3 autumn."""
    return F.floor((F.month(moment) % 12) / 3)


def cyclical(column: str, period: str, form: str = "signed") -> dict[str, Column]:
    m = F.col(f"`{column}`")
    days = F.when(F.dayofmonth(F.last_day(F.make_date(F.year(m), F.lit(2), F.lit(1)))) == 29, 366).otherwise(365)
    share = {
        "hourofday": (F.hour(m) + F.minute(m) / 60) / 24,
        "dayofweek": (F.dayofweek(m) - 1) / 7,
        "dayofmonth": (F.dayofmonth(m) - 1) / 31,
        "monthofyear": (F.month(m) - 1) / 12,
        "dayofyear": (F.dayofyear(m) - 1) / days,
        "season": season(m) / 4,
    }[period]
    angle = 2 * math.pi * share
    return formed({f"{column}_{period}_sin": F.sin(angle), f"{column}_{period}_cos": F.cos(angle)}, form)


def time_parts(column: str, parts: list[str], as_categories: bool = False) -> dict[str, Column]:
    """{column}_{part}: numbers, or words where asked for; days and seasons by name need words."""
    m = F.col(f"`{column}`")
    whole = {"minute": F.minute(m), "hour": F.hour(m), "dayofmonth": F.dayofmonth(m), "month": F.month(m), "quarter": F.quarter(m), "year": F.year(m)}
    words = {"dayofweek": F.lower(F.date_format(m, "EEEE")), "season": F.element_at(F.array(*map(F.lit, _SEASONS)), (season(m) + 1).cast("int"))}
    found = {}
    for p in parts:
        if p in words:
            if not as_categories:
                raise ValueError(f"{p} is a word: it needs asCategories")
            found[f"{column}_{p}"] = words[p]
        else:
            found[f"{column}_{p}"] = whole[p].cast("string") if as_categories else whole[p].cast("double")
    return found


def maths(v: Column, shape: str) -> Column:
    return {
        "log": F.ln(v), "log1p": F.ln(v + 1), "reciprocal": F.try_divide(F.lit(1.0), v), "sqrt": F.sqrt(v), "square": v * v,
        "arcsin": F.asin(F.sqrt(v)), "abs": F.abs(v), "sign": F.signum(v),
    }[shape]


def maths_refused(v: Column, shape: str) -> Column:
    """Which values the shape has no answer for."""
    return {"log": v <= 0, "log1p": v <= -1, "reciprocal": v == 0, "sqrt": v < 0, "arcsin": (v < 0) | (v > 1)}.get(shape, F.lit(False))


def maths_back(v: Column, shape: str) -> Column:
    """The value that the shape made v of, where there is one way back: none of abs and sign; of square the root that is not negative
    (whether a run's answers are none is verified by the run)."""
    back = {"log": F.exp(v), "log1p": F.exp(v) - 1, "reciprocal": F.try_divide(F.lit(1.0), v), "sqrt": v * v, "arcsin": F.sin(v) * F.sin(v)}
    if shape == "square":
        return F.when(v >= 0, F.sqrt(v)).when(v.isNotNull(), F.raise_error(F.concat(F.lit("a square is never negative, so nothing squares to "), v.cast("string"))).cast("double"))
    if shape not in back:
        raise ValueError(f"{shape} has no way back")
    return back[shape]


def scale_given(v: Column, lowest: float, highest: float, lands: str = "signed") -> Column:
    share = (v - lowest) / (highest - lowest)
    return share if lands == "unit" else 2 * share - 1


def scale_given_back(v: Column, lowest: float, highest: float, lands: str = "signed") -> Column:
    return lowest + (v if lands == "unit" else (v + 1) / 2) * (highest - lowest)


def was_missing(c: Column) -> Column:
    return F.when(c.isNull(), 1.0).otherwise(0.0)


def filled(c: Column, value: float, kind: str) -> Column:
    """Integers take the value rounded, halves away from zero."""
    if kind == "integer":
        return F.coalesce(c, F.lit(math.floor(abs(value) + 0.5) * (1 if value >= 0 else -1)).cast("bigint"))
    return F.coalesce(c, F.lit(float(value)))


def normalise_row(df: DataFrame, columns: list[str], norm: str) -> DataFrame:
    """Each row's present cells over their norm; cells are first divided by the largest, so that squares stay in range; a row of
    zeros stays as it is."""
    cells = [number(c) for c in columns]
    largest = F.greatest(*[F.coalesce(F.abs(c), F.lit(0.0)) for c in cells]) if len(cells) > 1 else F.coalesce(F.abs(cells[0]), F.lit(0.0))
    scaled = [F.coalesce(F.try_divide(c, largest), F.lit(0.0)) for c in cells]
    size = {"max": F.lit(1.0), "l1": reduce(lambda a, b: a + b, [F.abs(s) for s in scaled]), "l2": F.sqrt(reduce(lambda a, b: a + b, [s * s for s in scaled]))}[norm]
    return df.withColumns({c: F.when(largest == 0, x).otherwise(F.try_divide(F.try_divide(x, largest), size)) for c, x in zip(columns, cells, strict=True)})

"""Answers: one column, values rows ahead, shares of a whole, labels, several numbers; each with its checks and its way back."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidemark.operators.fits import Refused, Test, said
from tidemark.operators.series import STRETCH, along, edged, stretched, without_edges


def _c(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


def ahead_name(column: str, ahead: int) -> str:
    return f"{column}.ahead{ahead}"


def target_ahead(df: DataFrame, column: str, ahead: int, order: list[str], as_: str = "value", by: list[str] | None = None) -> DataFrame:
    """{column}.ahead{k}: the value k rows later, or how much it has changed by then (a gap where the value now is 0 or a gap)."""
    def made(window: WindowSpec) -> Column:
        later = F.lead(_c(column), ahead).over(window)
        return later if as_ == "value" else F.try_divide(later, _c(column)) - 1

    return over_series(df, {ahead_name(column, ahead): made}, ahead, order, by)


def over_series(df: DataFrame, made: dict[str, Callable[[WindowSpec], Column]], ahead: int, order: list[str], by: list[str] | None) -> DataFrame:
    """Columns that look so many rows ahead. A table that is one series is cut into stretches, which are shown the rows after them."""
    if by:
        return df.withColumns({n: f(Window.partitionBy(*by).orderBy(*order)) for n, f in made.items()})
    there = edged(stretched(df, order), order, ahead, ahead=True)
    return without_edges(there.withColumns({n: f(along(order)) for n, f in made.items()})).drop(STRETCH)


def ahead_back(prediction: Column, now: Column, as_: str) -> Column:
    return prediction if as_ == "value" else (prediction + 1) * now


def distribution_tests(columns: list[str], scale_by: str | None = None, remainder: str | None = None) -> list[Test]:
    """Where the columns are no shares of at least 0 that sum to 1, or with scale_by no counts out of that whole."""
    values = [_c(c) for c in columns]
    total, cells = reduce(lambda a, b: a + b, values), F.concat_ws(", ", *(v.cast("string") for v in values))
    there = reduce(lambda a, b: a & b, [v.isNotNull() for v in values])
    below = reduce(lambda a, b: a | b, [v < 0 for v in values])
    if scale_by is None:
        return [(there & (below | (F.abs(total - 1) > 1e-9 * len(columns))), cells, "target.distribution: the shares are at least 0 and sum to 1")]
    whole = _c(scale_by)
    limit = 1e-9 * len(columns) * F.greatest(F.abs(whole), F.lit(1.0))
    short = (total > whole + limit) if remainder else (F.abs(total - whole) > limit)
    return [(there & (whole.isNull() | (whole <= 0) | short | below), F.concat_ws(" of ", cells, whole.cast("string")), "target.distribution: the counts are part of their whole")]


def labels_tests(columns: list[str], ones: int = 0) -> list[Test]:
    values = [_c(c) for c in columns]
    bad = reduce(lambda a, b: a | b, [~v.isin(0.0, 1.0) for v in values])
    if ones:
        bad = bad | (reduce(lambda a, b: a + b, values) != ones)
    return [(bad, F.concat_ws(", ", *(v.cast("string") for v in values)), f"target.labels: each is 0 or 1{f', and {ones} of them are 1' if ones else ''}")]


def _refuse(df: DataFrame, tests: list[Test]) -> None:
    row = df.select(said(tests).alias("bad")).where("bad is not null").limit(1).collect()
    if row:
        raise Refused(row[0]["bad"].replace("\n", ": "))


def distributed(columns: list[str], scale_by: str | None = None, remainder: str | None = None) -> dict[str, Column]:
    """With scale_by the counts become shares of that whole; with a remainder what they leave of it becomes a share of its own."""
    if scale_by is None:
        return {}
    values, whole = [_c(c) for c in columns], _c(scale_by)
    made = {c: v / whole for c, v in zip(columns, values, strict=True)}
    if remainder:
        made[remainder] = F.greatest(F.lit(0.0), whole - reduce(lambda a, b: a + b, values)) / whole
    return made


def target_distribution(df: DataFrame, columns: list[str], scale_by: str | None = None, remainder: str | None = None) -> DataFrame:
    """df with shares of at least 0 that sum to 1; other rows are refused at once (a run refuses them with all others)."""
    _refuse(df, distribution_tests(columns, scale_by, remainder))
    return df.withColumns(distributed(columns, scale_by, remainder))


def target_labels(df: DataFrame, columns: list[str], ones: int = 0) -> DataFrame:
    """Each label is 0 or 1, and exactly `ones` of them are 1 where that is given."""
    _refuse(df, labels_tests(columns, ones))
    return df


def target_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing or len(columns) < 2:
        raise Refused(f"target.numbers: two columns at least that are there, not {columns}")
    return df

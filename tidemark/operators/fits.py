"""Transforms that learn from the training rows alone: statistics in one aggregation, then column expressions over what was learned.

sums() names the aggregates a step needs, learn() turns their values into what is kept, made() gives columns, what goes, and what is refused. Steps whose columns
do not depend on each other share one aggregation (learned_by, which plans/pipeline.py calls at each barrier). Quantiles and words are no
plain aggregates: a step names the shares it needs, or the words, and all columns are answered by one more pass (operators/quantiles.py).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.features import filled, was_missing
from tidemark.functions.kinds import cell_text, finite, is_not_finite
from tidemark.operators.quantiles import around, at_hand, exact
from tidemark.operators.series import carried, stretched

_EPSILON = 2.220446049250313e-16
LAMBDAS = [round(-2 + 0.05 * i, 2) for i in range(81)]
KNOTS = [i / 100 for i in range(101)]


class Refused(ValueError):
    """Data that a step does not take; row is the place, from 1, at which the first such row was read, where that is known."""

    def __init__(self, said: str, row: int | None = None):
        super().__init__(said)
        self.row = row


#: A category with more words than this is no category: it is refused before its words come to the driver.
MOST_WORDS = 10_000
#: A condition, the cell that is named where it holds, and what is wrong with it.
Test = tuple[Column, Column, str]


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _sql(name: str) -> str:
    """The column as a double, in SQL. Steps over many columns are told in SQL text: a call for each operation costs a driver more than the
    plan does."""
    return f"CAST(`{name}` AS DOUBLE)"


def _finite(name: str) -> str:
    return f"CASE WHEN NOT isnan({_sql(name)}) AND abs({_sql(name)}) <> double('infinity') THEN {_sql(name)} END"


def _odd(name: str) -> Column:
    return F.expr(f"count_if(isnan({_sql(name)}) OR abs({_sql(name)}) = double('infinity'))")


def _double(v: float) -> str:
    return f"{float(v)!r}D"


def _quoted(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def said(tests: list[Test]) -> Column:
    """What is wrong with a row, and its cell behind a line end; null where nothing is."""
    out = None
    for bad, cell, why in tests:
        told = F.concat(F.lit(f"{why}\n"), F.coalesce(cell.cast("string"), F.lit("a gap")))
        out = F.when(bad, told) if out is None else out.when(bad, told)
    return out


@dataclass(frozen=True)
class Fitted:
    """A step that learns from one column. made() is all that a replay does; apply() is made() over rows at hand, refused at once."""

    column: str

    def sums(self, df: DataFrame) -> dict[str, Column]:
        """Aggregates that learn() is given by name."""
        return {}

    def shares(self) -> list[float]:
        """Quantiles of the finite values that learn() is given as `q`."""
        return []

    def words(self, df: DataFrame) -> Column | None:
        """Text whose distinct values learn() is given as `words`."""
        return None

    def stats(self, df: DataFrame) -> dict[str, Column]:
        """All that learn() is given as aggregates of Spark's own, for a small table at hand. Runs take learned_by."""
        own, words = self.sums(df), self.words(df)
        own = own | ({"q": at_hand(finite(_c(self.column)), self.shares())} if self.shares() else {})
        return own | ({"words": F.collect_set(words)} if words is not None else {})

    def learn(self, s: dict) -> dict:
        raise NotImplementedError

    def made(self, df: DataFrame, learned: dict) -> tuple[dict[str, Column], list[str], list[Test]]:
        raise NotImplementedError

    def apply(self, df: DataFrame, learned: dict) -> DataFrame:
        columns, gone, tests = self.made(df, learned)
        if tests and not df.isStreaming:
            bad = df.select(said(tests).alias("bad")).where("bad is not null").limit(1).collect()
            if bad:
                why, cell = bad[0]["bad"].split("\n", 1)
                raise Refused(f"{why}: {cell}")
        return df.withColumns(columns).drop(*gone)


def _sums(one, df: DataFrame) -> dict[str, Column]:
    """A transform of one's own has stats() alone."""
    return one.sums(df) if isinstance(one, Fitted) else one.stats(df)


def learned_by(train: DataFrame, ones: list, observed: Callable[[DataFrame], DataFrame] = lambda df: df) -> list[dict]:
    """What each step learns of the training rows: one aggregation for all, one pass more for quantiles, one for words, if any ask for them.
    observed marks the rows that the aggregation reads (see the walk)."""
    sums = [_sums(one, train) for one in ones]
    columns = {f"s{k}_{n}": c for k, some in enumerate(sums) for n, c in some.items()}
    asking = [(k, one, finite(_c(one.column))) for k, one in enumerate(ones) if isinstance(one, Fitted) and one.shares()]
    for k, one, x in asking:
        columns |= {f"n{k}": F.count(x), f"q{k}": around(x, one.shares())}
    row = observed(train).agg(*(c.alias(n) for n, c in columns.items())).first().asDict() if columns else {}
    told = [{n: row[f"s{k}_{n}"] for n in some} for k, some in enumerate(sums)]
    if asking:
        found = exact(train, [x for _, _, x in asking], [one.shares() for _, one, _ in asking], [row[f"n{k}"] for k, _, _ in asking], [row[f"q{k}"] for k, _, _ in asking])
        for (k, _, _), q in zip(asking, found, strict=True):
            told[k]["q"] = q
    texts = {k: t for k, one in enumerate(ones) if isinstance(one, Fitted) and (t := one.words(train)) is not None}
    if texts:
        for k in texts:
            told[k]["words"] = []
        each = train.select(F.inline(F.array(*(F.struct(F.lit(k).alias("k"), t.alias("word")) for k, t in texts.items())))).where("word is not null").distinct()
        rows = each.limit(len(texts) * MOST_WORDS + 1).collect()  # bounded
        for r in rows:
            told[r["k"]]["words"].append(r["word"])
        for k in texts:
            if len(told[k]["words"]) > MOST_WORDS or len(rows) > len(texts) * MOST_WORDS:
                raise Refused(f"encode: {ones[k].column} has more than {MOST_WORDS} words")
    return [one.learn(t) for one, t in zip(ones, told, strict=True)]


@dataclass(frozen=True)
class FillMissing(Fitted):
    """mean, median, zero, constant, refuse; the marker {column}_was_missing is always written. A column whose share of gaps is over
    refuse_above goes, and only its marker stays. (with='previous' is fill_previous.)"""

    with_: str = "mean"
    constant: float = 0.0
    refuse_above: float | None = None

    def shares(self) -> list[float]:
        return [0.5] if self.with_ == "median" else []

    def sums(self, df: DataFrame) -> dict[str, Column]:
        own = {"rows": F.expr("count(1)"), "gaps": F.expr(f"count_if(`{self.column}` IS NULL)"), "odd": _odd(self.column)}
        return own | ({"value": F.expr(f"avg({_finite(self.column)})")} if self.with_ == "mean" else {})

    def learn(self, s: dict) -> dict:
        s = s | ({"value": (s["q"] or [None])[0]} if self.with_ == "median" else {})
        if self.with_ in ("mean", "median") and s["odd"]:
            raise Refused(f"fill.missing: {self.column} has {s['odd']} values that are no finite numbers")
        if self.with_ == "refuse" and s["gaps"]:
            raise Refused(f"fill.missing: {self.column} has {s['gaps']} gaps")
        share = s["gaps"] / s["rows"] if s["rows"] else 0.0
        value = {"zero": 0.0, "constant": self.constant, "refuse": 0.0}.get(self.with_, s.get("value"))
        keep = self.refuse_above is None or share <= self.refuse_above
        return {"value": value if value is not None else 0.0, "gaps": s["gaps"], "share": share, "filled": keep}

    def made(self, df: DataFrame, learned: dict) -> tuple[dict[str, Column], list[str], list[Test]]:
        marked = {f"{self.column}_was_missing": was_missing(_c(self.column))}
        if not learned["filled"]:
            return marked, [self.column], []
        kind = "integer" if df.schema[self.column].dataType.simpleString() in ("bigint", "int") else "number"
        return marked | {self.column: filled(_c(self.column), learned["value"], kind)}, [], []


def fill_previous(df: DataFrame, column: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Each gap takes the last value before it in the order (of its series, where `by` tells series apart); a gap with nothing before it is
    refused. Learns nothing. The first row of a series and its first value are compared for that: an aggregation, no ordering of rows."""
    place = F.struct(*(f"`{c}`" for c in order))
    ends = df.groupBy(*(by or [])).agg(F.min(place).alias("start"), F.min(F.when(_c(column).isNotNull(), place)).alias("value"))
    bad = ends.where("start is not null and (value is null or value > start)").limit(1).collect()
    if bad:
        raise Refused(f"fill.missing: {column} is a gap with nothing before it to carry forward at {tuple(bad[0]['start'])}")
    if not by:  # one series, in stretches
        marked = df.withColumn(f"{column}_was_missing", was_missing(_c(column)))
        return carried(stretched(marked, order), order, column).select(*marked.columns)
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(f"{column}_was_missing", was_missing(_c(column))).withColumn(column, F.last(_c(column), ignorenulls=True).over(window))


@dataclass(frozen=True)
class FillNaN(Fitted):
    with_: str = "refuse"
    constant: float = 0.0

    def shares(self) -> list[float]:
        return [0.5] if self.with_ == "median" else []

    def sums(self, df: DataFrame) -> dict[str, Column]:
        return {"odd": _odd(self.column)} | ({"value": F.expr(f"avg({_finite(self.column)})")} if self.with_ == "mean" else {})

    def learn(self, s: dict) -> dict:
        s = s | ({"value": (s["q"] or [None])[0]} if self.with_ == "median" else {})
        if self.with_ == "refuse" and s["odd"]:
            raise Refused(f"fill.nan: {self.column} has {s['odd']} values that are no finite numbers")
        value = {"zero": 0.0, "constant": self.constant, "refuse": 0.0}.get(self.with_, s.get("value"))
        return {"value": value if value is not None else 0.0, "notNumbers": s["odd"]}

    def made(self, df: DataFrame, learned: dict) -> tuple[dict[str, Column], list[str], list[Test]]:
        odd, c = is_not_finite(_c(self.column)), _c(self.column)
        if self.with_ == "refuse":
            return {}, [], [(odd, c, f"fill.nan: {self.column} is no finite number")]
        return {self.column: F.when(odd, F.lit(learned["value"])).otherwise(c)}, [], []


def yeo_johnson(v: Column, lam: float) -> Column:
    up = F.log1p(F.abs(v)) if lam == 0 else (F.pow(F.abs(v) + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(F.abs(v)) if lam == 2 else -(F.pow(F.abs(v) + 1, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(v >= 0, up).otherwise(down)


def yeo_johnson_back(s: Column, lam: float) -> Column:
    up = F.exp(s) - 1 if lam == 0 else F.pow(s * lam + 1, F.lit(1 / lam)) - 1
    down = 1 - F.exp(-s) if lam == 2 else 1 - F.pow(-(2 - lam) * s + 1, F.lit(1 / (2 - lam)))
    return F.when(s >= 0, up).otherwise(down)


@dataclass(frozen=True)
class Normalise(Fitted):
    """standard, minmax, midrange, maxabs, robust, quantile, power; out_of_range pass, clip or refuse (for scales with a range)."""

    scale: str = "midrange"
    out_of_range: str = "pass"

    def __post_init__(self) -> None:
        if self.scale == "quantile" and self.out_of_range == "pass":
            raise Refused("normalise: quantile cannot pass values out of range on")

    def shares(self) -> list[float]:
        return {"robust": [0.25, 0.5, 0.75], "quantile": KNOTS}.get(self.scale, [])

    @property
    def lands(self) -> tuple[float, float] | None:
        return {"minmax": (0, 1), "quantile": (0, 1), "midrange": (-1, 1), "maxabs": (-1, 1)}.get(self.scale)

    def sums(self, df: DataFrame) -> dict[str, Column]:
        x = F.expr(_finite(self.column)) if self.scale == "power" else None
        own = {"odd": _odd(self.column)} | {n: F.expr(f"{how}({_finite(self.column)})") for n, how in (("n", "count"), ("low", "min"), ("high", "max"))}
        if self.scale == "standard":
            own |= {n: F.expr(f"{how}({_finite(self.column)})") for n, how in (("mean", "avg"), ("sd", "stddev_pop"))}
        if self.scale == "power":
            own["logs"] = F.sum(F.signum(x) * F.log1p(F.abs(x)))
            for i, lam in enumerate(LAMBDAS):
                own |= {f"var{i}": F.var_pop(yeo_johnson(x, lam)), f"mean{i}": F.avg(yeo_johnson(x, lam))}
        return own

    def learn(self, s: dict) -> dict:
        if s["odd"]:
            raise Refused(f"normalise: {self.column} has {s['odd']} values that are no finite numbers")
        if not s["n"]:
            raise Refused(f"normalise: {self.column} has no value in the training rows")
        low, high, out = s["low"], s["high"], {}
        if self.scale == "standard":
            out = {"centre": s["mean"], "spread": s["sd"]}
        elif self.scale == "minmax":
            out = {"centre": low, "spread": high - low}
        elif self.scale == "midrange":
            out = {"centre": (low + high) / 2, "spread": (high - low) / 2}
        elif self.scale == "maxabs":
            out = {"centre": 0.0, "spread": max(abs(low), abs(high))}
        elif self.scale == "robust":
            out = {"centre": s["q"][1], "spread": s["q"][2] - s["q"][0]}
        elif self.scale == "quantile":
            return {"knots": list(s["q"])}
        else:
            # likelihood of each shape; the smallest lambda of equal ones
            best, lam = -math.inf, None
            for i, candidate in enumerate(LAMBDAS):
                if s[f"var{i}"] and s[f"var{i}"] > 0:
                    value = -s["n"] / 2 * math.log(s[f"var{i}"]) + (candidate - 1) * s["logs"]
                    if value > best:
                        best, lam = value, i
            lam = LAMBDAS.index(1.0) if lam is None else lam
            out = {"lambda": LAMBDAS[lam], "centre": s[f"mean{lam}"], "spread": math.sqrt(s[f"var{lam}"])}
        # A spread that rounding could have made is none.
        if out["spread"] <= s["n"] * _EPSILON * max(abs(low), abs(high)):
            out["spread"] = 1.0
        return out

    def _raw(self, v: Column, learned: dict) -> Column:
        if self.scale == "quantile":
            knots = learned["knots"]
            arr = F.array(*map(F.lit, knots))
            # the mean of the places where the value could stand among equal knots
            below, upto = F.size(F.filter(arr, lambda k: k < v)), F.size(F.filter(arr, lambda k: k <= v))
            a, b = F.try_element_at(arr, below), F.try_element_at(arr, below + 1)
            between = (below - 1 + F.coalesce(F.try_divide(v - a, b - a), F.lit(0.0))) / (len(knots) - 1)
            on = (below + upto - 1) / 2 / (len(knots) - 1)
            return F.when(v.isNull(), None).when(v <= knots[0], F.when(v == knots[0], on).otherwise(0.0)).when(v > knots[-1], 1.0).when(upto > below, on).otherwise(between)
        shaped = yeo_johnson(v, learned["lambda"]) if self.scale == "power" else v
        return (shaped - learned["centre"]) / learned["spread"]

    def made(self, df: DataFrame, learned: dict) -> tuple[dict[str, Column], list[str], list[Test]]:
        v = _c(self.column).cast("double")
        if self.scale == "quantile":
            out, knots = self._raw(v, learned), learned["knots"]
            tests = [((v < knots[0]) | (v > knots[-1]), v, f"normalise: {self.column} is out of the range of the training rows")]
            return {self.column: F.when(out.isNotNull(), F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0)))}, [], tests if self.out_of_range == "refuse" else []
        if not self.lands:
            return {self.column: self._raw(v, learned)}, [], []
        low, high = map(_double, self.lands)
        raw = f"(({_sql(self.column)} - {_double(learned['centre'])}) / {_double(learned['spread'])})"
        near = _double(_EPSILON * (abs(learned["centre"]) / learned["spread"] + 4))
        out = f"CASE WHEN abs({raw} - {low}) <= {near} THEN {low} WHEN abs({raw} - {high}) <= {near} THEN {high} ELSE {raw} END"
        if self.out_of_range == "clip":
            out = f"CASE WHEN {raw} <= {low} + {near} THEN {low} WHEN {raw} >= {high} - {near} THEN {high} ELSE {raw} END"
        tests = []
        if self.out_of_range == "refuse":
            tests = [(F.expr(f"{out} < {low} OR {out} > {high}"), v, f"normalise: {self.column} is out of the range of the training rows")]
        return {self.column: F.expr(out)}, [], tests

    def back(self, v: Column, learned: dict) -> Column:
        if self.scale == "quantile":
            arr = F.array(*map(F.lit, learned["knots"]))
            at = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * (len(learned["knots"]) - 1)
            k = F.least(F.floor(at), F.lit(len(learned["knots"]) - 2)).cast("int")
            return F.when(v.isNotNull(), arr[k] + (at - k) * (arr[k + 1] - arr[k]))
        raw = v * learned["spread"] + learned["centre"]
        return yeo_johnson_back(raw, learned["lambda"]) if self.scale == "power" else raw


@dataclass(frozen=True)
class ClipOutliers(Fitted):
    """bounds quantile (at: share cut at either end, 0 for the extremes), sigma or iqr (at: how many); outlier clip, blank or refuse."""

    bounds: str = "iqr"
    at: float = 1.5
    outlier: str = "clip"

    def shares(self) -> list[float]:
        return {"sigma": [], "iqr": [0.25, 0.75]}.get(self.bounds, [self.at, 1 - self.at])

    def sums(self, df: DataFrame) -> dict[str, Column]:
        own = {"odd": _odd(self.column)}
        return own | {n: F.expr(f"{how}({_finite(self.column)})") for n, how in (("mean", "avg"), ("sd", "stddev_pop"))} if self.bounds == "sigma" else own

    def learn(self, s: dict) -> dict:
        if s["odd"]:
            raise Refused(f"outliers.clip: {self.column} has {s['odd']} values that are no finite numbers")
        if s.get("mean") is None and s.get("q") is None:
            raise Refused(f"outliers.clip: {self.column} has no value in the training rows")
        if self.bounds == "sigma":
            return {"lower": s["mean"] - self.at * s["sd"], "upper": s["mean"] + self.at * s["sd"]}
        low, high = s["q"]
        reach = self.at * (high - low) if self.bounds == "iqr" else 0.0
        return {"lower": low - reach, "upper": high + reach}

    def made(self, df: DataFrame, learned: dict) -> tuple[dict[str, Column], list[str], list[Test]]:
        v, low, high = _c(self.column).cast("double"), F.lit(learned["lower"]), F.lit(learned["upper"])
        outside = (v < low) | (v > high)
        if self.outlier == "refuse":
            return {}, [], [(outside, v, f"outliers.clip: {self.column} is an outlier")]
        new = F.when(outside, None).otherwise(v) if self.outlier == "blank" else F.when(v < low, low).when(v > high, high).otherwise(v)
        return {self.column: new}, [], []


@dataclass(frozen=True)
class Encode(Fitted):
    """onehot or ordinal over the training rows' words, ascending; unseen words are reserved a place or refused. as 'places' gives the
    ordinal with -1 for a gap, as trees take it."""

    as_: str = "onehot"
    unseen: str = "reserve"

    def _text(self, df: DataFrame) -> Column:
        return cell_text(_c(self.column), df.schema[self.column].dataType)

    def words(self, df: DataFrame) -> Column | None:
        return self._text(df)

    def learn(self, s: dict) -> dict:
        words = sorted(s["words"], key=lambda w: w.encode("utf-16-be"))
        if self.as_ == "onehot" and {"other", "was_missing"} & set(words):
            raise Refused(f"encode: {self.column} has a category named other or was_missing")
        return {"categories": words}

    def made(self, df: DataFrame, learned: dict) -> tuple[dict[str, Column], list[str], list[Test]]:
        words, t = learned["categories"], self._text(df)
        if self.as_ == "onehot" and self.unseen == "reserve" and df.schema[self.column].dataType.typeName() == "string":
            c = f"`{self.column}`"
            told = {f"{self.column}_{w}": f"{c} = {_quoted(w)}" for w in words} | {f"{self.column}_other": f"{c} NOT IN ({', '.join(map(_quoted, words))})" if words else f"{c} IS NOT NULL", f"{self.column}_was_missing": f"{c} IS NULL"}
            return {n: F.expr(f"CASE WHEN {test} THEN 1.0D ELSE 0.0D END") for n, test in told.items()}, [self.column], []
        known = t.isin(*words) if words else F.lit(False)
        tests = [(t.isNotNull() & ~known, t, f"encode: {self.column} is a word that training has not seen")] if self.unseen == "refuse" else []
        if self.as_ == "onehot":
            made = {f"{self.column}_{w}": F.when(t == w, 1.0).otherwise(0.0) for w in words}
            if self.unseen == "reserve":
                made[f"{self.column}_other"] = F.when(t.isNotNull() & ~known, 1.0).otherwise(0.0)
            made[f"{self.column}_was_missing"] = was_missing(t)
            return made, [self.column], tests
        places = F.create_map(*(F.lit(x) for i, w in enumerate(words) for x in (w, float(i)))) if words else F.lit(None).cast("map<string,double>")
        gap = -1.0 if self.as_ == "places" else 0.0
        place = F.when(t.isNull(), gap).otherwise(F.coalesce(F.try_element_at(places, t), F.lit(float(len(words)))))
        made = {self.column: place} if self.as_ == "places" else {f"{self.column}_was_missing": was_missing(t), self.column: place}
        return made, [], tests


@dataclass(frozen=True)
class Piecewise(Fitted):
    """{column}_bin{i}: 0 below the bin, 1 above it, linear inside; the end bins go on unless out_of_range is clip."""

    bins: int = 4
    out_of_range: str = "clip"

    def shares(self) -> list[float]:
        return [k / self.bins for k in range(self.bins + 1)]

    def sums(self, df: DataFrame) -> dict[str, Column]:
        return {"odd": _odd(self.column)}

    def learn(self, s: dict) -> dict:
        if s["odd"]:
            raise Refused(f"encode.piecewise: {self.column} has values that are no finite numbers")
        edges = sorted(set(s["q"] or []))
        if len(edges) < 2:
            raise Refused(f"encode.piecewise: {self.column} has one value")
        return {"edges": edges}

    def made(self, df: DataFrame, learned: dict) -> tuple[dict[str, Column], list[str], list[Test]]:
        v, e, made = _c(self.column).cast("double"), learned["edges"], {}
        for i, (low, high) in enumerate(zip(e[:-1], e[1:], strict=True)):
            x = (v - low) / (high - low)
            floor = F.when(x < 0, 0.0) if i or self.out_of_range == "clip" else None
            last = i == len(e) - 2
            ceil = (x > 1) & F.lit(not last or self.out_of_range == "clip")
            made[f"{self.column}_bin{i}"] = (floor.when(ceil, 1.0) if floor is not None else F.when(ceil, 1.0)).otherwise(x)
        tests = [((v < e[0]) | (v > e[-1]), v, f"encode.piecewise: {self.column} is out of the range of the training rows")] if self.out_of_range == "refuse" else []
        return made, [self.column], tests


def words_in(c: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{Nd}]+"), "")


def _ids_of(tokens: list[str]) -> Callable[[Column], Column]:
    """The id of each word of a list: 1 where it is none of the tokens, which begin at 2. A batch looks all its words up in one hash table,
    where a map of Spark's compares each word with the tokens one by one."""
    known = pa.array(tokens, pa.string())

    @F.arrow_udf("array<int>")
    def ids(words: pa.Array) -> pa.Array:
        words = pa.concat_arrays([words])  # from its first offset on
        at = pc.index_in(words.flatten().cast(pa.string()), known)
        counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
        return pa.ListArray.from_arrays(offsets, pc.fill_null(pc.add(at, 2), 1).cast(pa.int32()), mask=words.is_null() if words.null_count else None)

    return ids


@dataclass(frozen=True)
class Tokenize:
    """Ids of a fixed length: 0 pads, 1 is unseen, words from 2 by falling count, then by name. Learns with a table, not a statistic."""

    column: str
    length: int = 16
    vocabulary: int = 1000

    def counts(self, train: DataFrame) -> DataFrame:
        return train.select(F.explode(words_in(_c(self.column))).alias("word")).groupBy("word").count()

    def fit(self, train: DataFrame) -> dict:
        top = self.counts(train).orderBy(F.desc("count"), "word").limit(self.vocabulary - 2)  # the vocabulary bounds it
        return {"tokens": [r["word"] for r in top.collect()]}

    def apply(self, df: DataFrame, learned: dict) -> DataFrame:
        words = F.slice(words_in(_c(self.column)), 1, self.length)
        return df.withColumn(self.column, self._padded(_ids_of(learned["tokens"])(words)))

    def _padded(self, found: Column) -> Column:
        found = F.coalesce(found, F.array().cast("array<int>"))
        return F.concat(found, F.array_repeat(F.lit(0), self.length - F.size(found)))


def _place(order: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in order]


@dataclass(frozen=True)
class History:
    """{into or value_history}: the mean of the key's earlier training values, drawn towards the training mean by `shrink` rows of it.

    Earlier is strictly before in the order columns; a window looks at the last so many distinct places that hold training rows. With
    known, rows of the table after the key's last training place count too. Training rows are summed by key and place, joined with
    the places asked for, and one running sum along each key answers all."""

    key: str
    value: str
    order: list[str] = field(default_factory=list)
    shrink: float = 1.0
    window: int | None = None
    into: str | None = None
    known: bool = False

    @property
    def name(self) -> str:
        return self.into or f"{self.value}_history"

    def fit(self, train: DataFrame) -> tuple[dict, DataFrame]:
        prior = train.agg(F.avg(finite(_c(self.value)))).first()[0]
        return {"prior": prior if prior is not None else 0.0}, self._sums(train)

    def _sums(self, df: DataFrame) -> DataFrame:
        x = finite(_c(self.value))
        there = df.where(_c(self.key).isNotNull() & x.isNotNull())
        return there.groupBy(_c(self.key).alias("_k"), *(c.alias(f"_o{i}") for i, c in enumerate(_place(self.order)))).agg(F.sum(x).alias("_s"), F.count(x).alias("_n"))

    def apply(self, df: DataFrame, learned: dict, sums: DataFrame) -> DataFrame:
        o = [f"_o{i}" for i in range(len(self.order))]
        asked = df.where(_c(self.key).isNotNull()).select(_c(self.key).alias("_k"), *(c.alias(f"_o{i}") for i, c in enumerate(_place(self.order)))).distinct()
        given = sums
        if self.known:
            last = sums.groupBy("_k").agg(F.max(F.struct(*o)).alias("_last"))
            later = self._sums(df).join(last, "_k", "left").where(F.col("_last").isNull() | (F.struct(*o) > F.col("_last"))).drop("_last")
            given = sums.unionByName(later)
        zero = asked.select("*", F.lit(0.0).alias("_s"), F.lit(0).cast("bigint").alias("_n"))
        placed = given.unionByName(zero).groupBy("_k", *o).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
        along = Window.partitionBy("_k").orderBy(*o)
        if self.window is None:
            before = along.rowsBetween(Window.unboundedPreceding, -1)
            told = placed.withColumn("_bs", F.sum("_s").over(before)).withColumn("_bn", F.sum("_n").over(before))
        else:
            # places that hold values are numbered; the sum is taken over numbers, not rows
            number = F.sum((F.col("_n") > 0).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, -1))
            placed = placed.withColumn("_p", F.coalesce(number, F.lit(0))).withColumn("_own", F.col("_p") + (F.col("_n") > 0).cast("int"))
            at = Window.partitionBy("_k").orderBy("_own").rangeBetween(-self.window, Window.currentRow)
            ahead = placed.withColumn("_q", F.when(F.col("_n") > 0, F.col("_own")))
            told = ahead.withColumn("_all", F.collect_list(F.when(F.col("_n") > 0, F.struct("_own", "_s", "_n"))).over(at))
            inside = F.filter("_all", lambda x: (x["_own"] <= F.col("_p")) & (x["_own"] > F.col("_p") - self.window))
            told = told.withColumn("_bs", F.aggregate(inside, F.lit(0.0), lambda s, x: s + x["_s"])).withColumn("_bn", F.aggregate(inside, F.lit(0).cast("bigint"), lambda s, x: s + x["_n"]))
        told = told.select("_k", *o, "_bs", "_bn")
        prior, shrink = learned["prior"], self.shrink
        match = [_c(self.key) == F.col("_k"), *(c.eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(_place(self.order)))]
        joined = df.join(told, match, "left")
        sums_, n = F.coalesce("_bs", F.lit(0.0)), F.coalesce("_bn", F.lit(0))
        mean = F.coalesce(F.try_divide(sums_ + shrink * prior, n + shrink), F.lit(prior))
        return joined.withColumn(self.name, mean).drop("_k", *o, "_bs", "_bn")

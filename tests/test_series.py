"""One series in many stretches against the same series in one piece."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import indicators
from tidemark.operators import fits, outputs, series


def prices(spark, n, gaps=0):
    rng = np.random.default_rng(n)
    close = 100 + rng.normal(size=n).cumsum()
    rows = [(i // 3, i, None if i < gaps else float(c), float(c + rng.random()), float(c - rng.random()), float(rng.integers(1, 100))) for i, c in enumerate(close)]
    return spark.createDataFrame(rows, "day bigint, at bigint, close double, high double, low double, volume double").repartition(5)


TAKES = {"obv": ["close", "volume"], "vwap": ["high", "low", "close", "volume"], "cci": ["high", "low", "close"], "williamsr": ["high", "low", "close"], "stochastic": ["high", "low", "close"], "atr": ["high", "low", "close"], "adx": ["high", "low", "close"]}


@pytest.mark.parametrize("name", sorted(indicators.INDICATORS))
@pytest.mark.parametrize("n,period,gaps", [(300, 5, 0), (40, 15, 0), (90, 4, 31)])
def test_stretches_say_what_one_series_says(spark, name, n, period, gaps):
    gaps = gaps if name in ("ema", "sma", "rsi", "macd") else 0
    df = prices(spark, n, gaps)
    columns, order = TAKES.get(name, ["close"]), ["day", "at"]
    made = [f"x{e}" for e in indicators.INDICATORS[name][1]]
    many = indicators.add_indicator(df, "x", name, period, columns, order)
    assert many.columns == [*df.columns, *made]
    one = indicators.add_indicator(df.withColumn("all", F.lit(1)), "x", name, period, columns, order, ["all"])
    a, b = (np.array([[np.nan if r[c] is None else r[c] for c in made] for r in t.orderBy("at").collect()], float) for t in (many, one))
    assert a.shape == (n, len(made)) and np.allclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True)
    assert series.stretched(df, order).select("_stretch").distinct().count() > 1


@pytest.mark.parametrize("ahead", [1, 7, 30])
def test_values_ahead(spark, ahead):
    df = prices(spark, 60)
    got = {r["at"]: r[f"close.ahead{ahead}"] for r in outputs.target_ahead(df, "close", ahead, ["day", "at"]).collect()}
    want = {r["at"]: r["v"] for r in df.withColumn("v", F.lead("close", ahead).over(Window.orderBy("at"))).collect()}
    assert got == want


def test_values_are_carried_over_stretches(spark):
    df = prices(spark, 120).withColumn("close", F.when((F.col("at") % 50 == 0), F.col("close")))
    told = fits.fill_previous(df, "close", ["day", "at"])
    want = {r["at"]: r["v"] for r in df.withColumn("v", F.last("close", ignorenulls=True).over(Window.orderBy("at"))).collect()}
    assert {r["at"]: r["close"] for r in told.collect()} == want and told.columns == [*df.columns, "close_was_missing"]


def test_a_series_ordered_by_words_is_one_stretch(spark):
    df = spark.createDataFrame([(f"w{i:03d}", float(i)) for i in range(50)], "w string, close double")
    got = indicators.add_indicator(df, "x", "sma", 3, ["close"], ["w"]).orderBy("w").collect()
    assert [r["x"] for r in got][:4] == [None, None, 1.0, 2.0]


def test_empty_series(spark):
    df = prices(spark, 3).where("at > 5")
    for name in ("sma", "obv", "ema", "adx"):
        assert indicators.add_indicator(df, "x", name, 3, TAKES.get(name, ["close"]), ["day", "at"]).collect() == []

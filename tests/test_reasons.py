"""Why-questions against plain loops over the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import reasons
from tidemark.operators.fits import Refused
from tidemark.plans.pipeline import create

N = 120
COLUMNS = [("id", "integer"), ("x", "number"), ("k", "category"), ("z", "number"), ("y", "number")]


def rows_of(spark, text=False):
    rng = np.random.default_rng(7)
    made = [(i, float(rng.normal()) if i % 9 else None, "abc"[int(rng.integers(3))], float(i % 5), float(rng.normal())) for i in range(N)]
    df = spark.createDataFrame(made, "id long, x double, k string, z double, y double").repartition(5)
    return df.select(*(F.col(c).cast("string") for c in df.columns)) if text else df


def fitted(spark, rows):
    columns = [{"name": n, "kind": k, **({"id": True} if n == "id" else {})} for n, k in COLUMNS]
    b = create().read_rows().declare(columns=columns).split_atRandom(seed=3).fill_missing(column="x", with_="median").normalise(column="x").encode(column="k")
    return b.target(column="y").normalise(column="y", scale="minmax").build().run(spark, rows)


def say(d):
    return d.withColumn("prediction", F.col("x") * F.col("x") + 2 * F.col("x") * F.col("k_a") - F.col("k_c"))


def plain(done, rows):
    """The answers to rows in the units of y, one by one, from what the fit has learned."""
    served = done.transform(rows)
    return {r["id"]: r["said"] for r in say(served).select("id", done.back(F.col("prediction")).alias("said")).collect()}


def test_reliance_is_what_dealing_by_hand_gives(spark):
    rows = rows_of(spark).cache()
    done = fitted(spark, rows)
    told = {r["column"]: r for r in done.reliance(rows, say, seed=5, repeats=6).collect()}
    assert set(told) == {"x", "k", "z"} and told["z"]["mean"] == 0 and told["z"]["spread"] == 0
    held = [r.asDict() for r in rows.collect()]
    base = plain(done, rows)
    pairs = [(a, b) for a in held for b in held]
    for c in ("x", "k"):  # the mean over all deals is the mean over all pairs of rows
        mixed = spark.createDataFrame([(i, *((b if n == c else a)[n] for n, _ in COLUMNS[1:])) for i, (a, b) in enumerate(pairs)], rows.schema)
        answers = plain(done, mixed)
        exact = np.mean([abs(answers[i] - base[a["id"]]) for i, (a, _) in enumerate(pairs)])
        assert told[c]["mean"] == pytest.approx(exact, rel=0.15) and told[c]["spread"] > 0
    assert done.reliance(rows, say, 5, 6).collect() == done.reliance(rows, say, 5, 6).collect()


def test_deals_are_permutations():
    import random

    for n in (1, 2, 3, 4, 12, 97):
        for a, b in reasons._factors(n, 5, random.Random(n)):
            assert sorted((a * i + b) % n for i in range(n)) == list(range(n))


@pytest.mark.parametrize("text", [False, True])
def test_dependence(spark, text):
    rows = rows_of(spark, text)
    done = fitted(spark, rows)
    told = done.dependence(rows, say, "k", 2).collect()
    assert [r["value"] for r in told] == ["a", "b", "c"]
    for r in told:
        assert r["mean"] == pytest.approx(np.mean(list(plain(done, rows.withColumn("k", F.lit(r["value"]))).values())))
    held = [float(r["x"]) for r in rows.collect() if r["x"] is not None]
    told = done.dependence(rows, say, "x", 4).collect()
    assert [float(r["value"]) for r in told] == pytest.approx(list(np.linspace(min(held), max(held), 4)))
    for r in told:
        assert r["mean"] == pytest.approx(np.mean(list(plain(done, rows.withColumn("x", F.lit(r["value"]).cast(rows.schema["x"].dataType))).values())))
    with pytest.raises(Refused, match="none of the columns"):
        done.dependence(rows, say, "y", 3)


def test_make_up_adds_up(spark):
    rows = rows_of(spark)
    done = fitted(spark, rows)
    told = done.make_up(rows, F.col("id") == 17, say, seed=2, repeats=40).collect()
    assert {r["column"] for r in told} == {"x", "k", "z"}
    assert sum(r["contribution"] for r in told) == pytest.approx(told[0]["said"] - told[0]["background"])
    assert told[0]["said"] == pytest.approx(plain(done, rows)[17]) and next(r for r in told if r["column"] == "z")["contribution"] == 0
    with pytest.raises(Refused, match="not there"):
        done.make_up(rows, F.col("id") == N, say, 2, 3)
    with pytest.raises(Refused, match="not the only one"):
        done.make_up(rows, F.col("id") < 2, say, 2, 3)


def test_an_additive_answer_is_made_of_its_terms(spark):
    rows = spark.createDataFrame([(float(i), float(i * i % 7), 0.0) for i in range(20)], "a double, b double, y double")
    done = create().read_rows().declare(columns=[{"name": n, "kind": "number"} for n in "aby"]).split_atRandom(seed=1).target(column="y").build().run(spark, rows)
    told = {r["column"]: r["contribution"] for r in done.make_up(rows, F.col("a") == 9, lambda d: d.withColumn("prediction", 2 * F.col("a") + F.col("b")), 3, 20).collect()}
    assert told["a"] == pytest.approx(2 * (9 - 9.5)) and told["b"] == pytest.approx(81 % 7 - np.mean([i * i % 7 for i in range(20)]))


def test_series_are_read_within_each_deal(spark):
    rows = spark.createDataFrame([(f"2024-01-{i + 1:02}", float(i * i % 11) if i % 5 else (0.5 if i == 0 else None), float(i)) for i in range(24)], "day string, v double, y double").repartition(3)
    columns = [{"name": "day", "kind": "timestamp"}, {"name": "v", "kind": "number"}, {"name": "y", "kind": "number"}]
    b = create().read_rows().declare(columns=columns).order_by(columns=["day"]).split_byTime(column="day").fill_missing(column="v", with_="previous")
    done = b.drop_columns(columns=["day"]).target(column="y").build().run(spark, rows)
    told = done.dependence(rows, lambda d: d.withColumn("prediction", F.col("v")), "v", 3).collect()
    assert [r["mean"] for r in told] == pytest.approx([float(r["value"]) for r in told])
    # Without gaps nothing is taken from other rows, so the moments do not matter.
    lean = done.reliance(rows.dropna(subset=["v"]), lambda d: d.withColumn("prediction", F.col("v")), 4, 3).collect()
    assert {r["column"]: r["mean"] > 0 for r in lean} == {"v": True, "day": False}


def test_rows_that_do_not_come_back_are_refused(spark):
    rows = rows_of(spark)
    columns = [{"name": n, "kind": k} for n, k in COLUMNS]
    done = create().read_rows().declare(columns=columns).drop_gaps(columns=["x"]).split_atRandom(seed=3).drop_columns(columns=["k"]).target(column="y").build().run(spark, rows)
    for ask in (lambda: done.reliance(rows, lambda d: d.withColumn("prediction", F.col("x")), 1, 2), lambda: done.dependence(rows, lambda d: d.withColumn("prediction", F.col("x")), "z", 2)):
        with pytest.raises(Refused, match="other rows"):
            ask()
    with pytest.raises(Refused, match="no rows"):
        done.reliance(rows.where("false"), lambda d: d.withColumn("prediction", F.col("x")), 1, 2)

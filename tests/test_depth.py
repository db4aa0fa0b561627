"""Exact quantiles by ranges, refusals in the plan, verified ways back, fits kept whole."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evidence, fits, quantiles
from tidemark.operators.fits import Refused
from tidemark.plans.pipeline import Prepared, create

NUMBERS = [0.0, 1.0, -3.5, 2.25, 2.25, 2.25, 1e300, -1e300, 7.0, 7.5]


@pytest.mark.parametrize("here", [0, 100_000])
def test_quantiles_are_exact(spark, monkeypatch, here):
    monkeypatch.setattr(quantiles, "MOST_HERE", here)
    rng = np.random.default_rng(3)
    rows = [(float(a), int(b), float(c), None if i % 3 else float(a)) for i, (a, b, c) in enumerate(zip(rng.normal(size=6000), rng.integers(-(2**62), 2**62, 6000), rng.integers(0, 4, 6000), strict=True))]
    df = spark.createDataFrame(rows, "a double, b bigint, c double, d double").repartition(6)
    shares = [0, 0.01, 0.25, 0.5, 0.75, 0.999, 1]
    got = quantiles.quantiles(df, [F.col("a"), F.col("c"), F.col("d"), F.lit(None).cast("double")], shares)
    for k, column in enumerate((0, 2, 3)):
        want = np.quantile([r[column] for r in rows if r[column] is not None], shares)
        assert np.allclose(got[k], want, rtol=1e-14, atol=0)
    assert got[3] is None
    n, gaps, at = quantiles.places(df, F.col("b"), lambda n: [n // 10, n // 2, n - 1])
    order = sorted(r[1] for r in rows)
    assert (n, gaps) == (6000, 0) and {p: x.value for p, x in at.items()} == {p: order[p] for p in (600, 3000, 5999)}


@pytest.mark.parametrize("here", [0, 100_000])
def test_bounds_that_miss_are_widened(spark, monkeypatch, here):
    monkeypatch.setattr(quantiles, "MOST_HERE", here)
    df = spark.createDataFrame([(x,) for x in NUMBERS], "x double")
    at = quantiles.places_at(df, [F.col("x")], [[7.2, 7.3, 900.0, 901.0]], [[0, 4, 9]], [10])[0]
    assert {p: (x.value, x.below, x.held) for p, x in at.items()} == {0: (-1e300, 0, 1), 4: (2.25, 4, 3), 9: (1e300, 9, 1)}
    assert quantiles.places_at(df, [F.col("x")], [[0.0, 0.0]], [[30]], [10]) == [{}]


def test_spearman_of_many_columns_is_one_table(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, (400, 5)).astype(float)
    x[:, 4] = 3.0
    df = spark.createDataFrame(x.tolist(), [f"c{i}" for i in range(5)]).repartition(3)
    rank = lambda v: np.array([(v < y).sum() + ((v == y).sum() + 1) / 2 for y in v])
    ranks = np.column_stack([rank(x[:, i]) for i in range(5)])
    for r in evidence.correlation(df, df.columns, "spearman").collect():
        i, j = int(r["left"][1]), int(r["right"][1])
        want = np.nan if 4 in (i, j) else np.corrcoef(ranks[:, i], ranks[:, j])[0, 1]
        assert (math.isnan(want) and math.isnan(r["coefficient"])) or abs(r["coefficient"] - want) < 1e-12
        assert (r["kept"], r["total"]) == (400, 400)


# -- refusals


def rows_of(spark, **more):
    cells = [(i, float(i), "ab"[i % 2], float(i % 5)) for i in range(40)]
    return spark.createDataFrame(cells, "i bigint, x double, w string, y double").coalesce(1)


def plan(*verbs, columns=(("i", "integer"), ("x", "number"), ("w", "category"), ("y", "number"))):
    b = create().read_rows().declare(columns=[{"name": n, "kind": k, **({"id": True} if n == "i" else {})} for n, k in columns])
    for verb, params in verbs:
        b = b.add(verb, **params)
    return b.build()


DEALT = ("split.atRandom", {"seed": 5, "byId": True})


def test_the_first_refusing_step_is_told_with_its_row(spark):
    both = plan(("maths", {"column": "x", "maths": "sqrt"}), ("maths", {"column": "y", "maths": "log"}), DEALT)
    with pytest.raises(Refused, match="maths: y has a value without a log: row 1 holds 0.0") as e:
        both.run(spark, rows_of(spark))
    assert e.value.row == 1
    bad = rows_of(spark).withColumn("x", F.when(F.col("i") == 20, -4.0).otherwise(F.col("x")))
    with pytest.raises(Refused, match="x has a value without a sqrt: row 21 holds -4.0"):
        plan(("maths", {"column": "x", "maths": "sqrt"}), DEALT).run(spark, bad)


def test_rows_are_counted_over_partitions(spark):
    many = spark.range(0, 5000, 1, 7).select(F.col("id").alias("i"), F.when(F.col("id") == 4321, -1.0).otherwise(1.0).alias("x"))
    with pytest.raises(Refused, match="row 4322 holds -1.0"):
        plan(("maths", {"column": "x", "maths": "log"}), columns=(("i", "integer"), ("x", "number"))).run(spark, many)


def test_refused_at_a_barrier_below_and_before_rows_go(spark):
    gaps = rows_of(spark).withColumn("y", F.when(F.col("i") != 7, F.col("y")))
    with pytest.raises(Refused, match="settle.gaps: y has gaps: row 8 holds a gap"):
        plan(("settle.gaps", {"column": "y", "with": "refuse"}), ("drop.gaps", {"columns": ["y"]}), DEALT).run(spark, gaps)
    with pytest.raises(Refused, match="settle.gaps: y has gaps: row 8"):
        plan(("settle.gaps", {"column": "y", "with": "refuse"}), DEALT, ("normalise", {"column": "x"})).run(spark, gaps)
    with pytest.raises(Refused, match="outliers.clip: x is an outlier: row"):
        plan(DEALT, ("outliers.clip", {"column": "x", "bounds": "quantile", "at": 0.3, "outlier": "refuse"}), ("normalise", {"column": "y"})).run(spark, rows_of(spark))


def test_an_id_with_a_gap_is_refused(spark):
    gap = rows_of(spark).withColumn("i", F.when(F.col("i") != 11, F.col("i")))
    with pytest.raises(Refused, match="split.atRandom: rows are dealt by i: row 12 holds a gap"):
        plan(DEALT).run(spark, gap)


def test_a_batch_names_the_row_that_a_learner_cannot_take(spark):
    gap = rows_of(spark).withColumn("y", F.when(F.col("i") != 13, F.col("y")))
    done = plan(("split.atRandom", {"seed": 5, "byId": True, "train": 1.0, "validation": 0.0, "test": 0.0}), ("encode", {"column": "w"}), ("target", {"column": "x"})).run(spark, gap)
    with pytest.raises(Refused, match=r"y \(first in row 14\)"):
        done.batch("train")


def test_a_stream_takes_refusing_steps_and_fails_on_the_bad_row(spark, tmp_path):
    done = plan(DEALT, ("encode", {"column": "w", "unseen": "refuse"}), ("normalise", {"column": "x", "scale": "minmax", "outOfRange": "clip"}), ("target", {"column": "y"})).run(spark, rows_of(spark))
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    rows_of(spark).write.parquet(good)
    rows_of(spark).withColumn("w", F.when(F.col("i") == 5, "c").otherwise(F.col("w"))).write.parquet(bad)

    def served(path, name):
        stream = spark.readStream.schema("i bigint, x double, w string, y double").parquet(path)
        asked = done.transform(stream).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        asked.awaitTermination(60)
        return spark.table(name)

    assert served(good, "good_rows").count() == 40
    with pytest.raises(Exception, match="encode: w is a word that training has not seen: c"):
        served(bad, "bad_rows")
    with pytest.raises(Refused, match="encode: w is a word that training has not seen: row 6 holds c"):
        done.transform(spark.read.parquet(bad))


def test_too_many_words_are_refused(spark, monkeypatch):
    monkeypatch.setattr(fits, "MOST_WORDS", 3)
    words = rows_of(spark).withColumn("w", F.concat(F.lit("w"), F.col("i")))
    with pytest.raises(Refused, match="encode: w has more than 3 words"):
        plan(DEALT, ("encode", {"column": "w"})).run(spark, words)


# -- ways back


def chain(*verbs):
    return plan(*verbs, ("target", {"column": "x"}))


def test_ways_back_are_verified(spark):
    done = chain(("maths", {"column": "x", "maths": "log1p"}), DEALT, ("normalise", {"column": "x", "scale": "standard"})).run(spark, rows_of(spark))
    assert done.way_back["x"] < 1e-9 and not [c for c in done.df.columns if c.startswith("_kept_")]
    square = chain(("maths", {"column": "x", "maths": "square"}), DEALT).run(spark, rows_of(spark))
    assert square.df.select(F.max(F.abs(square.back(F.col("x")) - F.col("i")))).first()[0] < 1e-12
    with pytest.raises(Exception, match="a square is never negative"):
        square.df.select(square.back(F.lit(-1.0))).collect()


def test_answers_without_a_way_back_are_refused(spark):
    low = rows_of(spark).withColumn("x", F.col("x") - 20)
    with pytest.raises(Refused, match=r"way back of x does not lead back through step 3 \(maths\): row 1 was -20.0, became 400.0, and comes back as 20.0"):
        chain(("maths", {"column": "x", "maths": "square"}), DEALT).run(spark, low)
    for shape in ("abs", "sign"):
        with pytest.raises(Refused, match=f"step 3: {shape} of the answer x has no way back"):
            chain(("maths", {"column": "x", "maths": shape}), DEALT).run(spark, rows_of(spark))
    plan(("maths", {"column": "x", "maths": "abs"}), DEALT, ("target", {"column": "y"})).run(spark, low)  # no answer, no matter


def test_an_answer_ahead_comes_back_to_the_later_row(spark):
    days = spark.range(0, 30, 1, 1).select(F.timestamp_seconds(F.col("id") * 86400).alias("t"), (F.col("id") * F.col("id") + 1.0).alias("v"))
    b = create().read_rows().declare(columns=[{"name": "t", "kind": "timestamp"}, {"name": "v", "kind": "number"}]).order_by(columns=["t"])
    done = b.split_byTime(column="t", gap=2).target_ahead(column="v", ahead=2, as_="return").build().run(spark, days)
    assert done.way_back["v.ahead2"] < 1e-9


# -- fits in files


def kept_fit(spark, path):
    rows = rows_of(spark).withColumn("x", F.col("x") * 2 + 1)
    d = plan(
        ("split.atRandom", {"seed": 5, "byId": True, "train": 0.5, "validation": 0.2, "test": 0.1, "calibration": 0.2}), ("encode", {"column": "w"}), ("normalise", {"column": "x", "scale": "standard"}),
        ("target", {"column": "x"}), ("evidence.report", {"metrics": ["rmse", "coverage"], "parts": ["validation", "test"], "shown": "numbers"}),
    )
    done = d.run(spark, rows)
    done.interval(predict, 0.2)
    done.save(path)
    return rows, done, Prepared.load(spark, path)


def predict(rows):
    return rows.withColumn("prediction", F.col("y") / 5 - 0.4)


def test_a_fit_read_from_a_file_is_whole(spark, tmp_path):
    rows, done, kept = kept_fit(spark, str(tmp_path / "fit"))
    entries = lambda p: sorted(map(tuple, p.fit_entries().collect()))
    assert entries(kept) == entries(done) and dict(entries(kept))["rows.train"] == "20"
    assert kept.margins == done.margins and kept.way_back == done.way_back and kept.fit_digest() == done.fit_digest()
    said = str(tmp_path / "said")
    done.predictions(predict).write.parquet(said)
    told = lambda m: sorted(map(tuple, m.collect()))
    assert told(kept.measure_again(said, rows=rows)) == told(done.measure(predict))
    with pytest.raises(Refused, match="other rows than those of the fit"):
        kept.measure_again(said, rows=rows.withColumn("y", F.col("y") + 1))
    with pytest.raises(Refused, match="another fit"):
        done.measure_again(spark.read.parquet(said).withColumn("fit", F.lit("x")))


def test_a_small_window_is_watched_like_a_large_one(spark, monkeypatch):
    kept = spark.createDataFrame([(i % 7 * 1.5, "abc"[i % 3], None, i % 11) for i in range(500)], "x double, w string, g double, k bigint")
    window = spark.createDataFrame([(i % 5 * 1.5 + (i % 2) / 4, "bcd"[i % 3], None, 20) for i in range(90)], "x double, w string, g double, k bigint")
    tallied = evidence.tallies(kept, kept.columns)
    told = lambda: sorted((r["column"], None if r["distance"] is None else round(r["distance"], 12), r["warned"]) for r in evidence.watched(tallied, window, kept.columns, 0.3).collect())
    small = told()
    monkeypatch.setattr(evidence, "MOST_WATCHED", 3)
    assert small == told() and [t[0] for t in small] == ["k", "w", "x"] and dict((t[0], t[1]) for t in small)["k"] == 1.0
    monkeypatch.undo()
    assert evidence.watched(tallied, window.where("false"), kept.columns, 0.3).where("distance is not null").count() == 0

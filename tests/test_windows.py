"""What a window is told beside how far it is: rows, gaps, and from when to when it is."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators.fits import Refused
from tidemark.plans.pipeline import Prepared, create

COLUMNS = [{"name": "at", "kind": "timestamp"}, {"name": "x", "kind": "number"}, {"name": "w", "kind": "category"}, {"name": "y", "kind": "number"}]


def rows(spark, first, n):
    start = datetime.datetime(2020, 1, 1)
    told = [((start + datetime.timedelta(days=i)).isoformat(), None if i % 7 == 0 else float(i % 10), None if i % 5 == 0 else "ab"[i % 2], float(i)) for i in range(first, first + n)]
    return spark.createDataFrame(told, "at string, x double, w string, y double")


def built(watch=True):
    b = create().read_rows().declare(columns=COLUMNS).order_by(columns=["at"]).split_by_time(column="at", train=0.7, validation=0.0, test=0.3)
    b = b.watch_reference(warnAbove=0.2, columns=["x", "w"]) if watch else b
    return b.target(column="y").build()


def test_rows_gaps_and_moments(spark, tmp_path):
    done = built().run(spark, rows(spark, 0, 100))
    done.save(str(tmp_path / "fit"))
    for one in (done, Prepared.load(spark, str(tmp_path / "fit"))):
        window = one.transform(rows(spark, 200, 30))
        told = {r["column"]: r for r in one.watched_window(window).collect()}
        x, w = told["x"], told["w"]
        assert (x.training_rows, x.training_gaps, x.window_rows, x.window_gaps) == (60, 10, 26, 4) and (w.training_rows, w.training_gaps, w.window_rows, w.window_gaps) == (56, 14, 24, 6)
        assert x["from"] == w["from"] == datetime.datetime(2020, 7, 19) and x["to"] == datetime.datetime(2020, 8, 17)
        plain = {r["column"]: (r.distance, r.warned) for r in one.watched(window).collect()}
        assert {c: (r.distance, r.warned) for c, r in told.items()} == plain


def test_windows_without_rows_values_or_order(spark):
    done = built().run(spark, rows(spark, 0, 100))
    window = done.transform(rows(spark, 200, 30))
    empty = done.watched_window(window.where("false")).collect()
    assert sorted((r["column"], r.distance, r.warned, r.window_rows, r["from"]) for r in empty) == [("w", None, False, 0, None), ("x", None, False, 0, None)]
    gaps = {r["column"]: r for r in done.watched_window(window.withColumn("x", F.lit(float("nan"))).drop("at")).collect()}
    assert (gaps["x"].window_rows, gaps["x"].window_gaps, gaps["x"].distance, gaps["x"]["to"]) == (0, 30, None, None)
    with pytest.raises(Refused, match="keeps 0"):
        built(False).run(spark, rows(spark, 0, 20)).watched_window(window)

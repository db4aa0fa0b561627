"""What a run can be asked: its file, measures, needs, fit entries, views, alerts, watched windows, learners."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evidence, fits, measures
from tidemark.plans.pipeline import Declaration, Prepared, create
from tidemark.plans.verbs import step

FILE = [
    {"step": "read.join", "left": {"kind": "csv", "path": "planned.csv"}, "right": {"kind": "csv", "path": "arrived.csv"}, "on": ["key"], "unmatched": "refuse"},
    {"step": "learn.ml", "trainer": {"kind": "fastTree", "leaves": 20, "trees": 100, "leastRows": 10, "rate": 0.2}, "seed": 20260929},
    {"step": "learn.network", "layers": [{"kind": "dense", "units": 16}, {"kind": "relu"}], "optimizer": {"kind": "adam", "rate": 0.001}, "loss": {"kind": "meanSquaredError"}, "stopping": {"kind": "never"}, "engine": "light", "seed": 1, "epochs": 100, "batch": 32},
    {"step": "evidence.report", "metrics": ["rmse"], "parts": ["validation", "test"], "shown": ["numbers"]},
    {"step": "split.byTime", "column": "when", "train": 0.7, "validation": 0.15, "test": 0.15, "predict": 0, "origins": 3, "origin": 0},
]


def test_steps_are_written_by_step_and_parts_by_kind():
    for one in FILE:
        assert step(one["step"], **{k: v for k, v in one.items() if k != "step"}).verb == one["step"]
    with pytest.raises(ValueError, match="part"):
        step("read.join", left={"csv": "a", "path": "b"}, right=FILE[0]["right"], on=["key"])
    with pytest.raises(ValueError, match="later"):
        Declaration.from_json(json.dumps({"version": 17, "declaration": [{"step": "read.nowhere"}]}))
    old = {"declaration": [{"step": "read.csv", "path": "x.csv"}, {"step": "declare", "remainder": "drop", "columns": [{"name": "a", "kind": "number", "optional": False}]}, {"step": "target", "column": "a"}]}
    read = Declaration.from_json(json.dumps(old))
    assert [s.verb for s in read.steps] == ["read.csv", "declare", "target"]
    assert list(json.loads(read.to_json())) == ["version", "declaration"] and json.loads(read.to_json())["declaration"][0]["step"] == "read.csv"


def test_join_by_the_verb(spark, tmp_path):
    (tmp_path / "l.csv").write_text("k,v\na ,1\nb,2\nz,3\n")
    (tmp_path / "r.csv").write_text("k,w\na,x\nb,y\n")
    part = lambda n: {"kind": "csv", "path": str(tmp_path / n)}
    columns = [{"name": "k", "kind": "category"}, {"name": "v", "kind": "number"}, {"name": "w", "kind": "category"}]
    b = create().read_join(left=part("l.csv"), right=part("r.csv"), on=["k"], unmatched="drop").declare(columns=columns)
    done = b.split_at_random(train=0.5, validation=0.0, test=0.5).target(column="v").build().run(spark)
    assert sorted((r.k.strip(), r.v, r.w) for r in done.df.collect()) == [("a", 1.0, "x"), ("b", 2.0, "y")]
    entries = {r.name: r.value for r in done.fit_entries().collect()}
    assert entries["rows.unmatched"] == "1" and entries["rows.train"] == "1" and len(entries["digest"]) == 64


def table(spark, n=200):
    rng = np.random.default_rng(7)
    rows = [(f"2020-01-{1 + i % 28:02d}T{i % 24:02d}:00:00Z", i, float(x), float(abs(x) * 3 + 1), "abc"[i % 3], float(i % 2), float(1 - i % 2)) for i, x in enumerate(rng.normal(size=n).round(4))]
    return spark.createDataFrame(rows, "at string, id long, x double, y double, w string, one double, two double")


COLUMNS = [
    {"name": "at", "kind": "timestamp"}, {"name": "id", "kind": "integer", "id": True}, {"name": "x", "kind": "number"}, {"name": "y", "kind": "number"},
    {"name": "w", "kind": "category"}, {"name": "one", "kind": "number"}, {"name": "two", "kind": "number"},
]


def declared(*names):
    return create().read_rows().declare(columns=[c for c in COLUMNS if c["name"] in ("id", *names)])


def test_measures_are_in_the_answers_own_units_beside_the_average(spark):
    b = declared("x", "y").maths(column="y", maths="log1p").split_at_random(seed=2)
    done = b.normalise(column="y", scale="standard").target(column="y").evidence_report(metrics=["rmse", "mae", "r2", "mape", "coverage", "width"], parts=["train", "test"]).build().run(spark, table(spark))
    predict = lambda d: d.withColumn("prediction", F.col("y") * 0.9)
    told = {(r.part, r.metric): (r.model, r.baseline) for r in done.measure(predict, [1.5]).collect()}
    assert set(told) == {(p, m) for p in ("train", "test") for m in ("rmse", "mae", "r2", "mape", "coverage", "width")}
    average = np.mean([r.y for r in done.part("train").collect()])
    for part in ("train", "test"):
        rows = done.part(part).select("y", done.back(F.col("y")).alias("own"), done.back(F.col("y") * 0.9).alias("said"), done.back(F.lit(float(average))).alias("base")).collect()
        own, said, base = (np.array([getattr(r, k) for r in rows]) for k in ("own", "said", "base"))
        for k, p in enumerate((said, base)):
            e = own - p
            want = {"rmse": math.sqrt((e * e).mean()), "mae": abs(e).mean(), "r2": 1 - (e * e).sum() / ((own - own.mean()) ** 2).sum(), "mape": abs(e / own).mean(), "coverage": (abs(e) <= 1.5).mean(), "width": 3.0}
            for m, v in want.items():
                assert told[part, m][k] == pytest.approx(v), m
    assert {r.metric for r in done.measure(predict).collect()} == {"rmse", "mae", "r2", "mape"}
    kept = done.predictions(predict)
    again = {(r.part, r.metric): r.model for r in done.measure_again(kept).collect()}
    assert again["test", "rmse"] == pytest.approx(told["test", "rmse"][0])
    with pytest.raises(fits.Refused, match="another fit"):
        done.measure_again(kept.withColumn("fit", F.lit("x")))
    with pytest.raises(fits.Refused, match="finite"):
        done.measure(lambda d: d.withColumn("prediction", F.lit(float("nan"))))


def test_measures_of_classes_and_of_labels(spark):
    b = declared("x", "one", "two").split_at_random(seed=2).target_labels(columns=["one", "two"], ones=1)
    metrics = ["accuracy", "precision", "recall", "f1", "brier", "auc", "confusionmatrix"]
    done = b.evidence_report(metrics=metrics, parts=["train"]).build().run(spark, table(spark))
    said = lambda d: d.withColumns({"prediction_0": F.when(F.col("x") > 0.3, 0.8).otherwise(F.col("one") * 0.5 + 0.2), "prediction_1": F.when(F.col("x") > 0.3, 0.2).otherwise(0.8 - F.col("one") * 0.5)})
    rows = said(done.batch("train")).collect()
    told = done.measure(said).collect()
    got = {r.metric: r.model for r in told if r.metric != "confusionmatrix"}
    held = np.array([[r.one > 0.5, r.two > 0.5] for r in rows])
    p = np.array([[r.prediction_0, r.prediction_1] for r in rows])
    named = np.array([[a >= b, b > a] for a, b in p])
    assert got["accuracy"] == pytest.approx((held == named).all(axis=1).mean())
    assert got["precision"] == pytest.approx(np.mean([(held[:, k] & named[:, k]).sum() / max(named[:, k].sum(), 1) for k in (0, 1)]))
    assert got["f1"] == pytest.approx(np.mean([2 * (held[:, k] & named[:, k]).sum() / (held[:, k].sum() + named[:, k].sum()) for k in (0, 1)]))
    assert got["brier"] == pytest.approx(((p - held) ** 2).sum(axis=1).mean())
    wins = lambda k: np.mean([(a > b) + (a == b) / 2 for a in p[held[:, k], k] for b in p[~held[:, k], k]])
    assert got["auc"] == pytest.approx((wins(0) + wins(1)) / 2)
    cells = {(r.held, r.said): r.model for r in told if r.metric == "confusionmatrix"}
    assert cells["two", "one"] == (held[:, 1] & named[:, 0]).sum() and sum(cells.values()) == len(rows)


def test_measures_of_shares(spark):
    df = spark.createDataFrame([(i, float(i % 4 + 1), float(i % 3 + 1), 10.0) for i in range(40)], "id long, a double, b double, whole double")
    columns = [{"name": n, "kind": "number"} for n in ("a", "b", "whole")]
    b = create().read_rows().declare(columns=[COLUMNS[1], *columns]).split_at_random(seed=1).target_distribution(columns=["a", "b"], scaleBy="whole", remainder="rest", ordered=True)
    done = b.evidence_report(metrics=["kl", "emd", "rps"], parts=["train"]).build().run(spark, df)
    got = {r.metric: r.model for r in done.measure(lambda d: d.withColumns({"prediction_0": F.lit(0.3), "prediction_1": F.lit(0.3), "prediction_2": F.lit(0.4)})).collect()}
    truth = np.array([[r.a, r.b, r.rest] for r in done.part("train").collect()])
    two = truth[:, :2] / truth[:, :2].sum(axis=1, keepdims=True)
    assert got["kl"] == pytest.approx((truth * np.log(truth / [0.3, 0.3, 0.4])).sum(axis=1).mean())
    assert got["emd"] == pytest.approx(abs(two[:, 0] - 0.5).mean()) and got["rps"] == pytest.approx(((two[:, 0] - 0.5) ** 2).mean())


def test_needs(spark):
    b = declared("x", "w", "y", "one").split_at_random(seed=2).normalise(column="x", scale="standard").normalise(column="one").encode(column="w").normalise(column="y").target(column="y").build()
    df = table(spark)
    done = b.run(spark, df)
    assert done.batch("train").columns[:2] == ["x", "one"]
    with pytest.raises(fits.Refused, match="between -1 and 1: x"):
        done.batch("train", "oneScale")
    trees = b.run_for(spark, "noScale", df)
    assert trees.skipped == {3: "out", 4: "out"} and {r.id: r.x for r in trees.df.collect()} == {r.id: r.x for r in df.collect()}
    with pytest.raises(fits.Refused, match="left out"):
        trees.batch("train", "numbers")
    places = b.run_for(spark, "categories", df)
    assert places.skipped == {3: "out", 4: "out", 5: "places"} and {r.w for r in places.batch("test", "categories").collect()} == {0.0, 1.0, 2.0}
    assert {r.w for r in places.transform(df.withColumn("w", F.lit("new"))).collect()} == {3.0}
    assert b.run_for(spark, "oneScale", df).skipped == {}


def test_views_do_not_fit_again(spark, tmp_path):
    b = declared("at", "x", "y", "w").order_by(columns=["at", "id"]).drop_gaps(columns=["x"]).feature_add(column="xx", left="x", arithmetic="times", right="x").split_byTime(column="at")
    done = b.history(key="w", value="y", orderBy=["at"], shrink=2).watch_reference(warnAbove=0.2, columns=["at", "x"]).normalise(column="x").target(column="y").build().run(spark, table(spark).withColumn("x", F.when(F.col("id") != 5, F.col("x"))))
    whole = done.view(len(done.declaration.steps))
    assert sorted(map(tuple, whole.select("id", "x", "y_history", "_standing").collect())) == sorted(map(tuple, done.df.select("id", "x", "y_history", "_part").collect()))
    early = {r.id: r._standing for r in done.view(3).collect()}
    assert early[5] == "dropped" and len(early) == 200 and set(early.values()) == {"dropped", "train", "validation", "test"}
    done.save(str(tmp_path / "p"))
    kept = Prepared.load(spark, str(tmp_path / "p"))
    assert kept.transform(table(spark)).count() == 200


def test_windows_of_moments_are_compared_as_days(spark):
    train = spark.range(100).select(F.timestamp_seconds(F.col("id") * 3600).alias("at"), F.col("id").cast("double").alias("x"))
    later = spark.range(100).select(F.timestamp_seconds(F.col("id") * 3600 + 6 * 3600).alias("at"), F.col("id").cast("double").alias("x"))
    told = {r.column: r.distance for r in evidence.watched(evidence.tallies(train, ["at", "x"]), later, ["at", "x"], 0.1).collect()}
    assert told["at"] == pytest.approx(0.06) and told["x"] == 0


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_running_sums_by_ranges(spark, partitions):
    rng = np.random.default_rng(1)
    rows = [(str(g), float(v), int(n)) for g in range(3) for v, n in zip(rng.normal(size=300 * g + 1), rng.integers(1, 9, 300 * g + 1), strict=True)]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    got = {(r.g, r.v): r.c for r in evidence.running(df, "v", {"c": "n"}, ["g"], int(partitions)).collect()}
    for g in "012":
        mine = sorted((v, n) for k, v, n in rows if k == g)
        assert [got[g, v] for v, _ in mine] == list(np.cumsum([n for _, n in mine]))
    steps = [r.step for r in evidence.steps(df.where("g = '2'"), "v").collect()]
    assert sorted(steps) == pytest.approx(sorted(np.diff(sorted(v for k, v, _ in rows if k == "2"))))


def test_alerts(spark):
    rows = [(i, f"row {i}", float((i * 37) % 50) if i % 10 else 999.0, "ab"[i % 2], i % 2, float(i * i), float(i) if i % 4 else None, 1.0, float(i % 2)) for i in range(100)]
    df = spark.createDataFrame(rows, "n long, t string, far double, c string, same int, up double, gap double, flat double, y double")
    df = df.withMetadata("c", {"kind": "category"}).withMetadata("t", {"kind": "text"})
    told = evidence.Alerts(df, df.columns[:-1], ["y"], [], 0.95).table().collect()
    found = {(r.column, r.alert): (r.other, r.action, r.verb, r.value, r.rows) for r in told}
    assert found["t", "text"][2] == "encode" and found["t", "identifier"][1] == "leaveout" and found["n", "identifier"][4] == 100
    assert found["far", "nothingknown"] == (None, "saymissing", None, "999", 10)
    assert found["c", "category"][2] == "encode.categories" and found["c", "answer"][:2] == ("y", "leaveout") and found["same", "answer"][0] == "y"
    assert found["gap", "gaps"][2] == "fill.missing" and found["flat", "constant"][1] == "leaveout" and found["gap", "ranks"][0] == "up"
    assert ("n", "identifier") not in {(r.column, r.alert) for r in evidence.Alerts(df, ["n"], [], ["n"]).table().collect()}


def test_gaps_and_outliers_that_are_refused(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 1.0), ("b", 1, 2.0), ("b", 2, None)], "k string, t int, x double")
    with pytest.raises(fits.Refused, match="nothing before"):
        fits.fill_previous(df, "x", ["t"], ["k"])
    assert [r.x for r in fits.fill_previous(df.where("k = 'b'"), "x", ["t"]).orderBy("t").collect()] == [2.0, 2.0]
    for bounds in ("iqr", "sigma"):
        one = fits.ClipOutliers("x", bounds)
        empty = df.where("x is null")
        with pytest.raises(fits.Refused, match="no value"):
            one.learn(empty.agg(*(c.alias(n) for n, c in one.stats(empty).items())).first().asDict())


def test_learners_are_trained_and_measured(spark):
    b = declared("x", "w", "one").split_at_random(seed=2).encode(column="w").target(column="one").evidence_report(metrics=["accuracy", "auc"], parts=["train"])
    done = b.learn_ml(trainer={"kind": "fastForest", "trees": 5, "leaves": 8, "leastRows": 1}, seed=3).build().run(spark, table(spark))
    trained = done.train_learner()
    told = {r.metric: (r.model, r.baseline) for r in done.measure(trained.predict, needs=trained.needs).collect()}
    assert told["auc"][0] > told["auc"][1] == 0.5
    network = b.learn_network(layers=[{"kind": "dense", "units": 2}, {"kind": "relu"}]).build().run(spark, table(spark))
    with pytest.raises(fits.Refused):
        network.train_learner()


def test_conformal_margin_is_the_exact_place(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(size=3000)
    df = spark.createDataFrame([(float(v),) for v in y], "y double")
    assert measures.conformal_margin(df, F.col("y"), F.lit(0.0), 0.1) == sorted(abs(y))[math.ceil(3001 * 0.9 - 1e-9) - 1]


def test_members_are_blended(spark):
    b = declared("x", "one").split_at_random(seed=2).target(column="one").evidence_report(metrics=["accuracy", "brier"], parts=["train"])
    done = b.build().run(spark, table(spark))
    say = lambda c: lambda d: d.withColumn("prediction", c)
    members = [say(F.lit(0.9)), say(F.col("one")), say(F.when(F.col("x") > 0, 0.6).otherwise(0.2))]
    rows = [(r.one, [0.9, r.one, 0.6 if r.x > 0 else 0.2]) for r in done.part("train").collect()]
    average = {r.metric: r.model for r in done.measure(members).collect()}
    assert average["brier"] == pytest.approx(np.mean([(np.mean(p) - y) ** 2 for y, p in rows]))
    vote = {r.metric: r.model for r in done.measure(members, blend="vote").collect()}
    assert vote["accuracy"] == pytest.approx(np.mean([(sum(x >= 0.5 for x in p) >= 2) == (y > 0.5) for y, p in rows]))


def test_search(spark):
    from tidemark.operators import search

    space = {"x": search.Uniform(-4, 4), "k": search.Choice([1, 2]), "r": search.Uniform(0.01, 1, log=True)}
    told = search.study(spark, space, lambda s, fold: (s["x"] - 1) ** 2 + fold + s["k"], 20, 3, seed=4)
    rows = told.collect()
    assert {r.state for r in rows} == {"done", "pruned"} and rows == search.study(spark, space, lambda s, fold: (s["x"] - 1) ** 2 + fold + s["k"], 20, 3, seed=4).collect()
    best = search.best(told, 3).first()
    whole = {t: [r.value for r in rows if r.trial == t] for t in {r.trial for r in rows}}
    assert best["mean"] == pytest.approx(min(np.mean(v) for v in whole.values() if len(v) == 3))
    a, b = [t for t, v in whole.items() if len(v) == 3][:2]
    assert search.paired(told, a, b).first()["mean"] == pytest.approx(np.mean(np.subtract(whole[a], whole[b])))
    points = spark.createDataFrame([(1.0, 5.0), (2.0, 3.0), (2.5, 4.0), (3.0, 1.0)], "a double, b double")
    assert sorted(tuple(r) for r in search.front(points, "a", "b").collect()) == [(1.0, 5.0), (2.0, 3.0), (3.0, 1.0)]

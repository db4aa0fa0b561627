"""Dense networks against plain numpy, against slopes by differences, and through a pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import networks
from tidemark.operators.fits import Refused
from tidemark.operators.networks import Shape, shaped, train_network
from tidemark.plans.pipeline import create

DENSE = [{"kind": "dense", "units": 6}, {"kind": "tanh"}, {"kind": "dense", "units": 4}, {"kind": "relu"}]


def rows_for(loss, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, (n, 3))
    z = np.stack([x[:, 0] * x[:, 1], np.sin(2 * x[:, 2]), x[:, 0] - x[:, 2]], axis=1)
    if loss == "meanSquaredError":
        return x, z
    if loss == "binaryCrossEntropy":
        return x, (z > 0).astype(float)
    e = np.exp(3 * z)
    return x, e / e.sum(axis=1, keepdims=True)


def frame(spark, x, y, parts=4):
    names = [*(f"x{i}" for i in range(x.shape[1])), *(f"y{i}" for i in range(y.shape[1]))]
    return spark.createDataFrame([tuple(map(float, (*a, *b))) for a, b in zip(x, y, strict=True)], names).repartition(parts), names[: x.shape[1]], names[x.shape[1] :]


@pytest.mark.parametrize("loss", ["meanSquaredError", "binaryCrossEntropy", "crossEntropy"])
def test_slopes_are_those_of_differences(loss):
    x, y = rows_for(loss, 20)
    shape = Shape((3, 5, 4, 3), ("tanh", "sigmoid"), loss.lower())
    weights = shape.drawn(2) + 0.1
    told = shape.summed(weights, x, y)
    for k in range(0, shape.size, 5):
        step = np.zeros(shape.size)
        step[k] = 1e-6
        assert told[2 + k] == pytest.approx((shape.summed(weights + step, x, y)[0] - shape.summed(weights - step, x, y)[0]) / 2e-6, rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("kind", ["adam", "sgd", "lbfgs"])
def test_many_tasks_learn_what_one_does(spark, monkeypatch, kind):
    monkeypatch.setattr(networks, "_FAN", 3)  # so that sums take two rounds
    monkeypatch.setattr(networks, "_SLICE", 10)
    x, y = rows_for("crossEntropy")
    df, features, answers = frame(spark, x, y, 7)
    given = {"adam": {"rate": 0.05}, "sgd": {"rate": 0.3, "momentum": 0.9}, "lbfgs": {}}[kind]
    got = train_network(df, features, answers, DENSE, "crossEntropy", {"kind": kind, **given}, epochs=6, seed=5)
    shape = shaped(DENSE, 3, 3, "crossentropy")

    def alone(weights):
        told = shape.summed(weights, x, y)
        return told[0] / len(x), told[2:] / len(x)

    weights = shape.drawn(5)
    for weights, _ in networks.OPTIMIZERS[kind](weights, alone, 6, **given):
        pass
    assert np.allclose(got.weights, weights, rtol=1e-6, atol=1e-8) and got.losses[-1] < got.losses[0]
    said = got.said(df, ["p0", "p1", "p2"]).select(*features, "p0", "p1", "p2").toPandas().to_numpy()
    assert np.allclose(said[:, 3:], shape.answers(weights, said[:, :3]), rtol=1e-5) and np.allclose(said[:, 3:].sum(axis=1), 1)


def test_lbfgs_learns_amounts_and_media(spark):
    x, y = rows_for("meanSquaredError", 600)
    df, features, answers = frame(spark, x, y)
    media = df.withColumn("m", F.array("x1", "x2").cast("array<float>")).drop("x1", "x2")
    got = train_network(media, ["x0", "m"], answers, [{"kind": "dense", "units": 16}, {"kind": "tanh"}], "meanSquaredError", "lbfgs", epochs=60)
    said = got.said(media, ["p0", "p1", "p2"]).select(*answers, "p0", "p1", "p2").toPandas().to_numpy()
    assert ((said[:, :3] - said[:, 3:]) ** 2).mean() < 0.1 * y.var(axis=0).mean()


def test_patience_keeps_the_best(spark):
    x, y = rows_for("meanSquaredError", 60)
    df, features, answers = frame(spark, x, y, 2)
    other, _, _ = frame(spark, x, -y, 2)  # what helps one hurts the other
    asked = dict(optimizer={"kind": "sgd", "rate": 0.1}, epochs=20, validation=other, patience=2)
    got = train_network(df, features, answers, DENSE, "meanSquaredError", **asked)
    shape = shaped(DENSE, 3, 3, "meansquarederror")
    judged = []
    for weights, _ in networks.sgd(shape.drawn(1), lambda w: (0.0, shape.summed(w, x, y)[2:] / 60), 20, 0.1):
        judged.append((shape.summed(weights, x, -y)[0], weights))
        lowest = min(range(len(judged)), key=lambda e: judged[e][0])
        if len(judged) - 1 - lowest >= 2:
            break
    assert len(got.losses) == len(judged) < 20 and np.allclose(got.weights, judged[lowest][1])
    assert not np.array_equal(got.weights, train_network(df, features, answers, DENSE, "meanSquaredError", **asked, best=False).weights)


def test_refusals(spark):
    x, y = rows_for("meanSquaredError", 10)
    df, features, answers = frame(spark, x, y, 1)
    for layers, loss, optimizer, match in (
        ([{"kind": "conv", "units": 2}], "meanSquaredError", "adam", "conv layers"), ([{"kind": "relu"}], "meanSquaredError", "adam", "behind a dense"),
        ([{"kind": "dense", "units": 2, "l1": 1}], "meanSquaredError", "adam", "l1"), (DENSE, "quantile", "adam", "quantile"), (DENSE, "meanSquaredError", "lion", "lion"),
        (DENSE, "meanSquaredError", {"kind": "adam", "speed": 1}, "speed"), ([{"kind": "dense", "units": 5_000_000}], "meanSquaredError", "adam", "weights"),
    ):
        with pytest.raises(Refused, match=match):
            train_network(df, features, answers, layers, loss, optimizer)
    with pytest.raises(Refused, match="no rows"):
        train_network(df.where("x0 > 9"), features, answers, DENSE, "meanSquaredError")
    with pytest.raises(Refused, match="the loss of epoch"):
        train_network(df.withColumn("y0", F.lit(1e300)), features, answers, DENSE, "meanSquaredError", {"kind": "sgd", "rate": 1e300}, epochs=5)


@pytest.mark.parametrize("verb, columns, metric", [("target", ["y"], "rmse"), ("target", ["up"], "auc"), ("target_numbers", ["y", "s"], "rmse"), ("target_labels", ["up", "down"], "accuracy"), ("target_distribution", ["s", "t"], "kl")])
def test_a_run_trains_its_network(spark, verb, columns, metric):
    rng = np.random.default_rng(1)
    made = {"y": lambda a, b: 2 * a - b, "up": lambda a, b: float(a > b), "down": lambda a, b: float(a <= b), "s": lambda a, b: a / (a + b), "t": lambda a, b: b / (a + b)}
    rows = [tuple(map(float, (a, b, *(made[c](a, b) for c in columns)))) for a, b in rng.uniform(0.1, 1, (300, 2))]
    table = spark.createDataFrame(rows, ["a", "b", *columns])
    b = create().read_rows().declare(columns=[{"name": c, "kind": "number"} for c in table.columns]).split_at_random(seed=2)
    for c in ("a", "b"):
        b = b.normalise(column=c, scale="minmax", outOfRange="clip")
    b = b.target(column=columns[0]) if verb == "target" else getattr(b, verb)(columns=columns)
    b = b.evidence_report(metrics=[metric], parts=["test"]).learn_network(layers=[{"kind": "dense", "units": 6}, {"kind": "tanh"}], epochs=30)
    done = b.build().run(spark, table)
    trained = done.train_learner()
    for r in done.measure(trained.predict, needs=trained.needs).where("model is not null").collect():
        assert r.model > r.baseline if metric in ("auc", "accuracy") else r.model < 0.3 * r.baseline, r

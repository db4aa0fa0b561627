"""Dense networks for amounts, classes, labels and shares, trained on rows that stay where they are.

A step of training is a job: each task works out the loss and the gradient of its rows in Arrow batches, gradients are summed in slices over a
tree of groups, and what comes to the driver is one gradient, as large as the network and not as the rows. One step takes all rows, so
what is learned does not depend on how they are dealt to tasks (but for the order of sums), and an epoch is a step. Sums are weighed by row counts.
"""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.fits import Refused
from tidemark.session import kept_table

#: A network of more weights is refused: the driver and each task hold them a few times over.
MOST_WEIGHTS = 10_000_000
_SLICE, _FAN = 1 << 16, 64
_SUMS = "slice int, part int, total array<double>"

#: Each layer between: its answer, and what its answer says of its slope.
BETWEEN: dict[str, tuple[Callable, Callable]] = {
    "relu": (lambda z: np.maximum(z, 0.0), lambda a: (a > 0).astype(float)),
    "sigmoid": (lambda z: 0.5 * (1 + np.tanh(z / 2)), lambda a: a * (1 - a)),
    "tanh": (np.tanh, lambda a: 1 - a * a),
}
#: Loss: what the last layer's sums become.
ENDS = {"meansquarederror": "amounts", "binarycrossentropy": "labels", "crossentropy": "shares"}


@dataclass(frozen=True)
class Shape:
    """widths: of the features, of each dense layer and of the answers; between: what follows each dense layer but the last ('' for nothing);
    loss: a name of ENDS."""

    widths: tuple[int, ...]
    between: tuple[str, ...]
    loss: str

    @property
    def size(self) -> int:
        return sum((a + 1) * b for a, b in zip(self.widths, self.widths[1:], strict=False))

    def drawn(self, seed: int) -> np.ndarray:
        """Weights drawn evenly from -r to r, r the root of 6 over the sum of a layer's widths; biases of 0."""
        rng, parts = np.random.default_rng(seed), []
        for a, b in zip(self.widths, self.widths[1:], strict=False):
            r = math.sqrt(6 / (a + b))
            parts += [rng.uniform(-r, r, a * b), np.zeros(b)]
        return np.concatenate(parts)

    def layers(self, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = 0
        for a, b in zip(self.widths, self.widths[1:], strict=False):
            yield weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + (a + 1) * b]
            at += (a + 1) * b

    def answers(self, weights: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self._ended(self._through(weights, x)[-1])

    def _through(self, weights: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        held = [x]
        for k, (w, b) in enumerate(self.layers(weights)):
            z = held[-1] @ w + b
            held.append(BETWEEN[self.between[k]][0](z) if k < len(self.between) and self.between[k] else z)
        return held

    def _ended(self, z: np.ndarray) -> np.ndarray:
        if self.loss == "meansquarederror":
            return z
        if self.loss == "binarycrossentropy":
            return BETWEEN["sigmoid"][0](z)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def summed(self, weights: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of some rows the sum of losses, the number of rows and the sum of gradients, in one row. A row's loss is the mean over its
        answers (the cross-entropy of shares: the sum)."""
        held = self._through(weights, x)
        z, many = held[-1], y.shape[1]
        said = self._ended(z)
        if self.loss == "meansquarederror":
            loss, slope = float(((said - y) ** 2).sum()) / many, 2 * (said - y) / many
        elif self.loss == "binarycrossentropy":
            loss, slope = float((np.logaddexp(0, z) - y * z).sum()) / many, (said - y) / many
        else:
            top = z.max(axis=1, keepdims=True)
            alone = z - top - np.log(np.exp(z - top).sum(axis=1, keepdims=True))
            loss, slope = float(-(y * alone).sum()), said * y.sum(axis=1, keepdims=True) - y
        parts = []
        each = list(self.layers(weights))
        for k in range(len(each) - 1, -1, -1):
            parts[:0] = [(held[k].T @ slope).ravel(), slope.sum(axis=0)]
            if k:
                slope = slope @ each[k][0].T
                if self.between[k - 1]:
                    slope = slope * BETWEEN[self.between[k - 1]][1](held[k])
        return np.concatenate([[loss, len(x)], *parts])


def shaped(layers: list[dict], features: int, answers: int, loss: str) -> Shape:
    """The layers as declared (dense, with what is between), then a dense layer for the answers. Other layers are refused."""
    widths, between = [features], []
    for one in layers:
        kind = one.get("kind")
        if kind == "dense":
            widths.append(int(one["units"]))
            between.append("")
        elif kind in BETWEEN and between and not between[-1]:
            between[-1] = kind
        else:
            raise Refused(f"{kind} layers are not trained here" if kind not in BETWEEN else f"a {kind} layer stands behind a dense one")
        other = sorted(set(one) - {"kind", "units", "name"})
        if other:
            raise Refused(f"{', '.join(other)} of a {kind} layer: not trained here")
    shape = Shape((*widths, answers), tuple(between), loss)
    if shape.size > MOST_WEIGHTS:
        raise Refused(f"the network has {shape.size} weights, and {MOST_WEIGHTS} at most are trained here")
    return shape


def _rows_of(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * width:
        raise ValueError(f"rows of other than {width} cells")
    return flat.reshape(len(column), width)


@dataclass
class Rows:
    """Rows that are trained on: x and y, arrays of doubles. They are written once, and kept where they were read while training lasts."""

    held: DataFrame
    shape: Shape

    def __post_init__(self) -> None:
        self.tasks = self.held.rdd.getNumPartitions()

    def told(self, weights: np.ndarray) -> tuple[float, np.ndarray]:
        """The mean loss and its gradient, over all rows."""
        shape = self.shape

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = np.zeros(shape.size + 2)
            for b in batches:
                if b.num_rows:
                    total += shape.summed(weights, _rows_of(b.column("x"), shape.widths[0]), _rows_of(b.column("y"), shape.widths[-1]))
            yield _slices(total, TaskContext.get().partitionId())

        def added(table: pa.Table) -> pa.Table:
            total = np.zeros(len(table["total"][0].values))
            for one in table["total"]:
                total += one.values.to_numpy(zero_copy_only=False)
            return pa.table({"slice": table["slice"][:1].cast(pa.int32()), "part": table["part"][:1].cast(pa.int32()), "total": pa.array([total], pa.list_(pa.float64()))})

        sums, parts = self.held.mapInArrow(summed, _SUMS), self.tasks
        while parts > _FAN:
            sums = sums.withColumn("part", F.expr(f"part div {_FAN}").cast("int")).groupBy("slice", "part").applyInArrow(added, _SUMS)
            parts = -(-parts // _FAN)
        # _FAN gradients at most, in slices
        total = np.zeros(shape.size + 2)
        for r in sorted(sums.collect(), key=lambda r: (r["slice"], r["part"])):
            total[r["slice"] * _SLICE : r["slice"] * _SLICE + len(r["total"])] += r["total"]
        if not total[1]:
            raise Refused("there are no rows to train on")
        return total[0] / total[1], total[2:] / total[1]


def _slices(total: np.ndarray, part: int) -> pa.RecordBatch:
    cut = [total[at : at + _SLICE] for at in range(0, len(total), _SLICE)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([part] * len(cut), pa.int32()), pa.array(cut, pa.list_(pa.float64()))], names=["slice", "part", "total"])


def adam(weights: np.ndarray, told: Callable, epochs: int, rate: float = 0.001, firstMoment: float = 0.9, secondMoment: float = 0.999, epsilon: float = 1e-8) -> Iterator[tuple[np.ndarray, float]]:
    """After each epoch the weights, and the loss before it."""
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, epochs + 1):
        loss, slope = told(weights)
        first = firstMoment * first + (1 - firstMoment) * slope
        second = secondMoment * second + (1 - secondMoment) * slope**2
        weights = weights - rate * (first / (1 - firstMoment**t)) / (np.sqrt(second / (1 - secondMoment**t)) + epsilon)
        yield weights, loss


def sgd(weights: np.ndarray, told: Callable, epochs: int, rate: float = 0.01, momentum: float = 0.0) -> Iterator[tuple[np.ndarray, float]]:
    moved = np.zeros_like(weights)
    for _ in range(epochs):
        loss, slope = told(weights)
        moved = momentum * moved + slope
        weights = weights - rate * moved
        yield weights, loss


def lbfgs(weights: np.ndarray, told: Callable, epochs: int, memory: int = 10, tolerance: float = 1e-6) -> Iterator[tuple[np.ndarray, float]]:
    """Limited-memory BFGS. A step is halved until the loss falls enough (mostly it does at once, so that an epoch is one job); it ends
    early where the gradient, or what a step gains, is next to nothing."""
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    loss, slope = told(weights)
    for _ in range(epochs):
        if np.abs(slope).max() < tolerance:
            return
        way, kept = slope.copy(), []
        for s, d in reversed(steps):
            share = (s @ way) / (s @ d)
            kept.append(share)
            way -= share * d
        way *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, np.abs(slope).sum())
        for (s, d), share in zip(steps, reversed(kept), strict=True):
            way += (share - (d @ way) / (s @ d)) * s
        length, falls = 1.0, slope @ way
        while True:
            then = weights - length * way
            new, after = told(then)
            if new <= loss - 1e-4 * length * falls:
                break
            length /= 2
            if length < 1e-10:
                return
        s, d = then - weights, after - slope
        if s @ d > 1e-12:
            steps = [*steps, (s, d)][-memory:]
        before, weights, loss, slope = loss, then, new, after
        yield weights, before
        if before - new <= tolerance * 1e-3 * max(1.0, abs(new)):
            return


OPTIMIZERS = {"adam": adam, "sgd": sgd, "lbfgs": lbfgs}


@dataclass
class Network:
    """What was trained: its shape and weights, and the loss before each epoch."""

    shape: Shape
    weights: np.ndarray
    features: list[str]
    losses: list[float] = field(default_factory=list)

    def said(self, handed: DataFrame, names: list[str]) -> DataFrame:
        """handed with the network's answers as columns of these names."""
        shape, weights = self.shape, self.weights

        def answered(x):
            import pandas as pd

            rows = np.stack(x.to_numpy()) if len(x) else np.empty((0, shape.widths[0]))
            return pd.Series(list(shape.answers(weights, rows)))

        made = F.pandas_udf(answered, "array<double>")(together(handed, self.features))
        out = handed.withColumn("_said", made)
        return out.withColumns({n: F.get("_said", F.lit(i)) for i, n in enumerate(names)}).drop("_said")


def together(rows: DataFrame, columns: list[str]):
    """All cells of these columns (numbers, or arrays of them) in one array of doubles."""
    cells = [F.col(f"`{c}`") for c in columns]
    return F.concat(*(c.cast("array<double>") if rows.schema[n].dataType.typeName() == "array" else F.array(c.cast("double")) for n, c in zip(columns, cells, strict=True)))


def train_network(
    train: DataFrame, features: list[str], answers: list[str], layers: list[dict], loss: str, optimizer: dict | str = "adam", epochs: int = 100, seed: int = 1,
    validation: DataFrame | None = None, patience: int | None = None, least: float = 0.0, best: bool = True,
) -> Network:
    """A network of dense layers trained on rows of features and answers without gaps. loss: meanSquaredError for amounts (the answers as they
    are), binaryCrossEntropy for labels that are each 0 or 1, crossEntropy for shares, or classes as columns of 0 and 1, that sum to 1.
    optimizer: adam, sgd or lbfgs, with its settings. With patience, training ends once the loss of the validation rows has not
    fallen by more than `least` for so many epochs; then the weights that it was lowest with are kept (best), or the last. Gaps and other
    widths of arrays are errors."""
    loss = loss.lower()
    if loss not in ENDS:
        raise Refused(f"{loss} is not trained by here; {', '.join(ENDS)} are")
    given = dict(optimizer) if isinstance(optimizer, dict) else {"kind": optimizer}
    kind = given.pop("kind").lower()
    if kind not in OPTIMIZERS:
        raise Refused(f"no optimizer {kind} here; {', '.join(OPTIMIZERS)} are")
    known = list(inspect.signature(OPTIMIZERS[kind]).parameters)[3:]
    if set(given) - set(known):
        raise Refused(f"optimizer {kind}: {', '.join(sorted(set(given) - set(known)))} not known; {', '.join(known)} are")
    first = train.select(F.size(together(train, features)).alias("n")).first()
    if first is None:
        raise Refused("there are no rows to train on")
    shape = shaped(layers, first["n"], len(answers), loss)

    def rows(df: DataFrame) -> Rows:
        return Rows(kept_table(df.select(together(df, features).alias("x"), together(df, answers).alias("y")), "network").persist(), shape)

    learned, judge = rows(train), rows(validation) if validation is not None and patience is not None else None
    weights = shape.drawn(seed)
    losses, lowest, at, kept = [], math.inf, 0, weights
    try:
        for epoch, (weights, told) in enumerate(OPTIMIZERS[kind](weights, learned.told, epochs, **given)):
            losses.append(told)
            if not math.isfinite(told):
                raise Refused(f"the loss of epoch {epoch + 1} is {told}")
            if judge is not None:
                now = judge.told(weights)[0]
                if now < lowest - least:
                    lowest, at, kept = now, epoch, weights
                if epoch - at >= patience:
                    break
    finally:
        for one in (learned, judge):
            if one is not None:
                one.held.unpersist()
    return Network(shape, kept if judge is not None and best and math.isfinite(lowest) else weights, features, losses)

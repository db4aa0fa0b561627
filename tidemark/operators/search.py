"""A search over settings: trials drawn from a space under a seed, each measured on folds by runs of its own, poor ones given up early."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIALS = "trial int, settings map<string,string>, fold int, value double, state string"


@dataclass(frozen=True)
class Choice:
    values: Sequence

    def draw(self, given: random.Random):
        return given.choice(list(self.values))


@dataclass(frozen=True)
class Uniform:
    """A number from low to high; log: its logarithm is uniform; whole: rounded to a whole number."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def draw(self, given: random.Random):
        x = math.exp(given.uniform(math.log(self.low), math.log(self.high))) if self.log else given.uniform(self.low, self.high)
        return round(x) if self.whole else x


def study(spark: SparkSession, space: dict[str, Choice | Uniform], measured: Callable[[dict, int], float], trials: int, folds: int = 1, seed: int = 1, smaller_is_better: bool = True, warm_up: int = 3) -> DataFrame:
    """TRIALS: a row for each fold that a trial was measured on. measured(settings, fold) runs a pipeline under the settings and returns the
    measure. A trial whose mean so far is worse than the median of what the trials before it had after as many folds is given up
    (state `pruned`), once warm_up trials are done."""
    given, told, means = random.Random(seed), [], []
    sign = 1 if smaller_is_better else -1
    for trial in range(trials):
        settings = {name: one.draw(given) for name, one in space.items()}
        values: list[float] = []
        for fold in range(folds):
            values.append(measured(settings, fold))
            others = sorted(sign * m[fold] for m in means if len(m) > fold)
            poor = len(others) >= warm_up and sign * (sum(values) / len(values)) > others[len(others) // 2]
            state = "pruned" if poor and fold + 1 < folds else "done"
            told.append((trial, {k: str(v) for k, v in settings.items()}, fold, float(values[-1]), state))
            if state == "pruned":
                break
        means.append([sum(values[: i + 1]) / (i + 1) for i in range(len(values))])
    return spark.createDataFrame(told, TRIALS)


def best(told: DataFrame, folds: int = 1, smaller_is_better: bool = True) -> DataFrame:
    """The trials that were measured on every fold: trial, settings, mean and deviation, the best first."""
    whole = told.groupBy("trial").agg(F.first("settings").alias("settings"), F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"))
    return whole.where(F.col("n") == folds).drop("n").orderBy(F.col("mean") if smaller_is_better else F.desc("mean"), "trial")


def front(told: DataFrame, first: str, second: str) -> DataFrame:
    """Rows that no other row beats in both columns (smaller is better), one of equal ones each: the best of second among all with a first
    that is no larger, found along the order of first."""
    from pyspark.sql.window import Window

    before = Window.orderBy(first, second).rowsBetween(Window.unboundedPreceding, -1)  # a row for each trial
    return told.withColumn("_least", F.min(second).over(before)).where(F.col("_least").isNull() | (F.col(second) < F.col("_least"))).drop("_least")


def paired(told: DataFrame, one: int, other: int) -> DataFrame:
    """n, mean, deviation and t of the differences (one less other) of two trials, fold by fold."""
    side = lambda trial, name: told.where(F.col("trial") == trial).select("fold", F.col("value").alias(name))
    apart = side(one, "a").join(side(other, "b"), "fold").select((F.col("a") - F.col("b")).alias("d"))
    told = apart.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("deviation"))
    return told.withColumn("t", F.try_divide(F.col("mean"), F.col("deviation") / F.sqrt("n")))

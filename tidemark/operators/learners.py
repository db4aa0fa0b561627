"""Learners on a prepared table: trees by Spark ML, dense networks (operators/networks.py). Other layers are declared and checked, not trained."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.fits import Refused
from tidemark.operators.networks import Network, train_network


def _depth(leaves: int) -> int:
    return max(1, min(30, (leaves - 1).bit_length()))


def learn_trees(train: DataFrame, features: list[str], answer: str, trainer: dict, classes: bool, seed: int = 1) -> PipelineModel:
    """trainer: {"kind": "fasttree" | "fastforest", "trees": n, "leaves": n, "leastRows": n, "rate": x}. A number of leaves becomes the depth
    that can hold it."""
    given = {"seed": seed, "labelCol": answer, "featuresCol": "_features", "maxDepth": _depth(trainer.get("leaves", 20)), "minInstancesPerNode": trainer.get("leastRows", 10)}
    kind = trainer["kind"].lower()
    if kind == "fasttree":
        made = (GBTClassifier if classes else GBTRegressor)(**given, maxIter=trainer.get("trees", 100), stepSize=trainer.get("rate", 0.2))
    elif kind == "fastforest":
        made = (RandomForestClassifier if classes else RandomForestRegressor)(**given, numTrees=trainer.get("trees", 100))
    else:
        raise Refused(f"no trainer {trainer['kind']}")
    assembler = VectorAssembler(inputCols=features, outputCol="_features")
    return PipelineModel([assembler, made.fit(assembler.transform(train))])


@dataclass
class Trained:
    """A model behind a fit. predict adds `prediction`: the probability of 1 for classes, else the amount."""

    model: PipelineModel
    classes: bool
    needs: str

    def predict(self, handed: DataFrame) -> DataFrame:
        out = self.model.transform(handed).drop("_features", "rawPrediction")
        return out.withColumn("prediction", vector_to_array("probability")[1]).drop("probability") if self.classes else out.withColumn("prediction", F.col("prediction"))


@dataclass
class TrainedNetwork:
    """A network behind a fit. predict adds the columns in which the run awaits predictions."""

    network: Network
    names: list[str]
    needs: str

    def predict(self, handed: DataFrame) -> DataFrame:
        return self.network.said(handed, self.names)


#: What a step may declare that this training does not do.
_NOT_DONE = ("schedule", "clip", "clipValue", "average", "judgedByAverage", "lossScale")


def train_dense(step, rows: DataFrame, features: list[str], answers: list[str], loss: str, names: list[str], needs: str, validation: DataFrame | None) -> TrainedNetwork:
    """The network of a learn.network step. Its loss is the declared one, else that of the answers; its optimizer the declared one, else
    lbfgs. An epoch is one step on all rows: `batch` and `stepEvery` have no meaning here. Other settings are refused if they are set."""
    p = step.params
    odd = [k for k in _NOT_DONE if p.get(k)]
    if odd:
        raise Refused(f"{', '.join(odd)}: not trained with here")
    stopping = p["stopping"] if isinstance(p["stopping"], dict) else {}
    patience = {k: stopping[k] for k in ("patience", "least", "best") if k in stopping} if stopping.get("kind") == "patience" else {}
    made = train_network(
        rows, features, answers, p["layers"], p["loss"]["kind"] if isinstance(p["loss"], dict) else loss, p["optimizer"] if isinstance(p["optimizer"], dict) else "lbfgs",
        p["epochs"], p["seed"], validation if patience else None, **patience,
    )
    return TrainedNetwork(made, names, needs)


def train(step, rows: DataFrame, features: list[str], answer: str, classes: bool, needs: str) -> Trained:
    """The trees that a learn.ml step names, trained on rows of features and an answer (classes: 0 or 1)."""
    p = step.params
    dots = {f: f.replace(".", "_") for f in [*features, answer] if "." in f}
    if dots:
        raise Refused(f"Spark's learners take no dots in names: {', '.join(dots)}")
    return Trained(learn_trees(rows, features, answer, p["trainer"], classes, p["seed"]), classes, needs)

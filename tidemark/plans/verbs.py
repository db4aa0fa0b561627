"""The verbs: their keys, what each reads and makes, and what it does to a walk."""

from __future__ import annotations

import difflib
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

REQUIRED = object()


@dataclass(frozen=True)
class Verb:
    name: str
    role: str  # source, schema, add, order, drop, split, fit, answer, evidence, report, learner
    since: int
    keys: dict[str, Any]  # key: REQUIRED or its default
    words: dict[str, tuple[str, ...]] = field(default_factory=dict)
    reads: Callable[[dict], list[str]] = lambda p: []
    ordered: bool = False  # reads the rows' order


@dataclass(frozen=True)
class Step:
    """A verb and its settings; `by` (columns that tell series apart) is an addition to the file's keys, written only where it is set."""

    verb: str
    params: dict[str, Any]

    @property
    def spec(self) -> Verb:
        return VERBS[self.verb]

    def __getitem__(self, key: str) -> Any:
        return self.params[key]

    @property
    def makes(self) -> str | None:
        """The column that the step writes under a name of its own."""
        p = self.params
        if self.verb == "target.ahead":
            return f"{p['column']}.ahead{p['ahead']}"
        if self.verb == "maths":
            return p["into"] or p["column"]
        if self.verb in ("history", "history.known"):
            return p["into"] or f"{p['value']}_history"
        return p["column"] if self.verb in ("feature.add", "feature.indicator") else None

    @property
    def reads(self) -> list[str]:
        return [c for c in self.spec.reads(self.params) if c]


def step(verb: str, **given: Any) -> Step:
    """A step with its defaults; unknown verbs, keys and words are refused, naming what is near."""
    wrong = wrong_keys(verb, given)
    if wrong:
        raise ValueError((f"{verb}: " if verb in VERBS else "") + "; ".join(what for _, what in wrong))
    return Step(verb, {k: given.get(k, d) for k, d in VERBS[verb].keys.items()})


def wrong_keys(verb: str, given: dict[str, Any]) -> list[tuple[str | None, str]]:
    """What keeps a step from being made: the key it is about (None: the step itself), and what is wrong."""
    if not isinstance(verb, str) or verb not in VERBS:
        near = difflib.get_close_matches(str(verb), VERBS, 1)
        return [(None, f"no verb {verb}" + (f"; is it {near[0]}?" if near else ""))]
    spec = VERBS[verb]
    wrong: list[tuple[str | None, str]] = [(k, f"no key {k}") for k in given if k not in spec.keys]
    wrong += [(None, f"{k} is left out") for k, d in spec.keys.items() if d is REQUIRED and k not in given]
    for k in ("left", "right", "trainer", "optimizer", "loss", "stopping", "schedule"):
        part = given.get(k)
        if k in spec.keys and verb in ("read.join", "learn.ml", "learn.network") and part is not None and not (isinstance(part, dict) and part.get("kind")):
            wrong.append((k, f"{k} is a part, written as its kind and its settings"))
    for k, words in spec.words.items():
        values = given.get(k, spec.keys[k])
        values = None if values is REQUIRED else values
        for v in values if isinstance(values, list) else [values]:
            if v is not None and v not in words:
                wrong.append((k, f"{k} is {v}, not one of {', '.join(words)}"))
    return wrong


def _one(p: dict) -> list[str]:
    return [p["column"]]


def _many(p: dict) -> list[str]:
    return list(p["columns"] or [])


FORMS, RANGES, UNSEEN = ("signed", "unit", "splitsign"), ("pass", "clip", "refuse"), ("reserve", "refuse")
METRICS = ("rmse", "mae", "r2", "accuracy", "precision", "recall", "confusionmatrix", "emd", "kl", "rps", "f1", "auc", "mape", "brier", "coverage", "width")
_SHARES = {"train": 0.7, "validation": 0.15, "test": 0.15, "predict": 0.0, "calibration": 0.0}
_R = REQUIRED

VERBS: dict[str, Verb] = {
    v.name: v
    for v in (
        Verb("declare", "schema", 1, {"columns": _R, "remainder": "drop"}, {"remainder": ("drop", "keep", "refuse")}),
        Verb("drop.columns", "drop", 2, {"columns": _R}, reads=_many),
        Verb("drop.gaps", "drop", 2, {"columns": _R}, reads=_many),
        Verb("drop.warmup", "drop", 2, {"atMost": 1000}, ordered=True),
        Verb("encode", "fit", 1, {"column": _R, "as": "onehot", "unseen": "reserve"}, {"as": ("onehot", "ordinal"), "unseen": UNSEEN}, _one),
        Verb("encode.categories", "fit", 2, {"as": "onehot", "unseen": "reserve"}, {"as": ("onehot", "ordinal"), "unseen": UNSEEN}),
        Verb("encode.piecewise", "fit", 10, {"column": _R, "bins": _R, "outOfRange": "clip"}, {"outOfRange": RANGES}, _one),
        Verb("evidence.correlation", "evidence", 2, {"columns": _R, "shown": "numbers", "coefficient": "pearson"}, {"shown": ("drawn", "numbers"), "coefficient": ("pearson", "spearman")}, _many),
        Verb("evidence.likeness", "evidence", 10, {"warnAbove": _R, "columns": None}, reads=_many),
        Verb("evidence.profile", "evidence", 2, {"columns": None, "rankAbove": None}, reads=_many),
        Verb("evidence.report", "report", 3, {"metrics": _R, "parts": _R, "shown": "numbers"}, {"metrics": METRICS, "parts": ("train", "validation", "test"), "shown": ("drawn", "numbers")}),
        Verb("feature.add", "add", 1, {"column": _R, "left": _R, "arithmetic": _R, "right": _R}, {"arithmetic": ("plus", "minus", "times", "dividedby")}, lambda p: [p["left"], p["right"]]),
        Verb("feature.cycle", "add", 8, {"column": _R, "length": _R, "form": "signed"}, {"form": FORMS}, _one),
        Verb("feature.cyclical", "add", 1, {"column": _R, "period": _R, "form": "signed"}, {"period": ("hourofday", "dayofweek", "dayofmonth", "monthofyear", "dayofyear", "season"), "form": FORMS}, _one),
        Verb("feature.indicator", "add", 1, {"column": _R, "indicator": _R, "period": _R, "columns": _R, "by": None}, {"indicator": ("sma", "ema", "rsi", "atr", "adx", "cci", "williamsr", "obv", "macd", "bollingerbands", "stochastic", "vwap")}, _many, True),
        Verb("feature.timeParts", "add", 1, {"column": _R, "asCategories": False, "parts": _R}, {"parts": ("minute", "hour", "dayofweek", "dayofmonth", "month", "quarter", "season", "year")}, _one),
        Verb("fill.missing", "fit", 1, {"column": _R, "with": "mean", "value": 0.0, "refuseAbove": None, "by": None}, {"with": ("mean", "median", "zero", "previous", "refuse", "constant")}, _one),
        Verb("fill.nan", "fit", 1, {"column": _R, "with": "refuse", "value": 0.0}, {"with": ("refuse", "mean", "median", "zero", "constant")}, _one),
        Verb("history", "fit", 10, {"key": _R, "value": _R, "orderBy": _R, "shrink": _R, "window": None, "into": None}, reads=lambda p: [p["key"], p["value"], *p["orderBy"]]),
        Verb("history.known", "fit", 16, {"key": _R, "value": _R, "orderBy": _R, "shrink": _R, "window": None, "into": None}, reads=lambda p: [p["key"], p["value"], *p["orderBy"]]),
        Verb("learn.ml", "learner", 7, {"trainer": _R, "seed": 1}),
        Verb("learn.network", "learner", 5, {"layers": _R, "optimizer": "adam", "schedule": None, "clip": None, "clipValue": None, "stepEvery": None, "average": None, "judgedByAverage": False, "lossScale": None, "recompute": False, "loss": "crossentropy", "stopping": None, "engine": "spark", "seed": 1, "epochs": 100, "batch": 128}),
        Verb("maths", "add", 1, {"column": _R, "maths": _R, "into": None}, {"maths": ("log", "log1p", "reciprocal", "sqrt", "square", "arcsin", "abs", "sign")}, _one),
        Verb("normalise", "fit", 1, {"column": _R, "scale": "midrange", "outOfRange": "pass"}, {"scale": ("standard", "minmax", "maxabs", "robust", "quantile", "power", "midrange"), "outOfRange": RANGES}, _one),
        Verb("normalise.row", "add", 1, {"norm": _R, "columns": _R}, {"norm": ("l1", "l2", "max")}, _many),
        Verb("order.by", "order", 2, {"columns": _R}, reads=_many),
        Verb("outliers.clip", "fit", 1, {"column": _R, "bounds": "iqr", "at": 1.5, "outlier": "clip"}, {"bounds": ("quantile", "sigma", "iqr"), "outlier": ("clip", "blank", "refuse")}, _one),
        Verb("read.csv", "source", 1, {"path": _R}),
        Verb("read.excel", "source", 1, {"path": _R, "sheet": None}),
        Verb("read.images", "source", 12, {"path": _R, "width": _R, "height": _R, "channels": _R}),
        Verb("read.join", "source", 8, {"left": _R, "right": _R, "on": _R, "unmatched": "refuse"}, {"unmatched": ("refuse", "drop")}),
        Verb("read.json", "source", 1, {"path": _R}),
        Verb("read.parquet", "source", 1, {"path": _R}),
        Verb("read.rows", "source", 1, {"description": ""}),
        Verb("read.sounds", "source", 12, {"path": _R, "rate": _R, "length": _R, "channels": _R}),
        Verb("read.texts", "source", 12, {"path": _R}),
        Verb("scale.given", "add", 7, {"column": _R, "lowest": _R, "highest": _R, "lands": "signed"}, {"lands": ("signed", "unit", "splitsign")}, _one),
        Verb("settle.gaps", "add", 6, {"column": _R, "with": "zero", "value": 0.0}, {"with": ("zero", "refuse", "constant")}, _one),
        Verb("shuffle", "order", 7, {"seed": 20260929, "byId": False}),
        Verb("split.atRandom", "split", 2, {**_SHARES, "seed": 1, "testSeed": None, "folds": None, "fold": 0, "byId": False}),
        Verb("split.byTime", "split", 2, {"column": _R, **_SHARES, "gap": 0, "origins": None, "origin": 0}, reads=_one),
        Verb("split.stratified", "split", 2, {"column": _R, **_SHARES, "seed": 1, "folds": None, "fold": 0, "byId": False}, reads=_one),
        Verb("target", "answer", 1, {"column": _R}, reads=_one),
        Verb("target.ahead", "answer", 2, {"column": _R, "ahead": _R, "as": "value", "by": None}, {"as": ("value", "return")}, _one, True),
        Verb("target.distribution", "answer", 2, {"columns": _R, "scaleBy": None, "ordered": False, "remainder": None}, reads=lambda p: [*p["columns"], p["scaleBy"]]),
        Verb("target.labels", "answer", 2, {"columns": _R, "ones": 0}, reads=_many),
        Verb("target.numbers", "answer", 8, {"columns": _R}, reads=_many),
        Verb("tokenize", "fit", 12, {"column": _R, "length": _R, "vocabulary": _R}, reads=_one),
        Verb("watch.reference", "fit", 11, {"warnAbove": _R, "columns": None}, reads=_many),
    )
}

"""Measures of predictions, each an aggregation; the means over folds, blends of members, conformal margins."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.evidence import running
from tidemark.operators.quantiles import places


def regression(y: Column, p: Column) -> dict[str, Column]:
    """rmse, mae, r2 and mape (of rows whose answer is not 0)."""
    e = y - p
    return {
        "rmse": F.sqrt(F.avg(e * e)), "mae": F.avg(F.abs(e)),
        "r2": 1 - F.try_divide(F.avg(e * e), F.var_pop(y)), "mape": F.avg(F.when(y != 0, F.abs(e / y))),
    }


def interval(y: Column, low: Column, high: Column) -> dict[str, Column]:
    return {"coverage": F.avg(((y >= low) & (y <= high)).cast("double")), "width": F.avg(high - low)}


def binary(y: Column, p: Column, threshold: float = 0.5) -> dict[str, Column]:
    """accuracy, precision, recall, f1 and brier of answers 0 or 1 and probabilities."""
    said, true = p >= threshold, y == 1
    tp, fp, fn = F.count_if(said & true), F.count_if(said & ~true), F.count_if(~said & true)
    return {
        "accuracy": F.avg((said == true).cast("double")), "precision": F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)),
        "recall": F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)), "f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)),
        "brier": F.avg((p - y) * (p - y)),
    }


def measure(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    return df.agg(*(c.cast("double").alias(n) for n, c in measures.items()))


def confusion(df: DataFrame, y: Column, said: Column) -> DataFrame:
    return df.groupBy(y.alias("answer"), said.alias("predicted")).agg(F.count("*").alias("rows"))


def auc(df: DataFrame, y: Column, p: Column) -> DataFrame:
    """The share of pairs of a 1 and a 0 that the probability puts in order, ties half. Rows are counted by probability first, and ranges
    of probabilities are added up apart."""
    counts = df.groupBy(p.cast("double").alias("p")).agg(F.count_if(y == 1).alias("ones"), F.count_if(y != 1).alias("zeros"))
    placed = running(counts, "p", {"upto": "zeros"}).withColumn("won", F.col("ones") * (F.col("upto") - F.col("zeros") / 2.0))
    return placed.agg(F.try_divide(F.sum("won"), F.sum("ones").cast("double") * F.sum("zeros")).alias("auc"))


def shares(truth: list[Column], said: list[Column]) -> dict[str, Column]:
    """kl, emd and rps of rows of shares: emd sums the sizes of the differences of cumulative shares, rps their squares, both without the
    last, which is 0."""
    parts = [F.when(p > 0, F.when(q > 0, p * F.ln(p / q)).otherwise(float("inf"))).otherwise(0.0) for p, q in zip(truth, said, strict=True)]
    add = lambda cs: reduce(lambda a, b: a + b, cs)
    gaps = [add(truth[: i + 1]) - add(said[: i + 1]) for i in range(len(truth) - 1)]
    return {"kl": F.avg(add(parts)), "emd": F.avg(add([F.abs(g) for g in gaps])), "rps": F.avg(add([g * g for g in gaps]))}


TOLD = "part string, metric string, answer string, held string, said string, model double, baseline double"
CLASSES, SHARES, INTERVALS = ("accuracy", "precision", "recall", "f1", "confusionmatrix", "auc", "brier"), ("kl", "emd", "rps"), ("coverage", "width")


def named(values: list[Column], ones: int) -> list[Column]:
    """Which answers a prediction names: those at a half or more, or the `ones` largest, an earlier one first among equals."""
    if not ones:
        return [v >= 0.5 for v in values]
    order = F.slice(F.array_sort(F.array(*(F.struct((-v).alias("less"), F.lit(i).alias("i")) for i, v in enumerate(values)))), 1, ones)
    return [F.array_contains(F.transform(order, lambda x: x["i"]), i) for i in range(len(values))]


def _add(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def blended(members: list[list[Column]], how: str, ones: int) -> list[Column]:
    """What members say together of each answer: the mean, or how most of them name it, the mean deciding between as many votes."""
    means = [_add([m[i] for m in members]) / len(members) for i in range(len(members[0]))]
    if len(members) == 1 or how == "average":
        return means
    if how != "vote":
        raise ValueError(f"members are averaged or vote, not {how}")
    votes = [_add([c.cast("double") for c in each]) / len(members) for each in zip(*(named(m, ones) for m in members), strict=True)]
    if not ones:
        return [F.when(v > 0.5, 1.0).when(v < 0.5, 0.0).otherwise((m >= 0.5).cast("double")) for v, m in zip(votes, means, strict=True)]
    return [v + m / 1e6 for v, m in zip(votes, means, strict=True)]


def of_answers(metric: str, y: list[Column], p: list[Column], ones: int, counted: int, margins: list[float] | None) -> Column:
    """A measure of rows of answers and predictions as one aggregate (any but auc and the confusion matrix). Measures of amounts and of
    classes are taken answer by answer and averaged, each counting alike; those of shares row by row, each row divided by its total,
    emd and rps over the first `counted` answers, which stand in an order."""
    mean = lambda each: _add([each(a, b) for a, b in zip(y, p, strict=True)]) / len(y)
    if metric == "rmse":
        return mean(lambda a, b: F.sqrt(F.avg((a - b) * (a - b))))
    if metric == "mae":
        return mean(lambda a, b: F.avg(F.abs(a - b)))
    if metric == "mape":
        return mean(lambda a, b: F.avg(F.abs(a - b) / F.abs(a)))
    if metric == "r2":
        left, spread = lambda a, b: F.avg((a - b) * (a - b)), lambda a: F.var_pop(a)
        return mean(lambda a, b: F.when(left(a, b) == 0, 1.0).otherwise(1 - F.coalesce(F.try_divide(left(a, b), spread(a)), F.lit(1.0))))
    if metric in INTERVALS:
        each = [F.avg((F.abs(a - b) <= m).cast("double")) if metric == "coverage" else F.avg(F.lit(2.0 * m)) for a, b, m in zip(y, p, margins, strict=True)]
        return _add(each) / len(y)
    if metric == "brier":
        square = [(b - a) * (b - a) for a, b in zip(y, p, strict=True)]
        return F.avg(_add(square)) if ones == 1 and len(y) > 1 else _add([F.avg(x) for x in square]) / len(y)
    if metric in ("accuracy", "precision", "recall", "f1"):
        held, said = [a > 0.5 for a in y], named(p, ones)
        if metric == "accuracy":
            return F.avg(reduce(lambda a, b: a & b, [h == s for h, s in zip(held, said, strict=True)]).cast("double"))
        share = lambda part, whole: F.coalesce(F.try_divide(part, whole), F.lit(0.0))
        each = []
        for h, s in zip(held, said, strict=True):
            both, of_h, of_s = F.count_if(h & s), F.count_if(h), F.count_if(s)
            each.append(share(both, of_s) if metric == "precision" else share(both, of_h) if metric == "recall" else share(2 * both, of_h + of_s))
        return _add(each) / len(y)
    n = len(y) if metric == "kl" else counted
    parts = lambda cs: [c / _add(cs[:n]) for c in cs[:n]]
    return shares(parts(y), parts(p))[metric]


def of_part(units: DataFrame, answers: list[str], metrics: list[str], ones: int, counted: int, margins: list[float] | None) -> list[tuple]:
    """Rows of TOLD without the part, for units: y0.. (answers), p0.. (predictions) and b0.. (the baseline's), in the answers' units.
    What a measure cannot be taken of is refused."""
    from tidemark.operators.fits import Refused

    k = range(len(answers))
    y, p, b = ([F.col(f"{c}{i}") for i in k] for c in "ypb")
    metrics = [m for m in dict.fromkeys(metrics) if margins is not None or m not in INTERVALS]
    some = lambda tests: F.count_if(reduce(lambda a, c: a | c, tests))
    bad = {"rows": F.count(F.lit(1)), "odd": some([x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) for x in p])}
    if set(metrics) & set(CLASSES):
        bad["classes"] = some([(F.abs(x) > 1e-6) & (F.abs(x - 1) > 1e-6) for x in y])
    if set(metrics) & set(SHARES):
        bad["shares"] = some([x < 0 for x in [*y, *p]] + [_add(y[:counted]) <= 0, _add(p[:counted]) <= 0])
    if "mape" in metrics:
        bad["mape"] = some([x == 0 for x in y])
    if "auc" in metrics:
        bad["auc"] = F.greatest(*(F.when((F.count_if(x > 0.5) == 0) | (F.count_if(x <= 0.5) == 0), 1).otherwise(0) for x in y), F.lit(0))
    plain = [m for m in metrics if m not in ("auc", "confusionmatrix")]
    taken = {f"{w}_{m}": of_answers(m, y, x, ones, counted, margins) for m in plain for w, x in (("m", p), ("b", b))}
    seen = units.agg(*(c.alias(f"bad_{n}") for n, c in bad.items())).first().asDict()
    if not seen["bad_rows"]:
        raise Refused("the part holds no rows: there is nothing to measure")
    wrong = {"odd": "predictions that are no finite numbers", "classes": "answers that are no classes, each 0 or 1", "shares": "rows that are no shares", "mape": "answers of 0, which have no share to be an error of", "auc": "an answer of one class alone, which leaves no curve"}
    faults = [f"{seen[f'bad_{n}']} x {what}" for n, what in wrong.items() if seen.get(f"bad_{n}")]
    if "r2" in metrics and seen["bad_rows"] < 2:
        faults.append("one row, whose mean is its answer")
    if faults:
        raise Refused("; ".join(faults))
    values = units.agg(*(c.cast("double").alias(n) for n, c in taken.items())).first().asDict() if taken else {}
    out = []
    for m in metrics:
        if m == "auc":
            both = [sum(auc(units, F.when(a > 0.5, 1).otherwise(0), x[i]).first()[0] for i, a in enumerate(y)) / len(y) for x in (p, b)]
            out.append((m, None, None, None, *both))
        elif m == "confusionmatrix":
            out += _confusions(units, answers, y, p, b, ones)
        else:
            out.append((m, None, None, None, values[f"m_{m}"], values[f"b_{m}"]))
    return out


def _confusions(units: DataFrame, answers: list[str], y: list[Column], p: list[Column], b: list[Column], ones: int) -> list[tuple]:
    """One matrix over the answers where a row holds one of them, else one of 0 and 1 for each answer."""
    def cells(x: list[Column]) -> dict[tuple, int]:
        held, said = [a > 0.5 for a in y], named(x, ones)
        if ones == 1:
            first = lambda flags: reduce(lambda rest, f: F.when(f[1], f[0]).otherwise(rest), reversed(list(zip(answers, flags, strict=True))), F.lit(None).cast("string"))
            rows = units.select(F.lit(None).cast("string").alias("answer"), first(held).alias("held"), first(said).alias("said"))
        else:
            rows = units.select(F.inline(F.array(*(F.struct(F.lit(a).alias("answer"), h.cast("int").cast("string").alias("held"), s.cast("int").cast("string").alias("said")) for a, h, s in zip(answers, held, said, strict=True)))))
        return {(r["answer"], r["held"], r["said"]): r["count"] for r in rows.groupBy("answer", "held", "said").count().collect()}

    model, base = cells(p), cells(b)
    return [("confusionmatrix", *cell, float(model.get(cell, 0)), float(base.get(cell, 0))) for cell in sorted({*model, *base}, key=str)]


def across(folds: DataFrame, metric: str) -> DataFrame:
    return folds.agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("deviation"))


def blend_average(members: DataFrame, key: str, prediction: str) -> DataFrame:
    return members.groupBy(key).agg(F.avg(prediction).alias("prediction"))


def blend_vote(members: DataFrame, key: str, word: str, weight: str) -> DataFrame:
    """The word most members say; of words said as often, that with the larger mean weight, then the first by name. Weights are added up as
    decimals of 12 places, so that means that are equal do not differ by the order in which they are summed."""
    exact, told = F.expr(f"try_cast(`{weight}` AS DECIMAL(28, 12))"), F.count(weight)
    mean = F.when(F.count(exact) == told, F.try_divide(F.sum(exact).cast("double"), told)).otherwise(F.avg(weight))  # weights beyond decimals are added as they are
    votes = members.groupBy(key, word).agg(F.count("*").alias("n"), mean.alias("w"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), F.desc("w"), word)
    return votes.withColumn("r", F.row_number().over(order)).where("r = 1").select(key, F.col(word).alias("prediction"))


def conformal_margin(df: DataFrame, y: Column, p: Column, alpha: float) -> float:
    """The ceil((n + 1)(1 - alpha))-th smallest error of the calibration rows, looked up by ranges and not by ordering rows."""
    place = lambda n: math.ceil((n + 1) * (1 - alpha) - 1e-9)
    n, _, at = places(df.select(F.abs(y - p).alias("e")), F.col("e"), lambda n: [place(n) - 1] if 1 <= place(n) <= n else [])
    if not at:
        raise ValueError(f"{n} calibration rows are too few for alpha {alpha}")
    return at[place(n) - 1].value


def around(prediction: Column, margin: float) -> tuple[Column, Column]:
    """The ends of the interval around a prediction."""
    return prediction - margin, prediction + margin

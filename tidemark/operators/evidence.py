"""What can be said of a table before anything is trained: profiles, duplicates, correlation, likeness of parts, and drift."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.kinds import finite, is_not_finite, kind_of
from tidemark.operators.quantiles import quantiles, range_of

#: Ranges that values are cut into at most.
MOST_RANGES = 256
#: Cells that a task meets with their ranks, and rows of one value among them, on average and at most.
MOST_CELLS, MOST_ALIKE = 1 << 21, 1 << 18


def _is_number(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("double", "float", "long", "integer", "short", "byte", "boolean", "decimal")


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: rows, gaps, not_finite, distinct, constant, min, max, mean, median. One aggregation over all, and two passes
    for all medians; distinct counts are exact."""
    aggregates, rows, numbers = [F.count(F.lit(1)).alias("rows")], [], []
    for k, name in enumerate(columns):
        c, number = F.col(f"`{name}`"), _is_number(df, name)
        x = finite(c) if number else F.lit(None).cast("double")
        aggregates += [
            F.count_if(c.isNull()).alias(f"gaps{k}"),
            (F.count_if(is_not_finite(c)) if number else F.lit(0)).cast("bigint").alias(f"odd{k}"),
            F.min(x).alias(f"min{k}"), F.max(x).alias(f"max{k}"), F.avg(x).alias(f"mean{k}"),
        ]
        if number:
            numbers.append(k)
        fields = [F.lit(name).alias("column"), F.col("rows"), *(F.col(f"{f}{k}").alias(t) for f, t in (("gaps", "gaps"), ("odd", "not_finite")))]
        rows.append((k, [*fields, *(F.col(f"{f}{k}").alias(f) for f in ("min", "max", "mean"))]))
    middle = dict(zip(numbers, quantiles(df, [finite(F.col(f"`{columns[k]}`")) for k in numbers], [0.5]), strict=True))
    rows = [F.struct(*cells, F.lit(middle[k][0] if middle.get(k) else None).cast("double").alias("median")) for k, cells in rows]
    told = df.agg(*aggregates).select(F.inline(F.array(*rows)))
    # one shuffle counts the distinct values of all columns
    values = df.select(F.inline(F.array(*(F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").cast("string").alias("v")) for n in columns))))
    distinct = values.where("v is not null").distinct().groupBy("column").agg(F.count("*").alias("distinct"))
    joined = told.join(distinct, "column", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))
    return joined.withColumn("constant", F.col("distinct") <= 1).select("column", "rows", "gaps", "not_finite", "distinct", "constant", "min", "max", "mean", "median")


def duplicates(df: DataFrame, key: Column, part: Column | None = None) -> DataFrame:
    """One row: groups of rows with one key, rows in them, copies beyond the first, and groups that lie in several parts."""
    counts = df.groupBy(key.alias("_k")).agg(F.count("*").alias("n"), F.size(F.collect_set(part if part is not None else F.lit(""))).alias("parts")).where("n > 1")
    return counts.agg(
        F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"),
        F.coalesce(F.count_if(F.col("parts") > 1), F.lit(0)).alias("across"),
    )


@dataclass
class Alerts:
    """What a profile finds wrong with columns of the measured rows, and how each is answered. table() is a row for each alert: place,
    column, other (the column it repeats), alert, rows (how many it counts), action (step, leaveout or saymissing), verb and value.

    Alerts: gaps; notfinite; constant; category; text; identifier (words no two rows share, or a running number, unless the rows are put
    in order or divided by it); nothingknown (0, -1 or nines as the smallest or largest value of two rows or more, further from the next
    than ten times the median step between values); answer (goes one to one with the answer); repeats (one to one with an earlier
    column); ranks (keeps the order of an earlier column, by Spearman above rank_above)."""

    df: DataFrame
    columns: list[str]
    answers: list[str]
    ordered_by: list[str]
    rank_above: float | None = None

    def table(self) -> DataFrame:
        kinds = {c: self.df.schema[c].metadata.get("kind") or kind_of(self.df.schema[c]) for c in self.columns}
        seen = {r["column"]: r for r in profile(self.df, self.columns).collect()}  # a row for each column
        out = []
        for place, c in enumerate(self.columns):
            r, kind = seen[c], kinds[c]
            say = lambda alert, rows, action, verb=None, value=None, other=None, c=c, place=place: out.append((place, c, other, alert, int(rows), action, verb, value))
            if r["gaps"]:
                say("gaps", r["gaps"], "step", {"number": "fill.missing", "integer": "fill.missing", "category": "encode.categories", "text": "encode"}.get(kind, "drop.gaps"))
            if r["not_finite"]:
                say("notfinite", r["not_finite"], "step", "fill.nan")
            if r["distinct"] == 1:
                say("constant", r["rows"], "leaveout")
            if kind in ("category", "text"):
                say(kind, r["rows"], "step", "encode.categories" if kind == "category" else "encode")
            values = r["rows"] - r["gaps"]
            running = kind == "integer" and r["max"] is not None and r["max"] - r["min"] + 1 == values
            if values >= 2 and r["distinct"] == values and c not in self.ordered_by and (kind == "text" or running):
                say("identifier", values, "leaveout")
            if kind in ("number", "integer"):
                for value, rows in self._nothing_known(c, r):
                    say("nothingknown", rows, "saymissing", value=f"{value:.0f}")
        out += self._pairs(seen)
        if self.rank_above is not None:
            out += self._ranks(seen, kinds, {o[1] for o in out if o[5] == "leaveout"})
        schema = "place int, column string, other string, alert string, rows long, action string, verb string, value string"
        return self.df.sparkSession.createDataFrame(out, schema)

    def _nothing_known(self, c: str, r) -> list[tuple[float, int]]:
        written = lambda v: v in (0, -1) or (v == int(v) and abs(v) >= 9 and set(str(int(abs(v)))) == {"9"})
        ends = [e for e in ("min", "max") if r[e] is not None and written(r[e])]
        if not ends or r["distinct"] < 3:
            return []
        counts = self.df.select(finite(F.col(f"`{c}`")).alias("v")).where("v is not null").groupBy("v").count()
        low = counts.orderBy("v").limit(2).collect()
        high = counts.orderBy(F.desc("v")).limit(2).collect()
        usual = quantiles(steps(counts, "v"), [F.col("step")], [0.5])[0][0]
        found = []
        for e, two in (("min", low), ("max", high)):
            if e in ends and len(two) == 2 and two[0]["count"] >= 2 and abs(two[0]["v"] - two[1]["v"]) > 10 * usual:
                found.append((two[0]["v"], two[0]["count"]))
        return found

    def _pairs(self, seen: dict) -> list[tuple]:
        """Columns are compared where they have equally many values (a gap being one), at least two of them and two rows a value."""
        rows = next(iter(seen.values()))["rows"] if seen else 0
        extra = [a for a in self.answers if a not in seen]
        more = {r["column"]: r for r in profile(self.df, extra).collect()} if extra else {}
        size = {c: r["distinct"] + (r["gaps"] > 0) for c, r in {**seen, **more}.items()}
        able = [c for c in [*self.columns, *extra] if size[c] >= 2 and 2 * size[c] <= rows]
        asked = []
        for place, c in enumerate(self.columns):
            if c in able and c not in self.answers:
                asked += [(place, c, a, "answer") for a in self.answers if a in able and size[a] == size[c]]
                asked += [(place, c, b, "repeats") for b in self.columns[:place] if b in able and b not in self.answers and size[b] == size[c]]
        if not asked:
            return []
        text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit(""))
        cells = self.df.select(F.inline(F.array(*(F.struct(F.lit(k).alias("k"), text(c).alias("x"), text(o).alias("y")) for k, (_, c, o, _) in enumerate(asked))))).distinct()
        both = {r["k"]: r["n"] for r in cells.groupBy("k").agg(F.count("*").alias("n")).collect()}
        out, done = [], set()
        for k, (place, c, other, alert) in enumerate(asked):
            if c not in done and both[k] == size[c]:
                done.add(c)
                out.append((place, c, other, alert, int(rows), "leaveout", None, None))
        return out

    def _ranks(self, seen: dict, kinds: dict[str, str], left: set[str]) -> list[tuple]:
        numbers = [c for c in self.columns if kinds[c] in ("number", "integer", "boolean") and c not in left and c not in self.answers]
        # Columns without gaps are complete in the same rows, so all their pairs come of one table; others share what their pair has.
        whole = [c for c in numbers if not seen[c]["gaps"] and not seen[c]["not_finite"]]
        told = correlation(self.df, whole, "spearman").collect() if len(whole) > 1 else []  # a row for each two columns
        told += [correlation(self.df, list(two), "spearman").first() for two in combinations(numbers, 2) if not set(two) <= set(whole)]
        met: dict[str, tuple] = {}
        for r in sorted(told, key=lambda r: numbers.index(r["left"])):
            if abs(r["coefficient"]) > self.rank_above and (r["right"] not in met or abs(r["coefficient"]) > abs(met[r["right"]][0])):
                met[r["right"]] = r["coefficient"], r["left"], r["kept"]
        return [(self.columns.index(c), c, met[c][1], "ranks", int(met[c][2]), "leaveout", None, None) for c in numbers if c in met]


def average_rank(c: Column, part: list[str] | None = None) -> Column:
    """Rank from 1, equal values sharing the mean of their places."""
    same = Window.partitionBy(*(part or []), c)
    return F.rank().over(Window.partitionBy(*(part or [])).orderBy(c)) + (F.count(F.lit(1)).over(same) - 1) / 2.0


def running(counts: DataFrame, value: str, sums: dict[str, str], by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """counts with, for each entry of sums (name: column), the sum of the column over the rows up to and with its own, by rising value
    (a number), within `by`. Values are cut into ranges at approximate quantiles; a task adds up one range, and what lies below a range
    is taken from a table of one row for each range. No task orders all values."""
    by, n = by or [], buckets or min(MOST_RANGES, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if n < 2:
        window = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        return counts.withColumns({name: F.sum(c).over(window) for name, c in sums.items()})
    shares = [i / n for i in range(1, n)]
    cuts = counts.agg(F.percentile_approx(value, shares, 10 * n)).first()[0] or []  # n numbers
    cuts = sorted({x for x in cuts if x is not None})
    dealt = counts.withColumn("_range", range_of(F.col(value), cuts))
    totals = dealt.groupBy(*by, "_range").agg(*(F.sum(c).alias(f"_t_{name}") for name, c in sums.items()))
    below = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = totals.select(*(F.col(b).alias(f"_b_{b}") for b in by), F.col("_range").alias("_at"), *(F.coalesce(F.sum(f"_t_{name}").over(below), F.lit(0)).alias(f"_o_{name}") for name in sums))
    inner = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumns({f"_i_{name}": F.sum(c).over(inner) for name, c in sums.items()})
    met = own.join(F.broadcast(offsets), [F.col("_range") == F.col("_at"), *(F.col(b).eqNullSafe(F.col(f"_b_{b}")) for b in by)])  # ranges x groups rows
    return met.select(*counts.columns, *((F.col(f"_i_{name}") + F.col(f"_o_{name}")).alias(name) for name in sums))


def steps(counts: DataFrame, value: str) -> DataFrame:
    """step: from each value to the next larger one. Ranges of values are ordered by a task each; the first value of a range is told to
    the range below it."""
    n = min(MOST_RANGES, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted({x for x in counts.agg(F.percentile_approx(value, [i / n for i in range(1, n)], 10 * n)).first()[0] or [] if x is not None}) if n > 1 else []
    dealt = counts.select(value, range_of(F.col(value), cuts).alias("_range"))
    firsts = dealt.groupBy("_range").agg(F.min(value).alias("_first"))  # a row for each range
    follows = firsts.select(F.col("_range").alias("_at"), F.lead("_first").over(Window.orderBy("_range")).alias("_after"))
    met = dealt.join(F.broadcast(follows), F.col("_range") == F.col("_at"))
    after = F.coalesce(F.lead(value).over(Window.partitionBy("_range").orderBy(value)), F.col("_after"))
    return met.select((after - F.col(value)).alias("step")).where("step is not null")


def ranked(df: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """c0, c1 and so on: the average ranks of columns without gaps, all from one long table. Values are counted first and only their
    counts are ordered; each cell then meets its rank by column and value, and the cells of a row meet each other. rows: how many df
    has. There are as many tasks as the cells ask for, and a value of many rows is dealt to several of them."""
    cells = F.array(*(F.col(f"`{c}`").cast("double") for c in columns))
    # Rows are numbered before they are exploded: beside an explode, each cell would have a number of its own.
    long = df.select(F.monotonically_increasing_id().alias("row"), cells.alias("cells")).select("row", F.posexplode("cells").alias("i", "v"))
    counts = df.select(F.posexplode(cells).alias("i", "v")).groupBy("i", "v").agg(F.count("*").alias("n"))
    placed = running(counts, "v", {"upto": "n"}, ["i"]).select(F.col("i").alias("of"), F.col("v").alias("w"), "n", (F.col("upto") - (F.col("n") - 1) / 2.0).alias("r"))
    # Spark deals doubles anew for a join, in as many tasks as the session has; their hashes, told apart by the values, stay where they are.
    at, met_by = ["i", "h"], ["of", "g"]
    if rows > MOST_ALIKE:
        shares = F.ceil(F.col("n") / MOST_ALIKE)
        many = counts.where(F.col("n") > MOST_ALIKE).select(F.col("i").alias("of"), F.col("v").alias("w"), shares.alias("shares"))  # rows x columns / MOST_ALIKE at most
        share = F.pmod(F.hash("row"), F.coalesce(F.col("shares"), F.lit(1)))
        long = long.join(F.broadcast(many), (F.col("i") == F.col("of")) & (F.col("v") == F.col("w")), "left").select("row", "i", "v", share.alias("share"))
        placed = placed.select("of", "w", "r", F.explode(F.sequence(F.lit(0).cast("bigint"), shares - 1)).alias("of_share"))
        at, met_by = [*at, "share"], [*met_by, "of_share"]
    long, placed = long.withColumn("h", F.xxhash64(F.col("v") + 0.0)), placed.withColumn("g", F.xxhash64(F.col("w") + 0.0))  # no -0.0
    tasks = math.ceil(rows * len(columns) / MOST_CELLS)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda d, by: d.repartition(max(tasks, least), *by) if tasks > 1 else d
    same = [F.col(a) == F.col(b) for a, b in zip(at, met_by, strict=True)] + [~((F.col("v") < F.col("w")) | (F.col("v") > F.col("w")))]
    met = dealt(long, at).join(dealt(placed, met_by), same).select("row", "i", "r")
    return dealt(met, ["row"]).groupBy("row").agg(*(F.max(F.when(F.col("i") == k, F.col("r"))).alias(f"c{k}") for k in range(len(columns)))).drop("row")


def gram(df: DataFrame, centre: float) -> DataFrame:
    """a, b and s: the sums of the products of each two columns of df, all doubles without gaps, less a centre. A task adds up its rows and
    sends one number a pair."""
    width = len(df.columns)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) - centre
            total += x.T @ x
        at, by = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(by.astype(np.int32)), pa.array(total[at, by])], names=["a", "b", "s"])

    return df.mapInArrow(summed, "a int, b int, s double").groupBy("a", "b").agg(F.sum("s").alias("s"))


def coefficient(a: Column, b: Column) -> Column:
    """Pearson's, NaN where a column is constant; at most 1 in size."""
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(r.isNull(), float("nan")).otherwise(F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))


def correlation(df: DataFrame, columns: list[str], how: str = "pearson") -> DataFrame:
    """left, right, coefficient, kept (rows with all columns finite) and total."""
    numbers = df.select(*(finite(F.col(f"`{c}`")).alias(c) for c in columns))
    total = numbers.agg(F.count("*").alias("total"))
    kept = numbers.dropna()
    if how == "spearman":
        return _by_rank(numbers, columns)
    pairs = list(combinations(range(len(columns)), 2))
    told = kept.agg(F.count("*").alias("kept"), *(coefficient(F.col(f"`{columns[i]}`"), F.col(f"`{columns[j]}`")).alias(f"r{i}_{j}") for i, j in pairs))
    rows = F.array(*(F.struct(F.lit(columns[i]).alias("left"), F.lit(columns[j]).alias("right"), F.col(f"r{i}_{j}").alias("coefficient"), F.col("kept")) for i, j in pairs))
    return told.select(F.inline(rows)).crossJoin(total)  # one row


def _by_rank(numbers: DataFrame, columns: list[str]) -> DataFrame:
    complete = F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    total, n = numbers.agg(F.count("*"), F.count_if(complete)).first()
    kept = numbers.where(complete)
    products = {(r["a"], r["b"]): r["s"] for r in gram(ranked(kept, columns, n), (n + 1) / 2).collect()}  # a number for each two columns
    told = []
    for i, j in combinations(range(len(columns)), 2):
        size = math.sqrt(products.get((i, i), 0.0) * products.get((j, j), 0.0))
        told.append((columns[i], columns[j], max(-1.0, min(1.0, products[i, j] / size)) if size else math.nan, n, total))
    return kept.sparkSession.createDataFrame(told, "left string, right string, coefficient double, kept bigint, total bigint")


PARTS = ("calibration", "test", "train", "validation")


def likeness(df: DataFrame, columns: list[str], part: str = "_part", warn_above: float = 0.1) -> DataFrame:
    """column, left, right, distance and warned for each column and two parts that hold values of it; rows of gap and predict take no part.

    The distance is the largest gap between cumulative shares (numbers, moments), or half the sum of the differences of shares (words).
    All columns are counted in one long table, a value once with its rows in each part."""
    cells = []
    for i, c in enumerate(columns):
        kind = df.schema[c].dataType.typeName()
        moment = kind in ("timestamp", "date", "timestamp_ntz")
        number = F.unix_micros(F.col(f"`{c}`").cast("timestamp")).cast("double") if moment else F.col(f"`{c}`").cast("double") if _is_number(df, c) else F.lit(None).cast("double")
        word = F.lit(None).cast("string") if moment or _is_number(df, c) else F.col(f"`{c}`").cast("string")
        cells.append(F.struct(F.lit(i).alias("i"), number.alias("v"), word.alias("word")))
    long = df.where(F.col(part).isin(*PARTS)).select(F.col(part).alias("p"), F.inline(F.array(*cells))).where("v is not null or word is not null")
    wide = long.groupBy("i", "v", "word").agg(*(F.count_if(F.col("p") == p).alias(f"n{k}") for k, p in enumerate(PARTS)))
    totals = wide.groupBy(F.col("i").alias("of")).agg(*(F.sum(f"n{k}").alias(f"t{k}") for k in range(len(PARTS))))  # a row a column
    pairs = list(combinations(range(len(PARTS)), 2))
    share = lambda prefix, k: F.try_divide(F.col(f"{prefix}{k}").cast("double"), F.col(f"t{k}"))
    apart = lambda prefix, a, b: F.abs(share(prefix, a) - share(prefix, b))
    along = running(wide.where("word is null").drop("word"), "v", {f"c{k}": f"n{k}" for k in range(len(PARTS))}, ["i"]).join(F.broadcast(totals), F.col("i") == F.col("of"))
    numbers = along.groupBy("i").agg(*(F.max(apart("c", a, b)).alias(f"d{a}{b}") for a, b in pairs))
    words = wide.where("word is not null").join(F.broadcast(totals), F.col("i") == F.col("of")).groupBy("i").agg(*((F.sum(apart("n", a, b)) / 2).alias(f"d{a}{b}") for a, b in pairs))
    rows = F.array(*(F.struct(F.lit(PARTS[a]).alias("left"), F.lit(PARTS[b]).alias("right"), F.col(f"d{a}{b}").alias("distance")) for a, b in pairs))
    told = numbers.unionByName(words).select(F.get(F.array(*map(F.lit, columns)), F.col("i")).alias("column"), F.inline(rows)).where("distance is not null")
    return told.withColumn("warned", F.col("distance") > warn_above)


def _tallied(df: DataFrame, c: str) -> Column:
    """The number a value is compared by: a moment counts as days; words have none."""
    if df.schema[c].dataType.typeName() in ("timestamp", "date", "timestamp_ntz"):
        return F.unix_micros(F.col(f"`{c}`").cast("timestamp")) / 86_400_000_000.0
    return finite(F.col(f"`{c}`")) if _is_number(df, c) else F.lit(None).cast("double")


def tallies(train: DataFrame, columns: list[str]) -> DataFrame:
    """column, value (as text), number, n: how often each value stands in the training rows. Numbers that are not finite count as gaps."""
    has = lambda c: _is_number(train, c) or train.schema[c].dataType.typeName() in ("timestamp", "date", "timestamp_ntz")
    cell = lambda c: F.when(_tallied(train, c).isNotNull() if has(c) else F.lit(True), F.col(f"`{c}`").cast("string"))
    rows = train.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), cell(c).alias("value"), _tallied(train, c).alias("number")) for c in columns))))
    return rows.where("value is not null").groupBy("column", "value", "number").agg(F.count("*").alias("n"))


#: A window of so many different cells at most is carried to the tallies; a larger one is joined with them.
MOST_WATCHED = 200_000


def watched(reference: DataFrame, window: DataFrame, columns: list[str], warn_above: float) -> DataFrame:
    """column, distance and warned: how far the rows of a window are from the tallies of training. Kolmogorov-Smirnov for numbers and
    moments, total variation for words; null where either side has no value."""
    cells = tallies(window, columns).limit(MOST_WATCHED + 1).collect()  # bounded
    if len(cells) > MOST_WATCHED:
        return _watched_joined(reference, window, columns, warn_above)
    numbers = {c: sorted((r["number"], r["n"]) for r in cells if r["column"] == c and r["number"] is not None) for c in columns}
    words = {c: {r["value"]: r["n"] for r in cells if r["column"] == c and r["number"] is None} for c in columns}
    told: dict[str, dict[tuple[str, int], int]] = {c: {} for c in columns}
    for r in _placed_tallies(reference, numbers, words).collect():  # at most three rows a cell of the window
        told[r["column"]][r["what"], r["k"]] = r["n"]
    rows = []
    for c in columns:
        if not told[c] and not numbers[c] and not words[c]:
            continue
        of_window = sum(n for _, n in numbers[c]) + sum(words[c].values())
        of_reference, distance = sum(told[c].values()), None
        if of_window and of_reference and numbers[c]:
            # Between two values of the window its share stands still, so the gap is widest at one of them or right before it.
            below = held = 0
            distance = 0.0
            for k, (_, n) in enumerate(numbers[c]):
                below += told[c].get(("below", k), 0)
                distance = max(distance, abs(below / of_reference - held / of_window))
                below, held = below + told[c].get(("at", k), 0), held + n
                distance = max(distance, abs(below / of_reference - held / of_window))
        elif of_window and of_reference:
            met = {w: told[c].get(("word", k), 0) for k, w in enumerate(words[c])}
            distance = (sum(abs(met[w] / of_reference - n / of_window) for w, n in words[c].items()) + (of_reference - sum(met.values())) / of_reference) / 2
        rows.append((c, distance, distance is not None and distance > warn_above))
    return window.sparkSession.createDataFrame(rows, "column string, distance double, warned boolean")


def _placed_tallies(reference: DataFrame, numbers: dict[str, list], words: dict[str, dict]) -> DataFrame:
    """column, what, k and n: how many training rows hold the window's k-th number (at), one right below it (below; above the last, the k
    after it), its k-th word (word), or another one (other, -1). The tallies are read once, by binary search, and hardly anything moves."""
    ends = {c: np.array([v for v, _ in some]) for c, some in numbers.items()}
    at_word = {c: {w: k for k, w in enumerate(some)} for c, some in words.items()}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str, int], int] = {}
        for b in batches:
            t = pa.Table.from_batches([b]).to_pandas()
            for c, rows in t.groupby("column"):
                if c not in ends:
                    continue
                x, n = rows["number"].to_numpy(float), rows["n"].to_numpy()
                there = ~np.isnan(x)
                if there.any():
                    k = np.searchsorted(ends[c], x[there], "left")
                    equal = (k < len(ends[c])) & (ends[c][np.minimum(k, len(ends[c]) - 1)] == x[there]) if len(ends[c]) else np.zeros(len(k), bool)
                    for what, mask in (("at", equal), ("below", ~equal)):
                        for i, m in zip(*(a.tolist() for a in _added(k[mask], n[there][mask])), strict=True):
                            total[c, what, i] = total.get((c, what, i), 0) + m
                for w, m in zip(rows["value"].to_numpy()[~there], n[~there].tolist(), strict=True):
                    k = at_word[c].get(w, -1)
                    total[c, "word" if k >= 0 else "other", k] = total.get((c, "word" if k >= 0 else "other", k), 0) + m
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([key[i] for key in total]) for i in range(3)] + [pa.array(list(total.values()), pa.int64())], names=["column", "what", "k", "n"])

    sent = reference.select("column", "value", "number", "n").mapInArrow(placed, "column string, what string, k bigint, n bigint")
    return sent.groupBy("column", "what", "k").agg(F.sum("n").alias("n"))


def _added(k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, where = np.unique(k, return_inverse=True)
    return at, np.bincount(where, n, len(at)).astype(np.int64) if len(k) else n[:0]


def accounts(reference: DataFrame, window: DataFrame, columns: list[str], trained: int | None, along: list[str]) -> DataFrame:
    """column, training_rows, training_gaps, window_rows, window_gaps, from and to: how many rows hold a value of each column and how many
    none, in training (of `trained` rows; null where that is not known) and in a window, and the first and last moment of the window
    by the first column of `along` that it holds moments in (null without one, and of a window without rows)."""
    moment = next((c for c in along if c in window.columns and window.schema[c].dataType.typeName() in ("timestamp", "date", "timestamp_ntz")), None)
    at = F.col(f"`{moment}`").cast("timestamp") if moment else F.lit(None).cast("timestamp")
    odd = [_tallied(window, c).isNull() if _is_number(window, c) else F.col(f"`{c}`").isNull() for c in columns]
    counted = window.agg(F.count("*").alias("rows"), F.min(at).alias("from"), F.max(at).alias("to"), *(F.count_if(o).alias(f"g{i}") for i, o in enumerate(odd)))  # one row
    each = counted.select("rows", "from", "to", F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"g{i}").alias("window_gaps")) for i, c in enumerate(columns)))))
    held = reference.groupBy("column").agg(F.sum("n").alias("held"))  # a row a column
    rows = F.coalesce("held", F.lit(0).cast("long"))
    return each.join(held, "column", "left").select(
        "column", rows.alias("training_rows"), (F.lit(trained).cast("long") - rows).alias("training_gaps"), (F.col("rows") - F.col("window_gaps")).alias("window_rows"), "window_gaps", "from", "to",
    )


def _watched_joined(reference: DataFrame, window: DataFrame, columns: list[str], warn_above: float) -> DataFrame:
    both = reference.select("column", "value", "number", "n", F.lit("a").alias("side")).unionByName(tallies(window, columns).withColumn("side", F.lit("b")))
    wide = both.where(F.col("column").isin(*columns)).groupBy("column", F.when(F.col("number").isNull(), F.col("value")).alias("word"), "number").agg(
        F.coalesce(F.sum(F.when(F.col("side") == "a", F.col("n"))), F.lit(0)).alias("a"), F.coalesce(F.sum(F.when(F.col("side") == "b", F.col("n"))), F.lit(0)).alias("b")
    )
    total = wide.groupBy("column").agg(F.sum("a").alias("of_a"), F.sum("b").alias("of_b"))  # a row for each column
    words = wide.where("number is null").join(F.broadcast(total), "column")
    tv = words.groupBy("column").agg((F.sum(F.abs(F.try_divide("a", "of_a") - F.try_divide("b", "of_b"))) / 2).alias("distance"))
    along = running(wide.where("number is not null").select("column", "number", "a", "b"), "number", {"ca": "a", "cb": "b"}, ["column"]).join(F.broadcast(total), "column")
    ks = along.groupBy("column").agg(F.max(F.abs(F.try_divide("ca", "of_a") - F.try_divide("cb", "of_b"))).alias("distance"))
    return ks.unionByName(tv).withColumn("warned", F.coalesce(F.col("distance") > warn_above, F.lit(False)))

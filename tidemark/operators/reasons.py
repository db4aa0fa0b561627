"""Why a model answers as it does: rows as they are read are changed, replayed through a fit and answered. Nothing is fitted.

Changed rows carry _asked (what is told of the row they are made of) and _draw (which change they are of) through the replay. `answered` takes such
rows to _asked, _draw and the answers a0, a1 and so on, in the units they are read in.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.operators.fits import Refused
from tidemark.session import kept_table

Answered = Callable[[DataFrame], DataFrame]
#: Rows are dealt among so many, about, that a hash has brought together.
PACK = 2**14
#: Factors of permutations are primes between these; none divides a pack's size.
FACTORS = 2**19, 2**20
OTHERS = "the model answered other rows than it was handed"


def _factors(n: int, k: int, given: random.Random) -> list[tuple[int, int]]:
    """k permutations of n places, and of any other number below the factors: place i goes to (a i + b) mod n."""
    out = []
    while len(out) < k:
        a = given.randrange(max(FACTORS[0], n + 1), max(FACTORS[1], 2 * n + 2))
        if all(a % p for p in range(2, math.isqrt(a) + 1)):
            out.append((a, given.randrange(FACTORS[1])))
    return out


def _sizes(answers: int) -> Column:
    return sum((F.abs(F.col(f"a{i}") - F.col(f"_asked.base.a{i}")) for i in range(answers)), F.lit(0.0)) / answers


def reliance(rows: DataFrame, columns: list[str], answered: Answered, answers: int, seed: int, repeats: int) -> DataFrame:
    """column, mean and spread: how far an answer moves (in size, averaged over rows and answers) when a column's cells are dealt among the
    rows anew, over `repeats` deals; the spread is their sample standard deviation, 0 for one deal. The column that moves it most is first.

    A hash of a row's place brings it to one of many packs, so that a pack is a random share of the rows and each row meets each other with
    equal chance. Rows are sent to their packs once; within it each deal is a permutation of places that is told by two numbers."""
    own = [c for c in rows.columns if c != "_read_at"]
    told = F.struct(F.col("_read_at").alias("at"), F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own))).alias("cells"))
    said = answered(rows.select(*(F.col(f"`{c}`") for c in own), "_read_at", F.lit(-1).alias("_draw"), told.alias("_asked")))
    base = kept_table(said.select(F.xxhash64(F.lit(seed), "_asked.at").alias("h"), "_asked.*", F.struct(*(f"a{i}" for i in range(answers))).alias("base")), "asked")
    n = base.count()
    if n == 0:
        raise Refused("there are no rows to ask why of")
    if n != rows.count():
        raise Refused(OTHERS)
    numbers = [own.index(c) for c in columns]
    drawn = [(c, c * repeats + r) for c in range(len(columns)) for r in range(repeats)]
    deals = F.array(*(F.struct(F.lit(d).alias("draw"), F.lit(numbers[c]).alias("column"), F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for (c, d), (a, b) in zip(drawn, _factors(PACK, len(drawn), random.Random(seed)), strict=True)))
    # The order within a pack is another hash's: what the first has in common in a pack says nothing of the second.
    row = F.struct(F.xxhash64(F.lit(seed + 1), "at").alias("h"), "at", "cells", "base")
    packs = base.groupBy(F.pmod("h", F.lit(-(-n // PACK))).alias("_pack")).agg(F.sort_array(F.collect_list(row)).alias("_rows"))  # about PACK rows
    each = packs.select(F.explode(deals).alias("_deal"), "_rows")

    # What is told of each row is only which two rows meet; cells are chosen by compiled code, once they are rows again.
    other = lambda place: F.get(F.col("_rows"), F.pmod(F.col("_deal.a") * place + F.col("_deal.b"), F.size("_rows")).cast("int"))
    met = each.select("_deal.draw", "_deal.column", F.inline(F.transform("_rows", lambda r, place: F.struct(r.alias("r"), other(place)["cells"].alias("got")))))
    cell = lambda i: F.when(F.col("column") == i, F.col(f"got.c{i}")).otherwise(F.col(f"r.cells.c{i}")) if i in numbers else F.col(f"r.cells.c{i}")
    asked = met.select(*(cell(i).alias(c) for i, c in enumerate(own)), F.col("r.at").alias("_read_at"), F.col("draw").alias("_draw"), F.struct("r.base").alias("_asked"))
    moved = answered(asked).groupBy("_draw").agg(F.avg(_sizes(answers)).alias("moved"), F.count("*").alias("rows")).collect()  # a row a deal
    if len(moved) != len(drawn) or any(r["rows"] != n for r in moved):
        raise Refused(OTHERS)
    sizes: dict[str, list[float]] = {c: [] for c in columns}
    for r in sorted(moved, key=lambda r: r["_draw"]):
        sizes[columns[r["_draw"] // repeats]].append(r["moved"])
    means = {c: sum(v) / repeats for c, v in sizes.items()}
    spread = lambda c: math.sqrt(sum((x - means[c]) ** 2 for x in sizes[c]) / (repeats - 1)) if repeats > 1 else 0.0
    out = sorted(((c, means[c], spread(c)) for c in columns), key=lambda r: -r[1])
    return rows.sparkSession.createDataFrame(out, "column string, mean double, spread double").coalesce(1)


def dependence(rows: DataFrame, column: str, grid: list, answered: Answered, names: list[str], n: int) -> DataFrame:
    """value (as text), place (from 0), answer and mean: the mean answers with a column set to each value of the grid in every row."""
    kind = rows.schema[column].dataType
    places = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(v).cast(kind).alias("value")) for i, v in enumerate(grid)))
    own = [c for c in rows.columns if c != "_read_at"]
    spread = rows.withColumn("_put", F.explode(places))
    asked = spread.select(*(F.col("_put.value").alias(c) if c == column else F.col(f"`{c}`") for c in own), "_read_at", F.col("_put.place").alias("_draw"), F.lit(0).alias("_asked"))
    # Sums alone, which a hash table keeps: a text among them would have all changed rows sorted, and be made anew for each.
    means = answered(asked).groupBy("_draw").agg(F.count("*").alias("rows"), *(F.avg(f"a{i}").alias(f"a{i}") for i in range(len(names)))).collect()  # a row a place
    if len(means) != len(grid) or any(r["rows"] != n for r in means):
        raise Refused(OTHERS)
    said = rows.sparkSession.range(1).select(F.transform(places, lambda p: p["value"].cast("string"))).first()[0]
    out = [(said[r["_draw"]], r["_draw"], name, r[f"a{i}"]) for r in sorted(means, key=lambda r: r["_draw"]) for i, name in enumerate(names)]
    return rows.sparkSession.createDataFrame(out, "value string, place int, answer string, mean double").coalesce(1)


def grid_of(low: float, high: float, points: int, whole: bool) -> list:
    """Places from low to high, as far from each other; whole numbers for integers, each once."""
    made = [low + (high - low) * i / (points - 1) for i in range(points - 1)] + [high]
    return list(dict.fromkeys(math.floor(x + 0.5) for x in made)) if whole else list(dict.fromkeys(made))


def make_up(rows: DataFrame, row: Column, columns: list[str], answered: Answered, names: list[str], seed: int, repeats: int) -> DataFrame:
    """column, answer, contribution, said and background: what each column adds to the answers of the one row that the condition picks, by
    Shapley's sampled values. In each of `repeats` samples a random row takes the row's cells over, one after the other in a random order; what
    an answer moves by is the column's. They add up to said less background. Rows are drawn once each before any is drawn again."""
    own = [c for c in rows.columns if c != "_read_at"]
    picked = rows.where(row).limit(2).collect()
    if len(picked) != 1:
        raise Refused(f"the row to ask why of is {'not there' if not picked else 'not the only one'}")
    told = picked[0]
    held: list[Row] = rows.orderBy(F.xxhash64(F.lit(seed), "_read_at"), "_read_at").limit(repeats).collect()  # repeats rows
    given, put = random.Random(seed), []
    for sample in range(repeats):
        cells = held[sample % len(held)].asDict()
        put.append((*(cells[c] for c in own), len(put), (sample, 0, None)))
        for step, column in enumerate(given.sample(columns, len(columns))):
            cells[column] = told[column]
            put.append((*(cells[c] for c in own), len(put), (sample, step + 1, column)))
    asked_of = T.StructType().add("sample", T.IntegerType()).add("step", T.IntegerType()).add("column", T.StringType())
    schema = T.StructType([*(rows.schema[c] for c in own), T.StructField("_draw", T.IntegerType()), T.StructField("_asked", asked_of)])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    asked = rows.sparkSession.createDataFrame(put, schema).withColumn("_read_at", F.col("_draw").cast("bigint"))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(name).alias("answer"), F.col(f"a{i}").alias("said")) for i, name in enumerate(names))))
    said = answered(asked).select("_asked.*", each.alias("_of")).select("sample", "step", "column", "_of.*")
    along = Window.partitionBy("sample", "place").orderBy("step")
    moved = said.withColumn("moved", F.col("said") - F.lag("said").over(along))
    ends = Window.partitionBy("answer")
    k = len(columns)
    sums = moved.groupBy("place", "answer", "column").agg(
        (F.sum("moved") / repeats).alias("contribution"), F.count("*").alias("rows"),
        F.avg(F.when(F.col("step") == k, F.col("said"))).alias("_said"), F.count_if(F.col("step") == k).alias("_ends"), F.avg(F.when(F.col("step") == 0, F.col("said"))).alias("_background"))
    full = sums.withColumns({
        "said": F.sum(F.col("_said") * F.col("_ends")).over(ends) / F.sum("_ends").over(ends), "background": F.max("_background").over(ends), "_all": F.sum("rows").over(ends)}).where("column is not null")
    whole = F.when(F.col("_all") == len(put), True).otherwise(F.raise_error(F.lit(OTHERS)).cast("boolean"))
    return full.where(whole).select("column", "answer", "contribution", "said", "background").orderBy(F.col("answer") != names[0], F.abs("contribution").desc(), "column")

"""What a larger table must not make slower or heavier than it grows, told by plans and by small tables."""

from pyspark.sql import functions as F

from tidemark.operators import evidence
from tidemark.operators.quantiles import range_of


def _lambdas(df):
    """The bodies of functions over arrays in a plan."""
    return [piece.split("lambdafunction(", 1)[1] for piece in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "lambdafunction(" in piece]


def test_a_value_is_worked_out_once_for_all_cuts(spark):
    df = spark.range(500).select(F.conv(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 8), 16, 10).cast("bigint").alias("r"), F.lit(1).alias("n"))
    placed = evidence.running(df, "r", {"place": "n"})
    assert [r["place"] for r in placed.orderBy("r").collect()] == list(range(1, 501))
    assert "sha2" in placed._jdf.queryExecution().optimizedPlan().toString()
    assert not any("sha2" in body for body in _lambdas(placed))


def test_ranges_of_values(spark):
    cuts = [-1.5, 0.0, 2.0, 7.0, 7.5]
    df = spark.createDataFrame([(v,) for v in (None, -9.0, -1.5, -1.0, 0.0, 2.0, 6.9, 7.0, 7.5, 8.0, float("nan"), float("inf"))], "v double")
    told = [(r["v"], r["at"]) for r in df.select("v", range_of(F.col("v"), cuts).alias("at")).collect()]
    assert [at for v, at in told] == [0 if v is None else 5 if v != v else sum(c <= v for c in cuts) for v, _ in told]
    assert {r["at"] for r in df.select(range_of(F.col("v"), []).alias("at")).collect()} == {0}


def test_changed_rows_are_summed_and_not_sorted(spark, monkeypatch):
    from pyspark.sql import GroupedData

    from tidemark.plans.pipeline import create

    plans, agg = [], GroupedData.agg

    def told(grouped, *columns):
        out = agg(grouped, *columns)
        if "_draw" in out.columns:
            plans.append(out._jdf.queryExecution())
        return out

    monkeypatch.setattr(GroupedData, "agg", told)
    rows = spark.createDataFrame([(float(i), "ab"[i % 2], float(i % 7), float(i)) for i in range(50)], "x double, k string, z double, y double")
    b = create().read_rows().declare(columns=[{"name": n, "kind": k} for n, k in (("x", "number"), ("k", "category"), ("z", "number"), ("y", "number"))])
    done = b.split_atRandom(seed=3).normalise(column="x").encode(column="k").target(column="y").build().run(spark, rows)
    say = lambda d: d.withColumn("prediction", 2 * F.col("x") + F.col("k_a"))
    means = done.dependence(rows, say, "x", 3).collect()
    assert [r["value"] for r in means] == ["0.0", "24.5", "49.0"] and [r["place"] for r in means] == [0, 1, 2]
    assert {r["column"]: r["mean"] > 0 for r in done.reliance(rows, say, 1, 2).collect()} == {"x": True, "k": True, "z": False}
    assert len(plans) == 2
    for plan in plans:
        assert "SortAggregate" not in plan.executedPlan().toString()
        assert plan.optimizedPlan().toString().count("a learner cannot take") == 1  # the code does not grow with each column
        assert "Join" not in plan.optimizedPlan().toString()


def test_a_wrong_cell_of_changed_rows_is_named(spark):
    import pytest

    from tidemark.plans.pipeline import create

    rows = spark.createDataFrame([(float(i), float(i % 7), float(i)) for i in range(50)], "x double, z double, y double")
    done = create().read_rows().declare(columns=[{"name": n, "kind": "number"} for n in "xzy"]).split_atRandom(seed=3).target(column="y").build().run(spark, rows)
    say = lambda d: d.withColumn("prediction", F.col("x"))
    for wrong in (None, float("inf"), float("nan")):
        with pytest.raises(Exception, match="z: a gap, or a value that a learner cannot take"):
            done.dependence(rows.withColumn("z", F.when(F.col("x") != 7, F.col("z")).otherwise(F.lit(wrong).cast("double"))), say, "x", 2)


def test_deals_in_packs_meet_all_rows(spark, monkeypatch):
    """The mean move of packs is that of all pairs of rows."""
    from tidemark.operators import reasons

    monkeypatch.setattr(reasons, "PACK", 100)
    rows = spark.range(0, 2000, 1, 3).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("z"), F.monotonically_increasing_id().alias("_read_at"))
    answered = lambda d: d.select("_asked", "_draw", F.col("x").alias("a0"))
    told = {r["column"]: r for r in reasons.reliance(rows, ["x", "z"], answered, 1, 4, 5).collect()}
    assert told["z"]["mean"] == 0 and abs(told["x"]["mean"] / (2000 / 3) - 1) < 0.03


def test_a_vote_of_equal_means_does_not_hang_on_the_order_of_sums(spark):
    from tidemark.operators import measures

    votes = [(1, "b", 0.1), (1, "b", 0.2), (1, "b", 0.3), (1, "a", 0.3), (1, "a", 0.2), (1, "a", 0.1), (2, "a", 0.1), (2, "b", 0.2), (3, "a", 1e300), (3, "b", float("inf")), (4, "a", None), (4, "b", 0.5)]
    said = measures.blend_vote(spark.createDataFrame(votes, "k int, word string, w double").coalesce(1), "k", "word", "w")
    assert {r["k"]: r["prediction"] for r in said.collect()} == {1: "a", 2: "b", 3: "b", 4: "b"}


def test_words_are_looked_up_in_one_table(spark):
    from tidemark.operators import fits

    rows = [(0, "b a c a"), (1, None), (2, ""), (3, "d d, e? a"), (4, "zz " * 30)]
    df, one = spark.createDataFrame(rows, "id int, t string").coalesce(1), fits.Tokenize("t", 5, 300)
    many = {"tokens": ["a", "b", "d", *(f"w{i}" for i in range(250))]}
    told = one.apply(df, many)
    assert {r["id"]: r["t"] for r in told.collect()} == {0: [3, 2, 1, 2, 0], 1: [0] * 5, 2: [0] * 5, 3: [4, 4, 1, 2, 0], 4: [1] * 5}
    assert {r["id"]: r["t"] for r in one.apply(df, {"tokens": []}).collect()}[0] == [1, 1, 1, 1, 0]
    assert "element_at" not in told._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_are_met_by_as_many_tasks_as_cells_ask_for(spark, monkeypatch):
    """A value of many rows is dealt to several tasks, and the tasks grow with the cells."""
    import numpy as np
    from pyspark.sql.classic.dataframe import DataFrame

    told = []
    join = DataFrame.join
    monkeypatch.setattr(DataFrame, "join", lambda left, right, *a, **k: (told.append(left), join(left, right, *a, **k))[1])
    monkeypatch.setattr(evidence, "MOST_CELLS", 500, raising=False)
    monkeypatch.setattr(evidence, "MOST_ALIKE", 100, raising=False)
    x = np.column_stack([np.arange(3000) % 3 - 1.0, (np.arange(3000) * 7919) % 3001, np.where(np.arange(3000) % 2, -0.0, 0.0)])
    x[::50, 2] = 2.5
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double").repartition(3)
    rank = lambda v: np.array([(v < y).sum() + ((v == y).sum() + 1) / 2 for y in v])
    want = np.corrcoef([rank(x[:, k]) for k in range(3)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for r in evidence.correlation(df, ["a", "b", "c"], "spearman").collect():
            assert abs(r["coefficient"] - want["abc".index(r["left"]), "abc".index(r["right"])]) < 1e-12 and r["kept"] == 3000
        cells = told[-1]  # what the ranks are joined with
        sizes = [r["count"] for r in cells.groupBy(*(c for c in cells.columns if c not in ("row", "v", "h")), "v").count().collect()]
        assert sum(sizes) == 9000 and max(sizes) < 200
        plan = cells._jdf.queryExecution().executedPlan().toString()
        assert "18), REPARTITION_BY_NUM" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

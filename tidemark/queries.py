"""The registered queries over the test tables, and DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import features, indicators, keys
from tidemark.functions.kinds import propose_kinds
from tidemark.operators import evidence, fits, measures, outputs, splits
from tidemark.plans.pipeline import Prepared, create
from tidemark.session import kept_path, kept_table
from tidemark.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def over(name: str, source: str, build: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """A query of one table."""
    register(name, lambda spark, d: build(table(spark, d, source)), sql)


LINE = ["l_orderkey", "l_linenumber"]

# Row-local features
for _how, _sql in (("plus", "l_quantity + l_tax"), ("minus", "l_quantity - l_tax"), ("times", "l_extendedprice * l_discount"), ("dividedby", "CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END")):
    _l, _r = {"times": ("l_extendedprice", "l_discount"), "dividedby": ("l_tax", "l_discount")}.get(_how, ("l_quantity", "l_tax"))
    over(
        f"feature_add_{_how}", "lineitem",
        lambda t, how=_how, a=_l, b=_r: t.select(*LINE, r6(features.arithmetic(features.number(a), how, features.number(b))).alias("v")),
        f"SELECT l_orderkey, l_linenumber, round({_sql}, 6) AS v FROM lineitem",
    )
for _shape, _col, _sql in (
    ("log", "l_quantity", "ln(l_quantity)"), ("log1p", "l_discount", "ln(l_discount + 1)"), ("reciprocal", "l_quantity", "1.0 / l_quantity"), ("sqrt", "l_tax", "sqrt(l_tax)"),
    ("square", "l_quantity", "l_quantity * l_quantity"), ("arcsin", "l_discount", "asin(sqrt(l_discount))"), ("abs", "l_tax", "abs(l_tax)"), ("sign", "l_discount", "sign(l_discount)::DOUBLE"),
):
    over(
        f"maths_{_shape}", "lineitem", lambda t, shape=_shape, c=_col: t.select(*LINE, r6(features.maths(features.number(c), shape)).alias("v")),
        f"SELECT l_orderkey, l_linenumber, round({_sql}, 6) AS v FROM lineitem",
    )
over("scale_given_signed", "lineitem", lambda t: t.select(*LINE, r6(features.scale_given(F.col("l_quantity"), 0, 50)).alias("v")), "SELECT l_orderkey, l_linenumber, round(2 * (l_quantity / 50.0) - 1, 6) AS v FROM lineitem")
over("scale_given_unit", "lineitem", lambda t: t.select(*LINE, r6(features.scale_given(F.col("l_quantity"), 0, 50, "unit")).alias("v")), "SELECT l_orderkey, l_linenumber, round(l_quantity / 50.0, 6) AS v FROM lineitem")


def _rounded(t: DataFrame, keep: list[str], made: dict[str, Column]) -> DataFrame:
    return t.select(*keep, *(r6(c).alias(n) for n, c in made.items()))


over(
    "feature_cycle", "lineitem", lambda t: _rounded(t, LINE, features.cycle("l_quantity", 7)),
    "SELECT l_orderkey, l_linenumber, round(sin(2 * pi() * (l_quantity - 7 * floor(l_quantity / 7)) / 7), 6) AS l_quantity_cycle7_sin, round(cos(2 * pi() * (l_quantity - 7 * floor(l_quantity / 7)) / 7), 6) AS l_quantity_cycle7_cos FROM lineitem",
)
over(
    "feature_cycle_splitsign", "lineitem", lambda t: _rounded(t, LINE, {k: v for k, v in features.cycle("l_quantity", 7, "splitsign").items() if "sin" in k}),
    "WITH s AS (SELECT l_orderkey, l_linenumber, sin(2 * pi() * (l_quantity - 7 * floor(l_quantity / 7)) / 7) AS v FROM lineitem) SELECT l_orderkey, l_linenumber, round(greatest(v, 0.0), 6) AS l_quantity_cycle7_sin_pos, round(greatest(-v, 0.0), 6) AS l_quantity_cycle7_sin_neg FROM s",
)
for _period, _sql in (
    ("hourofday", "(hour(ts) + minute(ts) / 60.0) / 24"), ("dayofweek", "dayofweek(ts) / 7.0"), ("dayofmonth", "(day(ts) - 1) / 31.0"), ("monthofyear", "(month(ts) - 1) / 12.0"),
    ("dayofyear", "(dayofyear(ts) - 1) / (CASE WHEN (year(ts) % 4 = 0 AND year(ts) % 100 <> 0) OR year(ts) % 400 = 0 THEN 366.0 ELSE 365.0 END)"), ("season", "floor((month(ts) % 12) / 3.0) / 4.0"),
):
    over(
        f"feature_cyclical_{_period}", "events", lambda t, p=_period: _rounded(t, ["event_id"], features.cyclical("ts", p, "unit")),
        f"SELECT event_id, round((sin(2 * pi() * {_sql}) + 1) / 2, 6) AS ts_{_period}_sin, round((cos(2 * pi() * {_sql}) + 1) / 2, 6) AS ts_{_period}_cos FROM events",
    )
over(
    "time_parts", "events", lambda t: t.select("event_id", *(c.alias(n) for n, c in features.time_parts("ts", ["minute", "hour", "dayofmonth", "month", "quarter", "year"]).items()), *(c.alias(n) for n, c in features.time_parts("ts", ["dayofweek", "season"], True).items())),
    """SELECT event_id, minute(ts)::DOUBLE AS ts_minute, hour(ts)::DOUBLE AS ts_hour, day(ts)::DOUBLE AS ts_dayofmonth, month(ts)::DOUBLE AS ts_month, quarter(ts)::DOUBLE AS ts_quarter, year(ts)::DOUBLE AS ts_year,
    lower(dayname(ts)) AS ts_dayofweek, (['winter', 'spring', 'summer', 'autumn'])[(floor((month(ts) % 12) / 3.0))::INT + 1] AS ts_season FROM events""",
)
for _norm, _sql in (("l1", "(l_quantity + l_discount + l_tax)"), ("l2", "sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax)"), ("max", "greatest(l_quantity, l_discount, l_tax)")):
    over(
        f"normalise_row_{_norm}", "lineitem", lambda t, n=_norm: features.normalise_row(t, ["l_quantity", "l_discount", "l_tax"], n).select(*LINE, *(r6(c).alias(c) for c in ("l_quantity", "l_discount", "l_tax"))),
        f"SELECT l_orderkey, l_linenumber, round(l_quantity / {_sql}, 6) AS l_quantity, round(l_discount / {_sql}, 6) AS l_discount, round(l_tax / {_sql}, 6) AS l_tax FROM lineitem",
    )


# Gaps: a seventh of the events' values are taken away
def _gappy(t: DataFrame) -> DataFrame:
    return t.withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))


_GAPPY = "WITH e AS (SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"
over("settle_gaps", "events", lambda t: (g := _gappy(t)).select("event_id", features.was_missing(g["value"]).alias("value_was_missing"), r6(features.filled(g["value"], 0.0, "number")).alias("value")), f"{_GAPPY} SELECT event_id, (value IS NULL)::INT::DOUBLE AS value_was_missing, round(coalesce(value, 0.0), 6) AS value FROM e")


def by_verbs(rows: DataFrame, columns: list[tuple[str, str]], *verbs: tuple[str, dict], spark: SparkSession | None = None) -> Prepared:
    """A pipeline over rows handed in."""
    b = create().read_rows().declare(columns=[{"name": n, "kind": k} for n, k in columns])
    for verb, params in verbs:
        b = b.add(verb, **params)
    return b.build().run(spark or rows.sparkSession, rows)


over(
    "drop_gaps", "events", lambda t: by_verbs(_gappy(t), [("event_id", "integer"), ("value", "number")], ("drop.gaps", {"columns": ["value"]})).df.select("event_id", "value"),
    f"{_GAPPY} SELECT event_id, value FROM e WHERE value IS NOT NULL",
)


def _fit(t: DataFrame, one, keep: list[str], made: list[str], train: str = "true") -> DataFrame:
    return one.apply(t, fits.learned_by(t.where(train), [one])[0]).select(*keep, *(r6(F.col(f"`{c}`")).alias(c) for c in made))


TRAIN = "event_id % 10 < 7"
for _with, _sql in (("mean", "avg(value)"), ("median", "median(value)"), ("zero", "0.0"), ("constant", "5.0")):
    over(
        f"fill_missing_{_with}", "events", lambda t, w=_with: _fit(_gappy(t), fits.FillMissing("value", w, 5.0), ["event_id"], ["value_was_missing", "value"], TRAIN),
        f"{_GAPPY}, f AS (SELECT {_sql} AS v FROM e WHERE {TRAIN}) SELECT event_id, (value IS NULL)::INT::DOUBLE AS value_was_missing, round(coalesce(value, v), 6) AS value FROM e, (SELECT any_value(v) AS v FROM f)",
    )
_FIRST = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)"
over(
    "fill_missing_previous", "events",
    lambda t: fits.fill_previous(t.withColumn("n", F.expr(_FIRST)).withColumn("value", F.when((F.col("event_id") % 7 != 0) | (F.col("n") == 1), F.col("value"))), "value", ["ts", "event_id"], ["user_id"]).select("event_id", r6("value").alias("value")),
    f"""WITH e AS (SELECT event_id, ts, user_id, CASE WHEN event_id % 7 <> 0 OR {_FIRST} = 1 THEN value END AS value FROM events)
    SELECT event_id, round(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS value FROM e""",
)
over(
    "fill_nan_mean", "events", lambda t: _fit(t.withColumn("value", F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value"))), fits.FillNaN("value", "mean"), ["event_id"], ["value"], TRAIN),
    f"{_GAPPY} SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM e WHERE {TRAIN})), 6) AS value FROM e",
)

# Splits
_SH = splits.Shares(0.7, 0.15, 0.15)
_EDGE = "(SELECT count(*) AS n, floor(count(*) * 0.7 + 0.5) AS a, floor(count(*) * 0.7 + 0.5) + floor(count(*) * 0.15 + 0.5) AS b FROM orders)"
_PART = "CASE WHEN f < a THEN 'train' WHEN f < b THEN 'validation' ELSE 'test' END"
over(
    "split_by_time", "orders", lambda t: splits.by_time(t, "o_orderdate", _SH).select("o_orderkey", F.col("_part").alias("part")),
    f"WITH p AS (SELECT o_orderkey, rank() OVER (ORDER BY o_orderdate) - 1 AS f FROM orders) SELECT o_orderkey, {_PART} AS part FROM p, {_EDGE}",
)
over(
    "split_by_time_gap", "orders", lambda t: splits.by_time(t, "o_orderdate", _SH, gap=3).select("o_orderkey", F.col("_part").alias("part")),
    f"""WITH p AS (SELECT o_orderkey, o_orderdate, rank() OVER (ORDER BY o_orderdate) - 1 AS f FROM orders), s AS (SELECT o_orderkey, o_orderdate, {_PART} AS part FROM p, {_EDGE}),
    g AS (SELECT *, dense_rank() OVER (PARTITION BY part ORDER BY o_orderdate DESC) AS d FROM s) SELECT o_orderkey, CASE WHEN d <= 3 AND part <> 'test' THEN 'gap' ELSE part END AS part FROM g""",
)
over(
    "split_by_time_origin", "orders", lambda t: splits.by_time(t, "o_orderdate", _SH, origins=3, origin=1).select("o_orderkey", F.col("_part").alias("part")),
    f"""WITH p AS (SELECT o_orderkey, rank() OVER (ORDER BY o_orderdate) - 1 AS f FROM orders), e AS (SELECT * FROM {_EDGE})
    SELECT o_orderkey, CASE WHEN f >= b THEN 'test' WHEN floor(f * 4 / b) <= 1 THEN 'train' WHEN floor(f * 4 / b) = 2 THEN 'validation' ELSE 'gap' END AS part FROM p, e""",
)


def _hex(seed: int) -> str:
    return seed.to_bytes(4, "little").hex().upper()


def _rank_sql(seed: int) -> str:
    """The first 60 bits of the seeded rank of an o_orderkey, as fifteen hexadecimal digits."""
    head = ((10).to_bytes(4, "little") + b"o_orderkey" + b"\1").hex().upper()
    return f"substr(sha256(unhex('{_hex(seed)}' || sha256(unhex('{head}' || printf('%02X', length(o_orderkey::VARCHAR)) || '000000' || hex(o_orderkey::VARCHAR))))), 1, 15)"


def _key(t: DataFrame) -> Column:
    return keys.row_key(t, ["o_orderkey"])


over("row_key", "orders", lambda t: t.select("o_orderkey", F.substring(keys.rank(_key(t), 7), 1, 15).alias("rank")), f"SELECT o_orderkey, {_rank_sql(7)} AS rank FROM orders")
over(
    "split_random_byid", "orders", lambda t: splits.at_random(t, _key(t), _SH, 7).select("o_orderkey", F.col("_part").alias("part")),
    f"WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_rank_sql(7)}) - 1 AS f FROM orders) SELECT o_orderkey, {_PART} AS part FROM p, {_EDGE}",
)
over(
    "split_random_fold", "orders", lambda t: splits.at_random(t, _key(t), _SH, 7, folds=5, fold=2).select("o_orderkey", F.col("_part").alias("part")),
    f"""WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_rank_sql(7)}) - 1 AS f FROM orders), e AS (SELECT * FROM {_EDGE})
    SELECT o_orderkey, CASE WHEN f >= b THEN 'test' WHEN floor(f * 5 / b) = 2 THEN 'validation' ELSE 'train' END AS part FROM p, e""",
)
over(
    "split_random_testseed", "orders", lambda t: splits.at_random(t, _key(t), _SH, 9, test_seed=7).select("o_orderkey", F.col("_part").alias("part")),
    f"""WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_rank_sql(7)}) - 1 AS f, {_rank_sql(9)} AS r FROM orders), e AS (SELECT * FROM {_EDGE}),
    q AS (SELECT o_orderkey, f, a, b, row_number() OVER (PARTITION BY f >= b ORDER BY r) - 1 AS g FROM p, e)
    SELECT o_orderkey, CASE WHEN f >= b THEN 'test' WHEN g < a THEN 'train' ELSE 'validation' END AS part FROM q""",
)
over(
    "split_stratified_byid", "orders", lambda t: splits.stratified(t, "o_orderpriority", _key(t), _SH, 7).select("o_orderkey", F.col("_part").alias("part")),
    f"""WITH p AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_rank_sql(7)}) - 1 AS f, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
    SELECT o_orderkey, CASE WHEN f < floor(n * 0.7 + 0.5) THEN 'train' WHEN f < floor(n * 0.7 + 0.5) + floor(n * 0.15 + 0.5) THEN 'validation' ELSE 'test' END AS part FROM p""",
)
over(
    "shuffle_byid", "orders", lambda t: evidence.running(t.select("o_orderkey", keys.rank_number(_key(t), 3).alias("r"), F.lit(1).alias("n")), "r", {"place": "n"}).select("o_orderkey", F.col("place").cast("long").alias("place")),
    f"SELECT o_orderkey, row_number() OVER (ORDER BY {_rank_sql(3)}) AS place FROM orders",
)

# Fitted scales: the statistics of training orders' lines, then a projection
_LT = "l_orderkey % 10 < 7"
_FIT = f"f AS (SELECT count(*) AS n, avg(l_extendedprice) AS mean, stddev_pop(l_extendedprice) AS sd, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, max(abs(l_extendedprice)) AS top, quantile_cont(l_extendedprice::DOUBLE, 0.25) AS q1, median(l_extendedprice::DOUBLE) AS q2, quantile_cont(l_extendedprice::DOUBLE, 0.75) AS q3 FROM lineitem WHERE {_LT})"
for _scale, _sql in (("standard", "(l_extendedprice - mean) / sd"), ("minmax", "(l_extendedprice - lo) / (hi - lo)"), ("midrange", "(l_extendedprice - (lo + hi) / 2) / ((hi - lo) / 2)"), ("maxabs", "l_extendedprice / top"), ("robust", "(l_extendedprice - q2) / (q3 - q1)")):
    over(
        f"normalise_{_scale}", "lineitem", lambda t, s=_scale: _fit(t, fits.Normalise("l_extendedprice", s), LINE, ["l_extendedprice"], _LT),
        f"WITH {_FIT} SELECT l_orderkey, l_linenumber, round({_sql}, 6) AS l_extendedprice FROM lineitem, f",
    )
over("normalise_clip", "lineitem", lambda t: _fit(t, fits.Normalise("l_extendedprice", "minmax", "clip"), LINE, ["l_extendedprice"], _LT), f"WITH {_FIT} SELECT l_orderkey, l_linenumber, round(least(greatest((l_extendedprice - lo) / (hi - lo), 0.0), 1.0), 6) AS l_extendedprice FROM lineitem, f")
over(
    "normalise_quantile", "part", lambda t: _fit(t, fits.Normalise("p_retailprice", "quantile", "clip"), ["p_partkey"], ["p_retailprice"], "p_partkey % 10 < 7"),
    """WITH k AS (SELECT quantile_cont(p_retailprice::DOUBLE, [i / 100.0 for i in range(101)]) AS k FROM part WHERE p_partkey % 10 < 7),
    b AS (SELECT p_partkey, p_retailprice AS v, k, len(list_filter(k, lambda x: x < p_retailprice)) AS lo, len(list_filter(k, lambda x: x <= p_retailprice)) AS up FROM part, k)
    SELECT p_partkey, round(CASE WHEN v < k[1] THEN 0.0 WHEN v > k[101] THEN 1.0 WHEN up > lo THEN (lo + up - 1) / 2.0 / 100 ELSE (lo - 1 + (v - k[lo]) / (k[lo + 1] - k[lo])) / 100 END, 6) AS p_retailprice FROM b""",
)
over(
    "normalise_power", "part", lambda t: _fit(t, fits.Normalise("p_retailprice", "power"), ["p_partkey"], ["p_retailprice"]).withColumn("p_retailprice", F.round("p_retailprice", 2)),
    """WITH l AS (SELECT round(-2 + 0.05 * i, 2)::DOUBLE AS l FROM range(81) t(i)), y AS (SELECT l, p_partkey, p_retailprice AS v, CASE WHEN l = 0 THEN ln(p_retailprice + 1) ELSE (pow(p_retailprice + 1, l) - 1) / l END AS y FROM part, l),
    s AS (SELECT l, avg(y) AS m, var_pop(y) AS q, -count(*) / 2.0 * ln(var_pop(y)) + (l - 1) * sum(ln(v + 1)) AS ll FROM y GROUP BY l), b AS (SELECT * FROM s ORDER BY ll DESC, l LIMIT 1)
    SELECT p_partkey, round((y - m) / sqrt(q), 2) AS p_retailprice FROM y JOIN b USING (l)""",
)
for _bounds, _at, _sql in (
    ("iqr", 0.5, "quantile_cont(l_extendedprice::DOUBLE, 0.25) - 0.5 * (quantile_cont(l_extendedprice::DOUBLE, 0.75) - quantile_cont(l_extendedprice::DOUBLE, 0.25)) AS lo, quantile_cont(l_extendedprice::DOUBLE, 0.75) + 0.5 * (quantile_cont(l_extendedprice::DOUBLE, 0.75) - quantile_cont(l_extendedprice::DOUBLE, 0.25)) AS hi"),
    ("sigma", 1.5, "avg(l_extendedprice) - 1.5 * stddev_pop(l_extendedprice) AS lo, avg(l_extendedprice) + 1.5 * stddev_pop(l_extendedprice) AS hi"),
    ("quantile", 0.05, "quantile_cont(l_extendedprice::DOUBLE, 0.05) AS lo, quantile_cont(l_extendedprice::DOUBLE, 0.95) AS hi"),
):
    for _out, _case in (("clip", "CASE WHEN v < lo THEN lo WHEN v > hi THEN hi ELSE v END"), ("blank", "CASE WHEN v < lo OR v > hi THEN NULL ELSE v END")):
        over(
            f"outliers_{_bounds}_{_out}", "lineitem", lambda t, b=_bounds, a=_at, o=_out: _fit(t, fits.ClipOutliers("l_extendedprice", b, a, o), LINE, ["l_extendedprice"], _LT),
            f"WITH f AS (SELECT {_sql} FROM lineitem WHERE {_LT}), x AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS v FROM lineitem) SELECT l_orderkey, l_linenumber, round({_case}, 6) AS l_extendedprice FROM x, f",
        )

# Encodings
_ONEHOT = ", ".join(f"(l_returnflag = '{w}')::INT::DOUBLE AS \"l_returnflag_{w}\"" for w in "ANR")
over("encode_onehot", "lineitem", lambda t: _fit(t, fits.Encode("l_returnflag"), LINE, ["l_returnflag_A", "l_returnflag_N", "l_returnflag_R", "l_returnflag_other", "l_returnflag_was_missing"], _LT), f"SELECT l_orderkey, l_linenumber, {_ONEHOT}, 0.0::DOUBLE AS l_returnflag_other, 0.0::DOUBLE AS l_returnflag_was_missing FROM lineitem")
_ORD = "WITH w AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS i FROM (SELECT DISTINCT c_mktsegment AS w FROM customer WHERE c_custkey % 10 < 7))"
over("encode_ordinal", "customer", lambda t: _fit(t, fits.Encode("c_mktsegment", "ordinal"), ["c_custkey"], ["c_mktsegment_was_missing", "c_mktsegment"], "c_custkey % 10 < 7"), f"{_ORD} SELECT c_custkey, 0.0::DOUBLE AS c_mktsegment_was_missing, coalesce(i, (SELECT count(*) FROM w))::DOUBLE AS c_mktsegment FROM customer LEFT JOIN w ON w.w = c_mktsegment")
over("encode_places", "customer", lambda t: _fit(t.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment"))), fits.Encode("c_mktsegment", "places"), ["c_custkey"], ["c_mktsegment"], "c_custkey % 10 < 7"), f"{_ORD} SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN -1.0 ELSE coalesce(i, (SELECT count(*) FROM w))::DOUBLE END AS c_mktsegment FROM customer LEFT JOIN w ON w.w = c_mktsegment")
over(
    "encode_piecewise", "lineitem", lambda t: _fit(t, fits.Piecewise("l_quantity", 4), LINE, [f"l_quantity_bin{i}" for i in range(4)], _LT),
    f"WITH f AS (SELECT quantile_cont(l_quantity::DOUBLE, [0, 0.25, 0.5, 0.75, 1]) AS e FROM lineitem WHERE {_LT}) SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(least(greatest((l_quantity - e[{i + 1}]) / (e[{i + 2}] - e[{i + 1}]), 0.0), 1.0), 6) AS l_quantity_bin{i}" for i in range(4)) + " FROM lineitem, f",
)
_WORDS = "unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda w: w <> '')) AS word"
over("tokenize_counts", "documents", lambda t: fits.Tokenize("text").counts(t).select("word", F.col("count").alias("n")), f"SELECT word, count(*) AS n FROM (SELECT {_WORDS} FROM documents) GROUP BY word")


def _tokenized(t: DataFrame) -> DataFrame:
    """A length that holds the longest text, so that no word is cut; what is compared is the number of words and a sum over all ids."""
    longest = t.agg(F.max(F.size(fits.words_in(F.col("text"))))).first()[0]
    one = fits.Tokenize("text", longest, 500)
    ids = one.apply(t, one.fit(t)).select("doc_id", F.array_remove("text", 0).alias("ids"))
    placed = F.transform("ids", lambda x, i: x.cast("long") * (i % 1009 + 1))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_words"), F.aggregate(placed, F.lit(0).cast("long"), lambda a, x: a + x).alias("mark"))


over(
    "tokenize_ids", "documents", _tokenized,
    f"""WITH v AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) + 1 AS id FROM (SELECT word, count(*) AS n FROM (SELECT {_WORDS} FROM documents) GROUP BY word) ORDER BY n DESC, word LIMIT 498),
    w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{Nd}}]+'), lambda w: w <> '') AS ws FROM documents),
    p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM w),
    j AS (SELECT doc_id, count(*) AS n, sum(coalesce(id, 1) * (i % 1009 + 1)) AS m FROM p LEFT JOIN v ON p.word = v.word GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(m, 0)::BIGINT AS mark FROM documents LEFT JOIN j USING (doc_id)""",
)


# History: a customer's earlier orders
def _history(t: DataFrame, window: int | None = None, known: bool = False) -> DataFrame:
    one = fits.History("o_custkey", "o_totalprice", ["o_orderdate"], 2.0, window, "h", known)
    learned, sums = one.fit(t.where("o_orderkey % 10 < 7" if not known else "o_orderdate < timestamp '1996-01-01'"))
    return one.apply(t, learned, sums).select("o_orderkey", F.round("h", 4).alias("h"))


over(
    "history", "orders", _history,
    """WITH t AS (SELECT * FROM orders WHERE o_orderkey % 10 < 7), p AS (SELECT avg(o_totalprice) AS prior FROM t)
    SELECT o.o_orderkey, round((coalesce(sum(t.o_totalprice), 0) + 2 * any_value(prior)) / (count(t.o_orderkey) + 2), 4) AS h FROM orders o CROSS JOIN p LEFT JOIN t ON t.o_custkey = o.o_custkey AND t.o_orderdate < o.o_orderdate GROUP BY o.o_orderkey""",
)
over(
    "history_window", "orders", lambda t: _history(t, 2),
    """WITH t AS (SELECT o_custkey, o_orderdate, sum(o_totalprice) AS s, count(*) AS n FROM orders WHERE o_orderkey % 10 < 7 GROUP BY ALL), p AS (SELECT avg(o_totalprice) AS prior FROM orders WHERE o_orderkey % 10 < 7),
    j AS (SELECT o.o_orderkey, s, n, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY t.o_orderdate DESC) AS r FROM orders o JOIN t ON t.o_custkey = o.o_custkey AND t.o_orderdate < o.o_orderdate),
    g AS (SELECT o_orderkey, sum(s) AS s, sum(n) AS n FROM j WHERE r <= 2 GROUP BY 1)
    SELECT o.o_orderkey, round((coalesce(s, 0) + 2 * prior) / (coalesce(n, 0) + 2), 4) AS h FROM orders o CROSS JOIN p LEFT JOIN g USING (o_orderkey)""",
)
over(
    "history_known", "orders", lambda t: _history(t, known=True),
    """WITH t AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'), p AS (SELECT avg(o_totalprice) AS prior FROM t), l AS (SELECT o_custkey, max(o_orderdate) AS last FROM t GROUP BY 1),
    k AS (SELECT o_custkey, o_orderdate, o_totalprice FROM t UNION ALL SELECT o.o_custkey, o.o_orderdate, o.o_totalprice FROM orders o LEFT JOIN l USING (o_custkey) WHERE last IS NULL OR o.o_orderdate > last)
    SELECT o.o_orderkey, round((coalesce(sum(k.o_totalprice), 0) + 2 * any_value(prior)) / (count(k.o_custkey) + 2), 4) AS h FROM orders o CROSS JOIN p LEFT JOIN k ON k.o_custkey = o.o_custkey AND k.o_orderdate < o.o_orderdate GROUP BY o.o_orderkey""",
)

# Joins
def _keyless(t: DataFrame) -> DataFrame:
    """Orders of which a fifth lacks its customer's key."""
    return t.withColumn("c_custkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey"))).drop("o_custkey")


register(
    "read_join_drop", lambda spark, d: readers.read_join(_keyless(table(spark, d, "orders")), table(spark, d, "customer"), ["c_custkey"], "drop").select("o_orderkey", "c_custkey", "c_name", "c_mktsegment"),
    "SELECT o_orderkey, c_custkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 5 <> 0",
)


def _joined_by_the_verb(spark: SparkSession, d: str) -> DataFrame:
    part = lambda name: {"kind": "parquet", "path": f"{d}/{name}.parquet"}
    columns = [{"name": n, "kind": k} for n, k in (("doc_id", "integer"), ("quality", "number"), ("lang", "category"), ("n_chars", "number"))]
    done = create().read_join(left=part("labels"), right=part("documents"), on=["doc_id"], unmatched="drop").declare(columns=columns).build().run(spark)
    return done.df.select("doc_id", "quality", "lang", "n_chars")


register("read_join_verb", _joined_by_the_verb, "SELECT doc_id, quality::DOUBLE AS quality, lang, n_chars::DOUBLE AS n_chars FROM labels JOIN documents USING (doc_id)")


def _read_again(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """nation, written as a file of the kind and read by its verb."""
    path, nation = kept_path(spark, f"nation-{kind}"), table(spark, d, "nation").withColumn("note", F.concat(F.lit('a "quoted", cell of\nline '), "n_name"))
    if kind == "csv":
        nation.coalesce(1).write.options(header=True, quoteAll=True, escape='"').csv(path)
    else:  # one array of objects: as many as there are nations
        nation.agg(F.to_json(F.collect_list(F.struct(*nation.columns))).alias("value")).coalesce(1).write.text(path)
    columns = [{"name": n, "kind": k} for n, k in (("n_nationkey", "integer"), ("n_name", "category"), ("n_regionkey", "integer"), ("note", "text"))]
    return create().add(f"read.{kind}", path=path).declare(columns=columns).build().run(spark).df.select("n_nationkey", "n_name", "n_regionkey", "note")


for _kind in ("csv", "json"):
    register(f"read_{_kind}", lambda spark, d, k=_kind: _read_again(spark, d, k), "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey, 'a \"quoted\", cell of' || chr(10) || 'line ' || n_name AS note FROM nation")
register(
    "read_join_refuse", lambda spark, d: readers.read_join(table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), table(spark, d, "nation"), ["n_nationkey"]).select("c_custkey", "n_nationkey", "n_name"),
    "SELECT c_custkey, n_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
)


# Series: a row for each day of orders
def _days(t: DataFrame) -> DataFrame:
    return t.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), ((F.max("o_totalprice") + F.min("o_totalprice")) / 2).alias("close"), F.count("*").alias("volume"))


_DAYS = "WITH d AS (SELECT o_orderdate::DATE AS day, max(o_totalprice) AS high, min(o_totalprice) AS low, (max(o_totalprice) + min(o_totalprice)) / 2 AS close, count(*) AS volume FROM orders GROUP BY 1)"
_W = "OVER (ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
_ENOUGH = f"CASE WHEN count(*) {_W} >= 5 THEN"
for _as, _sql in (("value", "lead(close, 2) OVER (ORDER BY day)"), ("return", "lead(close, 2) OVER (ORDER BY day) / nullif(close, 0) - 1")):
    over(
        f"target_ahead_{_as}", "orders", lambda t, a=_as: outputs.target_ahead(_days(t), "close", 2, ["day"], a).select(F.col("day").cast("string").alias("day"), F.round("`close.ahead2`", 4).alias("ahead")),
        f"{_DAYS} SELECT day::VARCHAR AS day, round({_sql}, 4) AS ahead FROM d",
    )
for _name, _cols, _sql in (
    ("sma", ["close"], {"x": f"{_ENOUGH} avg(close) {_W} END"}),
    ("bollingerbands", ["close"], {"x_upper": f"{_ENOUGH} avg(close) {_W} + 2 * stddev_pop(close) {_W} END", "x_middle": f"{_ENOUGH} avg(close) {_W} END", "x_lower": f"{_ENOUGH} avg(close) {_W} - 2 * stddev_pop(close) {_W} END"}),
    ("williamsr", ["high", "low", "close"], {"x": f"{_ENOUGH} -100 * (max(high) {_W} - close) / (max(high) {_W} - min(low) {_W}) END"}),
    ("obv", ["close", "volume"], {"x": "sum(sg * volume) OVER (ORDER BY day)"}),
    ("vwap", ["high", "low", "close", "volume"], {"x": "sum((high + low + close) / 3 * volume) OVER (ORDER BY day) / sum(volume) OVER (ORDER BY day)"}),
):
    _from = "(SELECT *, coalesce(sign(close - lag(close) OVER (ORDER BY day)), 0) AS sg FROM d)"
    over(
        f"indicator_{_name}", "orders", lambda t, n=_name, c=_cols, o=list(_sql): indicators.add_indicator(_days(t), "x", n, 5, c, ["day"]).select(F.col("day").cast("string").alias("day"), *(F.round(k, 4).cast("double").alias(k) for k in o)),
        f"{_DAYS} SELECT day::VARCHAR AS day, " + ", ".join(f"round(({s})::DOUBLE, 4) AS {k}" for k, s in _sql.items()) + f" FROM {_from}",
    )
over(
    "indicator_cci", "orders", lambda t: indicators.add_indicator(_days(t), "x", "cci", 5, ["high", "low", "close"], ["day"]).select(F.col("day").cast("string").alias("day"), F.round("x", 4).alias("x")),
    f"""{_DAYS}, t AS (SELECT day, (high + low + close) / 3 AS t FROM d), m AS (SELECT day, t, avg(t) {_W} AS m, list(t) {_W} AS l, count(*) {_W} AS n FROM t)
    SELECT day::VARCHAR AS day, round(CASE WHEN n >= 5 THEN coalesce((t - m) / nullif(0.015 * list_sum(list_transform(l, lambda v: abs(v - m))) / 5, 0), 0) END, 4) AS x FROM m""",
)
over(
    "indicator_stochastic", "orders", lambda t: indicators.add_indicator(_days(t), "x", "stochastic", 5, ["high", "low", "close"], ["day"]).select(F.col("day").cast("string").alias("day"), F.round("x_k", 4).alias("x_k"), F.round("x_d", 4).alias("x_d")),
    f"""{_DAYS}, k AS (SELECT day, {_ENOUGH} 100 * (close - min(low) {_W}) / (max(high) {_W} - min(low) {_W}) END AS k FROM d)
    SELECT day::VARCHAR AS day, round(k, 4) AS x_k, round(CASE WHEN count(k) OVER w >= 3 THEN avg(k) OVER w END, 4) AS x_d FROM k WINDOW w AS (ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)


def _series(t: DataFrame) -> DataFrame:
    """A series of days for each order priority."""
    return t.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), ((F.max("o_totalprice") + F.min("o_totalprice")) / 2).alias("close"))


_SERIES = """d AS (SELECT o_orderpriority AS series, o_orderdate::DATE AS day, max(o_totalprice) AS high, min(o_totalprice) AS low, (max(o_totalprice) + min(o_totalprice)) / 2 AS close FROM orders GROUP BY 1, 2),
    n AS (SELECT *, row_number() OVER w AS i, close - lag(close) OVER w AS step, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS reach,
    high - lag(high) OVER w AS up, lag(low) OVER w - low AS down FROM d WINDOW w AS (PARTITION BY series ORDER BY day))"""


def _recursion(name: str, source: str, x: str, first: int, period: int, weight: float) -> str:
    """A recursive table (series, i, v): from row first + period - 1, the mean of the period rows there, then v + weight * (x - v)."""
    at = first + period - 1
    return f"""{name} AS (SELECT series, {at}::BIGINT AS i, avg({x}) AS v FROM {source} WHERE i BETWEEN {first} AND {at} GROUP BY series HAVING count({x}) = {period}
    UNION ALL SELECT s.series, s.i, r.v + {weight!r} * ({x.replace('s.', '')} - r.v) FROM {name} r JOIN {source} s ON s.series = r.series AND s.i = r.i + 1)"""


_RECURSIONS = {
    "ema": ([_recursion("e", "n", "close", 1, 5, 2 / 6)], {"x": "e.v"}, "e"),
    "rsi": ([_recursion("a", "n", "greatest(step, 0)", 2, 5, 1 / 5), _recursion("b", "n", "greatest(-step, 0)", 2, 5, 1 / 5)], {"x": "CASE WHEN b.v = 0 THEN CASE WHEN a.v = 0 THEN 50.0 ELSE 100.0 END ELSE 100 - 100 / (1 + a.v / b.v) END"}, "a LEFT JOIN b"),
    "macd": (
        [_recursion("f", "n", "close", 1, 12, 2 / 13), _recursion("g", "n", "close", 1, 26, 2 / 27), "l AS (SELECT series, i, f.v - g.v AS line FROM f JOIN g USING (series, i))", _recursion("h", "l", "line", 26, 5, 2 / 6)],
        {"x_line": "l.line", "x_signal": "h.v", "x_histogram": "l.line - h.v"}, "l LEFT JOIN h",
    ),
    "atr": ([_recursion("e", "n", "reach", 1, 5, 1 / 5)], {"x": "e.v"}, "e"),
    "adx": (
        [_recursion("a", "n", "CASE WHEN up > down AND up > 0 THEN up ELSE 0 END", 2, 5, 1 / 5), _recursion("b", "n", "CASE WHEN down > up AND down > 0 THEN down ELSE 0 END", 2, 5, 1 / 5),
         "m AS (SELECT series, i, CASE WHEN a.v + b.v = 0 THEN 0.0 ELSE 100 * abs(a.v - b.v) / (a.v + b.v) END AS dx FROM a JOIN b USING (series, i))", _recursion("c", "m", "dx", 6, 5, 1 / 5)],
        {"x": "c.v"}, "c",
    ),
}
for _name, (_tables, _out, _from) in _RECURSIONS.items():
    _cols = ["high", "low", "close"] if _name in ("atr", "adx") else ["close"]
    _first, *_more = _from.split(" LEFT JOIN ")
    _joins = f"LEFT JOIN {_first} ON {_first}.series = n.series AND {_first}.i = n.i" + "".join(f" LEFT JOIN {m} ON {m}.series = n.series AND {m}.i = n.i" for m in _more)
    over(
        f"indicator_{_name}", "orders",
        lambda t, n=_name, c=_cols: indicators.add_indicator(_series(t), "x", n, 5, c, ["day"], ["series"]).select("series", F.col("day").cast("string").alias("day"), *(F.round(f"x{e}", 3).alias(f"x{e}") for e in indicators.INDICATORS[n][1])),
        f"WITH RECURSIVE {_SERIES}, " + ", ".join(_tables) + " SELECT n.series, n.day::VARCHAR AS day, " + ", ".join(f"round({q}, 3) AS {k}" for k, q in _out.items()) + f" FROM n {_joins}",
    )
over(
    "target_distribution_remainder", "lineitem", lambda t: outputs.target_distribution(t.withColumns({"a": F.col("l_quantity"), "b": F.col("l_linenumber") * 1.0, "whole": F.lit(100.0)}), ["a", "b"], "whole", "rest").select(*LINE, r6("a").alias("a"), r6("b").alias("b"), r6("rest").alias("rest")),
    "SELECT l_orderkey, l_linenumber, round(l_quantity / 100.0, 6) AS a, round(l_linenumber / 100.0, 6) AS b, round((100.0 - l_quantity - l_linenumber) / 100.0, 6) AS rest FROM lineitem",
)
over(
    "target_labels", "labels", lambda t: outputs.target_labels(t.where("quality is not null and toxic is not null"), ["quality", "toxic"]).groupBy("quality", "toxic").agg(F.count("*").alias("n")),
    "SELECT quality, toxic, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL",
)

# Evidence
over(
    "evidence_profile", "lineitem", lambda t: evidence.profile(t, ["l_quantity", "l_discount", "l_returnflag"]).select("column", "rows", "gaps", "not_finite", "distinct", "constant", *(F.round(c, 4).alias(c) for c in ("min", "max", "mean", "median"))),
    " UNION ALL ".join(
        f"SELECT '{c}' AS column, count(*) AS rows, count(*) - count({c}) AS gaps, 0::BIGINT AS not_finite, count(DISTINCT {c}) AS distinct, count(DISTINCT {c}) <= 1 AS constant, " + (f"round(min({c}), 6)::DOUBLE AS min, round(max({c}), 6)::DOUBLE AS max, round(avg({c}), 4)::DOUBLE AS mean, round(median({c}), 6)::DOUBLE AS median" if n else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS median") + " FROM lineitem"
        for c, n in (("l_quantity", 1), ("l_discount", 1), ("l_returnflag", 0))
    ),
)
over(
    "evidence_duplicates", "lineitem", lambda t: evidence.duplicates(t, keys.row_key(t, ["l_quantity", "l_discount", "l_tax"]), F.col("l_returnflag")),
    "WITH g AS (SELECT count(*) AS n, count(DISTINCT l_returnflag) AS p FROM lineitem GROUP BY l_quantity, l_discount, l_tax HAVING count(*) > 1) SELECT count(*) AS groups, sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS extra, count(*) FILTER (p > 1) AS across FROM g",
)


def _alerted(t: DataFrame) -> DataFrame:
    rows = t.select("o_orderkey", "o_orderstatus", "o_orderpriority", F.substring("o_orderpriority", 1, 1).alias("first"), F.lit(1.0).alias("flat"), F.when(F.col("o_orderkey") % 10 == 0, -1.0).otherwise(F.col("o_totalprice") + 5000).alias("price"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("gappy"), F.col("o_orderstatus").alias("answer"))
    for c, kind in (("o_orderstatus", "category"), ("o_orderpriority", "category"), ("first", "category"), ("answer", "category")):
        rows = rows.withMetadata(c, {"kind": kind})
    return evidence.Alerts(rows, rows.columns[:-1], ["answer"], []).table().select("column", "other", "alert", "rows", "action", "verb", "value")


over(
    "profile_alerts", "orders", _alerted,
    """WITH a AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) = count(*) AND max(o_orderkey) - min(o_orderkey) + 1 = count(*) AS running, count(*) FILTER (o_orderkey % 10 = 0) AS nothing, count(*) FILTER (o_orderkey % 3 = 0) AS gaps,
    count(DISTINCT o_orderpriority) AS p, count(DISTINCT substr(o_orderpriority, 1, 1)) AS q, count(DISTINCT (o_orderpriority, substr(o_orderpriority, 1, 1))) AS pq FROM orders)
    SELECT 'o_orderkey' AS "column", NULL AS other, 'identifier' AS alert, n AS rows, 'leaveout' AS action, NULL AS verb, NULL AS value FROM a WHERE running
    UNION ALL SELECT c, NULL, 'category', n, 'step', 'encode.categories', NULL FROM a, (VALUES ('o_orderstatus'), ('o_orderpriority'), ('first')) t(c)
    UNION ALL SELECT 'o_orderstatus', 'answer', 'answer', n, 'leaveout', NULL, NULL FROM a
    UNION ALL SELECT 'first', 'o_orderpriority', 'repeats', n, 'leaveout', NULL, NULL FROM a WHERE p = q AND q = pq
    UNION ALL SELECT 'flat', NULL, 'constant', n, 'leaveout', NULL, NULL FROM a
    UNION ALL SELECT 'price', NULL, 'nothingknown', nothing, 'saymissing', NULL, '-1' FROM a
    UNION ALL SELECT 'gappy', NULL, 'gaps', gaps, 'step', 'fill.missing', NULL FROM a""",
)
_PAIRS = (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))
over("correlation_pearson", "lineitem", lambda t: evidence.correlation(t, ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("coefficient", r6("coefficient")), " UNION ALL ".join(f"SELECT '{a}' AS left, '{b}' AS right, round(corr({a}, {b}), 6) AS coefficient, count(*) AS kept, count(*) AS total FROM lineitem" for a, b in _PAIRS))
_RANKS = "WITH r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount")) + " FROM lineitem)"
over("correlation_spearman", "lineitem", lambda t: evidence.correlation(t, ["l_quantity", "l_extendedprice", "l_discount"], "spearman").withColumn("coefficient", r6("coefficient")), f"{_RANKS} " + " UNION ALL ".join(f"SELECT '{a}' AS left, '{b}' AS right, round(corr({a}, {b}), 6) AS coefficient, count(*) AS kept, count(*) AS total FROM r" for a, b in _PAIRS))
_SIDES = "p AS (SELECT *, CASE WHEN l_orderkey % 10 < 7 THEN 'train' ELSE 'test' END AS part FROM lineitem)"


def _parted(t: DataFrame) -> DataFrame:
    return t.withColumn("_part", F.when(F.expr(_LT), "train").otherwise("test"))


_KS = "c AS (SELECT {v} AS v, count(*) FILTER (part = 'test') / (SELECT count(*) FROM p WHERE part = 'test') AS a, count(*) FILTER (part = 'train') / (SELECT count(*) FROM p WHERE part = 'train') AS b FROM p GROUP BY 1)"
over("likeness_ks", "lineitem", lambda t: evidence.likeness(_parted(t), ["l_extendedprice"]).withColumn("distance", r6("distance")), f"WITH {_SIDES}, {_KS.format(v='l_extendedprice')}, d AS (SELECT abs(sum(a - b) OVER (ORDER BY v)) AS d FROM c) SELECT 'l_extendedprice' AS column, 'test' AS left, 'train' AS right, round(max(d), 6) AS distance, max(d) > 0.1 AS warned FROM d")
over("likeness_tv", "lineitem", lambda t: evidence.likeness(_parted(t), ["l_returnflag"]).withColumn("distance", r6("distance")), f"WITH {_SIDES}, {_KS.format(v='l_returnflag')} SELECT 'l_returnflag' AS column, 'test' AS left, 'train' AS right, round(sum(abs(a - b)) / 2, 6) AS distance, sum(abs(a - b)) / 2 > 0.1 AS warned FROM c")
over(
    "watch_window", "lineitem", lambda t: evidence.watched(evidence.tallies(t.where(_LT), ["l_extendedprice", "l_returnflag"]), t.where(f"not ({_LT})"), ["l_extendedprice", "l_returnflag"], 0.1).withColumn("distance", r6("distance")),
    f"WITH {_SIDES}, {_KS.format(v='l_extendedprice')}, d AS (SELECT abs(sum(a - b) OVER (ORDER BY v)) AS d FROM c), {_KS.format(v='l_returnflag').replace('c AS', 'w AS', 1)} SELECT 'l_extendedprice' AS column, round(max(d), 6) AS distance, max(d) > 0.1 AS warned FROM d UNION ALL SELECT 'l_returnflag', round(sum(abs(a - b)) / 2, 6), sum(abs(a - b)) / 2 > 0.1 FROM w",
)

# Measures: predictions made from the rows by arithmetic


def _y() -> Column:
    return F.col("l_quantity").cast("double")


def _p() -> Column:
    return F.col("l_quantity") + (F.col("l_orderkey") % 7 - 3)


def _class() -> Column:
    return F.when(F.col("l_returnflag") == "R", 1).otherwise(0)


def _chance() -> Column:
    return ((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17) % 101) / 100.0


def _truth() -> list[Column]:
    return [F.col("l_discount"), F.col("l_tax"), 1 - F.col("l_discount") - F.col("l_tax")]


_P_SQL = "(l_quantity + (l_orderkey % 7 - 3))"
over("measure_regression", "lineitem", lambda t: measures.measure(t, {k: r6(c) for k, c in measures.regression(_y(), _p()).items()}), f"SELECT round(sqrt(avg(pow(l_quantity - {_P_SQL}, 2))), 6) AS rmse, round(avg(abs(l_quantity - {_P_SQL})), 6) AS mae, round(1 - avg(pow(l_quantity - {_P_SQL}, 2)) / var_pop(l_quantity), 6) AS r2, round(avg(abs((l_quantity - {_P_SQL}) / l_quantity)), 6) AS mape FROM lineitem")
over("measure_interval", "lineitem", lambda t: measures.measure(t, {k: r6(c) for k, c in measures.interval(_y(), _p() - 2, _p() + 2).items()}), f"SELECT round(avg((l_quantity >= {_P_SQL} - 2 AND l_quantity <= {_P_SQL} + 2)::INT), 6) AS coverage, 4.0::DOUBLE AS width FROM lineitem")
_CB = "WITH x AS (SELECT (l_returnflag = 'R')::INT AS y, ((l_orderkey * 31 + l_linenumber * 17) % 101) / 100.0 AS p FROM lineitem)"
over("measure_binary", "lineitem", lambda t: measures.measure(t, {k: r6(c) for k, c in measures.binary(_class(), _chance()).items()}), f"{_CB}, c AS (SELECT count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) AS n, avg(pow(p - y, 2)) AS brier FROM x) SELECT round((n - fp - fn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(brier, 6) AS brier FROM c")
over("measure_auc", "lineitem", lambda t: measures.auc(t, _class(), _chance()).select(r6("auc").alias("auc")), f"{_CB}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM x) SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r")
over("measure_confusion", "lineitem", lambda t: measures.confusion(t, _class(), (_chance() >= 0.5).cast("int")), f"{_CB} SELECT y AS answer, (p >= 0.5)::INT AS predicted, count(*) AS rows FROM x GROUP BY ALL")
over(
    "measure_shares", "lineitem", lambda t: measures.measure(t, {k: r6(c) for k, c in measures.shares(_truth(), [F.lit(0.2), F.lit(0.3), F.lit(0.5)]).items()}),
    "WITH x AS (SELECT l_discount AS a, l_tax AS b, 1 - l_discount - l_tax AS c FROM lineitem) SELECT round(avg(CASE WHEN a > 0 THEN a * ln(a / 0.2) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b / 0.3) ELSE 0 END + CASE WHEN c > 0 THEN c * ln(c / 0.5) ELSE 0 END), 6) AS kl, round(avg(abs(a - 0.2) + abs(a + b - 0.5)), 6) AS emd, round(avg(pow(a - 0.2, 2) + pow(a + b - 0.5, 2)), 6) AS rps FROM x",
)
over("measures_across", "lineitem", lambda t: measures.across(t.groupBy((F.col("l_orderkey") % 5).alias("fold")).agg(F.avg("l_quantity").alias("m")), "m").select(r6("mean").alias("mean"), r6("deviation").alias("deviation")), "WITH f AS (SELECT avg(l_quantity) AS m FROM lineitem GROUP BY l_orderkey % 5) SELECT round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS deviation FROM f")
over("blend_average", "lineitem", lambda t: measures.blend_average(t, "l_partkey", "l_quantity").select("l_partkey", r6("prediction").alias("prediction")), "SELECT l_partkey, round(avg(l_quantity), 6) AS prediction FROM lineitem GROUP BY 1")
over("blend_vote", "lineitem", lambda t: measures.blend_vote(t, "l_partkey", "l_returnflag", "l_discount"), "WITH v AS (SELECT l_partkey, l_returnflag AS w, count(*) AS n, sum(l_discount::DECIMAL(28, 12))::DOUBLE / count(l_discount) AS m FROM lineitem GROUP BY 1, 2) SELECT l_partkey, w AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, m DESC, w) = 1")
register("conformal", lambda spark, d: spark.createDataFrame([(measures.conformal_margin(table(spark, d, "orders"), F.col("o_totalprice"), F.lit(150000.0), 0.1),)], "margin double"), "WITH e AS (SELECT abs(o_totalprice - 150000.0) AS e FROM orders) SELECT e AS margin FROM e QUALIFY row_number() OVER (ORDER BY e) = (SELECT ceil((count(*) + 1) * 0.9 - 1e-9) FROM e)")
over("kind_proposal", "customer", lambda t: propose_kinds(t.select(*(F.col(c).cast("string").alias(c) for c in t.columns))), "SELECT * FROM (VALUES ('c_custkey', 'integer'), ('c_name', 'text'), ('c_nationkey', 'integer'), ('c_acctbal', 'number'), ('c_mktsegment', 'category')) t(\"column\", kind)")
over(
    "drop_columns", "lineitem",
    lambda t: by_verbs(t, [("l_orderkey", "integer"), ("l_linenumber", "integer"), ("l_quantity", "number"), ("l_returnflag", "category")], ("drop.columns", {"columns": ["l_quantity"]})).df.drop("_key", "_read_at"),
    "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_returnflag FROM lineitem",
)


def flagship_plan(path: str):
    """lineitem, declared, with a feature, split by ship date, filled, scaled, encoded and watched."""
    columns = [
        {"name": "l_shipdate", "kind": "timestamp"}, {"name": "l_quantity", "kind": "number"}, {"name": "l_extendedprice", "kind": "number"},
        {"name": "l_discount", "kind": "number"}, {"name": "l_tax", "kind": "number"}, {"name": "l_returnflag", "kind": "category"}, {"name": "l_linestatus", "kind": "category"},
    ]
    b = create().read_parquet(path=path).declare(columns=columns).feature_add(column="disc_price", left="l_extendedprice", arithmetic="times", right="l_discount")
    b = b.split_byTime(column="l_shipdate").fill_missing(column="l_quantity", with_="median").normalise(column="l_extendedprice").normalise(column="disc_price", scale="robust")
    return b.outliers_clip(column="l_tax").encode(column="l_returnflag").encode(column="l_linestatus", as_="ordinal").target(column="l_discount").build()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = flagship_plan(f"{sf_dir}/lineitem.parquet").run(spark).df
    sums = ("l_extendedprice", "disc_price", "l_tax", "l_returnflag_A", "l_returnflag_N", "l_returnflag_R", "l_linestatus")
    return done.groupBy(F.col("_part").alias("part")).agg(F.count("*").alias("n"), *(F.round(F.sum(c), 3).alias(c) for c in sums))


register(
    "flagship", flagship,
    """WITH s AS (SELECT *, l_extendedprice * l_discount AS dp, rank() OVER (ORDER BY l_shipdate) - 1 AS f FROM lineitem), e AS (SELECT floor(count(*) * 0.7 + 0.5) AS a, floor(count(*) * 0.7 + 0.5) + floor(count(*) * 0.15 + 0.5) AS b FROM lineitem),
    p AS (SELECT s.*, CASE WHEN f < a THEN 'train' WHEN f < b THEN 'validation' ELSE 'test' END AS part FROM s, e),
    t AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, quantile_cont(dp::DOUBLE, 0.25) AS d1, quantile_cont(dp::DOUBLE, 0.5) AS d2, quantile_cont(dp::DOUBLE, 0.75) AS d3, quantile_cont(l_tax::DOUBLE, 0.25) AS t1, quantile_cont(l_tax::DOUBLE, 0.75) AS t3 FROM p WHERE part = 'train')
    SELECT part, count(*) AS n, round(sum((l_extendedprice - (lo + hi) / 2) / ((hi - lo) / 2)), 3) AS l_extendedprice, round(sum((dp - d2) / (d3 - d1)), 3) AS disc_price, round(sum(least(greatest(l_tax, t1 - 1.5 * (t3 - t1)), t3 + 1.5 * (t3 - t1))), 3) AS l_tax,
    sum((l_returnflag = 'A')::INT)::DOUBLE AS "l_returnflag_A", sum((l_returnflag = 'N')::INT)::DOUBLE AS "l_returnflag_N", sum((l_returnflag = 'R')::INT)::DOUBLE AS "l_returnflag_R", sum((l_linestatus = 'O')::INT)::DOUBLE AS l_linestatus FROM p, t GROUP BY part""",
)


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship pipeline fitted, then applied to lines as if they came later."""
    done = flagship_plan(f"{sf_dir}/lineitem.parquet").run(spark)
    later = done.transform(table(spark, sf_dir, "lineitem"))
    return later.agg(F.count("*").alias("n"), F.round(F.sum("l_linestatus"), 3).alias("l_linestatus"), F.round(F.sum("l_returnflag_R"), 3).alias("l_returnflag_R"))


register("replay", replayed, "SELECT count(*) AS n, sum((l_linestatus = 'O')::INT)::DOUBLE AS l_linestatus, sum((l_returnflag = 'R')::INT)::DOUBLE AS \"l_returnflag_R\" FROM lineitem")


def warmed_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.plans.pipeline import drop_warmup, order_by

    days = indicators.add_indicator(_days(table(spark, sf_dir, "orders")), "x", "sma", 5, ["close"], ["day"])
    return drop_warmup(order_by(days, ["day"]), ["day"], ["close", "x"], 1000).select(F.col("day").cast("string").alias("day"), F.round("x", 4).alias("x"))


register("drop_warmup", warmed_up, f"{_DAYS}, s AS (SELECT day, {_ENOUGH} avg(close) {_W} END AS x FROM d) SELECT day::VARCHAR AS day, round(x, 4) AS x FROM s WHERE x IS NOT NULL")


# What a run can be asked. Orders are split by date: parts follow from the rank of the date.
_ORDERS = [("o_orderkey", "integer"), ("o_custkey", "integer"), ("o_totalprice", "number"), ("o_orderdate", "timestamp"), ("o_orderstatus", "category"), ("o_orderpriority", "category")]
_BY_TIME = ("split.byTime", {"column": "o_orderdate"})
_SPLIT = f"p AS (SELECT *, {_PART} AS part FROM (SELECT *, rank() OVER (ORDER BY o_orderdate) - 1 AS f FROM orders), {_EDGE})"


def _measured(told: DataFrame) -> DataFrame:
    return told.select("part", "metric", r6("model").alias("model"), r6("baseline").alias("baseline"))


def _wide(measures_sql: dict[str, tuple[str, str]]) -> str:
    """A row for each measure out of a table x (part, y, p, b), for parts validation and test."""
    each = [f"SELECT part, '{m}' AS metric, round({a}, 6)::DOUBLE AS model, round({b}, 6)::DOUBLE AS baseline FROM x WHERE part IN ('validation', 'test') GROUP BY part" for m, (a, b) in measures_sql.items()]
    return " UNION ALL ".join(each)


def _run_regression(t: DataFrame) -> DataFrame:
    report = ("evidence.report", {"metrics": ["rmse", "mae", "r2", "mape"], "parts": ["validation", "test"]})
    done = by_verbs(t, _ORDERS[:4], ("drop.columns", {"columns": ["o_custkey"]}), _BY_TIME, ("normalise", {"column": "o_totalprice", "scale": "standard"}), ("drop.columns", {"columns": ["o_orderdate"]}), ("target", {"column": "o_totalprice"}), report)
    return _measured(done.measure(lambda rows: rows.withColumn("prediction", F.col("o_totalprice") * 0.9)))


_ERR = {"rmse": "sqrt(avg(pow(y - {p}, 2)))", "mae": "avg(abs(y - {p}))", "r2": "1 - avg(pow(y - {p}, 2)) / var_pop(y)", "mape": "avg(abs((y - {p}) / y))"}
over(
    "measure_run_regression", "orders", _run_regression,
    f"WITH {_SPLIT}, t AS (SELECT avg(o_totalprice) AS m FROM p WHERE part = 'train'), x AS (SELECT part, o_totalprice AS y, m + 0.9 * (o_totalprice - m) AS p, m AS b FROM p, t) " + _wide({m: (q.format(p="p"), q.format(p="b")) for m, q in _ERR.items()}),
)


def _run_classes(t: DataFrame) -> DataFrame:
    report = ("evidence.report", {"metrics": ["accuracy", "precision", "recall", "f1", "brier", "auc"], "parts": ["validation", "test"]})
    rows = t.withColumn("dear", F.when(F.col("o_totalprice") > 200000, 1.0).otherwise(0.0))
    done = by_verbs(rows, [("o_orderkey", "integer"), ("o_orderdate", "timestamp"), ("dear", "number")], _BY_TIME, ("drop.columns", {"columns": ["o_orderdate"]}), ("target", {"column": "dear"}), report)
    return _measured(done.measure(lambda rows: rows.withColumn("prediction", ((F.col("o_orderkey") * 31) % 101) / 100.0)))


over(
    "measure_run_classes", "orders", _run_classes,
    f"""WITH {_SPLIT}, y AS (SELECT part, (o_totalprice > 200000)::INT AS y, ((o_orderkey * 31) % 101) / 100.0 AS p FROM p), t AS (SELECT avg(y) AS b FROM y WHERE part = 'train'),
    x AS (SELECT y.*, b, (p >= 0.5)::INT AS s, (b >= 0.5)::INT AS sb, rank() OVER (PARTITION BY part ORDER BY p) + (count(*) OVER (PARTITION BY part, p) - 1) / 2.0 AS r FROM y, t) """
    + _wide({
        "accuracy": ("avg((y = s)::INT)", "avg((y = sb)::INT)"),
        "precision": ("coalesce(sum(y * s) / nullif(sum(s), 0), 0)", "coalesce(sum(y * sb) / nullif(sum(sb), 0), 0)"),
        "recall": ("sum(y * s) / sum(y)", "sum(y * sb) / sum(y)"),
        "f1": ("2 * sum(y * s) / (sum(y) + sum(s))", "2 * sum(y * sb) / (sum(y) + sum(sb))"),
        "brier": ("avg(pow(p - y, 2))", "avg(pow(b - y, 2))"),
        "auc": ("(sum(r * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))", "0.5"),
    }),
)


def _run_shares(t: DataFrame) -> DataFrame:
    report = ("evidence.report", {"metrics": ["kl", "emd", "rps"], "parts": ["validation", "test"]})
    rows = t.withColumns({"a": F.col("o_orderkey") % 7 + 1.0, "b": F.col("o_orderkey") % 5 + 1.0, "whole": F.lit(20.0)})
    kinds = [("o_orderkey", "integer"), ("o_orderdate", "timestamp"), ("a", "number"), ("b", "number"), ("whole", "number")]
    done = by_verbs(rows, kinds, _BY_TIME, ("drop.columns", {"columns": ["o_orderdate"]}), ("target.distribution", {"columns": ["a", "b"], "scaleBy": "whole", "remainder": "rest", "ordered": True}), report)
    return _measured(done.measure(lambda rows: rows.withColumns({"prediction_0": F.lit(0.2), "prediction_1": F.lit(0.3), "prediction_2": F.lit(0.5)})))


def _share_sql(a: str, b: str, c: str) -> dict[str, str]:
    """Units are counts out of 20; kl over all three, emd and rps over the first two as shares of their sum."""
    held = {"u": "a / 20", "v": "b / 20", "w": "(20 - a - b) / 20"}
    kl = " + ".join(f"({h}) * ln(({h}) / ({s}))" for h, s in zip(held.values(), (a, b, c), strict=True))
    gap = f"(a / (a + b) - {a} / ({a} + {b}))"
    return {"kl": f"avg({kl})", "emd": f"avg(abs({gap}))", "rps": f"avg(pow({gap}, 2))"}


_M3, _B3 = _share_sql("0.2", "0.3", "0.5"), _share_sql("ma", "mb", "(1 - ma - mb)")
over(
    "measure_run_shares", "orders", _run_shares,
    f"WITH {_SPLIT}, c AS (SELECT part, o_orderkey % 7 + 1.0 AS a, o_orderkey % 5 + 1.0 AS b FROM p), t AS (SELECT avg(a) / 20 AS ma, avg(b) / 20 AS mb FROM c WHERE part = 'train'), x AS (SELECT * FROM c, t) " + _wide({m: (_M3[m], _B3[m]) for m in _M3}),
)


def _run_needs(t: DataFrame) -> DataFrame:
    """Sums over the training batch of a run of every step, of one without scales, and of one with categories as places."""
    b = create().read_rows().declare(columns=[{"name": n, "kind": k} for n, k in _ORDERS]).add("split.byTime", column="o_orderdate").drop_columns(columns=["o_orderdate", "o_custkey", "o_orderkey"])
    b = b.normalise(column="o_totalprice", scale="minmax").encode(column="o_orderstatus").encode(column="o_orderpriority", as_="ordinal").build()
    out = None
    for needs in ("numbers", "noScale", "categories"):
        done = b.run_for(t.sparkSession, needs, t)
        rows = done.batch("train", needs)
        status = F.col("o_orderstatus") if "o_orderstatus" in rows.columns else F.col("o_orderstatus_O") + 2 * F.col("o_orderstatus_P")
        one = rows.agg(F.lit(needs).alias("needs"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"), F.sum(status).alias("status"), F.sum("o_orderpriority").alias("priority"))
        out = one if out is None else out.unionByName(one)
    return out


over(
    "batch_needs", "orders", _run_needs,
    f"""WITH {_SPLIT}, t AS (SELECT *, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS s, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS q, min(o_totalprice) OVER () AS lo, max(o_totalprice) OVER () AS hi FROM p WHERE part = 'train')
    SELECT needs, count(*) AS n, round(sum(CASE WHEN needs = 'numbers' THEN (o_totalprice - lo) / (hi - lo) ELSE o_totalprice END), 2) AS price, sum(s)::DOUBLE AS status, sum(q)::DOUBLE AS priority
    FROM t, (VALUES ('numbers'), ('noScale'), ('categories')) v(needs) GROUP BY needs""",
)
over(
    "fit_entry", "orders", lambda t: by_verbs(t, _ORDERS, _BY_TIME).fit_entries().where("name <> 'digest'"),
    f"""WITH {_SPLIT} SELECT 'rows.' || part AS name, count(*)::VARCHAR AS value FROM p GROUP BY part
    UNION ALL SELECT 'moments.' || part, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') || ' .. ' || strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') FROM p GROUP BY part""",
)


def _viewed(t: DataFrame) -> DataFrame:
    rows = t.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")))
    done = by_verbs(rows, _ORDERS, ("feature.add", {"column": "twice", "left": "o_totalprice", "arithmetic": "plus", "right": "o_totalprice"}), ("drop.gaps", {"columns": ["o_totalprice"]}), _BY_TIME, ("normalise", {"column": "o_totalprice"}))
    return done.view(3).groupBy(F.col("_standing").alias("standing")).agg(F.count("*").alias("n"), F.round(F.sum("twice"), 2).alias("twice"))


over(
    "view_standing", "orders", _viewed,
    f"""WITH orders AS (SELECT * FROM main.orders WHERE o_orderkey % 9 <> 0), {_SPLIT} SELECT part AS standing, count(*) AS n, round(sum(2 * o_totalprice), 2) AS twice FROM p GROUP BY part
    UNION ALL SELECT 'dropped', count(*), NULL FROM main.orders WHERE o_orderkey % 9 = 0 HAVING count(*) > 0""",
)
over(
    "watch_moments", "lineitem", lambda t: evidence.watched(evidence.tallies(t.where(_LT), ["l_shipdate"]), t.where(f"not ({_LT})"), ["l_shipdate"], 0.01).withColumn("distance", r6("distance")),
    f"WITH {_SIDES}, {_KS.format(v='l_shipdate')}, d AS (SELECT abs(sum(a - b) OVER (ORDER BY v)) AS d FROM c) SELECT 'l_shipdate' AS column, round(max(d), 6) AS distance, max(d) > 0.01 AS warned FROM d",
)
over(
    "encode_categories", "orders", lambda t: by_verbs(t, _ORDERS, _BY_TIME, ("encode.categories", {})).df.select("o_orderkey", *(F.col(f"`o_orderstatus_{w}`").alias(f"status_{w}") for w in "FOP"), "o_orderstatus_other", "o_orderpriority_was_missing", F.col("`o_orderpriority_1-URGENT`").alias("urgent")),
    "SELECT o_orderkey, " + ", ".join(f"(o_orderstatus = '{w}')::INT::DOUBLE AS \"status_{w}\"" for w in "FOP") + ", 0.0::DOUBLE AS o_orderstatus_other, 0.0::DOUBLE AS o_orderpriority_was_missing, (o_orderpriority = '1-URGENT')::INT::DOUBLE AS urgent FROM orders",
)
over(
    "target_numbers", "orders", lambda t: by_verbs(t, _ORDERS[:4], _BY_TIME, ("drop.columns", {"columns": ["o_orderdate"]}), ("target.numbers", {"columns": ["o_totalprice", "o_custkey"]})).batch("test").select("o_orderkey", "o_totalprice", "o_custkey"),
    f"WITH {_SPLIT} SELECT o_orderkey::DOUBLE AS o_orderkey, o_totalprice, o_custkey::DOUBLE AS o_custkey FROM p WHERE part = 'test'",
)


# What a run verifies and refuses, and what its file keeps
_CHAIN = [("maths", {"column": "o_totalprice", "maths": "log1p"}), ("split.byTime", {"column": "o_orderdate"}), ("normalise", {"column": "o_totalprice", "scale": "standard"}), ("target", {"column": "o_totalprice"})]


def _way_back(t: DataFrame) -> DataFrame:
    """The largest error when logarithm and scale of the answer are undone on every row, as the run has verified it."""
    done = by_verbs(t, _ORDERS[:4], *_CHAIN)
    return t.sparkSession.createDataFrame([(a, round(e, 6)) for a, e in done.way_back.items()], "answer string, error double")


over(
    "way_back_error", "orders", _way_back,
    """WITH s AS (SELECT o_totalprice AS y, ln(o_totalprice + 1) AS x, rank() OVER (ORDER BY o_orderdate) - 1 AS f FROM orders), e AS (SELECT floor(count(*) * 0.7 + 0.5) AS a FROM orders),
    t AS (SELECT avg(x) AS m, stddev_pop(x) AS d FROM s, e WHERE f < a)
    SELECT 'o_totalprice' AS answer, round(max(abs(exp(((x - m) / d) * d + m) - 1 - y) / greatest(1, abs(y))), 6) AS error FROM s, t""",
)


def _refused(run: Callable[[], Prepared], spark: SparkSession) -> DataFrame:
    try:
        run()
    except fits.Refused as e:
        return spark.createDataFrame([(str(e).split(":")[0], e.row)], "step string, row long")
    return spark.createDataFrame([], "step string, row long")


over(
    "split_byid_refused", "orders",
    lambda t: _refused(lambda: create().read_rows().declare(columns=[{"name": "o_orderkey", "kind": "integer", "id": True}, {"name": "o_totalprice", "kind": "number"}]).split_atRandom(byId=True, seed=7).build().run(t.sparkSession, t.withColumn("o_orderkey", F.when(F.col("o_orderkey") % 1000 != 7, F.col("o_orderkey")))), t.sparkSession),
    "SELECT 'split.atRandom' AS step, min(n) AS row FROM (SELECT o_orderkey, row_number() OVER () AS n FROM orders) WHERE o_orderkey % 1000 = 7",
)
over(
    "maths_refused", "lineitem",
    lambda t: _refused(lambda: by_verbs(t, [("l_quantity", "number"), ("l_tax", "number")], ("maths", {"column": "l_quantity", "maths": "square"}), ("maths", {"column": "l_tax", "maths": "log"})), t.sparkSession),
    "SELECT 'maths' AS step, min(n) AS row FROM (SELECT l_tax, row_number() OVER () AS n FROM lineitem) WHERE l_tax <= 0",
)


def _interval(t: DataFrame) -> DataFrame:
    """An interval around the middle of a given scale, from the calibration rows of a run that was kept and read again."""
    b = create().read_rows().declare(columns=[{"name": n, "kind": k} for n, k in (("o_orderdate", "timestamp"), ("o_totalprice", "number"), ("o_orderkey", "integer"))])
    b = b.scale_given(column="o_totalprice", lowest=0, highest=500_000).split_byTime(column="o_orderdate", train=0.6, validation=0.1, test=0.1, calibration=0.2).drop_columns(columns=["o_orderdate"]).target(column="o_totalprice")
    done = b.build().run(t.sparkSession, t)
    done.interval(lambda rows: rows.withColumn("prediction", F.lit(0.0)), 0.1)
    path = kept_path(t.sparkSession, "fit")
    done.save(path)
    kept = Prepared.load(t.sparkSession, path)
    entry = kept.fit_entries().where("name = 'rows.calibration'").select(F.col("value").cast("bigint").alias("rows"))
    return entry.withColumn("margin", F.lit(round(kept.margins[0], 4)))


over(
    "interval_of_run", "orders", _interval,
    """WITH s AS (SELECT o_totalprice AS y, rank() OVER (ORDER BY o_orderdate) - 1 AS f FROM orders), e AS (SELECT floor(count(*) * 0.6 + 0.5) + floor(count(*) * 0.1 + 0.5) AS a, floor(count(*) * 0.2 + 0.5) AS b FROM orders),
    c AS (SELECT abs(y - 250000) AS d, row_number() OVER (ORDER BY abs(y - 250000)) AS k, count(*) OVER () AS n FROM s, e WHERE f >= a AND f < a + b)
    SELECT max(n)::BIGINT AS rows, round(min(d) FILTER (k >= ceil((n + 1) * 0.9 - 1e-9)), 4) AS margin FROM c""",
)


# Reasons: raw rows are changed, replayed and answered; the learner here is a given sum of the prepared cells
def _asked_of(t: DataFrame) -> Prepared:
    kinds = [("l_orderkey", "integer"), ("l_linenumber", "integer"), ("l_quantity", "number"), ("l_discount", "number"), ("l_tax", "number"), ("l_returnflag", "category"), ("l_shipdate", "timestamp"), ("l_extendedprice", "number")]
    declared = create().read_rows().declare(columns=[{"name": n, "kind": k} for n, k in kinds]).split_byTime(column="l_shipdate").drop_columns(columns=["l_orderkey", "l_linenumber", "l_shipdate"])
    return declared.normalise(column="l_quantity", scale="minmax").encode(column="l_returnflag").target(column="l_extendedprice").normalise(column="l_extendedprice", scale="minmax").build().run(t.sparkSession, t.select(*(n for n, _ in kinds)))


def _say(handed: DataFrame) -> DataFrame:
    return handed.withColumn("prediction", F.col("l_quantity") + 4 * F.col("l_quantity") * F.col("l_tax") + 0.25 * F.col("l_returnflag_R"))


_ASKED = """WITH e AS (SELECT floor(count(*) * 0.7 + 0.5) AS a FROM lineitem), s AS (SELECT *, rank() OVER (ORDER BY l_shipdate) - 1 AS f FROM lineitem),
t AS (SELECT min(l_quantity)::DOUBLE AS ql, max(l_quantity)::DOUBLE AS qh, min(l_extendedprice)::DOUBLE AS pl, max(l_extendedprice)::DOUBLE AS ph FROM s, e WHERE f < a)"""


def _depends(t: DataFrame, column: str) -> DataFrame:
    done = _asked_of(t)
    return done.dependence(t.select("l_quantity", "l_discount", "l_tax", "l_returnflag"), _say, column, 5).select("value", "place", "answer", r4("mean").alias("mean"))


def r4(c: str) -> Column:
    return F.round(F.col(c), 4)


over(
    "reasons_dependence", "lineitem", lambda t: _depends(t, "l_quantity").select("place", F.round(F.col("value").cast("double"), 4).alias("value"), "answer", "mean"),
    f"""{_ASKED}, g AS (SELECT min(l_quantity)::DOUBLE AS lo, max(l_quantity)::DOUBLE AS hi, avg(l_tax)::DOUBLE AS x, avg((l_returnflag = 'R')::INT) AS r FROM lineitem),
    p AS (SELECT i AS place, lo + (hi - lo) * i / 4 AS value, x, r FROM g, range(5) AS q(i))
    SELECT place::INT AS place, round(value, 4) AS value, 'l_extendedprice' AS answer, round(pl + (ph - pl) * ((value - ql) / (qh - ql) * (1 + 4 * x) + 0.25 * r), 4) AS mean FROM p, t""",
)
over(
    "reasons_dependence_words", "lineitem", lambda t: _depends(t, "l_returnflag"),
    f"""{_ASKED}, g AS (SELECT avg(l_quantity)::DOUBLE AS q, avg(l_quantity * l_tax)::DOUBLE AS qx, avg(l_tax)::DOUBLE AS x FROM lineitem),
    w AS (SELECT l_returnflag AS value, row_number() OVER (ORDER BY l_returnflag) - 1 AS place FROM s, e WHERE f < a GROUP BY 1)
    SELECT value, place::INT AS place, 'l_extendedprice' AS answer, round(pl + (ph - pl) * ((q - ql) / (qh - ql) + 4 * (qx - ql * x) / (qh - ql) + 0.25 * (value = 'R')::INT), 4) AS mean FROM w, g, t""",
)


def _leans(t: DataFrame) -> DataFrame:
    done = _asked_of(t)
    told = done.reliance(t.select("l_quantity", "l_discount", "l_tax", "l_returnflag"), _say, seed=3, repeats=4)
    return told.select("column", (F.col("mean") == 0).alias("ignored"), F.row_number().over(Window.orderBy(F.desc("mean"))).alias("place"))  # a row a column


over(
    "reasons_reliance", "lineitem", _leans,
    """WITH n AS (SELECT avg(l_tax)::DOUBLE AS x, count(*) AS n, (max(l_quantity) - min(l_quantity))::DOUBLE AS span FROM lineitem),
    d AS (SELECT c, sum((2 * k - n - 1) * v) * 2 / any_value(n * n) AS apart FROM (SELECT c, v, n, row_number() OVER (PARTITION BY c ORDER BY v) AS k FROM (SELECT unnest(['l_quantity', 'l_tax']) AS c, unnest([l_quantity, l_tax]::DOUBLE[]) AS v FROM lineitem), n) GROUP BY c),
    f AS (SELECT avg((l_returnflag = 'R')::INT) AS r, avg(l_quantity)::DOUBLE AS q, min(l_quantity)::DOUBLE AS ql FROM lineitem),
    m AS (SELECT 'l_quantity' AS "column", apart / span * (1 + 4 * x) AS mean FROM d, n WHERE c = 'l_quantity' UNION ALL SELECT 'l_tax', 4 * apart * (q - ql) / span FROM d, n, f WHERE c = 'l_tax'
    UNION ALL SELECT 'l_returnflag', 0.25 * 2 * r * (1 - r) FROM f UNION ALL SELECT 'l_discount', 0)
    SELECT "column", mean = 0 AS ignored, row_number() OVER (ORDER BY mean DESC)::INT AS place FROM m""",
)


def _made_up(t: DataFrame) -> DataFrame:
    """Of one segment of customers, with every segment as a background once: what a sum of cells is made of."""
    told = t.groupBy(F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("who")).agg(F.avg("c_acctbal").alias("balance"), F.count("*").cast("double").alias("many"), F.max("c_acctbal").alias("top"))
    kinds = [("who", "text"), ("balance", "number"), ("many", "number"), ("top", "number")]
    declared = create().read_rows().declare(columns=[{"name": n, "kind": k, **({"id": True} if n == "who" else {})} for n, k in kinds]).split_atRandom(seed=5, train=1.0, validation=0.0, test=0.0)
    told = kept_table(told, "segments")
    done = declared.target(column="top").build().run(t.sparkSession, told)
    n = told.count()  # nations x segments rows
    return done.make_up(told, F.col("who") == "7-BUILDING", lambda d: d.withColumn("prediction", F.col("balance") + 3 * F.col("many")), 2, n).select("column", *(r4(c).alias(c) for c in ("contribution", "said", "background")))


over(
    "reasons_make_up", "customer", _made_up,
    """WITH s AS (SELECT c_nationkey || '-' || c_mktsegment AS who, avg(c_acctbal)::DOUBLE AS b, count(*)::DOUBLE AS m FROM customer GROUP BY 1), a AS (SELECT avg(b) AS b, avg(m) AS m FROM s)
    SELECT unnest(['balance', 'many']) AS "column", round(unnest([s.b - a.b, 3 * (s.m - a.m)]), 4) AS contribution, round(s.b + 3 * s.m, 4) AS said, round(a.b + 3 * a.m, 4) AS background FROM s, a WHERE who = '7-BUILDING'""",
)

"""The engine's own rules: keys, splits, transforms, pipelines, replay, ways back, readers."""

import datetime
import json
import math
import struct
import wave
import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import features, indicators, keys
from tidemark.functions.kinds import read_cell
from tidemark.operators import evidence, fits, learners, measures, outputs, splits
from tidemark.plans.pipeline import Declaration, Prepared, create
from tidemark.plans.rules import DeclarationError
from tidemark.sources import readers
from tidemark.streaming.serve import serve


def test_row_key_is_byte_exact(spark):
    df = spark.createDataFrame([("Braund, Mr. Owen Harris", "22", None)], "name string, age string, cabin string")
    assert df.select(keys.row_key(df)).first()[0] == "0a5cc1133acc91d13a0205fd34510a5cd790d03d560573c857de048ce5d8cdac"


def test_cells(spark):
    rows = [(" 1.5 ",), ("NaN",), ("1e400",), ("1d",), ("",), ("yes",), ("7",), ("2020-01-02T03:04:05Z",)]
    got = spark.createDataFrame(rows, "c string").select(*(read_cell(F.col("c"), k).alias(k) for k in ("number", "integer", "boolean", "timestamp"))).collect()
    assert got[0].number == 1.5 and np.isnan(got[1].number) and got[2].number is None and got[3].number is None and got[4].number is None
    assert got[5].boolean is True and got[6].integer == 7 and got[7].timestamp == datetime.datetime(2020, 1, 2, 3, 4, 5)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 30), min_size=8, max_size=60), st.randoms())
def test_splits_do_not_depend_on_row_order_and_keep_copies_together(spark, values, random):
    other = list(values)
    random.shuffle(other)
    parts = []
    for v in (values, other):
        df = spark.createDataFrame([(x,) for x in v], "x int")
        parts.append(sorted(tuple(r) for r in splits.at_random(df, keys.row_key(df), splits.Shares(0.5, 0.25, 0.25), 5).select("x", "_part").collect()))
    assert parts[0] == parts[1]
    assert all(len({p for x, p in parts[0] if x == v}) == 1 for v in values)


def test_places_of_values(spark):
    values = [(i * i * 7919) % 1_000_003 for i in range(500)] + [5] * 40
    df = spark.createDataFrame([(v, str(v % 3)) for v in values], "v long, g string")
    found = splits.values_at(df, "v", [0, 20, 100, 333, 499])
    for p in (0, 20, 100, 333, 499):
        want = sorted(values)[p]
        assert found[(None, p)] == (want, sum(v < want for v in values), values.count(want))
    by_group = splits.values_at(df, "v", {g: [0, 50] for g in "012"}, "g")
    for g in range(3):
        own = sorted(v for v in values if v % 3 == g)
        assert [by_group[(str(g), p)][0] for p in (0, 50)] == [own[0], own[50]]


@pytest.mark.parametrize("folds", [None, 4])
def test_strata_are_dealt_by_their_own_ranks(spark, folds):
    rows = [(i % 90, "abc"[i % 3] if i % 7 else None) for i in range(400)]  # copies too
    df = spark.createDataFrame(rows, "x int, g string")
    key = keys.row_key(df)
    parts = splits.stratified(df, "g", key, splits.Shares(0.5, 0.2, 0.3), 3, folds, 1).withColumn("r", keys.rank_number(key, 3)).collect()
    for g in (*"abc", None):
        own = [r for r in parts if r.g == g]
        ranks = sorted(r.r for r in own)
        n = len(own)
        a, b = math.floor(n * 0.5 + 0.5), math.floor(n * 0.5 + 0.5) + math.floor(n * 0.2 + 0.5)
        m = sum(ranks.index(r.r) < b for r in own)
        for r in own:
            at = ranks.index(r.r)
            want = "test" if at >= b else ("validation" if at * folds // m == 1 else "train") if folds else "train" if at < a else "validation"
            assert r._part == want


def test_history_golden(spark):
    rows = [(t, "A", 10.0 * t) for t in range(1, 11)]
    df = spark.createDataFrame(rows, "t int, key string, v double")
    one = fits.History("key", "v", ["t"], 1.0, into="h", known=True)
    learned, sums = one.fit(df.where("t <= 6"))
    assert learned["prior"] == 35
    got = {r.t: r.h for r in one.apply(df, learned, sums).collect()}
    assert got[1] == 35 and got[8] == pytest.approx((210 + 70 + 35) / 8)


def test_piecewise_and_tokens(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 71)], "x double")
    one = fits.Piecewise("x", 4)
    assert one.learn(df.agg(*(c.alias(n) for n, c in one.stats(df).items())).first().asDict())["edges"] == [1, 18.25, 35.5, 52.75, 70]
    texts = spark.createDataFrame([("Good film, good plot",), ("a film",), (None,), ("",)], "r string")
    tok = fits.Tokenize("r", 3, 5)
    learned = tok.fit(texts)
    assert learned["tokens"] == ["film", "good", "a"]
    assert [r.r for r in tok.apply(texts, learned).collect()] == [[3, 2, 3], [4, 2, 0], [0, 0, 0], [0, 0, 0]]


@pytest.mark.parametrize("scale", ["standard", "minmax", "midrange", "maxabs", "robust", "power", "quantile"])
def test_scales_have_a_way_back(spark, scale):
    df = spark.createDataFrame([(float(x * x - 20),) for x in range(1, 40)] + [(None,)], "x double").withColumn("y", F.col("x"))
    one = fits.Normalise("x", scale, "clip" if scale == "quantile" else "pass")
    learned = one.learn(df.agg(*(c.alias(n) for n, c in one.stats(df).items())).first().asDict())
    out = one.apply(df, learned).withColumn("z", one.back(F.col("x"), learned)).collect()
    assert all(r.y is None and r.z is None or r.z == pytest.approx(r.y, rel=1e-6, abs=1e-6) for r in out)


def test_constant_and_not_finite(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    one = fits.Normalise("x", "standard")
    learned = one.learn(df.agg(*(c.alias(n) for n, c in one.stats(df).items())).first().asDict())
    assert learned["spread"] == 1.0
    odd = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    with pytest.raises(fits.Refused):
        one.learn(odd.agg(*(c.alias(n) for n, c in one.stats(odd).items())).first().asDict())


COLUMNS = [{"name": "id", "kind": "integer", "id": True}, {"name": "x", "kind": "number"}, {"name": "w", "kind": "category"}, {"name": "y", "kind": "number"}]


def plan():
    b = create().read_rows(description="rows").declare(columns=COLUMNS).feature_add(column="xy", left="x", arithmetic="times", right="x").split_at_random(seed=3, byId=True)
    return b.fill_missing(column="x", with_="mean").normalise(column="xy", scale="minmax").encode(column="w").normalise(column="y", scale="standard").target(column="y").build()


def rows(spark, n=60):
    return spark.createDataFrame([(str(i), str(i % 7) if i % 5 else "", "abc"[i % 3], str(i * 2)) for i in range(n)], "id string, x string, w string, y string")


def test_fit_replay_file_and_way_back(spark, tmp_path):
    df = rows(spark).withColumn("xx", F.lit("1"))
    declared = plan()
    done = declared.run(spark, df)
    fitted = {r["id"]: (r["x"], r["w_a"], r["y"]) for r in done.df.collect()}
    again = done.transform(df)
    assert {r["id"]: (r["x"], r["w_a"], r["y"]) for r in again.collect()} == fitted
    assert all(r.back == pytest.approx(r.id * 2) for r in again.select("id", done.back(F.col("y")).alias("back")).collect())
    done.save(str(tmp_path / "p"))
    kept = Prepared.load(spark, str(tmp_path / "p"))
    assert {r["id"]: (r["x"], r["w_a"], r["y"]) for r in kept.transform(df).collect()} == fitted
    assert Declaration.from_json(declared.to_json()).prefixes() == declared.prefixes()
    with pytest.raises(fits.Refused):
        done.batch("train")  # xy has gaps where x had


def test_rules_are_told_together():
    with pytest.raises(DeclarationError) as e:
        Declaration.from_json(json.dumps({"declaration": [{"verb": "normalise", "column": "x"}, {"verb": "target.ahead", "column": "x", "ahead": 2}]}))
    assert len(e.value.faults) >= 3
    with pytest.raises(DeclarationError, match="is it"):
        Declaration.from_json(json.dumps({"declaration": [{"verb": "normalize", "column": "x"}]}))
    with pytest.raises(ValueError):
        create().read_rows().add("normalise", column="x")


def test_stream_is_served(spark, tmp_path):
    df = rows(spark)
    done = plan().run(spark, df)
    df.write.parquet(str(tmp_path / "in"))
    out = serve(done, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("served").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("served").count() == 60


def test_indicators_look_back_only(spark):
    data = [(i, 10 + np.sin(i) * 3 + i / 9) for i in range(60)]
    changed = [(i, v + (100 if i == 40 else 0)) for i, v in data]
    for name in indicators.INDICATORS:
        n = indicators.INDICATORS[name][0]
        out = []
        for d in (data, changed):
            df = spark.createDataFrame([(i, float(v), float(v) - 1, float(v) - 0.5, 3.0) for i, v in d], "t int, h double, l double, c double, q double")
            cols = {1: ["c"], 2: ["c", "q"], 3: ["h", "l", "c"], 4: ["h", "l", "c", "q"]}[n]
            made = indicators.add_indicator(df, "x", name, 5, cols, ["t"])
            out.append([tuple(r) for r in made.where("t < 40").orderBy("t").drop("h", "l", "c", "q").collect()])
        assert out[0] == out[1]


def test_reading_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n2,\n')
    got = readers.read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in got] == [("1", "x\ny"), ("2", None)]
    (tmp_path / "a.json").write_text('[{"a": 1, "b": "x"}, {"a": 2.50}]')
    assert {tuple(r) for r in readers.read_json(spark, str(tmp_path / "a.json")).collect()} == {("1", "x"), ("2.50", None)}
    for w in ("good", "bad"):
        (tmp_path / "texts" / w).mkdir(parents=True)
        (tmp_path / "texts" / w / "1.txt").write_text(f"{w} text")
    assert [(r.text, r.label, r.good) for r in readers.read_texts(spark, str(tmp_path / "texts")).collect()] == [("bad text", "bad", 0.0), ("good text", "good", 1.0)]
    raw = b"".join(b"\0" + bytes([10 * y + x for x in range(2)]) for y in range(2))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    (tmp_path / "images" / "c").mkdir(parents=True)
    (tmp_path / "images" / "c" / "1.png").write_bytes(png)
    got = readers.read_images(spark, str(tmp_path / "images"), 2, 2, 1).first()
    assert [round((v + 1) * 127.5) for v in got.media] == [0, 1, 10, 11]
    (tmp_path / "sounds" / "c").mkdir(parents=True)
    with wave.open(str(tmp_path / "sounds" / "c" / "1.wav"), "wb") as w:
        w.setparams((1, 2, 8000, 0, "NONE", ""))
        w.writeframes(struct.pack("<3h", 0, 16384, -32768))
    assert readers.read_sounds(spark, str(tmp_path / "sounds"), 8000, 3, 1).first().media == [0.0, 0.5, -1.0]


def test_join_refusals(spark):
    left = spark.createDataFrame([("a ", 1), ("b", 2), (None, 3)], "k string, v int")
    right = spark.createDataFrame([("a", "x"), ("c", "y")], "k string, w string")
    assert [tuple(r) for r in readers.read_join(left, right, ["k"], "drop").collect()] == [("a ", 1, "x")]
    with pytest.raises(fits.Refused):
        readers.read_join(left, right, ["k"])
    with pytest.raises(fits.Refused):
        readers.read_join(left, right.union(right), ["k"], "drop")


def test_landing_is_kept(spark, tmp_path):
    rows_ = [(f"2020-01-01T0{h}:00:00Z", *["1"] * 9) for h in range(3)]
    df = spark.createDataFrame(rows_, readers.CANDLES)
    start = 1577836800
    mark = readers.land_candles(df, str(tmp_path / "l"), "AB", "1h", start, start + 3 * 3600)
    assert readers.land_candles(df, str(tmp_path / "l"), "AB", "1h", start, start + 3 * 3600) == mark
    with pytest.raises(fits.Refused):
        readers.land_candles(df, str(tmp_path / "l"), "AB", "1h", start, start + 4 * 3600)


def test_measures_and_answers(spark):
    one = spark.range(1)
    got = measures.measure(one, measures.shares([F.lit(0.5), F.lit(0.5), F.lit(0.0)], [F.lit(0.25), F.lit(0.5), F.lit(0.25)])).first()
    assert got.emd == pytest.approx(0.5) and got.rps == pytest.approx(0.125)
    with pytest.raises(fits.Refused):
        outputs.target_labels(spark.createDataFrame([(2, 0)], "a int, b int"), ["a", "b"])
    constant = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert np.isnan(evidence.correlation(constant, ["a", "b"]).first().coefficient)
    assert features.PERIODS


def test_trees_learn(spark):
    df = spark.createDataFrame([(float(i % 10), float(i % 10 > 4)) for i in range(200)], "x double, y double")
    model = learners.learn_trees(df, ["x"], "y", {"kind": "fastforest", "trees": 5}, True)
    assert model.transform(df).where("prediction = y").count() == 200

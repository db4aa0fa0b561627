"""A JSON array in many splits a file against Python's own reading of it."""

import json
import random

import pytest

from tidemark.operators.fits import Refused
from tidemark.sources.readers import read_json
from tidemark.sources.splitjson import cells_of


@pytest.fixture
def splits_of(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield of
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [64, 997, 1 << 20])
@pytest.mark.parametrize("indent", [None, 1])
def test_splits_say_what_the_file_says(spark, tmp_path, splits_of, size, indent):
    rng = random.Random(size)
    words = ["x", "a}b", '"}, {"', "\\", '\\"', "}{", "]", "é\n", "long } " * 40, "", None, True, 1.5, -7]
    told = [{"id": i, **{k: rng.choice(words) for k in rng.sample("abc", 3)[: rng.randrange(4)]}} for i in range(300)]
    (tmp_path / "t.json").write_text(json.dumps(told, indent=indent, ensure_ascii=False))
    splits_of(size)
    df = read_json(spark, str(tmp_path / "t.json"))
    assert size > 10_000 or df.rdd.getNumPartitions() > 8
    names = list(dict.fromkeys(k for r in told for k in r))
    assert df.columns == names
    text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
    assert sorted((tuple(r) for r in df.collect()), key=lambda r: int(r[0])) == [tuple(text(r.get(n)) for n in names) for r in told]


def test_numbers_keep_their_text(spark, tmp_path):
    (tmp_path / "t.json").write_text('\ufeff [ {"a": 1.500, "b": 1e5, "c": false} , {"b": -0, "d": "1.50"}, {} ]\n')
    df = read_json(spark, str(tmp_path / "t.json"))
    assert df.columns == ["a", "b", "c", "d"]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted([("1.500", "1e5", "false", None), (None, "-0", None, "1.50"), (None,) * 4], key=repr)


@pytest.mark.parametrize("text, refusal", [
    ('[{"a": 1}, {"a": 2, "b": 3, "a": 4}, {"c": [1]}]', "record 2 of .* names 'a' twice"),
    ('[{"a": 1}, {"b": "{", "c": {"d": 1}}, {"a": 2}]', "record 2 of .* holds an object under 'c'"),
    ('[{"a": [1, 2]}]', "record 1 of .* holds an array under 'a'"),
    ('[{"a": 1}, 7, {"a": 2}]', "record 2 of .* is no object of plain cells"),
    ('[{"a": 1} {"a": 2}]', "record 2 of .* stands where an array of objects is awaited"),
    ('[{"a": 1}, {"a": NaN}]', "record 2 of .* is no object of plain cells"),
    ('[{"a": 1}, {"a": "\\ud800"}]', "record 2 of .* is no object of plain cells"),
    ('[{"a": 1}', "record 1 of .* stands where the array ends"),
    ('[{"a": "}', "record 1 of .* stands where the array ends"),
    ('[{"a": 1}],', "record 2 of .* stands where the array ends"),
    ('{"a": 1}', "record 1 of .* stands where"),
    ("[1, 2]", "record 1 of .* stands where the array ends"),
    ("[]", "holds no records"),
])
def test_what_is_no_array_of_flat_objects_is_refused(spark, tmp_path, text, refusal):
    (tmp_path / "t.json").write_text(text)
    with pytest.raises(Refused, match=refusal):
        read_json(spark, str(tmp_path / "t.json"))


def test_a_fault_is_named_whatever_the_splits(spark, tmp_path, splits_of):
    rows = [json.dumps({"a": i, "b": "} " * (i % 40)}) for i in range(200)]
    rows[150] = '{"a": 1, "b": 2, "b": 3}'
    rows[170] = '{"a": {"b": 1}}'
    (tmp_path / "t.json").write_text(f"[{', '.join(rows)}]")
    for size in (50, 1000, 1 << 20):
        splits_of(size)
        with pytest.raises(Refused, match="record 151 of .* names 'b' twice") as told:
            read_json(spark, str(tmp_path / "t.json"))
        assert told.value.row == 151


def test_several_files(spark, tmp_path):
    (tmp_path / "1.json").write_text('[{"b": 1}]')
    (tmp_path / "2.json").write_text('[{"a": 2, "b": 3}]')
    (tmp_path / "3.json").write_text("[ ]")
    df = read_json(spark, str(tmp_path))
    assert df.columns == ["b", "a"] and sorted(map(tuple, df.collect()), key=repr) == [("1", None), ("3", "2")]


def test_cells():
    assert cells_of('[ {"a": null, "b": true', True) == ([("a", None), ("b", "true")], None)
    assert cells_of(",{", False) == ([], None)

"""Courses, presets, choices, lines, verbs of one's own and what is generated from the verbs."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.plans import catalog, courses
from tidemark.plans.courses import COURSES, Course, Preset
from tidemark.plans.pipeline import Declaration, create
from tidemark.plans.rules import DeclarationError
from tidemark.plans.verbs import Verb

HEADER = ["id", "age", "class", "name", "survived"]
COLUMNS = [{"name": "id", "kind": "integer", "id": True}, {"name": "age", "kind": "number"}, {"name": "class", "kind": "category", "was": "integer"}, {"name": "name", "kind": "text", "excluded": True}, {"name": "survived", "kind": "number"}]


def decided():
    return create().read_csv(path="x.csv").declare(columns=COLUMNS).split_at_random().fill_missing(column="age").drop_columns(columns=["age_was_missing"]).target(column="survived").build()


def test_courses_survive_their_files():
    filled = COURSES["table"].saying("read.csv", path="x.csv").saying("declare", columns=COLUMNS).saying("split.stratified", column="survived").saying("target", column="survived").saying("normalise", column="age").saying("normalise", column="id")
    for c in (*COURSES.values(), filled):
        assert Course.from_json(c.to_json()) == c
    assert [s.verb for s in filled.to_declaration().steps] == ["read.csv", "declare", "split.stratified", "target", "normalise", "normalise"]
    assert Course((("settle.gaps", {"with": "zero"}),)).to_json() == '{\n  "version": 16,\n  "course": [\n    {\n      "step": "settle.gaps",\n      "with": "zero"\n    }\n  ]\n}'
    assert dict(COURSES["seriesInTime"].steps)["split.byTime"] == {"gap": 1}
    with pytest.raises(ValueError):
        Course(())


def test_presets_are_taken_over():
    preset = Preset.of(decided(), HEADER)
    assert Preset.from_json(preset.to_json()) == preset and preset.drop == ("age_was_missing",)
    assert list(json.loads(preset.to_json())) == ["version", "source", "declare", "drop", "output"]
    same = preset.take_over(decided(), HEADER)
    assert same.steps == list(decided().steps) and not same.changes and not same.faults and same.output is None
    other = Declaration(tuple(courses.with_kind(courses.excluding(decided().steps, "class"), "survived", "category")))
    taken = Preset.of(other).take_over(decided(), [*HEADER, "more"])
    assert {c: (a["standing"], b["standing"]) for c, a, b in taken.changes} == {"class": ("taking", "excluded"), "survived": ("taking", "taking")}
    assert taken.steps == list(other.steps) and taken.new_columns == ["more"]
    with pytest.raises(ValueError, match="twice"):
        Preset(preset.declare, ("b", "b"))
    with pytest.raises(ValueError):
        Preset.from_json('{"declare": {"columns": []}, "colour": "red"}')


def test_choices_about_columns():
    steps = decided().steps
    assert [courses.standing(steps, c) for c in ("age", "name", "age_was_missing", "other")] == ["taking", "excluded", "dropped", "unnamed"]
    dropped = courses.excluding(steps, "age")
    assert dropped[4].verb == "drop.columns" and dropped[4]["columns"] == ["age"]
    assert courses.standing(courses.including(steps, "name"), "name") == "taking"
    said = courses.answered(steps, {"action": "saymissing", "column": "age", "value": "-1"})
    assert next(c for c in said[1]["columns"] if c["name"] == "age")["missing"] == "-1"
    with pytest.raises(DeclarationError):
        courses.with_missing(steps, "nowhere", "1")


def test_lines_and_default_forms():
    b = create().read_csv(path="x").declare(columns=COLUMNS).default_features("unit").feature_cycle(column="age", length=7)
    assert b.steps[-1]["form"] == "unit"
    b = b.split_at_random().lines("normalise", "scale", {"minmax": ["age"], "robust": ["id", "survived"]})
    assert [(s["column"], s["scale"]) for s in b.steps[-3:]] == [("age", "minmax"), ("id", "robust"), ("survived", "robust")]
    with pytest.raises(ValueError):
        create().default_features("round")


def test_verbs_of_ones_own(spark):
    catalog.register(Verb("feature.double", "add", 16, {"column": "x"}, reads=lambda p: [p["column"]]), lambda df, p: df.withColumn(p["column"], 2 * F.col(p["column"])))
    try:
        done = create().read_rows().declare(columns=[{"name": "x", "kind": "number"}]).add("feature.double", column="x").build().run(spark, spark.createDataFrame([(1.5,)], "x double"))
        assert done.df.first().x == 3.0
        assert "feature.double" in catalog.verb_page()
        with pytest.raises(ValueError, match="already"):
            catalog.register(Verb("feature.double", "add", 16, {}), None)
    finally:
        catalog.unregister("feature.double")
    assert {s["properties"]["step"]["const"] for s in catalog.json_schema()["properties"]["declaration"]["items"]["oneOf"]} >= {"read.csv", "target"}


def test_rules_of_answers_made_from_columns_as_read():
    b = create().read_csv(path="x").declare(columns=[{"name": "at", "kind": "timestamp"}, {"name": "c", "kind": "number"}]).order_by(columns=["at"]).maths(column="c", maths="log").split_byTime(column="at", gap=1)
    with pytest.raises(DeclarationError, match="as it was read"):
        b.target_ahead(column="c", ahead=1, as_="return").build()
    assert b.target_ahead(column="c", ahead=1).build()

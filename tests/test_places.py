"""What is wrong with a pipeline file, by line and column."""

import json
import random

import pytest

from tidemark.plans.pipeline import Declaration, create
from tidemark.plans.places import FileFaults, surveyed
from tidemark.plans.rules import DeclarationError

GOOD = """{
  "version": 1,
  "declaration": [
    {"step": "read.csv", "path": "x.csv"},
    {"step": "declare", "columns": [{"name": "a", "kind": "number"}]},
    {"step": "split.atRandom"},
    {"step": "normalise", "column": "a"},
    {"step": "target", "column": "a"}
  ]
}"""


def told(text):
    with pytest.raises(FileFaults) as e:
        Declaration.from_json(text)
    return list(zip(e.value.places, e.value.messages, strict=True)), e.value


def place(text, marker, nth=0):
    at = -1
    for _ in range(nth + 1):
        at = text.index(marker, at + 1)
    return text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at)


def test_all_faults_at_once_at_their_places():
    text = GOOD.replace('"normalise", "column": "a"', '"normalise", "colum": "a"').replace("split.atRandom", "split.atRandon").replace('"version": 1', '"version": 1, "colour": 2')
    found, error = told(text)
    assert [p for p, _ in found] == [place(text, '"colour"'), place(text, '"step": "split'), place(text, '{"step": "normalise'), place(text, '"colum"')]
    assert "holds version, declaration" in found[0][1] and "is it split.atRandom?" in found[1][1] and "column is left out" in found[2][1] and "no key colum" in found[3][1]
    assert error.faults[1] == f"line 6, column 6: {found[1][1]}" and isinstance(error, DeclarationError)


def test_rules_are_told_at_their_steps():
    text = GOOD.replace('    {"step": "split.atRandom"},\n', "").replace('"target", "column": "a"', '"target", "column": "b"')
    found, _ = told(text)
    assert (place(text, '{"step": "normalise'), "step 3 (normalise): nothing learns before the split") in found
    assert (place(text, '{"step": "target'), "step 4 (target): there is no column b") in found


@pytest.mark.parametrize("text, marker, message", [
    (GOOD.replace('"x.csv"},', '"x.csv"}'), '{"step": "declare', "comma"), (GOOD.replace('"path"', "path"), "path", "key"), (GOOD + " 1", "1", "follows"), (GOOD[:-1], None, "comma"),
    (GOOD.replace('"path": "x.csv"', '"path": "x.csv", "path": "y"'), '"path": "y"', "'path' stands twice"), (GOOD.replace('"version": 1', '"version": "1"'), '"version"', "whole number"),
    (GOOD.replace('"version": 1', '"version": 99'), '"version"', "later"), ("[" * 500, None, "deeply"), ("", None, "Expecting value"), ("7", "7", "an object"),
])
def test_what_is_no_file(text, marker, message):
    found, _ = told(text)
    assert message in found[0][1]
    if marker:
        assert found[0][0] == (place(text, marker) if marker != "1" else (10, 3))


def test_it_reads_what_json_reads():
    rng = random.Random(4)

    def value(depth):
        kind = rng.randrange(7 if depth < 4 else 5)
        if kind < 5:
            return [None, True, -1.5e3, 12, 'é"\\\n{}[],:'][kind]
        return [value(depth + 1) for _ in range(rng.randrange(4))] if kind == 5 else {f"k{i}": value(depth + 1) for i in range(rng.randrange(4))}

    for _ in range(200):
        one = value(0)
        for indent in (None, 2):
            text = json.dumps(one, indent=indent)
            found = surveyed(text)
            assert found.value == one
            for path, at in found.places.items():
                part = one
                for k in path:
                    part = part[k]
                assert json.JSONDecoder().raw_decode(text, at)[0] == (path[-1] if path and isinstance(path[-1], str) else part)


def test_measures_along_an_order_need_one():
    def report(**given):
        b = create().read_csv(path="x").declare(columns=[{"name": c, "kind": "number"} for c in "ab"]).split_at_random(seed=1).target_distribution(columns=["a", "b"], **given)
        return b.evidence_report(metrics=["kl", "emd", "rps"], parts=["test"]).build()

    report(ordered=True)
    with pytest.raises(DeclarationError, match="emd measures shares along an order") as e:
        report()
    assert len(e.value.faults) == 2

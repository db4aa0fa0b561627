"""Courses (skeletons of pipelines to be filled in), presets (what was decided about columns) and choices about single columns."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from tidemark.plans.needs import answers_of
from tidemark.plans.pipeline import VERSION, Declaration
from tidemark.plans.rules import DeclarationError, faults
from tidemark.plans.verbs import REQUIRED, VERBS, Step, step

# The two courses there are: their verbs in order.
TABLE = "read.csv declare settle.gaps feature.add scale.given split.stratified target drop.columns fill.missing normalise evidence.report learn.network"
SERIES_IN_TIME = "read.csv declare order.by settle.gaps feature.add scale.given split.byTime target.ahead drop.columns fill.missing normalise evidence.report learn.network"


@dataclass(frozen=True)
class Course:
    """Verbs in the order they belong, each with what has been said of it so far."""

    steps: tuple[tuple[str, dict[str, Any]], ...]

    def __post_init__(self) -> None:
        if not self.steps:
            raise ValueError("a course holds at least one step")
        unknown = [v for v, _ in self.steps if v not in VERBS]
        if unknown:
            raise ValueError(f"no verb {', '.join(unknown)}")

    def saying(self, verb: str, **said: Any) -> Course:
        """The course with more said of a verb. A verb said again after all its keys are there stands twice."""
        at = [i for i, (v, _) in enumerate(self.steps) if v == verb]
        if not at:
            raise ValueError(f"the course has no {verb}")
        wrong = [k for k in said if k not in VERBS[verb].keys]
        if wrong:
            raise ValueError(f"{verb}: no key {', '.join(wrong)}")
        last, steps = at[-1], list(self.steps)
        if set(said) & set(steps[last][1]):
            steps.insert(last + 1, (verb, said))
        else:
            steps[last] = (verb, steps[last][1] | said)
        return Course(tuple(steps))

    def to_declaration(self) -> Declaration:
        """A pipeline of the steps of which everything needed has been said; the others are left out."""
        needed = lambda v: {k for k, d in VERBS[v].keys.items() if d is REQUIRED}
        return Declaration(tuple(step(v, **said) for v, said in self.steps if needed(v) <= set(said)))

    def to_json(self) -> str:
        return json.dumps({"version": VERSION, "course": [{"step": v, **said} for v, said in self.steps]}, indent=2, ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> Course:
        told = json.loads(text)
        if told.get("version", 1) > VERSION:
            raise ValueError(f"version {told['version']} is later than {VERSION}")
        return Course(tuple((one["step"], {k: v for k, v in one.items() if k != "step"}) for one in told["course"]))


COURSES = {
    "table": Course(tuple((v, {}) for v in TABLE.split())),
    "seriesInTime": Course(tuple((v, {"gap": 1} if v == "split.byTime" else {}) for v in SERIES_IN_TIME.split())),
}


def standing(steps: Sequence[Step], name: str) -> str:
    """taking, excluded, dropped, made (by a step) or unnamed."""
    declared = next((s for s in steps if s.verb == "declare"), None)
    column = next((c for c in declared["columns"] if c["name"] == name), None) if declared else None
    if any(s.verb == "drop.columns" and name in s["columns"] for s in steps):
        return "dropped"
    if column is not None:
        return "excluded" if column.get("excluded") else "taking"
    return "made" if any(s.makes == name for s in steps) else "unnamed"


def _declared(steps: Sequence[Step]) -> int:
    at = next((i for i, s in enumerate(steps) if s.verb == "declare"), None)
    if at is None:
        raise DeclarationError(["there is no schema"])
    return at


def _with_column(steps: Sequence[Step], name: str, change: dict | None) -> list[Step]:
    """Steps whose schema says something else of a column: keys set, or taken away where they are None."""
    at = _declared(steps)
    columns = [dict(c) for c in steps[at]["columns"]]
    own = next((c for c in columns if c["name"] == name), None)
    if own is None:
        raise DeclarationError([f"the schema does not name {name}"])
    for k, v in (change or {}).items():
        if v is None:
            own.pop(k, None)
        else:
            own[k] = v
    return [*steps[:at], Step("declare", {**steps[at].params, "columns": columns}), *steps[at + 1 :]]


def excluding(steps: Sequence[Step], name: str) -> list[Step]:
    """The column left out: by the schema where no step names it, else dropped after the last step that reads it."""
    at = _declared(steps)
    last = max((i for i, s in enumerate(steps) if i > at and (name in s.reads or s.makes == name)), default=None)
    declared = any(c["name"] == name for c in steps[at]["columns"])
    if last is None and declared:
        if sum(not c.get("excluded") for c in steps[at]["columns"]) <= 1:
            raise DeclarationError([f"{name} is the last column that the schema takes"])
        return _with_column(steps, name, {"excluded": True})
    return [*steps[: (last if last is not None else at) + 1], step("drop.columns", columns=[name]), *steps[(last if last is not None else at) + 1 :]]


def including(steps: Sequence[Step], name: str, kind: str = "text") -> list[Step]:
    """The column taken in again: no longer excluded nor dropped, and declared where it was not."""
    out = []
    for s in steps:
        if s.verb == "drop.columns" and name in s["columns"]:
            rest = [c for c in s["columns"] if c != name]
            out += [step("drop.columns", columns=rest)] if rest else []
        else:
            out.append(s)
    at = _declared(out)
    if any(c["name"] == name for c in out[at]["columns"]):
        return _with_column(out, name, {"excluded": None})
    if any(s.makes == name for s in out):
        return out
    return [*out[:at], Step("declare", {**out[at].params, "columns": [*out[at]["columns"], {"name": name, "kind": kind}]}), *out[at + 1 :]]


def with_kind(steps: Sequence[Step], name: str, kind: str) -> list[Step]:
    """The column declared as another kind; a category remembers what it was."""
    was = next((c["kind"] for c in steps[_declared(steps)]["columns"] if c["name"] == name), None)
    return _with_column(steps, name, {"kind": kind, "was": was if kind == "category" and was != kind else None})


def with_missing(steps: Sequence[Step], name: str, value: str) -> list[Step]:
    """The value said to stand for a gap in the column."""
    return _with_column(steps, name, {"missing": value})


def answered(steps: Sequence[Step], alert: Any) -> list[Step]:
    """The steps with an alert's answer given (a row of Alerts.table()), where that is a change to the columns; a step that is to be
    written is placed by a person."""
    if alert["action"] == "leaveout":
        return excluding(steps, alert["column"])
    return with_missing(steps, alert["column"], alert["value"]) if alert["action"] == "saymissing" else list(steps)


@dataclass(frozen=True)
class TakenOver:
    """What taking a preset over makes of a pipeline: steps, or the faults and no steps. changes lists columns whose decision changes, with
    what was decided before and after; not_made the drops that did not reach the end."""

    steps: list[Step]
    faults: list[str] = field(default_factory=list)
    new_columns: list[str] | None = None
    changes: list[tuple[str, dict, dict]] = field(default_factory=list)
    output: tuple[dict | None, dict | None] | None = None
    not_made: list[str] = field(default_factory=list)


def _output(steps: Sequence[Step]) -> Step | None:
    return next((s for s in steps if s.spec.role == "answer"), None)


def _told(s: Step | None) -> dict | None:
    return None if s is None else {"step": s.verb, **{k: v for k, v in s.params.items() if v != VERBS[s.verb].keys[k]}}


def _decided(steps: Sequence[Step], name: str) -> dict:
    column = next((c for s in steps if s.verb == "declare" for c in s["columns"] if c["name"] == name), {})
    return {"standing": standing(steps, name), **{k: column[k] for k in ("kind", "was", "missing", "format", "optional", "id") if column.get(k)}}


@dataclass(frozen=True)
class Preset:
    """What a pipeline decided about its columns: its schema, drops, answer, and the source's columns as last shown."""

    declare: Step
    drop: tuple[str, ...] = ()
    output: Step | None = None
    source: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        twice = sorted({c for c in self.drop if self.drop.count(c) > 1})
        if twice:
            raise ValueError(f"dropped twice: {', '.join(twice)}")

    @staticmethod
    def of(declaration: Declaration, header: Sequence[str] | None = None) -> Preset:
        declare = next((s for s in declaration.steps if s.verb == "declare"), None)
        if declare is None:
            raise ValueError("a pipeline without a schema has decided nothing about its columns")
        drops = tuple(c for s in declaration.steps if s.verb == "drop.columns" for c in s["columns"])
        return Preset(declare, drops, _output(declaration.steps), tuple(header) if header is not None else None)

    def to_json(self) -> str:
        told: dict[str, Any] = {"version": VERSION}
        if self.source is not None:
            told["source"] = list(self.source)
        told["declare"] = {k: v for k, v in _told(self.declare).items() if k != "step"}
        if self.drop:
            told["drop"] = list(self.drop)
        if self.output is not None:
            told["output"] = _told(self.output)
        return json.dumps(told, indent=2, ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> Preset:
        told = json.loads(text)
        if told.get("version", 1) > VERSION:
            raise ValueError(f"version {told['version']} is later than {VERSION}")
        wrong = sorted(set(told) - {"version", "source", "declare", "drop", "output"})
        if wrong or "declare" not in told:
            raise ValueError(f"no key {', '.join(wrong)}" if wrong else "declare is left out")
        output = told.get("output")
        made = step(output["step"], **{k: v for k, v in output.items() if k != "step"}) if output else None
        return Preset(step("declare", **told["declare"]), tuple(told.get("drop", ())), made, tuple(told["source"]) if "source" in told else None)

    def new_columns(self, header: Sequence[str]) -> list[str]:
        """Columns of a source that these decisions never showed."""
        named = [*(c["name"] for c in self.declare["columns"]), *self.drop, *(answers_of([self.output]) if self.output else [])]
        known = self.source if self.source is not None else named
        return [c for c in header if c not in known]

    def take_over(self, into: Declaration, header: Sequence[str] | None = None) -> TakenOver:
        """These decisions made for another pipeline, a stage at a time, each held to the rules: drops they do not make are taken back, the
        schema is put in the place of the one there, their drops are made, and the answer is set or taken away."""
        fresh = self.new_columns(header) if header is not None else None
        steps = list(into.steps)
        try:
            for c in [c for s in into.steps if s.verb == "drop.columns" for c in s["columns"] if c not in self.drop]:
                steps = self._kept(including(steps, c))
            at = next((i for i, s in enumerate(steps) if s.verb == "declare"), None)
            steps = self._kept([*steps[: at if at is not None else 1], self.declare, *steps[(at + 1) if at is not None else 1 :]])
            for c in self.drop:
                if standing(steps, c) not in ("dropped", "excluded"):
                    steps = self._kept(excluding(steps, c))
            at = next((i for i, s in enumerate(steps) if s.spec.role == "answer"), None)
            rest = [s for i, s in enumerate(steps) if i != at]
            if self.output is not None:
                split = next((i for i, s in enumerate(rest) if s.spec.role == "split"), len(rest) - 1)
                where = at if at is not None else split + 1
                rest = [*rest[:where], self.output, *rest[where:]]
            steps = self._kept(rest)
        except DeclarationError as e:
            return TakenOver([], e.faults, fresh)
        names = dict.fromkeys([*(header or []), *(c["name"] for s in (*into.steps, *steps) if s.verb == "declare" for c in s["columns"]), *self.drop])
        before_after = [(c, _decided(into.steps, c), _decided(steps, c)) for c in names]
        outputs = _told(_output(into.steps)), _told(_output(steps))
        return TakenOver(
            steps, [], fresh, [x for x in before_after if x[1] != x[2]], outputs if outputs[0] != outputs[1] else None,
            [c for c in self.drop if standing(steps, c) not in ("dropped", "excluded")],
        )

    @staticmethod
    def _kept(steps: list[Step]) -> list[Step]:
        wrong = list(faults(steps))
        if wrong:
            raise DeclarationError(wrong)
        return steps

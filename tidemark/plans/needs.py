"""What a learner needs of its features: where each lands, and which steps a run for it leaves out. Decided from the steps alone."""

from __future__ import annotations

from collections.abc import Sequence

from tidemark.plans.verbs import Step

NEEDS = ("numbers", "oneScale", "noScale", "categories")
_SCALES = ("minmax", "quantile", "midrange", "maxabs")


class Landing:
    """Columns, and beginnings of names that only data completes, whose values lie between -1 and 1 whatever the rows hold."""

    def __init__(self, steps: Sequence[Step], skipped: dict[int, str]):
        self.columns: set[str] = set()
        self.families: set[str] = set()
        self.ids: set[str] = set()
        for i, s in enumerate(steps):
            if i not in skipped:
                self._after(s, steps)

    def of(self, name: str) -> bool:
        return name in self.columns or name in self.ids or any(name.startswith(f) for f in self.families)

    def _after(self, s: Step, steps: Sequence[Step]) -> None:
        p, column = s.params, s.params.get("column")
        if s.verb == "declare":
            self.columns |= {c["name"] for c in p["columns"] if c["kind"] in ("boolean", "media")}
        elif s.verb in ("feature.cycle", "feature.cyclical"):
            self.families.add(f"{column}_")
        elif s.verb == "scale.given":
            self._put(column, p["lands"] != "splitsign")
            self.families |= {f"{column}_"} if p["lands"] == "splitsign" else set()
        elif s.verb == "normalise":
            self._put(column, p["scale"] in _SCALES)
        elif s.verb == "normalise.row":
            self.columns |= set(p["columns"])
        elif s.verb in ("fill.missing", "settle.gaps"):
            self.columns.add(f"{column}_was_missing")
        elif s.verb == "encode":
            self._encoded(column, p["as"])
        elif s.verb == "encode.categories":
            for c in next((x["columns"] for x in steps if x.verb == "declare"), []):
                if c["kind"] == "category" and not c.get("excluded"):
                    self._encoded(c["name"], p["as"])
        elif s.verb == "encode.piecewise" and p["outOfRange"] != "pass":
            self.families.add(f"{column}_bin")
        elif s.verb == "tokenize":
            self.ids.add(column)
        elif s.verb in ("feature.add", "feature.indicator", "maths", "history", "history.known"):
            self._put(s.makes, False)

    def _put(self, name: str, lands: bool) -> None:
        (self.columns.add if lands else self.columns.discard)(name)

    def _encoded(self, name: str, how: str) -> None:
        if how == "onehot":
            self.families.add(f"{name}_")
        else:
            self.columns.add(f"{name}_was_missing")
            self.columns.discard(name)


def way_back(steps: Sequence[Step], answers: Sequence[str]) -> set[int]:
    """The steps that the way back of an answer leads through."""
    found = set()
    for answer in answers:
        name = answer
        for i in range(len(steps) - 1, -1, -1):
            s, p = steps[i], steps[i].params
            if s.verb == "target.ahead" and s.makes == name:
                found.add(i)
                name = p["column"]
            elif s.verb == "maths" and s.makes == name:
                found.add(i)
                name = p["column"]
            elif s.verb in ("normalise", "scale.given") and p["column"] == name:
                found.add(i)
    return found


def answers_of(steps: Sequence[Step]) -> list[str]:
    """The columns of the answer that the steps name."""
    for s in steps:
        if s.spec.role == "answer":
            if s.verb == "target":
                return [s["column"]]
            if s.verb == "target.ahead":
                return [s.makes]
            return [*s["columns"], *([s["remainder"]] if s.params.get("remainder") else [])]
    return []


def left_out(steps: Sequence[Step], needs: str) -> dict[int, str]:
    """The steps that a run for a learner leaves out, and how: 'out', or 'places' for an encoder that hands categories over as their
    places. A step stays where an answer's way back leads through it, where a step below reads or changes its column, and where it
    refuses what it was not fitted on."""
    if needs not in NEEDS:
        raise ValueError(f"no need {needs}; there are {', '.join(NEEDS)}")
    kept, found = way_back(steps, answers_of(steps)), {}
    for i, s in enumerate(steps):
        if i in kept or any(_touches(b, s) for b in steps[i + 1 :]):
            continue
        if s.verb == "normalise" and needs in ("noScale", "categories") and s["outOfRange"] != "refuse":
            found[i] = "out"
        elif s.verb in ("encode", "encode.categories") and needs == "categories":
            found[i] = "places"
    return found


def _touches(below: Step, s: Step) -> bool:
    """Whether a step reads or makes the column of a step above it, or one of those it makes."""
    column = s.params.get("column")
    if s.verb == "encode.categories":
        return below.verb == "encode"
    named = {*below.reads, *([below.makes] if below.makes else [])}
    return any(n == column or (s.verb == "encode" and n.startswith(f"{column}_")) for n in named)


def missed(skipped: dict[int, str], steps: Sequence[Step], needs: str) -> list[int]:
    """Steps that a run left out although a learner with these needs cannot do without them."""
    return [i for i, how in skipped.items() if left_out(steps, needs).get(i) != how]

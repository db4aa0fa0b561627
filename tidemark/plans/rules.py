"""What a list of steps must keep to. All faults are reported together, before anything is read."""

from __future__ import annotations

from collections.abc import Iterator

from tidemark.plans.verbs import Step

CLASS_METRICS = {"accuracy", "precision", "recall", "f1", "confusionmatrix", "auc", "brier"}
SHARE_METRICS = {"kl", "emd", "rps"}


class DeclarationError(ValueError):
    def __init__(self, faults: list[str]):
        super().__init__("\n".join(faults))
        self.faults = faults


def faults(steps: list[Step]) -> Iterator[str]:
    roles = [s.spec.role for s in steps]
    at = {r: [i for i, x in enumerate(roles) if x == r] for r in set(roles)}
    say = lambda i, what: f"step {i + 1} ({steps[i].verb}): {what}"
    if "source" not in at:
        yield "there is no source"
    elif at["source"][0] != 0:
        yield say(at["source"][0], "a source stands first")
    for role in ("source", "schema", "order", "split", "answer", "report", "learner"):
        for i in at.get(role, [])[1:]:
            yield say(i, f"there is a {role} already")
    if "schema" in at and at["schema"][0] != 1:
        yield say(at["schema"][0], "columns are declared right after the source")
    split = at.get("split", [len(steps)])[0]
    for i, s in enumerate(steps):
        if roles[i] == "fit" and i < split:
            yield say(i, "nothing learns before the split")
        if roles[i] in ("drop", "order", "add") and i > split and s.verb not in ("drop.columns",):
            yield say(i, "belongs above the split")
        if s.spec.ordered and not any(steps[k].verb == "order.by" for k in range(i)):
            yield say(i, "reads the rows' order, which no order.by above it gives")
    settled = {s["column"] for s in steps if s.verb == "settle.gaps"}
    for i, s in enumerate(steps):
        if s.verb == "fill.missing" and s["column"] in settled:
            yield say(i, f"the gaps of {s['column']} are settled already")
        if s.verb == "fill.missing" and s["with"] == "previous" and (split == len(steps) or steps[split].verb != "split.byTime"):
            yield say(i, "previous values need a split by time")
        if s.verb == "history.known" and (split == len(steps) or steps[split].verb != "split.byTime"):
            yield say(i, "needs a split by time")
        if s.verb == "target.ahead":
            order = next((x["columns"] for x in steps if x.verb == "order.by"), None)
            if split == len(steps) or steps[split].verb != "split.byTime":
                yield say(i, "rows ahead need a split by time")
            elif order != [steps[split]["column"]]:
                yield say(i, "rows ahead need the split's column alone as order")
            elif steps[split]["gap"] < s["ahead"]:
                yield say(i, f"the split's gap of {steps[split]['gap']} is less than {s['ahead']} rows ahead")
        changed = [x for k, x in enumerate(steps[:i]) if x.verb in ("normalise", "scale.given", "outliers.clip", "fill.nan", "encode", "encode.piecewise") or (x.verb == "maths" and not x["into"])]
        if s.verb == "target.ahead" and s["as"] == "return" and any(x["column"] == s["column"] for x in changed):
            yield say(i, f"a return is made from {s['column']} as it was read")
        if s.verb == "target.distribution" and s["remainder"]:
            touched = [x["column"] for x in changed if x["column"] in (*s["columns"], s["scaleBy"])]
            if touched:
                yield say(i, f"a remainder is made from {', '.join(touched)} as read")
            if not s["scaleBy"]:
                yield say(i, "a remainder is what counts leave of a whole, and scaleBy names none")
        if s.spec.ordered and i > split and s.spec.role != "answer" and steps[split].verb != "split.byTime":
            yield say(i, "reads the rows' order below a split that is not by time")
    answer = at.get("answer", [None])[0]
    for role in ("report", "learner"):
        for i in at.get(role, []):
            if answer is None or answer > i:
                yield say(i, f"a {role} stands below an answer")
            if split > i:
                yield say(i, f"a {role} needs a split above it")
    for i in at.get("report", []):
        kind = steps[answer].verb if answer is not None else ""
        for m in steps[i]["metrics"]:
            if m in SHARE_METRICS and kind != "target.distribution":
                yield say(i, f"{m} measures shares")
            if m in ("emd", "rps") and kind == "target.distribution" and not steps[answer]["ordered"]:
                yield say(i, f"{m} measures shares along an order, which the answer does not declare ('ordered')")
            if m in CLASS_METRICS and kind in ("target.ahead", "target.numbers", "target.distribution"):
                yield say(i, f"{m} measures classes")
    if "schema" in at:
        columns = steps[at["schema"][0]]["columns"]
        ids = [c["name"] for c in columns if c.get("id")]
        if len(ids) > 1:
            yield say(at["schema"][0], "one column at most is the id")
        for i, s in enumerate(steps):
            if s.params.get("byId") and not ids:
                yield say(i, "there is no id to go by")
            if roles[i] == "answer" and ids and ids[0] in s.reads:
                yield say(i, "the id is no answer")
        yield from _columns(steps, at["schema"][0], say)


def _columns(steps: list[Step], schema: int, say) -> Iterator[str]:
    """Columns are there where they are read. Families that only data names are known by their beginning."""
    declared = steps[schema]
    if declared["remainder"] == "keep":
        return
    there = {c["name"] for c in declared["columns"] if not c.get("excluded")}
    families: set[str] = set()
    for i, s in enumerate(steps[schema + 1 :], schema + 1):
        for c in s.reads:
            if c not in there and not any(c.startswith(f) for f in families):
                yield say(i, f"there is no column {c}")
        p = s.params
        if s.verb == "drop.columns":
            there -= set(p["columns"])
        elif s.verb in ("encode", "encode.piecewise") and (s.verb != "encode" or p["as"] == "onehot"):
            there.discard(p["column"])
            families.add(f"{p['column']}_")
        elif s.verb == "encode.categories":
            families |= {f"{c['name']}_" for c in declared["columns"] if c["kind"] == "category"}
        elif s.verb in ("feature.add",):
            there.add(p["column"])
        elif s.verb in ("feature.cycle", "feature.cyclical", "feature.timeParts", "fill.missing", "settle.gaps", "scale.given", "feature.indicator"):
            there.add(p["column"])
            families.add(f"{p['column']}_")
        elif s.verb == "maths" and p["into"]:
            there.add(p["into"])
        elif s.verb in ("history", "history.known"):
            there.add(p["into"] or f"{p['value']}_history")
        elif s.verb == "target.ahead":
            there.add(f"{p['column']}.ahead{p['ahead']}")
        elif s.verb == "target.distribution" and p["remainder"]:
            there.add(p["remainder"])

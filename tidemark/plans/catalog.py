"""The catalog of verbs: what a file may hold as a JSON schema and as a page, and verbs of one's own."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from tidemark.plans.verbs import REQUIRED, VERBS, Verb

#: What verbs of one's own do, by verb: see register.
HANDLERS: dict[str, Callable] = {}
ROLES = ("source", "add", "drop", "fit", "evidence")


def register(verb: Verb, handler: Callable) -> None:
    """A verb of one's own. Its handler is called with its settings and, by its role,
    - source: handler(spark, params) gives the rows;
    - add, drop: handler(df, params) gives the rows with more columns, or fewer rows;
    - fit: handler(params) gives a transform with stats(df), learn(values) and apply(df, learned), as in operators/fits.py, and `column`;
    - evidence: handler(df, params) gives a table, kept under the verb in what the run found."""
    if verb.name in VERBS:
        raise ValueError(f"there is a verb {verb.name} already")
    if verb.role not in ROLES:
        raise ValueError(f"{verb.role} steps are not registered; {', '.join(ROLES)} are")
    VERBS[verb.name], HANDLERS[verb.name] = verb, handler


def unregister(name: str) -> None:
    """Takes a verb of one's own away again."""
    if name not in HANDLERS:
        raise ValueError(f"{name} is no verb of one's own")
    del HANDLERS[name], VERBS[name]


def _kind(default: Any) -> dict:
    for kind, word in ((bool, "boolean"), (int, "number"), (float, "number"), (str, "string"), (list, "array"), (dict, "object")):
        if isinstance(default, kind):
            return {"type": word}
    return {}


def json_schema() -> dict:
    """A JSON schema of a pipeline file: what an editor can check while it is written."""
    steps = []
    for v in VERBS.values():
        keys = {}
        for k, default in v.keys.items():
            words = v.words.get(k)
            one = {"enum": list(words)} if words else _kind(default)
            keys[k] = {"anyOf": [one, {"type": "array", "items": one}]} if words else one
        needed = ["step", *(k for k, d in v.keys.items() if d is REQUIRED)]
        steps.append({"type": "object", "properties": {"step": {"const": v.name}, **keys}, "required": needed, "additionalProperties": False})
    declaration = {"type": "array", "items": {"oneOf": steps}}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "properties": {"version": {"type": "integer", "minimum": 1}, "declaration": declaration, "fitted": {"type": "array"}}, "required": ["declaration"]}


def verb_page() -> str:
    """Every verb with its keys, in Markdown."""
    lines = ["# The verbs", ""]
    for name in sorted(VERBS):
        v = VERBS[name]
        lines += [f"## `{name}`", "", f"A step of the role {v.role}, from version {v.since} of the file.", "", "| key | holds |", "|-|-|"]
        for k, default in v.keys.items():
            words = f"one of {', '.join(map(str, v.words[k]))}" if k in v.words else "a setting"
            lines.append(f"| `{k}` | {words}{'' if default is REQUIRED else '; may be left out'} |")
        lines.append("")
    return "\n".join(lines)

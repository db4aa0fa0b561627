"""Where the parts of a pipeline file stand, so that what is wrong with it is told by line and column."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from tidemark.plans.rules import DeclarationError

_SPACE = re.compile(r"[ \t\r\n]*")
_PLAIN = json.JSONDecoder()
_DEEPEST = 200


class FileFaults(DeclarationError):
    """All that is wrong with a file, in the order in which it stands there; places are lines and columns, counted from 1."""

    def __init__(self, text: str, found: list[tuple[int, str]]):
        found = sorted(found, key=lambda f: f[0])
        self.places = [(text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at)) for at, _ in found]
        self.messages = [what for _, what in found]
        super().__init__([f"line {line}, column {column}: {what}" for (line, column), what in zip(self.places, self.messages, strict=True)])


@dataclass
class Surveyed:
    """The value of a text, where each part stands (by the names and numbers that lead to it; a key's part is where the key stands), and
    every key that stands twice."""

    text: str
    value: object = None
    places: dict[tuple, int] = field(default_factory=dict)
    faults: list[tuple[int, str]] = field(default_factory=list)

    def place(self, *path) -> int:
        """Of the part, or of the nearest that holds it."""
        while path and path not in self.places:
            path = path[:-1]
        return self.places.get(path, 0)


def surveyed(text: str) -> Surveyed:
    """The text read as JSON. Text that is none is refused where it stops being it; keys that stand twice are refused, all at once."""
    found = Surveyed(text)
    try:
        found.value, end = _value(found, _space(text, 1 if text.startswith("\ufeff") else 0), ())
        if _space(text, end) != len(text):
            raise json.JSONDecodeError("something follows the value", text, _space(text, end))
    except json.JSONDecodeError as e:
        raise FileFaults(text, [(e.pos, e.msg)]) from e
    if found.faults:
        raise FileFaults(text, found.faults)
    return found


def _space(text: str, at: int) -> int:
    return _SPACE.match(text, at).end()


def _value(found: Surveyed, at: int, path: tuple) -> tuple[object, int]:
    text = found.text
    found.places.setdefault(path, at)
    opening = text[at : at + 1]
    if opening not in ("{", "["):
        value, end = _PLAIN.raw_decode(text, at)
        return value, end
    if len(path) > _DEEPEST:
        raise json.JSONDecodeError("nested too deeply", text, at)
    held: dict | list = {} if opening == "{" else []
    closing, at = "}" if opening == "{" else "]", _space(text, at + 1)
    if text[at : at + 1] == closing:
        return held, at + 1
    while True:
        if opening == "{":
            if text[at : at + 1] != '"':
                raise json.JSONDecodeError("a key is awaited, in double quotes", text, at)
            key, after = _PLAIN.raw_decode(text, at)
            inner = (*path, key)
            if key in held:
                found.faults.append((at, f"{key!r} stands twice"))
            found.places[inner] = at
            after = _space(text, after)
            if text[after : after + 1] != ":":
                raise json.JSONDecodeError("a colon is awaited", text, after)
            held[key], at = _value(found, _space(text, after + 1), inner)
        else:
            inner = (*path, len(held))
            one, at = _value(found, at, inner)
            held.append(one)
        at = _space(text, at)
        if text[at : at + 1] == closing:
            return held, at + 1
        if text[at : at + 1] != ",":
            raise json.JSONDecodeError(f"a comma or {closing} is awaited", text, at)
        at = _space(text, at + 1)

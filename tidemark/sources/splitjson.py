"""One JSON array of flat objects a file, read by many tasks (sources/records.py): a brace outside of a string ends a record."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.fits import Refused
from tidemark.sources.records import Records, Taken

_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"(\s*:\s*\{)?', re.DOTALL)
_END = re.compile(r"\s*(\[?)\s*\]\s*")


def _quotes(stretches: pa.Array) -> np.ndarray:
    """Quotes that no backslash stands before."""
    return pc.count_substring(pc.replace_substring_regex(stretches, r"(?s)\\.", ""), '"').to_numpy(zero_copy_only=False)


def _unknown(word: str) -> None:
    raise ValueError(word)


def cells_of(text: str, first: bool) -> tuple[list[tuple[str, str | None]] | None, str | None]:
    """Names and cells of a record, as its text up to the brace that ends it; or what is wrong with it. Words are the words they are,
    numbers, true and false their own text, null a gap."""
    text = text.strip()
    if text[:1] != ("[" if first else ","):
        return None, "stands where an array of objects is awaited"
    text = text[1:].strip()
    try:
        pairs = json.loads(text + "}", object_pairs_hook=list, parse_int=str, parse_float=str, parse_constant=_unknown)
        if "\\u" in text:
            "".join(p for pair in pairs for p in pair if isinstance(p, str)).encode()
    except (ValueError, RecursionError):
        inner = next((m for m in _STRING.finditer(text[1:]) if m[2]), None)
        return None, f"holds an object under '{inner[1]}'" if inner and text[:1] == "{" else "is no object of plain cells"
    names: set[str] = set()
    for name, value in pairs:
        if name in names:
            return None, f"names '{name}' twice"
        if isinstance(value, list):
            return None, f"holds an array under '{name}'"
        names.add(name)
    return [(name, str(value).lower() if isinstance(value, bool) else value) for name, value in pairs], None


def read_split_json(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text, columns in the order in which their names are first seen (file by file); a missing name is a gap. A name that
    stands twice in a record, a nested value, and a file that is no array of objects are refused, naming the first such record of the
    first such file (records count from 1); so are files without any names."""
    records = Records(spark, path, "}", _quotes)
    last = {file: many - 1 for file, many in records.counts.items()}

    def known(file: str, n: int, text: str) -> tuple[list[tuple[str, str | None]] | None, str | None] | None:
        text = text.lstrip("\ufeff") if n == 0 else text
        if n < last[file]:
            return cells_of(text, n == 0)
        end = _END.fullmatch(text)  # what follows the last object
        return None if end and bool(end[1]) == (n == 0) else (None, "stands where the array ends")

    def named(file: str, n: int, text: str) -> Taken:
        held = known(file, n, text)
        return held and ([name for name, _ in held[0]] if held[0] is not None else None, held[1])

    # Records of one shape are one row before anything is sent; then there is a row for each name and each kind of fault.
    shapes = records.rows(named).groupBy("cells", "fault").agg(F.min(F.struct("file", "n")).alias("at"))
    places = shapes.select("fault", "at", F.posexplode_outer("cells").alias("place", "name"))
    seen = places.groupBy("name", "fault").agg(F.min(F.struct("at.file", "at.n", "place")).alias("at")).orderBy("at").collect()
    for one in seen:
        if one["fault"]:
            raise Refused(f"read.json: record {one['at']['n'] + 1} of {one['at']['file']} {one['fault']}", one["at"]["n"] + 1)
    names = [one["name"] for one in seen if one["name"] is not None]
    if not names:
        raise Refused(f"read.json: {path} holds no records, so its columns have no names")

    def cells(file: str, n: int, text: str) -> Taken:
        held = known(file, n, text)
        if held is None:
            return None
        if held[0] is None:
            raise ValueError(f"read.json: record {n + 1} of {file} {held[1]}")
        own = dict(held[0])
        return [own.get(name) for name in names], None

    return records.rows(cells).select(*(F.get("cells", i).alias(name) for i, name in enumerate(names)))

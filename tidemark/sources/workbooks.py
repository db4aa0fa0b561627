"""Workbooks (.xlsx) as a Python data source: a sheet is read by many tasks, each of which takes the rows that begin in its stretch of the sheet's XML.

The driver opens no more of a workbook than its list of sheets, its styles and the first row. A task inflates the sheet up to its stretch (which
cannot be entered in the middle), parses that alone, and then runs once through the shared words, keeping those that its rows name.
"""

from __future__ import annotations

import datetime
import re
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import quote
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.operators.fits import Refused

SCHEMA = "file string, row long, cells array<string>"
#: Bytes of a sheet's XML that a task parses.
STRETCH = 16 << 20
_CHUNK = 1 << 20
_ROW = re.compile(rb"<(?:[\w.-]+:)?row(?=[\s>/])")
_END = re.compile(rb"</(?:[\w.-]+:)?sheetData\s*>|<(?:[\w.-]+:)?sheetData\s*/>")
_AT = re.compile(rb"\sr\s*=\s*[\"'](\d+)[\"']")
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Formats that the file format itself numbers as dates or times of day.
_DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _own(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _located(file: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path of a file as Spark names it (without escapes)."""
    if file.startswith("file:") or "://" not in file:
        return fs.LocalFileSystem(), "/" + file.removeprefix("file:").lstrip("/")
    scheme, rest = file.split("://", 1)
    return fs.FileSystem.from_uri(f"{scheme}://{quote(rest)}")


@contextmanager
def _opened(file: str) -> Iterator[zipfile.ZipFile]:
    place, path = _located(file)
    with place.open_input_file(path) as held:
        try:
            with zipfile.ZipFile(held) as z:
                yield z
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, EOFError) as e:
            raise Refused(f"{file} cannot be read as an Excel workbook: {e}") from e


@dataclass(frozen=True)
class Sheet:
    """A sheet of a workbook: its XML, the XML of the shared words, the tag that opens the sheet, which styles are dates, the epoch."""

    file: str
    name: str
    member: str
    words: str | None
    opening: bytes
    dates: frozenset[int]
    late: bool  # days count from 1904
    size: int


@dataclass(frozen=True)
class Stretch(InputPartition):
    sheet: Sheet
    start: int
    end: int


def is_date(code: str) -> bool:
    """Whether a number format shows a moment: it holds a letter of dates or times outside of quotes, escapes and brackets."""
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*\]', "", code.split(";")[0])
    return bool(re.search("[ymdhs]", bare, re.IGNORECASE)) and bare.strip().lower() != "general"


def _date_styles(z: zipfile.ZipFile, part: str | None) -> frozenset[int]:
    if part is None:
        return frozenset()
    codes, styles, within = {}, [], False
    for event, e in ElementTree.iterparse(z.open(part), ("start", "end")):
        tag = _own(e.tag)
        if tag == "cellXfs":
            within = event == "start"
        elif event == "start" and tag == "numFmt":
            codes[int(e.get("numFmtId"))] = e.get("formatCode", "")
        elif event == "start" and tag == "xf" and within:
            styles.append(int(e.get("numFmtId", 0)))
    return frozenset(i for i, n in enumerate(styles) if (is_date(codes[n]) if n in codes else n in _DATES))


def _sheet(file: str, name: str | None) -> Sheet:
    with _opened(file) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        parts = {r.get("Id"): (r.get("Target"), r.get("Type", "").rsplit("/", 1)[-1]) for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        whole = lambda target: target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        sheets = {s.get("name"): whole(parts[s.get(_REL)][0]) for s in book.iter() if _own(s.tag) == "sheet"}
        if name is not None and name not in sheets:
            raise Refused(f"{file} has no sheet called '{name}'. Its sheets are: {', '.join(sheets)}.")
        chosen = name if name is not None else next(iter(sheets))
        kinds = {kind: whole(target) for target, kind in parts.values()}
        late = any(_own(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book.iter())
        member = sheets[chosen]
        with z.open(member) as held:
            opening = re.match(rb"(?s).*?(<(?:[\w.-]+:)?worksheet\b[^>]*>)", held.read(_CHUNK))
        if opening is None:
            raise KeyError(f"the sheet '{chosen}' does not begin as one")
        there = lambda kind: kinds.get(kind) if kinds.get(kind) in z.namelist() else None
        return Sheet(file, chosen, member, there("sharedStrings"), opening[1], _date_styles(z, there("styles")), late, z.getinfo(member).file_size)


def moment(serial: float, late: bool) -> str:
    """The moment of a day number. Days before March 1900 are one later than the rest, as the format counts a 29th of February there."""
    base = datetime.datetime(1904, 1, 1) if late else datetime.datetime(1899, 12, 31 if serial < 60 else 30)
    told = base + datetime.timedelta(milliseconds=round(serial * 86_400_000))
    return told.strftime("%Y-%m-%dT%H:%M:%S.") + f"{told.microsecond:06d}0"


def number(text: str) -> str:
    """The number a cell holds, in its shortest form."""
    x = float(text)
    return str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x).upper()


def _stretch(held, start: int, end: int) -> tuple[bytes, int | None]:
    """The XML of the rows that begin from start to before end, and the number of the row that follows them (None: there is none)."""
    for skipped in range(0, start, _CHUNK):
        held.read(min(_CHUNK, start - skipped))
    data, seen = bytearray(), 0
    while True:
        chunk = held.read(_CHUNK)
        data += chunk
        begin = max(end - start, seen - 64)
        after = _ROW.search(data, begin) if len(data) > begin else None
        if after is not None and data.find(b">", after.end()) < 0 and chunk:
            continue
        over = _END.search(data, max(0, seen - 64))
        stop = min((m.start() for m in (after, over) if m is not None), default=len(data))
        if after is not None or over is not None or not chunk:
            first = _ROW.search(data, 0, stop + 8)
            if first is None or first.start() >= min(stop, end - start):
                return b"", None
            following = None
            if after is not None and after.start() == stop:
                at = _AT.search(data, after.end(), data.find(b">", after.end()))
                following = int(at[1]) if at else None
            return bytes(data[first.start() : stop]), following
        seen = len(data)


def _place(reference: str | None, last: int) -> int:
    if reference is None:
        return last + 1
    at = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        at = at * 26 + ord(letter) - 64
    return at - 1


def _text(e: ElementTree.Element) -> str:
    """The words of a cell, without how they are to be pronounced."""
    told, said = [], {t for p in e.iter() if _own(p.tag) == "rPh" for t in p.iter()}
    for t in e.iter():
        if _own(t.tag) == "t" and t not in said:
            told.append(t.text or "")
    return "".join(told)


def _rows(sheet: Sheet, data: bytes) -> Iterator[tuple[int | None, dict[int, str | int]]]:
    """The number and the cells of each row; a shared word is its place among the words."""
    reader = ElementTree.XMLPullParser(("end",))
    reader.feed(sheet.opening)
    for at in range(0, len(data), _CHUNK):
        reader.feed(data[at : at + _CHUNK])
        for _, row in reader.read_events():
            if _own(row.tag) != "row":
                continue
            cells, last = {}, -1
            for c in row:
                last = _place(c.get("r"), last)
                kind, v = c.get("t", "n"), next((x.text for x in c if _own(x.tag) == "v"), None)
                if kind == "inlineStr":
                    cells[last] = _text(c)
                elif v is None:
                    continue
                elif kind == "s":
                    cells[last] = int(v)
                elif kind == "b":
                    cells[last] = "True" if v == "1" else "False"
                elif kind == "n":
                    cells[last] = moment(float(v), sheet.late) if int(c.get("s", 0)) in sheet.dates else number(v)
                else:  # words, faults of formulas, moments written out
                    cells[last] = v
            yield (int(row.get("r")) if row.get("r") else None), cells
            row.clear()


def _words(z: zipfile.ZipFile, part: str | None, wanted: set[int]) -> dict[int, str]:
    found: dict[int, str] = {}
    if part is None or not wanted:
        return found
    n, top = 0, None
    for event, e in ElementTree.iterparse(z.open(part), ("start", "end")):
        top = e if top is None else top
        if event == "end" and _own(e.tag) == "si":
            if n in wanted:
                found[n] = _text(e)
            n += 1
            top.clear()
    return found


def stretch_rows(part: Stretch) -> Iterator[tuple[int, list[str | None]]]:
    """Numbers (as the sheet has them, from 1) and cells of a stretch's rows. Rows that the sheet skips follow the row before them, as rows
    without cells."""
    sheet = part.sheet
    with _opened(sheet.file) as z:
        with z.open(sheet.member) as held:
            data, following = _stretch(held, part.start, part.end)
        rows = list(_rows(sheet, data))
        words = _words(z, sheet.words, {v for _, cells in rows for v in cells.values() if isinstance(v, int)})
    for i, (n, cells) in enumerate(rows):
        if n is None:
            raise Refused(f"row {i + 1} of a stretch of '{sheet.name}' of {sheet.file} has no number")
        yield n, [None if (v := cells.get(k)) is None else words[v] if isinstance(v, int) else v for k in range(max(cells, default=-1) + 1)]
        after = rows[i + 1][0] if i + 1 < len(rows) else following
        for skipped in range(n + 1, after or n):
            yield skipped, []


def head(sheet: Sheet) -> tuple[int, list[str | None]]:
    """Number and cells of the first row that the sheet holds, from a stretch that ends right behind where its data begin."""
    with _opened(sheet.file) as z, z.open(sheet.member) as held:
        data, at = b"", None
        while at is None and (chunk := held.read(_CHUNK)):
            data += chunk
            at = _ROW.search(data)
    first = at and next(stretch_rows(Stretch(sheet, 0, at.start() + 1)), None)
    if first:
        return first
    raise Refused(f"The sheet '{sheet.name}' of {sheet.file} has no header row, so its columns have no names.")


class WorkbookReader(DataSourceReader):
    def __init__(self, sheets: list[Sheet], stretch: int):
        self.sheets, self.stretch = sheets, stretch

    def partitions(self) -> list[Stretch]:
        return [Stretch(s, at, min(at + self.stretch, s.size)) for s in self.sheets for at in range(0, s.size, self.stretch)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        for n, cells in stretch_rows(partition):
            kept.append((partition.sheet.file, n, cells))
            if len(kept) == 8192:
                yield _batch(kept)
                kept = []
        if kept:
            yield _batch(kept)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "row", "cells"])


class WorkbookSource(DataSource):
    """spark.read.format("workbook"): options files (separated by line breaks), sheet (the first unless named), stretchBytes."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkbookReader:
        o = {k.lower(): v for k, v in dict(self.options).items()}
        return WorkbookReader([_sheet(f, o.get("sheet")) for f in o["files"].split("\n")], int(o.get("stretchbytes", STRETCH)))


def _names(heads: Iterable[list[str | None]]) -> list[str]:
    told = {tuple(h) for h in heads}
    if len(told) != 1:
        raise Refused("read.excel: the workbooks have different columns")
    names = [n or f"column{i + 1}" for i, n in enumerate(told.pop())]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise Refused(f"read.excel: columns of one name: {', '.join(twice)}")
    return names


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None, stretch: int = STRETCH) -> DataFrame:
    """The rows of a sheet below the first row that it holds, which names the columns, of a workbook or of a folder of workbooks with the same
    columns. Cells are text: a number in its shortest form, True and False, a moment (a number whose format shows a date or a time) as
    yyyy-MM-ddTHH:mm:ss.fffffff, words as they are, a formula's fault as it is spelled there; an empty cell is a gap, and a row that the
    sheet skips is one of gaps. A row with a cell beyond the last name is refused when it is read, by its number in the sheet."""
    files = sorted(r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect())  # a row a workbook, without content
    if not files:
        raise Refused(f"read.excel: there is no workbook at {path}")
    sheets = [_sheet(f, sheet) for f in files]
    heads = [head(s) for s in sheets]
    names = _names(cells for _, cells in heads)
    spark.dataSource.register(WorkbookSource)
    asked = {"files": "\n".join(files), "stretchBytes": str(stretch), **({"sheet": sheet} if sheet is not None else {})}
    rows = spark.read.format("workbook").options(**asked).load()
    firsts = {f: n for f, (n, _) in zip(files, heads, strict=True)}
    first = F.create_map(*(F.lit(x) for pair in firsts.items() for x in pair))[F.col("file")] if len(set(firsts.values())) > 1 else F.lit(next(iter(firsts.values())))
    beyond = F.exists(F.slice("cells", len(names) + 1, F.greatest(F.size("cells"), F.lit(1))), lambda v: v.isNotNull() & (v != ""))
    said = F.concat(F.lit("read.excel: row "), F.col("row").cast("string"), F.lit(" of "), F.col("file"), F.lit(f" has more than {len(names)} cells"))
    kept = rows.where(F.col("row") > first).where(F.when(beyond, F.raise_error(said).cast("boolean")).otherwise(True))
    return kept.select(*(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)))


"""Pipelines: declared by verbs, run over a table, kept as one JSON document, and replayed over later rows.

Fitting reads the rows of part train alone. Steps that learn by statistics share an aggregation as long as none reads what an earlier
one of them writes; everything else is projection, so what a pipeline costs is a scan for each such barrier.

What steps refuse is part of the plan: a hidden column says what is wrong with a row and in which cell. The aggregation at a barrier
observes it on its way, and one at the end of a run sees to the rest, together with the way back of the answers; a stream raises it at the
row. Only when something is refused are rows counted, to tell the place at which it was read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import features, indicators, keys
from tidemark.functions.kinds import TYPES, as_kind, cell_text, is_gap, kind_of, read_cell, unreadable
from tidemark.operators import evidence, fits, learners, measures, outputs, reasons, splits
from tidemark.operators.fits import Refused
from tidemark.plans.catalog import HANDLERS
from tidemark.plans.needs import Landing, answers_of, left_out, missed
from tidemark.plans.places import FileFaults, Surveyed, surveyed
from tidemark.plans.rules import DeclarationError, faults
from tidemark.plans.verbs import FORMS, VERBS, Step, step, wrong_keys
from tidemark.session import kept_table
from tidemark.sources import readers

VERSION = 16
#: Verbs that write features in a form, and the key that names it.
FORMED = {"feature.cycle": "form", "feature.cyclical": "form", "scale.given": "lands"}
HIDDEN = ("_read_at", "_key", "_part", "_asked", "_draw")
#: What is wrong with a row, while a walk lasts.
WRONG = "_refused"
#: How far a value may be from the one it was made of, as a share of it, when its steps are undone.
WAY_BACK = 1e-6
#: Beginning of the names of columns that keep what a way back needs of a row.
KEPT = "_kept_"
#: And of those that hold what an answer was made of, until a run has verified its way back.
AS_READ = f"{KEPT}as_read_"
_LABEL = "tidemark.declaration"


@dataclass(frozen=True)
class Declaration:
    steps: tuple[Step, ...]

    def __post_init__(self) -> None:
        found = list(faults(list(self.steps)))
        if found:
            raise DeclarationError(found)

    def to_list(self) -> list[dict]:
        return [{"step": s.verb, **{k: v for k, v in s.params.items() if v != VERBS[s.verb].keys[k]}} for s in self.steps]

    def prefixes(self) -> list[str]:
        """A digest of the steps up to each, chained, which a fit of other steps does not match."""
        out, last = [], hashlib.sha256(_LABEL.encode()).digest()
        for one in self.to_list():
            last = hashlib.sha256(last + json.dumps(one, sort_keys=True, ensure_ascii=False).encode()).digest()
            out.append(last.hex())
        return out

    def to_json(self) -> str:
        return json.dumps({"version": VERSION, "declaration": self.to_list()}, ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> Declaration:
        """The declaration of a file. All that is wrong with it is told at once, each thing by its line and column."""
        found = surveyed(text)
        return _read(found.value, found)

    def run(self, spark: SparkSession, rows: DataFrame | None = None) -> Prepared:
        """Every step taken, over the rows of its source or those handed in."""
        return _Walk(self, spark).run(rows)

    def run_for(self, spark: SparkSession, needs: str, rows: DataFrame | None = None) -> Prepared:
        """A run for a learner that needs 'numbers', 'oneScale', 'noScale' or 'categories': without the steps it does without."""
        return _Walk(self, spark, skipped=left_out(self.steps, needs)).run(rows)


_TOP = ("version", "declaration", "fitted", "skipped")


def _read(document: dict, found: Surveyed | None = None) -> Declaration:
    """The steps of a file: `declaration`, a list of objects that name their verb in `step`. A file without a version is of the first."""
    wrong: list[tuple[tuple, str]] = []
    if not isinstance(document, dict):
        wrong.append(((), f"a pipeline file is an object that holds {', '.join(_TOP)}"))
        document = {"declaration": []}
    wrong += [((k,), f"a pipeline file has no {k!r}; it holds {', '.join(_TOP)}") for k in document if k not in _TOP and found is not None]
    version, listed = document.get("version", 1), document.get("declaration")
    if not isinstance(version, int) or isinstance(version, bool):
        wrong.append((("version",), "a version is a whole number"))
        version = VERSION
    elif version > VERSION:
        wrong.append((("version",), f"version {version} is later than {VERSION}"))
    if not isinstance(listed, list):
        wrong.append((("declaration",), "a declaration is a list of steps"))
        listed = []
    steps = []
    for i, one in enumerate(listed):
        at = ("declaration", i)
        if not isinstance(one, dict) or not ("step" in one or "verb" in one):
            wrong.append((at, f"step {i + 1}: a step names its verb in `step`"))
            continue
        named = "step" if "step" in one else "verb"
        verb, given = one[named], {k: v for k, v in one.items() if k not in ("step", "verb")}
        odd, known = wrong_keys(verb, given), isinstance(verb, str) and verb in VERBS
        wrong += [((*at, k) if k else at if known else (*at, named), f"step {i + 1}: {f'{verb}: ' if known else ''}{what}") for k, what in odd]
        if not odd:
            steps.append(step(verb, **given))
            if steps[-1].spec.since > version and "version" in document:
                wrong.append(((*at, named), f"step {i + 1}: {verb} is there from version {steps[-1].spec.since} of the file"))
    if not wrong:
        try:
            return Declaration(tuple(steps))
        except DeclarationError as e:
            places = [re.match(r"step (\d+) ", what) for what in e.faults]
            wrong = [(("declaration", int(m[1]) - 1) if m else ("declaration",), what) for m, what in zip(places, e.faults, strict=True)]
    if found is None:
        raise DeclarationError([what for _, what in wrong])
    raise FileFaults(found.text, [(found.place(*path), what) for path, what in wrong])


class FittingBuilder:
    """Verbs below the split. Methods are verbs with dots as underscores: .fill_missing(column=..., with_=...)."""

    roles = {"fit", "answer", "evidence", "report", "learner", "drop"}

    def __init__(self, steps: tuple[Step, ...] = (), form: str | None = None):
        self.steps, self.form = steps, form

    def add(self, verb: str, **params: Any) -> FittingBuilder:
        given = {k.rstrip("_"): v for k, v in params.items()}
        if self.form and verb in FORMED:
            given.setdefault(FORMED[verb], self.form)
        one = step(verb, **given)
        if one.spec.role not in self.roles:
            raise ValueError(f"{verb} does not stand here")
        return (FittingBuilder if one.spec.role == "split" else type(self))((*self.steps, one), self.form)

    def lines(self, verb: str, key: str, groups: dict[Any, list[str]], **params: Any) -> FittingBuilder:
        """One step a column, a setting named per group of columns: lines("normalise", "scale", {"minmax": ["a"], "robust": ["b", "c"]})."""
        if not any(groups.values()):
            raise ValueError("the line names no column")
        out = self
        for word, columns in groups.items():
            for c in columns:
                out = out.add(verb, column=c, **{key: word}, **params)
        return out

    def __getattr__(self, name: str):
        verb = next((v for v in VERBS if v.replace(".", "_").lower() == name.replace("_", "").lower() or v.replace(".", "_").lower() == name.lower()), None)
        verb = verb or next((v for v in VERBS if v.replace(".", "").lower() == name.replace("_", "").lower()), None)
        if verb is None:
            raise AttributeError(name)
        return lambda **params: self.add(verb, **params)

    def build(self) -> Declaration:
        return Declaration(self.steps)


class PipelineBuilder(FittingBuilder):
    """Verbs above the split; the split gives a FittingBuilder, so nothing can learn before it."""

    roles = {"source", "schema", "add", "order", "drop", "split", "evidence", "answer"}

    def default_features(self, form: str) -> PipelineBuilder:
        """Where features written below land, unless a step says otherwise: signed, unit or splitsign."""
        if form not in FORMS:
            raise ValueError(f"a form is one of {', '.join(FORMS)}")
        return PipelineBuilder(self.steps, form)


def create() -> PipelineBuilder:
    return PipelineBuilder()


def _kept(answer: str) -> str:
    return f"{KEPT}{answer.replace('.', '_')}"


def number_rows(df: DataFrame) -> DataFrame:
    """df with _read_at, which rises in the order in which rows are read."""
    return df.withColumn("_read_at", F.monotonically_increasing_id())


def read_place(source: DataFrame | None, read_at: int) -> int:
    """The place, from 1, of a row as it was read: _read_at tells its partition and its place there, and partitions are counted."""
    part = read_at >> 33
    earlier = source.where(F.shiftright("_read_at", 33) < part).count() if source is not None and part else 0
    return earlier + (read_at & ((1 << 33) - 1)) + 1


def undone(steps: tuple[Step, ...], answer: str, skipped: dict[int, str]) -> list[tuple[int, str]]:
    """The steps that made an answer what it is, last first, each with the column that is left when it is undone."""
    name, out = answer, []
    for i in range(len(steps) - 1, -1, -1):
        s = steps[i]
        p = s.params
        if i in skipped:
            continue
        if s.verb == "normalise" and p["column"] == name or s.verb == "scale.given" and p["column"] == name and p["lands"] != "splitsign":
            out.append((i, name))
        elif s.verb == "maths" and (p["into"] or p["column"]) == name or s.verb == "target.ahead" and s.makes == name:
            name = p["column"]
            out.append((i, name))
        elif s.verb == "target.distribution" and p["scaleBy"] and name in p["columns"]:
            out.append((i, name))
    return out


def _fitted(s: Step, df: DataFrame, places: bool = False) -> list[fits.FillMissing]:
    """What a fitted verb learns with; places: an encoder hands categories over as their places."""
    p = s.params
    if s.verb == "fill.missing" and p["with"] != "previous":
        return [fits.FillMissing(p["column"], p["with"], p["value"], p["refuseAbove"])]
    if s.verb == "fill.nan":
        return [fits.FillNaN(p["column"], p["with"], p["value"])]
    if s.verb == "normalise":
        return [fits.Normalise(p["column"], p["scale"], p["outOfRange"])]
    if s.verb == "outliers.clip":
        return [fits.ClipOutliers(p["column"], p["bounds"], p["at"], p["outlier"])]
    if s.verb == "encode":
        return [fits.Encode(p["column"], "places" if places else p["as"], p["unseen"])]
    if s.verb == "encode.categories":
        return [fits.Encode(f.name, "places" if places else p["as"], p["unseen"]) for f in df.schema if f.metadata.get("kind") == "category"]
    if s.verb in HANDLERS:
        return [HANDLERS[s.verb](p)]
    if s.verb == "encode.piecewise":
        return [fits.Piecewise(p["column"], p["bins"], p["outOfRange"])]
    return []


class _Walk:
    """One run over the steps, fitting or replaying."""

    def __init__(self, declaration: Declaration, spark: SparkSession, learned: dict[int, Any] | None = None, tables: dict[int, DataFrame] | None = None, skipped: dict[int, str] | None = None):
        self.declaration, self.spark = declaration, spark
        self.skipped = skipped or {}
        self.divided: DataFrame | None = None  # the rows where the split stands
        self.unmatched: DataFrame | None = None  # left rows that a join left out
        self.replaying = learned is not None
        self.learned: dict[int, Any] = learned or {}
        self.tables: dict[int, DataFrame] = tables or {}
        self.evidence: dict[str, DataFrame] = {}
        self.order: list[str] = []
        self.answers: list[str] = []
        self.id: str | None = None
        self.df: DataFrame = None
        self.source: DataFrame | None = None  # the rows as read, with their places
        self.way_back: dict[str, float] = {}
        self.pending: list[tuple[int, list]] = []
        #: What is refused is raised at the row when it is read, and not by a job while the steps are walked.
        self.at_row = False

    def refuse(self, tests: list[fits.Test]) -> None:
        """Rows that meet a test are refused, the first test first; see settle."""
        if tests:
            before = [F.col(WRONG)] if WRONG in self.df.columns else []
            self.df = self.df.withColumn(WRONG, F.coalesce(*before, fits.said(tests)))

    def _wrong(self) -> Column:
        """The first wrong row: its place, padded so that places sort, and what is wrong."""
        place = F.lpad(F.col("_read_at").cast("string"), 20, "0") if "_read_at" in self.df.columns else F.lit("")
        return F.min(F.when(F.col(WRONG).isNotNull(), F.concat(place, F.lit("\n"), F.col(WRONG))))

    def _raise(self, found: str | None) -> None:
        if found:
            place, why, cell = found.split("\n", 2)
            row = read_place(self.source, int(place)) if place and self.source is not None else None
            raise Refused(f"{why}: {f'row {row} holds ' if row else ''}{cell}", row)

    def settle(self) -> None:
        """Refuses now what is wrong so far: before rows go, and at the end. A stream carries it to its rows."""
        if WRONG not in self.df.columns:
            return
        if self.df.isStreaming or self.at_row:
            wrong = F.raise_error(F.regexp_replace(WRONG, "\n", ": ")).cast("boolean")
            self.df = self.df.where(F.when(F.col(WRONG).isNotNull(), wrong).otherwise(True)).drop(WRONG)
            return
        self._raise(self.df.agg(self._wrong()).first()[0])
        self.df = self.df.drop(WRONG)

    def train(self) -> DataFrame:
        return self.df.where("_part = 'train'")

    def run(self, rows: DataFrame | None, until: int | None = None) -> Prepared:
        for i, s in enumerate(self.declaration.steps[:until]):
            role = s.spec.role
            if self.skipped.get(i) == "out":
                continue
            if role == "fit" and i not in self.learned and _fitted(s, self.df):
                written = {c for _, ones in self.pending for one in ones for c in (one.column,)}
                if any(c in written or any(c.startswith(f"{w}_") for w in written) for c in s.reads) or s.verb == "encode.categories":
                    self.flush()
                self.pending.append((i, _fitted(s, self.df, i in self.skipped)))
                continue
            self.flush()
            if role in ("drop", "split", "order"):
                self.settle()
            if role == "source":
                self._open(s, rows)
            elif role == "schema":
                self._declare(s)
            elif role == "fit":
                self._fit(i, s)
            elif role == "split":
                self._split(s)
            elif role == "evidence":
                self._evidence(s)
            elif role in ("report", "learner"):
                pass
            else:
                self._act(s)
        self.flush()
        if not self.replaying and until is None and not self.df.isStreaming:
            self._verify()
        self.settle()
        kept = [c for c in self.df.columns if c.startswith(AS_READ)]
        self.df = self.df.drop(*kept)
        return Prepared(self.declaration, self.df, self.learned, self.tables, self.evidence, self.answers, self.id, self.order, self.skipped, rows, self.divided, self.unmatched, source=self.source, way_back=self.way_back)

    def _verify(self) -> None:
        """The answers are put back and compared with the column they come back to as it was read, in the aggregation that also looks for
        refused rows. An answer without steps to undo, or one that comes back to a column that a step made, has nothing to be compared."""
        told, asked = [], []
        prepared = Prepared(self.declaration, self.df, self.learned, answers=self.answers, skipped=self.skipped)
        for answer in self.answers:
            chain = undone(self.declaration.steps, answer, self.skipped)
            end = chain[-1][1] if chain else None
            if not chain or f"{AS_READ}{end}" not in self.df.columns:
                continue
            for i, _ in chain:
                s = self.declaration.steps[i]
                if s.verb == "maths" and s["maths"] in ("abs", "sign"):
                    raise Refused(f"step {i + 1}: {s['maths']} of the answer {answer} has no way back, as it throws the {'sign' if s['maths'] == 'abs' else 'size'} away")
            was, now = F.col(f"`{AS_READ}{end}`"), F.col(f"`{answer}`").cast("double")
            back = prepared.back(now, answer)
            error = F.when(was.isNotNull() & now.isNotNull(), F.coalesce(F.abs(back - was) / F.greatest(F.abs(was), F.lit(1.0)), F.lit(float("inf"))))
            asked.append((answer, error, F.struct(F.col("_read_at"), was.alias("was"), now.alias("now"), back.alias("back"))))
        if not asked:
            return
        wrong = WRONG in self.df.columns
        told = [F.max(e).alias(f"e{k}") for k, (_, e, _) in enumerate(asked)] + [F.max_by(r, F.when(e.isNotNull(), F.struct(e.alias("e"), -F.col("_read_at")))).alias(f"r{k}") for k, (_, e, r) in enumerate(asked)]  # the first of equally wrong rows
        row = self.df.agg(*told, *([self._wrong().alias("wrong")] if wrong else [])).first()
        if wrong:
            self._raise(row["wrong"])
            self.df = self.df.drop(WRONG)
        for k, (answer, _, _) in enumerate(asked):
            worst, r = row[f"e{k}"], row[f"r{k}"]
            self.way_back[answer] = worst if worst is not None else 0.0
            if worst is not None and not worst <= WAY_BACK:
                steps = ", ".join(f"step {i + 1} ({self.declaration.steps[i].verb})" for i, _ in undone(self.declaration.steps, answer, self.skipped))
                raise Refused(f"the way back of {answer} does not lead back through {steps}: row {read_place(self.source, r[0])} was {r['was']}, became {r['now']}, and comes back as {r['back']}")

    def flush(self) -> None:
        """One aggregation over the training rows for all that wait, then one projection. What was refused so far is observed on the way."""
        pending, self.pending = self.pending, []
        if not pending:
            return
        every = [one for _, ones in pending for one in ones]
        seen, before = None, self.df
        if WRONG in before.columns:
            seen = Observation()
            before = before.observe(seen, self._wrong().alias("wrong"))
        told, at = fits.learned_by(self.train(), every, lambda train: before.where("_part = 'train'") if seen is not None else train), 0
        if seen is not None:
            self._raise(seen.get.get("wrong"))
            self.df = self.df.drop(WRONG)
        for i, ones in pending:
            self.learned[i] = told[at : at + len(ones)]
            at += len(ones)
        self._apply([(one, learned) for i, ones in pending for one, learned in zip(ones, self.learned[i], strict=True)])

    def _apply(self, learned: list[tuple[Any, Any]]) -> None:
        """The columns of steps that do not read each other's, in one projection."""
        columns, gone, tests = {}, [], []
        for one, values in learned:
            if isinstance(one, fits.Fitted):
                made, dropped, wrong = one.made(self.df, values)
                columns, gone, tests = columns | made, gone + dropped, tests + wrong
            else:  # a transform of one's own
                self.df = one.apply(self.df, values)
        self.refuse(tests)
        self.df = self.df.withColumns(columns).drop(*gone)

    def _open(self, s: Step, rows: DataFrame | None) -> None:
        p = s.params
        if s.verb == "read.rows" or self.replaying or rows is not None:
            if rows is None:
                raise Refused("rows are handed in when the pipeline is run")
            df = rows
        else:
            part = lambda side: {"csv": readers.read_csv, "parquet": readers.read_parquet, "json": readers.read_json}[side["kind"]](self.spark, side["path"])
            df = HANDLERS[s.verb](self.spark, p) if s.verb in HANDLERS else {
                "read.csv": lambda: readers.read_csv(self.spark, p["path"]),
                "read.parquet": lambda: readers.read_parquet(self.spark, p["path"]),
                "read.json": lambda: readers.read_json(self.spark, p["path"]),
                "read.excel": lambda: readers.read_excel(self.spark, p["path"], p["sheet"]),
                "read.texts": lambda: readers.read_texts(self.spark, p["path"]),
                "read.images": lambda: readers.read_images(self.spark, p["path"], p["width"], p["height"], p["channels"]),
                "read.sounds": lambda: readers.read_sounds(self.spark, p["path"], p["rate"], p["length"], p["channels"]),
                "read.join": lambda: readers.read_join(part(p["left"]), part(p["right"]), p["on"], p["unmatched"]),
            }[s.verb]()
            if s.verb == "read.join" and p["unmatched"] == "drop":
                self.unmatched = readers.alone(part(p["left"]), part(p["right"]), p["on"])
        plain = [f.name for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct", "binary") and f.name not in HIDDEN]
        # Both columns are expressions: a plan that does not use them does not compute them.
        self.df = df.withColumn("_key", keys.row_key(df, plain) if plain else F.lit(None).cast("string"))
        self.df = self.source = self.df if df.isStreaming or "_asked" in df.columns else number_rows(self.df)

    def _declare(self, s: Step) -> None:
        named = {c["name"]: c for c in s["columns"]}
        own = [c for c in self.df.columns if c not in HIDDEN]
        lacking = [n for n, c in named.items() if n not in own and not c.get("optional") and not self.replaying]
        if lacking:
            raise Refused(f"the source has no {', '.join(lacking)}; it has {', '.join(own)}")
        if s["remainder"] == "refuse" and set(own) - set(named):
            raise Refused(f"not declared: {', '.join(sorted(set(own) - set(named)))}")
        out, bad = [], []
        for name, c in named.items():
            if c.get("id"):
                self.id = name
            if c.get("excluded"):
                continue
            if name not in own:
                out.append(F.lit(None).cast(TYPES[c["kind"]]).alias(name, metadata={"kind": c["kind"]}))
                continue
            cell, text = F.col(f"`{name}`"), self.df.schema[name].dataType.typeName() == "string"
            if "missing" in c and c["missing"] is not None:
                cell = F.when(~(cell == F.lit(c["missing"]).cast(self.df.schema[name].dataType)), cell)
            if text:
                if c["kind"] not in ("text", "category"):  # words are read as they are
                    bad.append((name, unreadable(cell, c["kind"], c.get("format"))))
                made = F.when(~is_gap(cell, c["kind"]), read_cell(cell, c["kind"], c.get("format")))
            else:
                made = cell_text(cell, self.df.schema[name].dataType) if TYPES[c["kind"]] == "string" else cell.cast(TYPES[c["kind"]])
            out.append(made.alias(name, metadata={"kind": c["kind"]}))
        if s["remainder"] == "keep":
            out += [as_kind(self.df, n, kind_of(self.df.schema[n])) for n in own if n not in named]
        if bad and not (self.df.isStreaming or self.at_row):
            seen = self.df.agg(*(x for n, b in bad for x in (F.count_if(b).alias(f"n_{n}"), F.min_by(F.struct(F.col("_read_at"), F.col(f"`{n}`")), F.when(b, F.col("_read_at"))).alias(f"r_{n}")))).first()
            wrong = [f"{n}: {seen[f'n_{n}']} cells cannot be read, first {seen[f'r_{n}'][1]!r} in row {read_place(self.source, seen[f'r_{n}'][0])}" for n, _ in bad if seen[f"n_{n}"]]
            if wrong:
                raise Refused("\n".join(wrong))
        ends = {c[-1][1] for a in answers_of(self.declaration.steps) if (c := undone(self.declaration.steps, a, self.skipped))} if not self.replaying else set()
        numbers = [n for n, c in named.items() if n in ends and n in own and c["kind"] in ("number", "integer", "boolean") and not c.get("excluded")]
        if (self.df.isStreaming or self.at_row) and bad:
            self.refuse([(b, F.col(f"`{n}`"), f"{n}: the cell cannot be read") for n, b in bad])
        self.df = self.df.select(*out, *(h for h in (*HIDDEN, WRONG) if h in self.df.columns))
        self.df = self.df.withColumns({f"{AS_READ}{n}": F.col(f"`{n}`").cast("double") for n in numbers})

    def _act(self, s: Step) -> None:
        p, df = s.params, self.df
        if s.verb in HANDLERS:
            self.df = HANDLERS[s.verb](df, p)
        elif s.verb == "drop.columns":
            lacking = [c for c in p["columns"] if c not in df.columns]
            if lacking:
                raise Refused(f"there is no {', '.join(lacking)}")
            self.df = df.drop(*p["columns"])
        elif s.verb == "drop.gaps":
            for c in p["columns"]:
                if not (self.replaying and c in self.answers):
                    df = df.where(F.col(f"`{c}`").isNotNull())
            self.df = df
        elif s.verb == "drop.warmup":
            self.df = drop_warmup(df, self.order, [c for c in df.columns if c not in HIDDEN and c != WRONG and not c.startswith(KEPT) and c != self.id], p["atMost"])
        elif s.verb == "order.by":
            self.df, self.order = order_by(df, [*p["columns"], *(c for c in ("_draw",) if c in df.columns)]), p["columns"]
        elif s.verb == "shuffle":
            self._known_id(s)
            self.df = self.df.orderBy(keys.rank(self._by(p["byId"]), p["seed"]))
        elif s.verb == "feature.add":
            self.df = df.withColumn(p["column"], features.arithmetic(features.number(p["left"]), p["arithmetic"], features.number(p["right"])))
        elif s.verb == "feature.cycle":
            self.df = df.withColumns(features.cycle(p["column"], p["length"], p["form"]))
        elif s.verb == "feature.cyclical":
            self.df = df.withColumns(features.cyclical(p["column"], p["period"], p["form"]))
        elif s.verb == "feature.timeParts":
            made = features.time_parts(p["column"], p["parts"], p["asCategories"])
            self.df = df.withColumns(made)
            if p["asCategories"]:
                for c in made:
                    self.df = self.df.withMetadata(c, {"kind": "category"})
        elif s.verb == "feature.indicator":
            self.df = indicators.add_indicator(df, p["column"], p["indicator"], p["period"], p["columns"], self._along(p["by"]), self._within(p["by"]))
        elif s.verb == "maths":
            v = features.number(p["column"])
            self.refuse([(features.maths_refused(v, p["maths"]), v, f"maths: {p['column']} has a value without a {p['maths']}")])
            self.df = self.df.withColumn(p["into"] or p["column"], features.maths(v, p["maths"]))
        elif s.verb == "scale.given":
            v = features.scale_given(features.number(p["column"]), p["lowest"], p["highest"], "signed" if p["lands"] == "splitsign" else p["lands"])
            self.df = df.withColumns(features.formed({p["column"]: v}, "splitsign")).drop(p["column"]) if p["lands"] == "splitsign" else df.withColumn(p["column"], v)
        elif s.verb == "settle.gaps":
            c = F.col(f"`{p['column']}`")
            if p["with"] == "refuse":
                self.refuse([(c.isNull(), c, f"settle.gaps: {p['column']} has gaps")])
            else:
                kind = "integer" if df.schema[p["column"]].dataType.typeName() == "long" else "number"
                self.df = df.withColumn(f"{p['column']}_was_missing", features.was_missing(c)).withColumn(p["column"], features.filled(c, p["value"] if p["with"] == "constant" else 0.0, kind))
        elif s.verb == "normalise.row":
            self.df = features.normalise_row(df, p["columns"], p["norm"])
        elif s.verb == "target":
            self.answers = [p["column"]]
        elif s.verb == "target.ahead":
            self.answers = [outputs.ahead_name(p["column"], p["ahead"])]
            if p["as"] == "return":
                df = df.withColumn(_kept(self.answers[0]), F.col(f"`{p['column']}`").cast("double"))
            if self.replaying:
                self.df = df.withColumn(self.answers[0], F.lit(None).cast("double"))
            else:
                self.df = outputs.target_ahead(df, p["column"], p["ahead"], self._along(p["by"]), p["as"], p["by"])
                # the answer comes back to the value that was read so many rows later
                read = [c for c in df.columns if c.startswith(AS_READ)]
                if read:
                    self.df = outputs.over_series(self.df, {c: (lambda w, c=c: F.lead(F.col(f"`{c}`"), p["ahead"]).over(w)) for c in read}, p["ahead"], self._along(p["by"]), p["by"])
        elif s.verb == "target.distribution":
            self.answers = [*p["columns"], *([p["remainder"]] if p["remainder"] else [])]
            if p["scaleBy"] and p["scaleBy"] in df.columns:
                df = df.withColumns({_kept(a): F.col(f"`{p['scaleBy']}`").cast("double") for a in self.answers})
            self.df = df
            if not self.replaying:
                self.refuse(outputs.distribution_tests(p["columns"], p["scaleBy"], p["remainder"]))
                self.df = self.df.withColumns(outputs.distributed(p["columns"], p["scaleBy"], p["remainder"]))
        elif s.verb == "target.labels":
            self.answers = p["columns"]
            self.refuse([] if self.replaying else outputs.labels_tests(p["columns"], p["ones"]))
        elif s.verb == "target.numbers":
            self.answers, self.df = p["columns"], df if self.replaying else outputs.target_numbers(df, p["columns"])

    def _along(self, by: list[str] | None) -> list[str]:
        """The order of the rows within a series."""
        return [c for c in self.order if c not in (by or [])] or self.order

    def _within(self, by: list[str] | None) -> list[str] | None:
        """The columns that tell the series: rows that are asked anew are a series of their own in each draw."""
        return [*(by or []), "_draw"] if "_draw" in self.df.columns else by

    def _by(self, by_id: bool) -> Column:
        return keys.row_key(self.df, [self.id]) if by_id else F.col("_key")

    def _known_id(self, s: Step) -> None:
        """Rows are dealt by their id only if each has one."""
        if s.params.get("byId") and not self.replaying:
            self.refuse([(F.col(f"`{self.id}`").isNull(), F.col(f"`{self.id}`"), f"{s.verb}: rows are dealt by {self.id}")])
            self.settle()

    def _split(self, s: Step) -> None:
        if self.replaying:
            return
        p = s.params
        self._known_id(s)
        shares = splits.Shares(p["train"], p["validation"], p["test"], p["predict"], p["calibration"])
        if s.verb == "split.byTime":
            self.df = splits.by_time(self.df, p["column"], shares, p["gap"], p["origins"], p["origin"])
        elif s.verb == "split.atRandom":
            self.df = splits.at_random(self.df, self._by(p["byId"]), shares, p["seed"], p["testSeed"], p["folds"], p["fold"])
        else:
            self.df = splits.stratified(self.df, p["column"], self._by(p["byId"]), shares, p["seed"], p["folds"], p["fold"])
        self.divided = self.df

    def _fit(self, i: int, s: Step) -> None:
        p = s.params
        if _fitted(s, self.df):
            self._apply(list(zip(_fitted(s, self.df, i in self.skipped), self.learned[i], strict=True)))
        elif s.verb == "fill.missing":
            self.df = fits.fill_previous(self.df, p["column"], self._along(p["by"]), self._within(p["by"]))
        elif s.verb == "tokenize":
            one = fits.Tokenize(p["column"], p["length"], p["vocabulary"])
            if i not in self.learned:
                self.learned[i] = [one.fit(self.train())]
            self.df = one.apply(self.df, self.learned[i][0])
        elif s.verb in ("history", "history.known"):
            one = fits.History(p["key"], p["value"], p["orderBy"], p["shrink"], p["window"], p["into"], s.verb == "history.known")
            if i not in self.learned:
                learned, sums = one.fit(self.train())
                self.learned[i], self.tables[i] = [learned], kept_table(sums, "history")
            self.df = one.apply(self.df, self.learned[i][0], self.tables[i])
        elif s.verb == "watch.reference":
            columns = p["columns"] or [c for c in self.df.columns if c not in HIDDEN and c != WRONG and not c.startswith(KEPT)]
            if i not in self.learned:
                seen = Observation()
                self.tables[i] = kept_table(evidence.tallies(self.train().observe(seen, F.count("*").alias("rows")), columns), "tallies")
                self.learned[i] = [{"columns": columns, "warnAbove": p["warnAbove"], "rows": seen.get.get("rows")}]

    def _evidence(self, s: Step) -> None:
        if self.replaying:
            return
        p = s.params
        columns = p.get("columns") or [c for c in self.df.columns if c not in HIDDEN and c != WRONG and not c.startswith(KEPT) and c != self.id]
        if s.verb in HANDLERS:
            self.evidence[s.verb] = HANDLERS[s.verb](self.df, p)
        elif s.verb == "evidence.profile":
            measured = self.train() if "_part" in self.df.columns else self.df
            self.evidence["profile"] = evidence.profile(measured, columns)
            along = [*self.order, *(x["column"] for x in self.declaration.steps if x.verb == "split.byTime")]
            answers = [a for a in answers_of(self.declaration.steps) if a in self.df.columns]
            self.evidence["alerts"] = evidence.Alerts(measured, columns, answers, along, p["rankAbove"])
            self.evidence["duplicates"] = evidence.duplicates(self.df, F.col("_key"), F.col("_part") if "_part" in self.df.columns else None)
        elif s.verb == "evidence.correlation":
            self.evidence["correlation"] = evidence.correlation(self.df, columns, p["coefficient"])
        else:
            self.evidence["likeness"] = evidence.likeness(self.df, columns, "_part", p["warnAbove"])


def order_by(df: DataFrame, columns: list[str]) -> DataFrame:
    """df ordered; gaps, NaN and rows that the columns do not tell apart are refused."""
    if not df.isStreaming:
        odd = {c: F.col(f"`{c}`").isNull() | (F.isnan(f"`{c}`") if df.schema[c].dataType.typeName() in ("double", "float") else F.lit(False)) for c in columns}
        seen = df.agg(*(F.count_if(o).alias(f"n{k}") for k, o in enumerate(odd.values()))).first()
        gaps = [c for k, c in enumerate(odd) if seen[k]]
        if gaps:
            raise Refused(f"order.by: {', '.join(gaps)} has gaps")
        twice = df.groupBy(*(f"`{c}`" for c in columns)).count().where("count > 1").limit(1).collect()
        if twice:
            raise Refused(f"order.by: rows stand at one place: {tuple(twice[0])[:-1]}")
    return df.orderBy(*(f"`{c}`" for c in columns))


def drop_warmup(df: DataFrame, order: list[str], columns: list[str], at_most: int) -> DataFrame:
    """df without the rows before every column has had a value. The first value's place is found for each column, and only the largest
    of these places bounds the rows."""
    place = F.struct(*(f"`{c}`" for c in order))
    firsts = df.agg(*(F.min(F.when(F.col(f"`{c}`").isNotNull(), place)).alias(f"c{i}") for i, c in enumerate(columns))).first()
    known = [f for f in firsts if f is not None]
    if len(known) < len(columns):
        raise Refused("drop.warmup: a column has no value at all")
    start = max(known, key=tuple)
    bound = F.struct(*(F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, start, strict=True)))
    if df.where(place < bound).limit(at_most + 1).count() > at_most:
        raise Refused(f"drop.warmup: more than {at_most} rows")
    return df.where(place >= bound)


@dataclass
class Prepared:
    """A table that has been through a pipeline, and all that was learned."""

    declaration: Declaration
    df: DataFrame
    learned: dict[int, Any]
    tables: dict[int, DataFrame] = field(default_factory=dict)
    evidence: dict[str, DataFrame] = field(default_factory=dict)
    answers: list[str] = field(default_factory=list)
    id: str | None = None
    order: list[str] = field(default_factory=list)
    skipped: dict[int, str] = field(default_factory=dict)
    rows: DataFrame | None = None
    divided: DataFrame | None = None
    unmatched: DataFrame | None = None
    #: The rows as read, with their places.
    source: DataFrame | None = None
    #: For each answer that steps have changed: the largest error, as a share of the value, when they are undone on every row of the run.
    way_back: dict[str, float] = field(default_factory=dict)
    #: Half an interval around a prediction of each answer, in its units: see interval().
    margins: list[float] = field(default_factory=list)
    #: What the split saw, of a fit that was read from a file.
    entries: list[tuple[str, str]] | None = None

    def features(self) -> list[str]:
        return [c for c in self.df.columns if c not in HIDDEN and c != WRONG and not c.startswith(KEPT) and c != self.id and c not in self.answers]

    def part(self, name: str) -> DataFrame:
        if name == "gap":
            raise ValueError("rows of the gap are handed to nobody")
        return self.df.where(F.col("_part") == name)

    def batch(self, name: str, needs: str = "numbers") -> DataFrame:
        """The features and answers of a part as numbers, with the id and the key. Words, gaps and values that are not finite are refused
        by column. needs: 'numbers'; 'oneScale', which refuses features that no step declares to land between -1 and 1; 'noScale' and
        'categories', which take numbers of any size. A run that left out what the learner needs is refused."""
        return self._checked(self.part(name), needs).drop("_read_at", *(c for c in self.df.columns if c.startswith(KEPT)))

    def _checked(self, rows: DataFrame, needs: str, at_row: bool = False) -> DataFrame:
        """What a learner is handed. at_row: a cell that it cannot take is an error when the row is read, and not before."""
        names, steps = self.features(), self.declaration.steps
        lacking = missed(self.skipped, steps, needs)
        if lacking:
            raise Refused(f"this run left out {', '.join(f'step {i + 1} ({steps[i].verb})' for i in lacking)}, which a learner that needs {needs} cannot do without")
        words = [c for c in names if rows.schema[c].dataType.typeName() == "string"]
        if words:
            raise Refused(f"words are left in {', '.join(words)}")
        if needs == "oneScale":
            landing = Landing(steps, {i: how for i, how in self.skipped.items() if how == "out"})
            off = [c for c in names if not landing.of(c) and rows.schema[c].dataType.typeName() != "array"]
            if off:
                raise Refused(f"not declared to land between -1 and 1: {', '.join(off)}")
        plain = [c for c in names if rows.schema[c].dataType.typeName() != "array"]
        x = lambda c: F.col(f"`{c}`").cast("double")
        odd = {c: F.expr(f"`{c}` IS NULL OR isnan(CAST(`{c}` AS DOUBLE)) OR abs(CAST(`{c}` AS DOUBLE)) = double('infinity')") if c in plain else F.expr(f"`{c}` IS NULL") for c in names}
        place = F.col("_read_at") if "_read_at" in rows.columns else F.lit(None).cast("bigint")
        if odd and at_row:
            # Every number times 0 is 0 but for gaps and what is not finite. Which cell is wrong is told by one function over the cells, for the
            # row that is refused alone: a test for each column would make code too long to be compiled to machine code.
            cells = [x(c) if c in plain else F.when(F.col(f"`{c}`").isNotNull(), F.lit(0.0)) for c in names]
            fine = F.coalesce(reduce(lambda a, b: a + b, (v * 0.0 for v in cells)) == 0.0, F.lit(False))
            off = F.filter(F.zip_with(F.array(*map(F.lit, names)), F.array(*cells), lambda n, v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), n)), lambda n: n.isNotNull())
            rows = rows.where(F.when(fine, True).otherwise(F.raise_error(F.concat(off[0], F.lit(": a gap, or a value that a learner cannot take"))).cast("boolean")))
        elif odd:
            seen = rows.agg(*(F.min(F.when(test, F.coalesce(place, F.lit(-1)))).alias(f"b{i}") for i, test in enumerate(odd.values()))).first()
            bad = {c: seen[f"b{i}"] for i, c in enumerate(odd) if seen[f"b{i}"] is not None}
            if bad:
                rows_read = {c: read_place(self.source, at) for c, at in bad.items() if at >= 0 and self.source is not None}
                told = ", ".join(f"{c}{f' (first in row {rows_read[c]})' if c in rows_read else ''}" for c in sorted(bad))
                raise Refused(f"{told}: gaps, or values that a learner cannot take", min(rows_read.values(), default=None))
        hidden = [c for c in rows.columns if c in ("_key", "_read_at", "_asked", "_draw") or c.startswith(KEPT)]
        return rows.select(*(x(c).alias(c) if c in plain else F.col(f"`{c}`") for c in names), *(x(c).alias(c) for c in self.answers), *([self.id] if self.id else []), *(F.col(f"`{c}`") for c in hidden))

    def said_names(self) -> list[str]:
        """The columns that a prediction is given in: `prediction`, or prediction_0 and so on where there are several answers."""
        return ["prediction"] if len(self.answers) == 1 else [f"prediction_{k}" for k in range(len(self.answers))]

    def measure(self, predict: Callable[[DataFrame], DataFrame] | list[Callable[[DataFrame], DataFrame]], margins: list[float] | None = None, needs: str = "numbers", blend: str = "average") -> DataFrame:
        """part, metric, model and baseline for each measure that the report names, and for a confusion matrix a row for each cell (answer,
        held, said, and how many rows the model and the baseline put there).

        predict takes a part as batch hands it over and adds said_names(), in the units of the prepared answers. Everything is measured
        in the units the answers were read in; the baseline is the training rows' average answer, brought back the same way. margins (in
        the answers' units) are half an interval for each answer, by default those that interval() has made; without them coverage and width
        are left out. Several predictions are
        members of an ensemble, which are brought back and then averaged, or counted as votes for classes (blend 'vote')."""
        members = predict if isinstance(predict, list) else [predict]
        margins = margins or self.margins or None
        report = next((s for s in self.declaration.steps if s.verb == "evidence.report"), None)
        if report is None:
            raise Refused("the pipeline declares no report, so nothing says what a model is measured by")
        names = self.said_names()
        train = self.part("train").agg(*(F.avg(F.col(f"`{a}`").cast("double")).alias(f"a{i}") for i, a in enumerate(self.answers))).first()
        if train[0] is None:
            raise Refused("the training part holds no rows, so there is no average to measure beside")
        ones = next((s.params.get("ones", 0) for s in self.declaration.steps if s.spec.role == "answer"), 0)
        counted = next((len(s["columns"]) for s in self.declaration.steps if s.verb == "target.distribution"), len(self.answers))
        parts = report["parts"] if isinstance(report["parts"], list) else [report["parts"]]
        metrics = report["metrics"] if isinstance(report["metrics"], list) else [report["metrics"]]
        told = []
        for part in dict.fromkeys(parts):
            handed = self._checked(self.part(part), needs)
            said: list[list[Column]] = []
            for k, member in enumerate(members):
                handed = member(handed)
                lacking = [n for n in names if n not in handed.columns]
                if lacking:
                    raise Refused(f"the predictions lack {', '.join(lacking)}")
                handed = handed.withColumnsRenamed({n: f"_said{k}_{i}" for i, n in enumerate(names)})
                said.append([self.back(F.col(f"_said{k}_{i}").cast("double"), a).cast("double") for i, a in enumerate(self.answers)])
            units = handed.select(
                *(self.back(F.col(f"`{a}`"), a).cast("double").alias(f"y{i}") for i, a in enumerate(self.answers)),
                *(c.alias(f"p{i}") for i, c in enumerate(measures.blended(said, blend, ones))),
                *(self.back(F.lit(train[i]), a).cast("double").alias(f"b{i}") for i, a in enumerate(self.answers)),
            )
            # Written once: the measures take several passes, and predictions may be dear.
            told += [(part, *row) for row in measures.of_part(kept_table(units, "units"), self.answers, metrics, ones, counted, margins)]
        return self.df.sparkSession.createDataFrame(told, measures.TOLD)

    def interval(self, predict: Callable[[DataFrame], DataFrame], alpha: float = 0.1, needs: str = "numbers") -> list[float]:
        """Half the interval around a prediction that holds the answer with a chance of 1 - alpha at least, for each answer in the units it was
        read in: from the errors on the rows set apart for it, the part `calibration`. Kept with the fit, for measure() and save()."""
        handed = predict(self._checked(self.part("calibration"), needs))
        pairs = [(self.back(F.col(f"`{a}`"), a).cast("double").alias(f"y{i}"), self.back(F.col(n).cast("double"), a).cast("double").alias(f"p{i}")) for i, (a, n) in enumerate(zip(self.answers, self.said_names(), strict=True))]
        both = handed.select(*(c for two in pairs for c in two))
        self.margins = [measures.conformal_margin(both, F.col(f"y{i}"), F.col(f"p{i}"), alpha) for i in range(len(pairs))]
        return self.margins

    def over(self, rows: DataFrame | None = None) -> Prepared:
        """A fit that was read from a file, over the rows it was fitted on (those of its source, or handed in): nothing is fitted again, the
        rows are divided as they were. Other rows than those are refused by their digest."""
        walk = _Walk(self.declaration, self.df.sparkSession, skipped=self.skipped)
        walk.learned, walk.tables = dict(self.learned), dict(self.tables)
        again = walk.run(rows)
        held = dict(self.entries or []).get("digest")
        if held is not None and keys.digest(again.divided) != held:
            raise Refused("these are other rows than those of the fit")
        again.margins, again.entries = self.margins, self.entries
        return again

    def predictions(self, predict: Callable[[DataFrame], DataFrame], needs: str = "numbers") -> DataFrame:
        """What is kept of predictions so that they can be measured again: part, key, said (one number an answer) and fit (a digest of the
        steps and of all that was learned)."""
        report = next(s for s in self.declaration.steps if s.verb == "evidence.report")
        parts, out = report["parts"] if isinstance(report["parts"], list) else [report["parts"]], None
        for part in dict.fromkeys(parts):
            handed = predict(self._checked(self.part(part), needs))
            one = handed.select(F.lit(part).alias("part"), F.col("_key").alias("key"), F.array(*(F.col(n).cast("double") for n in self.said_names())).alias("said"))
            out = one if out is None else out.unionByName(one)
        return out.withColumn("fit", F.lit(self.fit_digest()))

    def measure_again(self, predictions: DataFrame | str, margins: list[float] | None = None, rows: DataFrame | None = None) -> DataFrame:
        """measure() of kept predictions (part, key, said, fit; or the path of a Parquet table of them), which must be of this very fit and
        hold each row of each part. Rows with one key are alike in all they hold, so one prediction stands for them. A fit that was read from
        a file takes its rows from its source, or from those handed in: see over()."""
        if isinstance(predictions, str):
            predictions = self.df.sparkSession.read.parquet(predictions)
        if self.divided is None:
            return self.over(rows).measure_again(predictions, margins)
        other = predictions.where(F.col("fit") != self.fit_digest()).limit(1).count()
        if other:
            raise Refused("these predictions were made behind another fit than this one")
        said = predictions.groupBy("key").agg(F.first("said").alias("_said"))

        def predict(handed: DataFrame) -> DataFrame:
            met = handed.join(said, handed["_key"] == said["key"], "left")
            if met.where("_said is null").limit(1).count():
                raise Refused("there are rows without a prediction")
            return met.withColumns({n: F.col("_said")[k] for k, n in enumerate(self.said_names())})

        return self.measure(predict, margins)

    def fit_digest(self) -> str:
        """A digest of the steps, of what was left out and of what was learned."""
        told = [self.declaration.prefixes()[-1], sorted(self.skipped.items()), sorted((i, v) for i, v in self.learned.items())]
        return hashlib.sha256(json.dumps(told, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()

    def train_learner(self) -> learners.Trained | learners.TrainedNetwork:
        """The learner that the pipeline names, trained on the training rows. What is not trained here is refused."""
        s = next((s for s in self.declaration.steps if s.spec.role == "learner"), None)
        if s is None:
            raise Refused("the pipeline names no learner")
        asked = next((x["metrics"] for x in self.declaration.steps if x.verb == "evidence.report"), [])
        classes = bool(set(asked) & {"accuracy", "precision", "recall", "f1", "confusionmatrix", "auc", "brier"})
        if s.verb == "learn.network":
            answer = next(x for x in self.declaration.steps if x.spec.role == "answer")
            shares = answer.verb == "target.distribution" or (answer.verb == "target.labels" and answer["ones"] == 1)
            loss = "crossentropy" if shares else "binarycrossentropy" if answer.verb == "target.labels" or (classes and len(self.answers) == 1) else "meansquarederror"
            stops = isinstance(s["stopping"], dict) and s["stopping"].get("kind") == "patience"
            return learners.train_dense(s, self.batch("train", "oneScale"), self.features(), self.answers, loss, self.said_names(), "oneScale", self.batch("validation", "oneScale") if stops else None)
        if len(self.answers) != 1:
            raise Refused("trees here answer one column")
        return learners.train(s, self.batch("train", "noScale"), self.features(), self.answers[0], classes, "noScale")

    def fit_entries(self) -> DataFrame:
        """What the split saw, as name and value: rows of each part, rows of a join without a partner, the first and last moment of each part
        of a split by time, and a digest of the rows it divided. A fit that was read from a file tells what it saw when it was fitted."""
        if self.divided is None:
            return self.df.sparkSession.createDataFrame(self.entries or [], "name string, value string")
        s = next(x for x in self.declaration.steps if x.spec.role == "split")
        timed = s.verb == "split.byTime"
        moment = F.col(f"`{s['column']}`").cast("string") if timed else F.lit(None).cast("string")
        by_part = self.divided.groupBy("_part").agg(F.count("*").cast("string").alias("rows"), F.min(moment).alias("first"), F.max(moment).alias("last"))
        entry = lambda name, value: F.struct(F.concat(F.lit(name), F.col("_part")).alias("name"), value.alias("value"))
        told = by_part.select(F.inline(F.array(entry("rows.", F.col("rows")), *([entry("moments.", F.concat_ws(" .. ", "first", "last"))] if timed else []))))
        more = [("digest", keys.digest(self.divided))]
        if self.unmatched is not None:
            more.append(("rows.unmatched", str(self.unmatched.count())))
        return told.where("name <> 'moments.gap'").unionByName(self.df.sparkSession.createDataFrame(more, "name string, value string"))

    def transform(self, rows: DataFrame) -> DataFrame:
        """Later rows, through the same steps with what was learned. Rows of a stream take every plan that does not read their order."""
        if rows.isStreaming:
            held = [s.verb for s in self.declaration.steps if s.spec.ordered or s.verb in ("order.by", "shuffle", "history", "history.known") or s.params.get("with") == "previous"]
            if held:
                raise Refused(f"a stream has no order for {', '.join(held)}")
        return self._replayed(rows)

    def _replayed(self, rows: DataFrame, at_row: bool = False) -> DataFrame:
        names = {c["name"] for s in self.declaration.steps if s.verb == "declare" for c in s["columns"]}
        awaited = [c for c in self.answers if c not in rows.columns and (c in names or not names)]
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in awaited if "." not in c})
        walk = _Walk(self.declaration, rows.sparkSession, self.learned, self.tables, self.skipped)
        walk.at_row = at_row
        return walk.run(rows).df

    def _asking(self, rows: DataFrame, predict: Callable[[DataFrame], DataFrame], needs: str) -> tuple[DataFrame, list[str], reasons.Answered]:
        """The rows with their places, the columns that can be changed, and how changed rows are answered: through the same steps with
        what was learned, by predict, brought back to the units the answers were read in."""
        if not self.answers:
            raise Refused("the pipeline names no answer, so there is none to ask why of")

        def answered(asked: DataFrame) -> DataFrame:
            handed = predict(self._checked(self._replayed(asked, True), needs, True))
            return handed.select("_asked", "_draw", *(self.back(F.col(n).cast("double"), a).cast("double").alias(f"a{i}") for i, (a, n) in enumerate(zip(self.answers, self.said_names(), strict=True))))

        return number_rows(rows), [c for c in rows.columns if c not in self.answers and c != self.id], answered

    def reliance(self, rows: DataFrame, predict: Callable[[DataFrame], DataFrame], seed: int, repeats: int, needs: str = "numbers") -> DataFrame:
        """column, mean and spread: how far the answers to rows (as they are read) move when a column's cells are dealt among them anew. See
        operators/reasons.py; predict as in measure()."""
        if repeats < 1:
            raise ValueError("cells are dealt once at least")
        rows, columns, answered = self._asking(rows, predict, needs)
        return reasons.reliance(rows, columns, answered, len(self.answers), seed, repeats)

    def dependence(self, rows: DataFrame, predict: Callable[[DataFrame], DataFrame], column: str, points: int, needs: str = "numbers") -> DataFrame:
        """value, place, answer and mean: the mean answers to rows (as they are read) when a column is moved through its range: a number from
        its smallest to its largest in so many places, a category through the words that were learned of it, else those of the rows."""
        if points < 2:
            raise ValueError("a column is moved to two places at least")
        rows, columns, answered = self._asking(rows, predict, needs)
        if column not in columns:
            raise Refused(f"{column} is none of the columns that can be moved: {', '.join(columns)}")
        declared = next((c for s in self.declaration.steps if s.verb == "declare" for c in s["columns"] if c["name"] == column), {})
        kind, cell, text = declared.get("kind"), F.col(f"`{column}`"), rows.schema[column].dataType.typeName() == "string"
        if kind in ("number", "integer"):
            value = F.when(~is_gap(cell, kind), read_cell(cell, kind, declared.get("format"))) if text else cell
            low, high, n = rows.agg(F.min(value).cast("double"), F.max(value).cast("double"), F.count("*")).first()
            if low is None:
                raise Refused(f"{column} holds no number to move through")
            grid = reasons.grid_of(low, high, points, kind == "integer")
        elif kind == "category":
            n, learned = rows.count(), next((self.learned[i][0] for i, s in enumerate(self.declaration.steps) if s.verb == "encode" and s.params.get("column") == column and i in self.learned), None)
            grid = learned["categories"] if learned is not None else [r[0] for r in rows.select(cell.cast("string")).dropna().distinct().limit(fits.MOST_WORDS + 1).collect()]
            if len(grid) > fits.MOST_WORDS:
                raise Refused(f"{column} has more than {fits.MOST_WORDS} words")
            grid = sorted(grid, key=lambda w: w.encode("utf-16-be"))
            if not grid:
                raise Refused(f"{column} holds no word to move through")
        else:
            raise Refused(f"{column} is {kind or 'not declared'}, which has no range to move through")
        return reasons.dependence(rows, column, grid, answered, self.answers, n)

    def make_up(self, rows: DataFrame, row: Column, predict: Callable[[DataFrame], DataFrame], seed: int, repeats: int, needs: str = "numbers") -> DataFrame:
        """column, answer, contribution, said and background: what each column adds to the answers of the one row of rows (as they are read)
        that a condition picks."""
        if repeats < 1:
            raise ValueError("a row is asked of once at least")
        rows, columns, answered = self._asking(rows, predict, needs)
        return reasons.make_up(rows, row, columns, answered, self.answers, seed, repeats)

    def view(self, steps: int, rows: DataFrame | None = None) -> DataFrame:
        """The table after so many steps, with _standing: the part each row is in, `dropped` if it does not reach the split, `undivided` where
        there is none. What was learned is used as it is; nothing is fitted again."""
        if not 1 <= steps <= len(self.declaration.steps):
            raise ValueError(f"there are {len(self.declaration.steps)} steps")
        given = rows if rows is not None else self.rows
        split = next((i for i, s in enumerate(self.declaration.steps) if s.spec.role == "split"), None)
        there = self._walked(given, steps)
        if "_part" in there.columns:
            return there.withColumn("_standing", F.col("_part"))
        if split is None:
            return there.withColumn("_standing", F.lit("undivided"))
        later = self._walked(given, split + 1).select(F.col("_read_at").alias("_at"), F.col("_part").alias("_standing"))
        return there.join(later, F.col("_read_at") == F.col("_at"), "left").drop("_at").withColumn("_standing", F.coalesce("_standing", F.lit("dropped")))

    def _walked(self, rows: DataFrame | None, steps: int) -> DataFrame:
        walk = _Walk(self.declaration, self.df.sparkSession, skipped=self.skipped)
        walk.learned, walk.tables = dict(self.learned), dict(self.tables)
        return walk.run(rows, steps).df

    def back(self, prediction: Column, column: str | None = None) -> Column:
        """A prediction of an answer in the units it was read in: the steps that made it are undone, last first."""
        name, out = column or self.answers[0], prediction
        if any(s.verb == "target.distribution" and s["scaleBy"] and name == s["remainder"] for s in self.declaration.steps):
            return out * F.col(f"`{_kept(name)}`")
        for i, left in undone(self.declaration.steps, name, self.skipped):
            s = self.declaration.steps[i]
            p = s.params
            if s.verb == "normalise":
                out = fits.Normalise(name, p["scale"], p["outOfRange"]).back(out, self.learned[i][0])
            elif s.verb == "maths":
                out = features.maths_back(out, p["maths"])
            elif s.verb == "scale.given":
                out = features.scale_given_back(out, p["lowest"], p["highest"], p["lands"])
            elif s.verb == "target.ahead":
                out = outputs.ahead_back(out, F.col(f"`{_kept(name)}`"), p["as"]) if p["as"] == "return" else out
            else:
                out = out * F.col(f"`{_kept(name)}`")
            name = left
        return out

    def watched(self, window: DataFrame) -> DataFrame:
        """How far the rows of a window (served rows, as transform gives them) are from the training rows, by watched column."""
        i, kept = self._watch()
        return evidence.watched(self.tables[i], window, kept["columns"], kept["warnAbove"])

    def watched_window(self, window: DataFrame) -> DataFrame:
        """watched, with the rows that hold each column and those that do not, in training and in the window, and from when to when the window
        is by the columns that the rows are ordered by."""
        i, kept = self._watch()
        along = next((s["columns"] for s in self.declaration.steps if s.verb == "order.by"), [])
        told = evidence.accounts(self.tables[i], window, kept["columns"], kept.get("rows"), along)
        return self.watched(window).join(told, "column", "right").withColumn("warned", F.coalesce("warned", F.lit(False)))

    def _watch(self) -> tuple[int, dict]:
        found = [k for k, s in enumerate(self.declaration.steps) if s.verb == "watch.reference" and k in self.learned]
        if len(found) != 1:
            raise Refused(f"a window is measured against one watch.reference; this pipeline keeps {len(found)}")
        return found[0], self.learned[found[0]][0]

    def save(self, path: str) -> None:
        """path/pipeline.json, and a Parquet table beside it for each step whose memory is a table."""
        spark = self.df.sparkSession
        for i, t in self.tables.items():
            t.write.mode("overwrite").parquet(f"{path}/table-{i}")
        prefixes = self.declaration.prefixes()
        fitted = [{"step": i, "prefix": prefixes[i], "learned": v} for i, v in sorted(self.learned.items())]
        entries = [tuple(r) for r in self.fit_entries().collect()] if any(x.spec.role == "split" for x in self.declaration.steps) else []  # a few for each part
        told = {"version": VERSION, "entries": entries, "margins": self.margins, "wayBack": self.way_back, "declaration": self.declaration.to_list(), "fitted": fitted, "tables": sorted(self.tables), "answers": self.answers, "id": self.id, "skipped": sorted(self.skipped.items())}
        spark.createDataFrame([(json.dumps(told, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/pipeline.json")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Prepared:
        told = json.loads(spark.read.text(f"{path}/pipeline.json").first()[0])
        declaration = _read(told)
        prefixes = declaration.prefixes()
        for f in told["fitted"]:
            if prefixes[f["step"]] != f["prefix"]:
                raise ValueError(f"step {f['step'] + 1} was fitted under other steps")
        tables = {i: spark.read.parquet(f"{path}/table-{i}") for i in told["tables"]}
        return Prepared(declaration, spark.createDataFrame([], "_part string"), {f["step"]: f["learned"] for f in told["fitted"]}, tables, {}, told["answers"], told["id"], skipped={i: how for i, how in told.get("skipped", [])}, way_back=told.get("wayBack", {}), margins=told.get("margins", []), entries=[tuple(e) for e in told.get("entries", [])])

"""Text files whose records end at a separator that may also stand within quotes, read by many tasks a file.

Whether a separator ends a record depends on how many quotes stand before it. A first pass counts, for each split of a file, its quotes and how
many records begin in it, for either way it may begin. From these few numbers it follows how each split does begin and how its records are
numbered, and a second pass parses all splits at once. A record over several splits is put together from its pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a record holds: its cells, or what is wrong with it; None for a record that is no row.
Taken = tuple[list[str | None] | None, str | None] | None
_PARSED = "file string, n bigint, start bigint, piece string, cells array<string>, fault string"
_KINDS = {"file": pa.string(), "n": pa.int64(), "start": pa.int64(), "piece": pa.string(), "cells": pa.list_(pa.string()), "fault": pa.string()}


def _told(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS.values(), strict=True)], names=list(_KINDS))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """The stretches between separators of each split, batch by batch."""
    for b in batches:
        if not b.num_rows:
            continue
        files, starts = b.column("file").to_pylist(), b.column("start").to_numpy()
        ends = [0, *(i for i in range(1, b.num_rows) if starts[i] != starts[i - 1] or files[i] != files[i - 1]), b.num_rows]
        for a, z in zip(ends[:-1], ends[1:], strict=True):
            yield (files[a], int(starts[a])), b.column("value").slice(a, z - a)


class Records:
    """The records of the files at a path. quotes says how many quotes each stretch between two separators holds."""

    def __init__(self, spark: SparkSession, path: str, separator: str, quotes: Callable[[pa.Array], np.ndarray]):
        self.separator, self.quotes = separator, quotes
        self.lines = spark.read.option("lineSep", separator).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
        self.begins, self.counts, self.unclosed = self._survey()

    def _survey(self) -> tuple[dict[tuple[str, int], tuple[int, int]], dict[str, int], bool]:
        """For each split whether it begins within quotes, and how many records of its file have begun before it; the records of each
        file; whether a file ends within quotes (its last record is a piece, too)."""
        quotes = self.quotes

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            told: dict[tuple[str, int], list[int]] = {}  # a task's splits
            for split, lines in _runs(batches):
                held, many = told.setdefault(split, [0, 0, 0]), quotes(lines)
                before = (held[0] + np.concatenate(([0], np.cumsum(many)[:-1]))) % 2
                held[0] = int(held[0] + many.sum()) % 2
                held[1] += int((before == 0).sum())
                held[2] += int((before == 1).sum())
            if told:
                rows = [(*split, *held) for split, held in told.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["file", "start", "odd", "outside", "inside"])

        splits = self.lines.mapInArrow(measured, "file string, start bigint, odd bigint, outside bigint, inside bigint").collect()  # a row a split
        begins: dict[tuple[str, int], tuple[int, int]] = {}
        counts: dict[str, int] = {}
        odd: dict[str, int] = {}
        for s in sorted(splits, key=lambda s: (s["file"], s["start"])):
            quoted, records = odd.get(s["file"], 0), counts.get(s["file"], 0)
            begins[s["file"], s["start"]] = (quoted, records)
            counts[s["file"]] = records + (s["inside"] if quoted else s["outside"])
            odd[s["file"]] = quoted ^ s["odd"]
        return begins, counts, any(odd.values())

    def rows(self, take: Callable[[str, int, str], Taken]) -> DataFrame:
        """file, n (from 0), cells and fault of each record for which take gives something."""
        begins, separator, quotes = self.begins, self.separator, self.quotes

        def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, quoted, n, open_, headless = None, 0, 0, [], False
            for split, some in _runs(batches):
                rows = []
                if split != now:
                    if open_:
                        rows.append((now[0], n, now[1], separator.join(open_), None, None))
                    now, (quoted, n) = split, begins[split]
                    n, open_, headless = n - 1, [], bool(quoted)
                for line, many in zip(some.to_pylist(), quotes(some).tolist(), strict=True):
                    if not quoted:
                        n += 1
                    open_.append(line)
                    quoted ^= many & 1
                    if not quoted:
                        if headless:  # it began in an earlier split
                            rows.append((split[0], n, split[1], separator.join(open_), None, None))
                            headless = False
                        else:
                            held = take(split[0], n, separator.join(open_))
                            if held is not None:
                                rows.append((split[0], n, split[1], None, *held))
                        open_ = []
                if rows:
                    yield _told(rows)
            if open_:
                yield _told([(now[0], n, now[1], separator.join(open_), None, None)])

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                held = [(r["file"], r["n"], take(r["file"], r["n"], r["piece"])) for r in b.to_pylist()]
                rows = [(file, n, 0, None, *one) for file, n, one in held if one is not None]
                if rows:
                    yield _told(rows)

        found = self.lines.mapInArrow(parsed, _PARSED)
        whole = found.where("piece is null")
        if self.unclosed or any(quoted for quoted, _ in begins.values()):
            parts = found.where("piece is not null").groupBy("file", "n").agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("parts"))
            one = parts.select("file", "n", F.array_join(F.col("parts.piece"), separator).alias("piece"))
            whole = whole.unionByName(one.mapInArrow(joined, _PARSED))
        return whole.select("file", "n", "cells", "fault")

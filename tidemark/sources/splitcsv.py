"""CSV files whose quoted cells may hold line breaks, read by many tasks a file (sources/records.py)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.records import Records, Taken


def cells_of(record: str) -> list[str | None]:
    """The cells of one record: a quote begins and ends a stretch in which commas and line breaks are text, two of them there are one;
    carriage returns outside are dropped; an empty cell without quotes is a gap."""
    if '"' not in record:
        return [c or None for c in record.replace("\r", "").split(",")]
    cells, cell, quoted = [], [], False
    parts = record.split('"')
    for i, part in enumerate(parts):
        if i % 2:
            cell.append(part)
            quoted = True
        elif not part and 0 < i < len(parts) - 1:
            cell.append('"')
        else:
            for k, piece in enumerate(part.replace("\r", "").split(",")):
                if k:
                    cells.append("".join(cell) or ("" if quoted else None))
                    cell, quoted = [], False
                cell.append(piece)
    cells.append("".join(cell) or ("" if quoted else None))
    return cells


def _quotes(lines: pa.Array) -> np.ndarray:
    return pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)


def read_split_csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Files of a header and records of as many cells, all as text. Another number of cells, or another header, is refused when the row is
    read, naming it (the first record below the header is row 1)."""

    def take(file: str, n: int, record: str) -> Taken:
        cells = cells_of(record)
        if n == 0:
            cells[0] = cells[0].lstrip("\ufeff") if cells[0] else cells[0]
        if len(cells) != len(names):
            raise ValueError(f"read.csv: row {n} of {file} holds {len(cells)} cells, not {len(names)}")
        return (cells, None) if n else None

    rows = Records(spark, path, "\n", _quotes).rows(take)
    return rows.select(*(F.get("cells", i).alias(name) for i, name in enumerate(names)))

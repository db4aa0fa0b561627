"""Keys that a row's content determines, ranks under a seed, and digests of tables: SHA-256 as column expressions."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.kinds import cell_text, trimmed


def _bytes(data: bytes) -> Column:
    return F.lit(bytearray(data))


def _le32_hex(n: Column) -> Column:
    h = F.lpad(F.hex(n), 8, "0")
    return F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1)))


def row_key(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 in hexadecimal over the columns in ordinal order of their names. Each gives the length of its name (four bytes, little
    end first), the name, and 0 for a gap or 1, the length of its trimmed text and the text.

    Only words are trimmed: the text of a number, a moment or a truth has no white space. One function of a cell runs over the array of
    all cells, so the code that a plan compiles does not grow with each column."""
    heads, cells = [], []
    for name in sorted(columns or df.columns, key=lambda n: n.encode("utf-16-be")):
        text = cell_text(F.col(f"`{name}`"), df.schema[name].dataType)
        cells.append(trimmed(text) if df.schema[name].dataType.typeName() == "string" else text)
        heads.append((struct.pack("<i", len(name.encode())) + name.encode()).hex())
    written = lambda head, cell: F.concat(head, F.when(cell.isNull(), "00").otherwise(F.concat(F.lit("01"), _le32_hex(F.octet_length(cell)), F.hex(cell))))
    return F.sha2(F.unhex(F.array_join(F.zip_with(F.array(*map(F.lit, heads)), F.array(*cells), written), "")), 256)


def rank(key: Column, seed: int) -> Column:
    """The key's place under a seed, as hexadecimal text that sorts as its bytes do."""
    return F.sha2(F.concat(_bytes(struct.pack("<i", seed)), F.unhex(key)), 256)


def rank_number(key: Column, seed: int) -> Column:
    """The first 60 bits of the rank."""
    return F.conv(F.substring(rank(key, seed), 1, 15), 16, 10).cast("bigint")


def digest(df: DataFrame, key: str = "_key") -> str:
    """A digest of the rows' keys in order. Keys of a range are digested by its task, so only a digest for each range comes back."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = df.select(F.substring(key, 1, 2).alias("p"), F.col(key).alias("k")).repartition(n, "p")
    each = part.groupBy("p", F.substring("k", 1, 4).alias("q")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("k")), ""), 256).alias("d"))
    return each.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("q", "d"))), lambda x: x["d"]), ""), 256)).first()[0]

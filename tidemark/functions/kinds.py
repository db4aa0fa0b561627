"""The seven kinds of column, how text cells are read as each, and the text that a typed cell counts as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("text", "category", "number", "integer", "boolean", "timestamp", "media")
NUMBERS = ("number", "integer", "boolean")
TYPES = {"text": "string", "category": "string", "number": "double", "integer": "bigint", "boolean": "boolean", "timestamp": "timestamp", "media": "array<float>"}
TRUE, FALSE = ("true", "1", "yes", "y", "t"), ("false", "0", "no", "n", "f")
#: White space of all scripts.
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_MOMENT = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,7})?)?)?(Z|[+-]\d{2}:\d{2})?$"


def trimmed(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.btrim(c, F.lit(_BLANKS))


def read_cell(c: Column, kind: str, pattern: str | None = None) -> Column:
    """A text cell as `kind`; null where it is a gap or cannot be read (see unreadable)."""
    t = trimmed(c)
    if kind in ("text", "category"):
        return F.when(c != "", c)
    if kind == "number":
        special = F.when(t == "NaN", float("nan")).when(t == "Infinity", float("inf")).when(t == "-Infinity", float("-inf"))
        plain = F.when(t.rlike(_NUMBER), t.try_cast("double"))
        return F.coalesce(special, F.when(F.abs(plain) != float("inf"), plain))
    if kind == "integer":
        return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint"))
    if kind == "boolean":
        return F.when(F.lower(t).isin(*TRUE), True).when(F.lower(t).isin(*FALSE), False)
    if kind == "timestamp":
        iso = F.when(t.rlike(_MOMENT), F.try_to_timestamp(t))
        return F.coalesce(F.try_to_timestamp(t, F.lit(pattern)), iso) if pattern else iso
    raise ValueError(f"a text cell cannot be read as {kind}")


def is_gap(c: Column, kind: str) -> Column:
    """Whether a text cell holds nothing: for words only the empty cell, else white space too."""
    return c.isNull() | ((c == "") if kind in ("text", "category") else (trimmed(c) == ""))


def unreadable(c: Column, kind: str, pattern: str | None = None) -> Column:
    return ~is_gap(c, kind) & read_cell(c, kind, pattern).isNull()


def kind_of(field: T.StructField) -> str:
    """The kind that a typed column states, or its metadata."""
    if "kind" in field.metadata:
        return field.metadata["kind"]
    t = field.dataType
    if isinstance(t, T.StringType):
        return "text"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "number"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    raise ValueError(f"column {field.name} is {t.simpleString()}, which no kind holds")


def as_kind(df: DataFrame, name: str, kind: str) -> Column:
    """A typed column as the type of its kind."""
    return F.col(f"`{name}`").cast(TYPES[kind]).alias(name, metadata={"kind": kind})


def cell_text(c: Column, data_type: T.DataType) -> Column:
    """The text a typed cell counts as in keys: whole numbers without a point, True and False, moments with seven places."""
    if isinstance(data_type, T.StringType):
        return c
    if isinstance(data_type, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        whole = (F.abs(c) < 1e15) & (F.floor(c) == c)
        return F.when(c.isNull(), None).when(F.isnan(c), "NaN").when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    if isinstance(data_type, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0"))
    return c.cast("string")


def finite(c: Column) -> Column:
    """The number, or null where it is no finite one."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def is_not_finite(c: Column) -> Column:
    d = c.cast("double")
    return F.isnan(d) | (F.abs(d) == float("inf"))


def propose_kinds(df: DataFrame, most: int = 64) -> DataFrame:
    """column and kind for each column of df, all of them read as text: one aggregation.

    Text where all is gap; boolean where all cells are words for it, unless only 0 and 1 stand there; then integer, number, timestamp,
    else text. Words become a category where at most `most` differ and each comes twenty times on average."""
    columns = df.columns
    aggregates = []
    for k, name in enumerate(columns):
        c = F.col(f"`{name}`").cast("string")
        there = ~is_gap(c, "number")
        t = trimmed(c)
        aggregates += [
            F.count_if(there).alias(f"n{k}"),
            F.count_if(there & ~F.lower(t).isin(*TRUE, *FALSE)).alias(f"b{k}"),
            F.count_if(there & ~t.isin("0", "1")).alias(f"o{k}"),
            F.count_if(there & unreadable(c, "integer")).alias(f"i{k}"),
            F.count_if(there & unreadable(c, "number")).alias(f"f{k}"),
            F.count_if(there & unreadable(c, "timestamp")).alias(f"m{k}"),
            F.approx_count_distinct(c, 0.02).alias(f"d{k}"),
        ]
    r = df.agg(*aggregates)
    rows = []
    for k, name in enumerate(columns):
        n, d = F.col(f"n{k}"), F.col(f"d{k}")
        words = F.when((d <= most) & (d * 20 <= n), "category").otherwise("text")
        kind = F.when(n == 0, "text").when((F.col(f"b{k}") == 0) & (F.col(f"o{k}") > 0), "boolean").when(F.col(f"i{k}") == 0, "integer")
        kind = kind.when(F.col(f"f{k}") == 0, "number").when(F.col(f"m{k}") == 0, "timestamp").otherwise(words)
        rows.append(F.struct(F.lit(name).alias("column"), kind.alias("kind")))
    return r.select(F.inline(F.array(*rows)))

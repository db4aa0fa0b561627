"""Readers: CSV, Parquet, JSON, workbooks, a many-to-one join, folders of texts, images and sounds, rows handed in, landed candles."""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.kinds import trimmed
from tidemark.operators.fits import Refused
from tidemark.sources.splitcsv import read_split_csv
from tidemark.sources.splitjson import read_split_json
from tidemark.sources.workbooks import read_workbooks


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text; quoted cells may hold line breaks; a row with another number of cells is refused when it is read. A file is read
    by many tasks (sources/splitcsv.py)."""
    names = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    return read_split_csv(spark, path, names)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Columns of plain types; nested and binary ones are refused by name."""
    df = spark.read.parquet(path)
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    if nested:
        raise Refused(f"read.parquet: {', '.join(nested)} hold no plain cells")
    return df


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of flat objects, cells as text; a file is read by many tasks (sources/splitjson.py)."""
    return read_split_json(spark, path)


def read_excel(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet of a workbook, or of each of a folder of workbooks; it is read by many tasks (sources/workbooks.py)."""
    return read_workbooks(spark, path, sheet)


def read_join(left: DataFrame, right: DataFrame, on: list[str], unmatched: str = "refuse") -> DataFrame:
    """Left rows with the other columns of the one right row whose trimmed key text is equal; a gap matches nothing. Repeated right keys
    and other shared columns are refused; left rows without a partner are refused or dropped."""
    shared = [c for c in left.columns if c in right.columns and c not in on]
    if shared:
        raise Refused(f"read.join: both sides have {', '.join(shared)}")
    key = lambda c: F.nullif(trimmed(F.col(f"`{c}`").cast("string")), F.lit(""))
    keyed = right.withColumns({f"_r{i}": key(c) for i, c in enumerate(on)})
    names = [f"_r{i}" for i in range(len(on))]
    twice = keyed.dropna(subset=names).groupBy(*names).count().where("count > 1").limit(3).collect()
    if twice:
        raise Refused(f"read.join: right keys stand twice: {[tuple(r)[:-1] for r in twice]}")
    other = keyed.drop(*on)
    condition: list[Column] = [key(c) == F.col(n) for c, n in zip(on, names, strict=True)]
    if unmatched == "refuse":
        alone = left.join(other, condition, "left_anti").limit(3).collect()
        if alone:
            raise Refused(f"read.join: left rows without a partner: {[tuple(r[c] for c in on) for r in alone]}")
    return left.join(other, condition).drop(*names)


def alone(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left rows without a partner."""
    key = lambda df, c: F.nullif(trimmed(df[c].cast("string")), F.lit(""))
    keys = right.select(*(key(right, c).alias(f"_r{i}") for i, c in enumerate(on)))
    return left.join(keys, [key(left, c) == F.col(f"_r{i}") for i, c in enumerate(on)], "left_anti")


def _named(found: DataFrame, path: str, *others: str) -> DataFrame:
    """path (below the folder), label (its folder) and others of found files; a file at the root is refused."""
    root = path.rstrip("/").rsplit("/", 1)[-1]
    inner = F.regexp_extract("path", f"/{re.escape(root)}/(.*)$", 1)
    named = found.select(inner.alias("path"), F.substring_index(inner, "/", 1).alias("label"), *others)
    if named.where(F.instr("path", "/") == 0).limit(1).count():
        raise Refused("files at the root have no class")
    return named


def _files(spark: SparkSession, path: str, endings: tuple[str, ...]) -> DataFrame:
    """path, label (its folder) and content of the files of a folder of folders; a file at the root is refused."""
    glob = "*.{" + ",".join(endings) + "}"
    return _named(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path), path, "content")


def _classes(df: DataFrame, taken: list[str]) -> DataFrame:
    labels = sorted(r[0] for r in df.select("label").distinct().collect())  # a row for each folder
    clash = sorted(set(labels) & set(taken))
    if clash:
        raise Refused(f"classes are named as columns: {', '.join(clash)}")
    return df.withColumns({w: F.when(F.col("label") == w, 1.0).otherwise(0.0) for w in labels})


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """text, label and a column of 0 and 1 for each class, by relative path."""
    files = _files(spark, path, ("txt",)).select("path", F.decode("content", "UTF-8").alias("text"), "label")
    return _classes(files, ["text", "label", "path"]).orderBy("path").drop("path")


def image_cells(data: bytes, width: int, height: int, channels: int) -> bytes:
    """The samples of an 8-bit PNG (not interlaced) or an uncompressed BMP, row by row; another size is refused."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at, body, head, palette = 8, b"", None, b""
        while at < len(data):
            n, kind = struct.unpack(">I4s", data[at : at + 8])
            chunk = data[at + 8 : at + 8 + n]
            head = struct.unpack(">IIBBBBB", chunk) if kind == b"IHDR" else head
            palette = chunk if kind == b"PLTE" else palette
            body += chunk if kind == b"IDAT" else b""
            at += 12 + n
        w, h, depth, colour, _, _, interlace = head
        own = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
        if depth != 8 or interlace:
            raise Refused("only PNG files of 8 bits that are not interlaced are read")
        raw, stride, rows, before = zlib.decompress(body), w * own, [], bytearray(w * own)
        for y in range(h):
            kind, line = raw[y * (stride + 1)], bytearray(raw[y * (stride + 1) + 1 : (y + 1) * (stride + 1)])
            for x in range(stride):
                a, b, c = (line[x - own] if x >= own else 0), before[x], (before[x - own] if x >= own else 0)
                if kind == 4:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                else:
                    guess = (0, a, b, (a + b) // 2)[kind]
                line[x] = (line[x] + guess) & 255
            rows.append(bytes(line))
            before = line
        pixels = [r[i : i + own] for r in rows for i in range(0, stride, own)]
        pixels = [palette[3 * p[0] : 3 * p[0] + 3] for p in pixels] if colour == 3 else pixels
    elif data[:2] == b"BM":
        start, w, h, bits, packing = *struct.unpack_from("<I", data, 10), *struct.unpack_from("<ii", data, 18), *struct.unpack_from("<HI", data, 28)
        if bits not in (24, 32) or packing not in (0, 3):
            raise Refused("only BMP files of 24 or 32 bits are read")
        own, size = bits // 8, (w * bits // 8 + 3) // 4 * 4
        lines = [data[start + y * size : start + y * size + w * own] for y in range(abs(h))]
        pixels = [bytes((r[i + 2], r[i + 1], r[i], *r[i + 3 : i + own])) for r in (lines[::-1] if h > 0 else lines) for i in range(0, w * own, own)]
        h = abs(h)
    else:
        raise Refused("only PNG and BMP images are read")
    if (w, h) != (width, height):
        raise Refused(f"an image of {w}x{h}, not {width}x{height}")
    if channels == 1:
        return bytes(p[0] if len(p) < 3 or p[0] == p[1] == p[2] else round(0.299 * p[0] + 0.587 * p[1] + 0.114 * p[2]) for p in pixels)
    full = [p if len(p) >= 3 else bytes((p[0],) * 3) + p[1:] for p in pixels]
    return b"".join(p[:3] if channels == 3 else (p + b"\xff")[:4] for p in full)


def _decoded(df: DataFrame, decode) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "label": f["label"], "media": [decode(bytes(c)) for c in f["content"]]})

    return df.mapInPandas(run, "path string, label string, media array<float>")


def image_samples(data: pd.Series, own: pd.Series, channels: int) -> pd.Series:
    """The samples of images as Spark's image source holds them (own channels: 1, or blue, green, red and perhaps alpha), row by row, from
    -1 to 1: one channel is the brightness of the colours, a missing alpha is full."""
    told = []
    for held, n in zip(data, own, strict=True):
        pixels = np.frombuffer(held, np.uint8).reshape(-1, n)
        colours = pixels[:, [2, 1, 0]] if n >= 3 else pixels[:, [0, 0, 0]]
        if channels == 1:
            pixels = pixels[:, :1] if n == 1 else np.rint(colours @ np.array([0.299, 0.587, 0.114]))
        else:
            alpha = pixels[:, 3:] if n == 4 else np.full((len(pixels), 1), 255)
            pixels = np.concatenate([colours, alpha], axis=1)[:, :channels]
        told.append((pixels.astype(np.float64) / 127.5 - 1).ravel())
    return pd.Series(told)


def _photographs(spark: SparkSession, path: str, width: int, height: int, channels: int) -> DataFrame:
    """JPEG and GIF files (of the latter the first picture), decoded by Spark's image source; what it cannot decode is refused when it is read."""
    found = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jpg,jpeg,gif}").load(path)
    size = F.concat(F.lit("an image of "), F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")), F.lit(f", not {width}x{height}: "), F.col("path"))
    wrong = F.when(F.col("width") < 0, F.concat(F.lit("no image that can be read: "), F.col("path"))).when((F.col("width") != width) | (F.col("height") != height), size)
    named = _named(found.select(F.col("image.origin").alias("path"), "image.width", "image.height", "image.nChannels", "image.data"), path, "width", "height", "nChannels", "data")
    there = named.where(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(True))
    samples = F.pandas_udf(lambda data, own: image_samples(data, own, channels), "array<float>")
    return there.select("path", "label", samples("data", "nChannels").alias("media"))


def read_images(spark: SparkSession, path: str, width: int, height: int, channels: int) -> DataFrame:
    """media (samples / 127.5 - 1, row by row), label and a column for each class. PNG, BMP, JPEG and GIF are read; TGA is not."""
    cells = lambda data: [b / 127.5 - 1 for b in image_cells(data, width, height, channels)]
    files = _decoded(_files(spark, path, ("png", "bmp")), cells).unionByName(_photographs(spark, path, width, height, channels))
    return _classes(files, ["media", "label", "path"]).orderBy("path").drop("path")


def read_sounds(spark: SparkSession, path: str, rate: int, length: int, channels: int) -> DataFrame:
    """media (16-bit samples / 32768), label and a column for each class; another rate, length or number of channels is refused."""

    def cells(data: bytes) -> list[float]:
        with wave.open(io.BytesIO(data)) as w:
            if (w.getframerate(), w.getnframes(), w.getnchannels(), w.getsampwidth()) != (rate, length, channels, 2):
                raise Refused(f"a sound of {w.getframerate()} Hz, {w.getnframes()} samples, {w.getnchannels()} channels")
            return [s / 32768 for (s,) in struct.iter_unpack("<h", w.readframes(length))]

    return _classes(_decoded(_files(spark, path, ("wav",)), cells), ["media", "label", "path"]).orderBy("path").drop("path")


INTERVALS = {"1m": 60, "3m": 180, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "2h": 7200, "4h": 14400, "6h": 21600, "8h": 28800, "12h": 43200, "1d": 86400, "3d": 259200, "1w": 604800}
CANDLES = "timestamp string, open string, high string, low string, close string, volume string, quoteVolume string, trades string, takerBuyVolume string, takerBuyQuoteVolume string"


def land_candles(candles: DataFrame, path: str, symbol: str, interval: str, start: int, end: int) -> str:
    """Writes the candles of a closed window [start, end) (seconds) once, with a manifest; returns their fingerprint.

    A landing that is there is verified against its manifest and never overwritten. Candles off the interval's grid, outside the
    window or twice at one moment are refused."""
    step, spark = INTERVALS[interval], candles.sparkSession
    if start % step or end % step or start >= end:
        raise Refused("the window does not lie on the interval's grid")
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    manifest = f"{path}/manifest.json"
    if store.exists(root):
        kept = json.loads(spark.read.text(manifest, wholetext=True).first()[0])
        asked = {"symbol": symbol, "interval": interval, "from": start, "to": end}
        if {k: kept[k] for k in asked} != asked or fingerprint(read_csv(spark, f"{path}/candles")) != kept["fingerprint"]:
            raise Refused(f"{path} holds another landing")
        return kept["fingerprint"]
    t = F.unix_seconds(F.to_timestamp("timestamp"))
    bad = candles.where((t % step != 0) | (t < start) | (t >= end) | t.isNull()).limit(1).collect()
    twice = candles.groupBy("timestamp").count().where("count > 1").limit(1).collect()
    if bad or twice:
        raise Refused(f"candles off the grid, outside the window or twice: {(bad or twice)[0]}")
    candles.orderBy("timestamp").write.option("header", True).csv(f"{path}/candles")
    mark = fingerprint(read_csv(spark, f"{path}/candles"))
    text = json.dumps({"symbol": symbol, "interval": interval, "from": start, "to": end, "fingerprint": mark})
    out = store.create(spark._jvm.org.apache.hadoop.fs.Path(manifest), False)
    out.write(bytearray(text.encode()))
    out.close()
    return mark


def fingerprint(df: DataFrame) -> str:
    """A digest of the rows in any order."""
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(f"`{c}`"), F.lit("\0")) for c in df.columns)), 256)
    parts = df.select(row.alias("d")).groupBy(F.substring("d", 1, 4).alias("p")).agg(F.sort_array(F.collect_list("d")).alias("ds"))
    each = parts.select("p", F.sha2(F.array_join("ds", ""), 256).alias("d")).orderBy("p").collect()  # 65,536 rows at most
    return hashlib.sha256("".join(r["d"] for r in each).encode()).hexdigest()

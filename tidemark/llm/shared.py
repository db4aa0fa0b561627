"""Folders that the driver and every executor see, and how tasks put files there."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_scopes: list[list[str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, as a URI. Where the setting is missing, a temporary folder is set in its place, but only
    if the executors are threads of the driver, as in tests; on a cluster they would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    root = str(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()).rstrip("/")
    return "file://" + root[len("file:") :] if root.startswith("file:/") and not root.startswith("file://") else root


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared root."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes[-1:]:
        scope.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders named within it are deleted at its end: what a stage wrote on the way to a result that has been written elsewhere."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that no later plan reads."""
    for t in tables:
        path = _paths.pop(t, None)
        if path:
            _delete(t.sparkSession, path)


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written once to the shared folder and read again, which cuts its lineage. It stays there until discard() or the end of scratch()."""
    path = workspace(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Jobs started within it delete their shuffles when they end. Otherwise those stay until the driver's collector happens to run."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def spread(df: DataFrame) -> int:
    """How many partitions a shuffle of this session makes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: A key is hot where more than one row in so many holds it; there are fewer of those keys than this.
HOT_SHARE = 1024


def matched(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """rows joined with a written table of one row a key, whose column `weight` counts the rows that hold the key (nulls are equal).

    Hot keys are broadcast, as fewer than HOT_SHARE of them can be there; the others are dealt by key, so that no task gets more than a
    row in HOT_SHARE for one key. Where there are hot keys, rows is read twice. how: 'inner' or 'left'."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    renamed = table.drop(weight).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    told, own = [f"_of_{k}" for k in keys], [c for c in table.columns if c not in keys and c != weight]
    heavy = table.where(F.col(weight) * HOT_SHARE > total)
    met = lambda left, right: [left[k].eqNullSafe(right[f"_of_{k}"]) for k in keys]
    if heavy.limit(1).count() == 0:
        return rows.join(renamed, met(rows, renamed), how).select(*rows.columns, *own)
    hot = F.broadcast(heavy.drop(weight).withColumnsRenamed(dict(zip(keys, told, strict=True))))
    cold = table.where(F.col(weight) * HOT_SHARE <= total).drop(weight).withColumnsRenamed(dict(zip(keys, told, strict=True)))
    first = rows.join(hot, met(rows, hot)).select(*rows.columns, *own)
    others = rows.join(hot.select(*told), met(rows, hot), "left_anti")
    return first.unionByName(others.join(cold, met(others, cold), how).select(*rows.columns, *own))

"""Making this package importable by a session's Python workers, and tables that outlive the plans they come from."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the session's executors once, for clusters where it is not installed."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        root = Path(__file__).parent
        folder = tempfile.mkdtemp(prefix="tidemark-")
        path = os.path.join(folder, "tidemark_package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"tidemark/{f.relative_to(root)}")
        context.addPyFile(path)
        _sent.add(context.applicationId)
    return spark


def kept_path(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir; where that is unset, as in tests, below a temporary folder that only a session of one
    machine can use."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """df written once and read again, so that what was learned does not change with its source."""
    path = kept_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

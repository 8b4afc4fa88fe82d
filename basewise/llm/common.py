"""What the operators share: the scratch folder, staged tables and word splitting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_kept: dict[str, object] = {}


def kept(name: str, make=dict):
    """What a worker process keeps between tasks under ``name``; whatever it kept under another name goes.

    Workers outlive the stages of a pipeline, so that their memos would otherwise add up.
    """
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def released(work):
    """``work`` over a task's batches; at its end the worker gives back what it kept and its free memory.

    Workers stay idle between tasks and stages, while Spark's own share of an executor's memory is in use.
    """

    def run(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from work(batches)
        finally:
            _kept.clear()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # no glibc
                pass

    return run


#: Word separators: space and the ASCII controls from tab to carriage return.
SEPARATORS = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that ``spark.checkpoint.dir`` names.

    Only where that setting is absent (tests on one machine) is a temporary folder set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + os.path.abspath(root)
    return f"{root.rstrip('/')}/basewise/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text as an array (null and blank texts: no words)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def free(name: str, *frames: DataFrame) -> str:
    """A column name like ``name`` that none of the frames has, whatever its case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def named(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def all_columns(df: DataFrame) -> list[Column]:
    return [named(c) for c in df.columns]


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, also where ``use`` has lambdas over it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

"""The folder that driver and executors share, and lineage cuts in it."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; where it is unset a
    temporary folder is set once, on one machine only (tests): a cluster must name one."""
    context = spark.sparkContext
    named = context.getCheckpointDir()
    if not named:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="talus-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


#: The tables written in each scope that is open.
_OPEN: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("open", default=())


def cut(df: DataFrame) -> DataFrame:
    """The rows from the shared folder: a lost executor costs no recomputation of what lies before. They are
    written by column and packed, which takes a fraction of what rows as Spark checkpoints them take."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._talus_path = path
    for tables in _OPEN.get()[-1:]:
        tables.append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote and nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._talus_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A scope at whose end the tables that ``cut`` wrote in it are deleted, but for those that it is told to keep, and
    Spark's cleaner may delete the shuffle files of plans that nothing refers to. What is built on the others must be
    written by then."""
    tables, kept = [], []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(getattr(table, "_talus_path", None))
        return table

    token = _OPEN.set((*_OPEN.get(), tables))
    try:
        yield keep
    finally:
        _OPEN.reset(token)
        for outer in _OPEN.get()[-1:]:
            outer.extend(t for t in tables if t._talus_path in kept)
        gone = [t for t in tables if t._talus_path not in kept]
        drop(*gone)
        if tables:
            jvm = tables[0].sparkSession._jvm
            del tables, gone
            gc.collect()
            jvm.System.gc()

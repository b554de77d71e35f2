"""Where jobs keep what must outlive an executor."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of the tables written within each open scratch() of a thread.
_open = threading.local()


def _stack() -> list[list[str]]:
    if not hasattr(_open, "stack"):
        _open.stack = []
    return _open.stack


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a new local one in local mode, and an error on a cluster."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sweepflow-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, read from the checkpoint folder: nothing before has to be computed again if an executor is lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _write(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage in a way that outlives any executor."""
    found, path = _write(df, label)
    if _stack() and not keep:
        _stack()[-1].append(path)
    return found


class Rounds:
    """Tables of a loop, each of which is made from the one before and takes its place in the shared folder."""

    def __init__(self, label: str) -> None:
        self.label, self.path = label, None

    def store(self, df: DataFrame) -> DataFrame:
        found, path = _write(df, self.label)
        if self.path:
            _delete(df.sparkSession, self.path)
            if _stack() and self.path in _stack()[-1]:
                _stack()[-1].remove(self.path)
        if _stack():
            _stack()[-1].append(path)
        self.path = path
        return found


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that are written inside are deleted at the end, but for those written by the function that it hands out."""
    _stack().append([])
    try:
        yield functools.partial(written, keep=True)
    finally:
        for path in _stack().pop():
            _delete(spark, path)

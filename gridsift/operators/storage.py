"""Tables written between the rounds of iterative operators, in the folder that all machines share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir; where that is unset, a temporary one, if all is one machine."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="gridsift-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def _file_system(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _file_system(spark, path)
    return system.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    system, where = _file_system(spark, path)
    system.delete(where, True)


class Store:
    """Tables written below shared_dir and read again; each cuts the lineage of what follows."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.made = 0
        _OPEN.append(self)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """df, written and read again; an older table of that name is deleted once df, which may use it, is there."""
        old, self.made = self.paths.get(name), self.made + 1
        path = f"{self.root}/{name}-{self.made}"
        df.write.parquet(path)
        if old:
            delete(self.spark, old)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                delete(self.spark, self.paths.pop(name))

    def close(self) -> None:
        """Delete everything; what was built on it can't be read any more."""
        delete(self.spark, self.root)
        self.paths.clear()
        if self in _OPEN:
            _OPEN.remove(self)


_OPEN: list[Store] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Stores that are opened within are deleted at the end, when their results have been written elsewhere or the work has failed."""
    before = list(_OPEN)
    try:
        yield
    finally:
        for store in [s for s in _OPEN if s not in before]:
            store.close()


@atexit.register
def _close_all() -> None:
    """Results are lazy, so their tables stay as long as the process; on a session that has ended nothing can be deleted."""
    if SparkContext._active_spark_context is not None:
        for store in list(_OPEN):
            store.close()

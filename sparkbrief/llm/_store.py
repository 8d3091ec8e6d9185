"""Written tables in the folder that the driver and all executors share.

``spark.checkpoint.dir`` names the folder. Where it is unset, a temporary folder serves a local master (tests, a laptop); on a
cluster the call is refused, since executors would not see each other's files.
A written table cuts lineage and survives the loss of any executor.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_open: list[list[Store]] = []


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get(_KEY, None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sparkbrief-")
        spark.conf.set(_KEY, folder)
    return folder.rstrip("/")


class Store:
    """A private folder of written tables; ``drop`` frees those that later steps no longer read, ``close`` all."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        for held in _open:
            held.append(self)

    def _path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self._path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._store_path = path
        return out

    def put_sorted(self, df: DataFrame, keys: list[str], buckets: int, name: str = "t") -> DataFrame:
        """A table bucketed by ``keys`` and sorted by them in each bucket, so that joins by them need no shuffle of it."""
        path, table = self._path(name), f"run_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
        out = self.spark.table(table)
        out._store_path, out._store_table = path, table
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table made by ``put`` that no pending plan reads."""
        if table := getattr(df, "_store_table", None):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._delete(df._store_path)

    def close(self) -> None:
        """Delete all its tables: when what was read from them has been written elsewhere."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def freed() -> Iterator[None]:
    """Deletes, at the end, the tables of all stores made meanwhile."""
    held: list[Store] = []
    _open.append(held)
    try:
        yield
    finally:
        _open.remove(held)
        for s in held:
            s.close()

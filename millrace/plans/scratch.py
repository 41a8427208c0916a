"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local folder only where it names none and all runs on this machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"millrace-{os.getuid()}")
    return folder.rstrip("/")


class Scratch:
    """Tables written as Parquet: lineage is cut, and a lost executor loses none of them.

    What a returned frame still reads stays until its caller deletes it: settle() does so.
    """

    _own = threading.local()  # what a thread made

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self._made().append(self)

    @classmethod
    def _made(cls) -> list[Scratch]:
        if not hasattr(cls._own, "made"):
            cls._own.made = []
        return cls._own.made

    def save(self, df: DataFrame, label: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}-{label}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def settle(self, make: Callable[[], DataFrame], label: str) -> DataFrame:
        """Save what make() returns, and delete all intermediate tables that were made for it."""
        made = self._made()
        before = len(made)
        saved = self.save(make(), label)
        for other in made[before:]:
            other._delete(other.root)
        del made[before:]
        self._free_shuffles()
        return saved

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that nothing reads any more."""
        for folder in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
            self._delete(folder)
        self._free_shuffles()

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _free_shuffles(self) -> None:
        """Shuffle files of finished writes go once the driver has collected their plans; until then they fill disks."""
        self.spark._jvm.System.gc()

"""Tables written to the shared folder, so that later steps neither recompute nor depend on one executor."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. A temporary one only in a local session (tests) that sets none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="versemill-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


MOST_TASKS = 1 << 16


def deal(df: DataFrame, groups: int, *keys: str, numbered: bool = False) -> GroupedData:
    """``df`` grouped by ``keys`` over as many partitions as there are groups: a task's share doesn't grow with the data.

    ``numbered``: the one key is a whole number below ``groups``, and gives the partition itself, so that no two groups meet by chance.
    """
    n = min(max(1, groups), MOST_TASKS)
    return (df.repartitionById(n, F.col(keys[0])) if numbered else df.repartition(n, *keys)).groupBy(*keys)


class Staging:
    """Parquet tables of one operator call, under a folder of their own.

    A staged table cuts lineage: an executor lost later costs only the tasks that were reading.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/versemill/{label}-{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the written table."""
        path = f"{self.root}/{len(self.paths):03d}-{name}"
        self.paths.append(path)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_path = path  # for drop() and keep()
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables from ``write`` that no later plan reads."""
        self._delete([t._staged_path for t in tables])

    def keep(self, *tables: DataFrame | None) -> None:
        """Delete all tables but these, which a returned plan still reads. The folder's owner may delete those once results are written."""
        kept = {t._staged_path for t in tables if t is not None}
        self._delete([p for p in self.paths if p not in kept])

    def settle(self) -> None:
        """Have Spark remove the shuffle files of plans that are written and let go: it does so when the driver collects garbage, which is seldom."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, paths: list[str]) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in map(jvm.org.apache.hadoop.fs.Path, paths):
            path.getFileSystem(conf).delete(path, True)

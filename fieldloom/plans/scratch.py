"""Tables in the shared folder, and other helpers of plans.

``Scratch.keep`` is the one way lineage is cut here: a Parquet table in the
folder that the cluster names in ``spark.checkpoint.dir``, which survives the
loss of executors and carries no partitioning, so that a later join on it
plans an exchange that adaptive execution can split when a key is hot.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where none is set."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='fieldloom-')}"
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/fieldloom/{uuid.uuid4().hex}-{name}"


class Scratch:
    """Tables written in the shared folder by one operator call.

    ``drop`` removes a table once nothing reads it any more; tables that the
    returned plan still reads stay.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := self.paths.pop(id(df), None):
                delete_path(self.spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def columns_only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, so that extra columns can't clash with working names."""
    return df.select(*[df[n] for n in names])



Queries = dict[str, Callable[[SparkSession, str], DataFrame]]

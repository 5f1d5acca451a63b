"""Where jobs write intermediate tables: the shared folder named by the session.

``spark.checkpoint.dir`` names it. Where that is unset, a local session uses its warehouse folder;
a cluster session must name one, since the folders of single machines are not shared.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_FOLDERS: set[str] = set()


def base_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{base.rstrip('/')}/evenmatch-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove, folder)
    return folder


def _remove(folder: str) -> None:
    """Delete a folder of this session, as long as the session still runs."""
    context = SparkContext._active_spark_context
    if context is not None and context._jsc is not None:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    _FOLDERS.discard(folder)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one table below the shared folder; removed when the program ends."""
    return f"{base_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once and read it back: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    schema = df.schema
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(schema).parquet(path)


class Scratch:
    """Written tables of one job that can be deleted as soon as later ones no longer read them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, shared_dir(spark, name)

    def write(self, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
        """Write ``df`` below this job's folder under a name of its own, and read it back."""
        schema = df.schema
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        context = self.spark.sparkContext
        for name in names:
            path = context._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

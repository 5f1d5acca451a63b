"""Results that later runs reuse: tables bucketed by the key of the content they were made from.

A store is appended to batch by batch and never rewritten. Joins by its key read it bucket by bucket:
only the new batch is shuffled, the store stays where it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.storage import shared_dir


class ResultStore:
    """Rows under a content key, in ``buckets`` buckets; each ``append`` is one version."""

    def __init__(self, spark: SparkSession, name: str, key: str, buckets: int | None = None):
        self.spark, self.key, self.versions = spark, key, 0
        # with fewer buckets than shuffle partitions a join would shuffle the store after all
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table, self.path = f"evenmatch_{name}_{uuid.uuid4().hex[:12]}", shared_dir(spark, name)

    def append(self, rows: DataFrame) -> None:
        """Add the rows of one batch; their keys must be new (see ``missing``)."""
        self.versions += 1
        out = rows.withColumn("version", F.lit(self.versions)).repartition(self.buckets, self.key)
        out.write.mode("append").option("path", self.path).format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(self.table)

    def read(self) -> DataFrame:
        """All rows, without the version."""
        return self.spark.table(self.table).drop("version")

    def missing(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch whose key the store does not have."""
        return batch if not self.versions else batch.join(self.read().select(self.key), self.key, "left_anti")

    def attach(self, batch: DataFrame, how: str = "inner") -> DataFrame:
        """The batch with the stored columns of its keys."""
        return batch.join(self.read(), self.key, how)

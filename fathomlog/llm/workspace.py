"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: a lost executor
then costs a re-read, never a recomputation, and unlike a local checkpoint nothing
lives on one machine only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomlog.shipping import ship
from fathomlog.storage import new_root, remove

#: Rows of one Arrow batch sent to Python: whole texts can be long.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts takes in a Python worker; ship the package there."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Workspace:
    """Tables of one operator call. ``drop`` frees what later steps do not read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = new_root(spark, name)
        small_batches(spark)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Write and re-read; several calls with one name replace the path by numbering."""
        df.write.mode("error").options(**options).parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.path(name))

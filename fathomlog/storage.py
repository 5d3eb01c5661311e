"""Tables that cut lineage: Parquet below the shared folder, readable after any executor is lost."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only in a local session that names none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and the executors share")
        path = "file://" + tempfile.mkdtemp(prefix="fathomlog-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_ROOTS: list[tuple[SparkSession, str]] = []


def new_root(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one, until ``clean`` or the end of the driver's program."""
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _ROOTS.append((spark, root))
    return root


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def clean() -> None:
    """Delete all intermediate tables; results that still read them cannot be used any more."""
    while _ROOTS:
        spark, root = _ROOTS.pop()
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):
                remove(spark, root)


class Store:
    """Tables of one program run, numbered as they are written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = new_root(spark, "program")
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame) -> tuple[DataFrame, int]:
        """The table and its rows, by the files' own counts."""
        table = self.keep(df)
        return table, table.count()

"""Scratch tables in the folder that the driver and all executors share.

A table written here cuts the lineage and outlives a lost executor.  The folder is the one that
the session names in ``spark.checkpoint.dir``; only where that is unset and the session is local
(tests, a laptop) a temporary folder is used.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the session, without a slash at its end."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="cartaspark-"))
        named = _LOCAL[0]
    return named.rstrip("/")


def hadoop_fs(spark: SparkSession, path: str):
    """(FileSystem, Path) of Hadoop for a path; works for every store that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class Scratch:
    """A folder of intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, records: int = 2000, by: str | None = None) -> DataFrame:
        """Write a table (in folders of the values of `by`) and return it as read back.  `records` bounds the rows of an Arrow batch meanwhile: few for wide rows."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(BATCH)
        self.spark.conf.set(BATCH, str(min(records, int(before)) if int(before) > 0 else records))
        try:
            df.write.option("compression", "zstd").parquet(path, partitionBy=by)
        finally:
            self.spark.conf.set(BATCH, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            fs, at = hadoop_fs(self.spark, f"{self.root}/{name}")
            with contextlib.suppress(Exception):
                fs.delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name

"""Intermediate tables of one job, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tillcast.session import shared_checkpoint_dir
from tillcast.sources.tables import remove_folder


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share. A session within one process may go without the setting: it has a temporary one."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.startswith("local["):
        return f"file://{tempfile.mkdtemp(prefix='tillcast-')}"
    return shared_checkpoint_dir(spark)


class Scratch:
    """A folder below ``spark.checkpoint.dir`` that holds the staged tables of a job until they are dropped.

    A staged table is computed once, whatever reads it, and outlives lost executors.
    """

    def __init__(self, spark: SparkSession, job: str) -> None:
        self.spark = spark
        self.path = f"{scratch_root(spark)}/tillcast/{job}-{uuid.uuid4().hex}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete the folder; tables read from it are no longer usable."""
        remove_folder(self.spark, self.path)

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *failure) -> None:
        self.drop()

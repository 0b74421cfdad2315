"""Written intermediate tables.

A result that several later steps read is written once as parquet to the shared checkpoint
folder and read back. This cuts the lineage (a lost executor costs a re-read, not another pass
over the order lines) and gives Spark the true size of the table, so the planner itself decides
whether it may be broadcast (``spark.sql.autoBroadcastJoinThreshold``) or has to be shuffled.

Without such a folder nothing is written: later steps compute the result again.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str | None:
    """The folder all executors can reach: what ``spark.checkpoint.dir`` names, if it is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured.rstrip("/") if configured else None


class StagingArea:
    """A folder of its own under the shared one, for the written tables of one run. Made when first written to."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._written = 0

    @cached_property
    def root(self) -> str | None:
        shared = shared_dir(self.spark)
        return f"{shared}/ordercast-{uuid.uuid4().hex}" if shared else None

    def path(self, name: str) -> str:
        """A path below the folder that has not been handed out before."""
        if not self.root:
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        self._written += 1
        return f"{self.root}/{self._written:03d}-{name}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the written table; without a folder, ``df`` itself."""
        if not self.root:
            return df
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Delete the folder. Tables staged in it, and results not yet computed from them, are gone."""
        if self._written:
            files, path = fs.FileSystem.from_uri(self.root)
            files.delete_dir(path)
            self._written = 0
            del self.root

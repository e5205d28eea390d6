"""Tables that an operator writes to the shared folder while it works."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from panelmill.session import ensure_checkpoint_dir, owned


class Stores:
    """Owns a folder below the checkpoint folder of the session.

    ``keep`` writes a table there and reads it back, which cuts lineage and
    survives lost executors. ``drop`` deletes tables that nothing reads any more;
    the folder goes with the session's scope (``panelmill.session.scope``), as the
    lazy result of an operator may still read it.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.root = owned(spark, f"{spark.sparkContext.getCheckpointDir()}/llm-{uuid.uuid4().hex}")
        self._next = 0

    def path(self, name: str) -> str:
        self._next += 1
        return f"{self.root}/{name}-{self._next}"

    def keep(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.stored_at = path
        return kept

    def drop(self, *kept: DataFrame) -> None:
        """Delete tables whose last reader has finished."""
        for df in kept:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

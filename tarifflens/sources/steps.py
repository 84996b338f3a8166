"""Tables between the steps of a job, in the folder that all executors share. They cut the lineage, so that later steps are planned fast and a lost executor costs one step."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where nothing is named, one is made only in local mode, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tarifflens-"))
    return context.getCheckpointDir()


class Steps:
    """The tables of one job."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, frame: DataFrame) -> DataFrame:
        """frame, written."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def delete(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

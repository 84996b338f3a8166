"""An extension: the batch ingest over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.rows import parse_rows
from ..sources.files import read_grids


def parsed(files: DataFrame) -> DataFrame:
    """Parsed rows of rows (path, content)."""
    return parse_rows(read_grids(files).drop("page"), ["path"])


def start(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """A query that appends the parsed rows of new files in folder to a table of Parquet files, all that are there at once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def write(batch: DataFrame, n: int) -> None:
        parsed(batch.select("path", "content")).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

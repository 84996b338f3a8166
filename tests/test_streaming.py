"""The ingest over arriving files gives the rows that the batch gives."""

from pyspark.sql import functions as F

from tarifflens.sources import writers
from tarifflens.streaming import ingest


def test_arriving_files_are_parsed(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for n in range(2):
        (folder / f"{n}.docx").write_bytes(writers.docx([["Код", "Наименование услуги", "Цена"], [f"A{n}", f"blood count {n}", "1000"]]))
        ingest.start(spark, str(folder), out, str(tmp_path / "checkpoint")).awaitTermination()
    found = spark.read.parquet(out).select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "service_name_raw", "price_resident")
    assert sorted(map(tuple, found.collect())) == [(f"{n}.docx", f"blood count {n}", 1000.0) for n in range(2)]

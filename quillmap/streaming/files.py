"""The same per-document parse over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.plans.parsing import parsed
from quillmap.sources.corpus import FILES


def parsed_stream(spark: SparkSession, folder: str, pattern: str = "*.xml", files_per_batch: int = 1000) -> DataFrame:
    """Parsed rows of new files. Documents are independent: no state, no watermark."""
    read = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    rows = read.option("maxFilesPerTrigger", files_per_batch).load(folder)
    return parsed(rows.select(F.col("path").alias("doc_id"), "content"))

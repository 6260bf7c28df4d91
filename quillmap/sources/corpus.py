"""Corpora of documents as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, modificationTime timestamp, length long, content binary"


def files(spark: SparkSession, folder: str, pattern: str = "*.xml") -> DataFrame:
    """(doc_id, content) of every file below a folder; doc_id is its path."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return read.load(folder).select(F.col("path").alias("doc_id"), "content")


def java_sources(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of every Java file below a folder."""
    return files(spark, folder, "*.java").select(F.col("doc_id").alias("path"), F.col("content").cast("string").alias("text"))


def column(table: DataFrame, doc_id: str, content: str) -> DataFrame:
    """(doc_id, content) from any table's columns."""
    return table.select(F.col(doc_id).alias("doc_id"), F.col(content).alias("content"))

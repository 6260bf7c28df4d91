"""Tables in a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def workspace(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only where it is unset and the master is local a local folder takes its
    place. On a cluster executors would each write to their own disk: that raises.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is not set, and with master {master} a local folder is not shared")
        base = f"file://{tempfile.gettempdir()}/quillmap-work"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{workspace(spark)}/quillmap/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder.

    This cuts the lineage: a lost executor costs no more than the tasks that
    ran on it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables made by :func:`written`, once nothing reads them any more."""
    for df in tables:
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            deleted(df.sparkSession, folder)


def cleared(spark: SparkSession) -> None:
    """Deletes all such tables in the workspace, also those that results yet to be computed need."""
    deleted(spark, f"{workspace(spark)}/quillmap")

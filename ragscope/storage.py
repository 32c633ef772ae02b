"""Intermediate tables in the shared folder, and small files next to data.

``store`` cuts lineage: a table that several jobs read is written once to the
folder that ``spark.checkpoint.dir`` names, so a lost executor costs a reread.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ragscope.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Spark's file system for ``path`` and the path itself: any storage that
    the executors see."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file: a marker that what stands beside it is whole."""
    fs, p = file_system(spark, path)
    fs.create(p, True).close()

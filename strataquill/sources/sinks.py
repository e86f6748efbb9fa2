"""Sinks: JSON-lines traces, append-only logs, version directories that a pointer row makes current."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trace(df: DataFrame, path: str) -> None:
    """One JSON line per row, appended; a failed write fails the call."""
    df.write.mode("append").json(path)


def commit_version(rows: DataFrame, root: str, version: str, pointers: str, keys: Sequence[str], expected: int) -> bool:
    """Write a version directory, check its row count, then append the pointer row that makes it current.

    A version that is already there with the expected rows is only pointed to again. Returns whether rows were written;
    raises ValueError, and leaves the pointer as it is, if the count is not as expected.
    """
    spark, path = rows.sparkSession, f"{root}/version={version}"
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files)
    if not there:
        rows.write.mode("overwrite").parquet(path)
    count = spark.read.parquet(path).count()
    if count != expected:
        raise ValueError(f"version {version} has {count} rows, expected {expected}")
    point = spark.range(1).select(*(F.lit(k).alias(f"key{i}") for i, k in enumerate(keys)), F.lit(version).alias("version"), F.current_timestamp().alias("switched_at"))
    point.write.mode("append").parquet(pointers)
    return not there

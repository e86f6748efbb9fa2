"""Session set-up and the shared folder that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "strataquill", cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine relies on: UTC, adaptive execution, Arrow."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.dataFrameQueryContext.enabled": "false",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, read from ``spark.checkpoint.dir``.

    Only a local session, whose executors are threads of this process, may leave it unset and is given a temporary folder;
    on a cluster a missing setting raises ValueError, as a folder of one machine would be lost to the others.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="strataquill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a cut in the lineage that survives the loss of executors.

    The table is removed when the application ends, or before by ``remove_written``.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing is written to yet; what will be is removed as ``written`` says."""
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    system, place = _file_system(spark, path)
    system.deleteOnExit(place)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: Tables written to shared folders, by application.
_WRITTEN: dict[str, list[str]] = {}


def _file_system(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there."""
    system, place = _file_system(spark, path)
    return system.exists(place)


def remove_written(spark: SparkSession) -> int:
    """Removes the tables ``written`` so far in this application; returns how many. No frame built on them may be used after."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        system, place = _file_system(spark, path)
        system.delete(place, True)
    return len(paths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a scale-factor directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

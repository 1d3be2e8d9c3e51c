"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: str = "*", shuffle_partitions: int = 8, app_name: str = "orderlore") -> SparkSession:
    """Local session for tests and the bench; a cluster passes its own session in."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


# temporary folders of local sessions that name none, by application
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: spark.checkpoint.dir, else the one given to setCheckpointDir.

    A local session that names neither gets a temporary folder, which goes when the program ends. On a cluster a folder
    of the driver's machine would lose data, so there a missing setting is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        given = context._jsc.sc().getCheckpointDir()
        folder = given.get() if given.isDefined() else None
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if context.applicationId not in _local_folders:
            _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="orderlore-")
            atexit.register(shutil.rmtree, _local_folders[context.applicationId], ignore_errors=True)
        folder = _local_folders[context.applicationId]
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; nothing is ever overwritten in place."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    Cuts the lineage so that several readers share one computation, and survives the loss of
    executors, which cached blocks do not.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

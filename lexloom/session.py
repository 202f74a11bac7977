"""Session defaults and the checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

def session(name: str = "lexloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ensure_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder named in spark.checkpoint.dir; without one, to a temporary one, on a local master only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexloom-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; without one, a temporary one, on a local master only."""
    ensure_checkpoints(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of the shared file system, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df, materialised in the checkpoint folder, with a plan of its own: for small tables that a plan meets many times."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()

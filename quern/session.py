"""Session factory."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the library's semantics rely on.

    Time zone UTC (naive timestamps are truncated in it), ANSI arithmetic and
    adaptive execution; further settings by name with ``__`` for dots.
    """
    builder = SparkSession.builder.appName("quern")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return builder.config(map=settings | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate files that the driver and all executors share: ``spark.checkpoint.dir``.

    One machine alone has none to share; there it is a folder of the warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


def scratch(spark: SparkSession) -> str:
    """A new name for a folder in the shared place."""
    return f"{shared_folder(spark)}/quern-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as files in the shared place, so that what follows does not make them anew."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)

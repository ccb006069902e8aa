"""A session with the settings that the library is tested with, and where lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "changeloom", **settings: str) -> SparkSession:
    """Adaptive plans, UTC; further settings by their Spark names with dots as two underscores."""
    conf = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return SparkSession.builder.appName(name).config(map=conf | {k.replace("__", "."): v for k, v in settings.items()}).getOrCreate()


def cut(df: DataFrame, measured: bool = False) -> DataFrame:
    """Computes df and writes it to the checkpoint folder, so that a loop's plan doesn't grow with its rounds.

    A checkpoint keeps the plan's estimate of its size, a product over joins: in a loop that joins what its last round has made, a number
    whose digits double each round, until the driver's memory is full of it. With ``measured`` rows are held meanwhile and counted.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    if not measured:
        return df.checkpoint()
    held = df.persist()
    held.count()
    made = held.checkpoint()
    held.unpersist()
    return made

"""Session settings that the operators assume."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build(master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS, and settings of one's own; spark_sql_x stands for spark.sql.x."""
    builder = SparkSession.builder.appName("docloom")
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once: it needn't be installed on the executors."""
    sc = spark.sparkContext
    if getattr(sc, "_docloom_shipped", False):
        return
    root, held = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("docloom", os.path.relpath(path, root)))
    path = os.path.join(tempfile.mkdtemp(prefix="docloom-"), "docloom-package.zip")  # Spark copies it from here to the executors
    with open(path, "wb") as out:
        out.write(held.getvalue())
    sc.addPyFile(path)
    sc._docloom_shipped = True


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: that of spark.checkpoint.dir. Only a local session, which has no other machines, gets one
    of its own where that is unset; elsewhere it's an error, because a folder of one machine is lost with it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="docloom-checkpoints-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)

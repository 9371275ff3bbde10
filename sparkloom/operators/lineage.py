"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset and the master is in-process (tests) is
    a temporary folder chosen here; on a cluster a missing setting is an error rather than a machine-local folder.
    """
    ensure_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ensure_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate data, set as the checkpoint folder of the session."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="sparkloom-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession) -> str:
    """A new name inside that folder."""
    return f"{ensure_folder(spark)}/{uuid.uuid4().hex}"

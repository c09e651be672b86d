"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="termloom-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the cluster's shared folder.

    The folder is ``spark.checkpoint.dir``; only a local session without that
    setting gets a temporary one, deleted at its end. Lost executors lose nothing of the result.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def beside(df: DataFrame, row: DataFrame) -> DataFrame:
    """``df`` with the columns of ``row``, a table of exactly one row such as a global aggregate."""
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(row.withColumn("__one", F.lit(1))), "__one").drop("__one")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for files that are written and read again, in the shared folder of checkpoints."""
    _checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"

"""Steps of a plan that are written once and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where that is unset, in local mode."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        known = spark.conf.get("spark.checkpoint.dir", None)
        if known is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(known or tempfile.mkdtemp(prefix="framesieve-"))
    return context._jsc.sc().getCheckpointDir().get()


def step_folder(spark: SparkSession, name: str) -> str:
    """A new folder of that name in the shared one."""
    return f"{_shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, made once and kept in the shared folder, so that whatever reads it neither makes it again nor depends on the
    executors that did."""
    _shared(df.sparkSession)
    return df.checkpoint()

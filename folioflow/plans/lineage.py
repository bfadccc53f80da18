"""Cutting lineage so that iterative jobs survive lost executors.

Everything that is cut goes to the folder all executors share, which the session
names in ``spark.checkpoint.dir``. Only a local session without that setting, as
in tests, gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; sets the context's checkpoint folder if needed."""
    context = spark.sparkContext
    wanted = context.getConf().get(_SETTING, None) or spark.conf.get(_SETTING, None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return wanted or current.get()
    if not wanted:
        if not context.master.startswith("local"):
            raise RuntimeError(f"{_SETTING} is not set: a cluster needs a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="folioflow-")
    context.setCheckpointDir(wanted)
    return wanted


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from the shared folder from here on."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)

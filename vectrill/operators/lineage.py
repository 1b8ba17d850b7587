"""Cutting the lineage of iterative jobs in the folder that executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in spark.checkpoint.dir. Where that is unset, a local session gets a
    folder of its own; on a cluster it is an error, as other machines couldn't read that folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="vectrill-"))
    return df.checkpoint()

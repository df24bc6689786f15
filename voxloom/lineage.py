"""Cutting the lineage of tables that loops build up."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the folder that ``spark.checkpoint.dir`` names.

    Only a session in local mode without one (a test) gets a folder of this machine; on a cluster that is an error.
    """
    sc, named = df.sparkSession.sparkContext, df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not re.match(r"local(\[[^-]*\])?$", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="voxloom-"))
    return df.checkpoint(eager=True)

"""Lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint: loops keep short plans and survive lost executors.

    The folder is the one of spark.checkpoint.dir. Where none is set, a session on one machine,
    as in tests, gets a temporary one; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="lattica-graph-"))
    return df.checkpoint(eager=True)

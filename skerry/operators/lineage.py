"""Cutting lineage in driver loops."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder the cluster shares (spark.checkpoint.dir). Without that setting a session
    with a local master, as in tests, uses a folder in /tmp; on a cluster it is an error."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        context.setCheckpointDir(folder or "/tmp/checkpoints")
    return df.checkpoint(eager=True)

"""State that outlives a round of an iterative operator: reliable checkpoints in the shared folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``. A local master without that setting gets a folder of its own; a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or f"/tmp/clonoframe-checkpoint-{uuid.uuid4().hex}")
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to ``checkpoint_folder``, with its lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)

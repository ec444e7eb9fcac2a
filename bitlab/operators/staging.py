"""Fixed versions of tables between rounds of iterative operators, in the folder that executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder, without lineage; it survives lost executors.

    The folder is ``spark.checkpoint.dir``; where that is unset, local sessions take a temporary folder and clusters raise.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        root = context.getConf().get("spark.checkpoint.dir", "")
        if not root and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="bitlab-"))
    return df.checkpoint()

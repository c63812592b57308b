"""Results that are written to the shared checkpoint folder, where their lineage ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df as Parquet in the session's spark.checkpoint.dir, read again.

    Only where that is unset and all runs in one process, a temporary folder is set; on a cluster that is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset; on a cluster it must name a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="checkpoints-"))
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

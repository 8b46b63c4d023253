"""Tables that driver and executors share while a job runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent and all runs in this process (tests), a folder of this machine is set; ValueError
    if the executors are elsewhere.
    """
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not top:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        top = given.get() if given.isDefined() else None
    if not top:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="siltstone-checkpoints-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/siltstone-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows written to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a table may have to be sent to every task.
FEW = 100_000


def small(df: DataFrame, rows: int = FEW) -> DataFrame:
    """The table, marked for broadcast if a count shows that it has few rows; else as it is, to be joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

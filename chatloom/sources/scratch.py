"""Tables written between the steps of a workload, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir (a new local folder where a local session has none)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="chatloom-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, group: int | None = None) -> DataFrame:
    """Write df as Parquet in a new folder and read it back; large rows in groups of so many, as a reader holds a whole group."""
    path = new_dir(df.sparkSession, name)
    (df.write if group is None else df.write.option("parquet.block.row.count.limit", group)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Cutting lineage: write an intermediate table to the shared folder.

A frame that several jobs read (the customer profile, cluster features) is
written once as Parquet into the folder named by ``spark.checkpoint.dir`` and
read back.  The table survives the loss of executors, later jobs prune its
columns, and its real size is known to the optimizer.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="basketlens-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


# Drops a query's shuffle files when it ends; otherwise they stay until the driver happens to collect garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_stage(df: DataFrame, name: str, clean_up: bool = False, compression: str | None = None) -> DataFrame:
    """Materialise ``df`` once and return a frame that reads the stored table; with ``clean_up`` its shuffle files go at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/basketlens/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true" if clean_up else before)
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)

"""The folder that driver and executors share, and cutting lineage there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not (master.startswith("local[") or master == "local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_dir()
    return base.rstrip("/")


@lru_cache(1)
def _local_dir() -> str:
    """One temporary folder for this process, removed when it ends."""
    folder = tempfile.mkdtemp(prefix="kgraph-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, so that loops don't pile up lineage and a
    lost executor costs no finished round."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/kgraph/{uuid.uuid4().hex[:12]}-{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders that this session has made.
_made: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors share.

    Only a local session may do without that setting; it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
        base = tempfile.mkdtemp(prefix="namefold-")
        spark.conf.set("spark.checkpoint.dir", base)
    _made.append(f"{base.rstrip('/')}/namefold-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession) -> None:
    """Delete the folders made so far; call it when all results that read them are written."""
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """``stored``, and the shuffle files that led there go, so that disk holds those of one step at a time.

    They go with the plan that made them, so the caller should not keep ``df``.
    """
    spark, out = df.sparkSession, stored(df)
    del df
    for _ in range(2):  # the cleaner learns of what the first round finds
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)
    return out

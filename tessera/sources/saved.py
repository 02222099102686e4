"""Intermediate tables kept in the folder that all executors share, and rows numbered in order without one task seeing all."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a local one where that isn't set and Spark runs in one process (tests)."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="tessera-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """df computed once and kept in the folder that all executors share, with its lineage cut.

    Spark removes it when nothing refers to it any more, if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def placed(df: DataFrame, by: list[str], to: str = "place", rows: int | None = None) -> DataFrame:
    """df with its place in the order of `by`, 0, 1, ...: range partitions are sorted, and counted on from one another.

    rows: about how many there are, if known; a partition holds about 500,000. One number a partition comes to the driver.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(cores, 64)) if rows is None else max(1, min(-(-rows // 1000), max(cores, -(-rows // 500_000))))
    dealt = saved(df.repartitionByRange(parts, *by).sortWithinPartitions(*by)).withColumn("_tz_at", F.monotonically_increasing_id())
    sizes = dict(dealt.groupBy(F.shiftright("_tz_at", 33).cast("int")).count().collect())
    before, offsets = 0, []
    for part in range(max(sizes, default=-1) + 1):
        offsets.append(before)
        before += sizes.get(part, 0)
    begin = F.get(F.array(*(F.lit(x).cast("long") for x in offsets or [0])), F.shiftright("_tz_at", 33).cast("int"))
    return dealt.withColumn(to, begin + F.col("_tz_at").bitwiseAND((1 << 33) - 1)).drop("_tz_at")

"""Helpers shared by the operators: durable lineage cuts and column names."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("an active SparkSession is needed")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is absent, which is allowed in local mode alone, a folder is made here.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="cellweave-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from those files.

    A reliable checkpoint: it survives lost executors. Spark removes the files of a plan
    that is gone only with spark.cleaner.referenceTracking.cleanCheckpoints=true; see release.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*dfs: DataFrame) -> None:
    """Delete the files of checkpoints that nothing will read again, as a later checkpoint holds what they led to."""
    for df in dfs:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        for k in range(leaves.size()):
            if leaves.apply(k).nodeName() == "LogicalRDD":
                file = leaves.apply(k).rdd().getCheckpointFile()
                if file.isDefined():
                    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
                    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def same(a: Column, b: Column) -> Column:
    """Null-safe equality."""
    return a.eqNullSafe(b)


def finite(c: Column) -> Column:
    """c as a double, with NaN and infinities turned to NULL."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(None)).otherwise(d)

"""The folder that all nodes of a cluster share, for tables between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset a temporary folder serves a local session, as in tests;
    on a cluster each executor would write to a disk of its own, so that is an
    error.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all nodes share (master {master})")
        folder = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the driver's JVM ends."""
    where = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here, and rows dealt by place keep theirs."""
    where = new_folder(df.sparkSession, "table")
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)

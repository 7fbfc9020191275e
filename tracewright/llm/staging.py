"""Tables between jobs, in the folder that all nodes of the cluster share."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_folder


#: Tables staged within each open ``temporary`` block of a thread of the driver: ``blocks``, the innermost last.
_open = threading.local()


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here.

    Any executor can read the result, so a lost executor costs nothing.  The
    files go when an enclosing ``temporary`` block or the driver's JVM ends.
    """
    spark = df.sparkSession
    where = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(where)
    path, system = _path(spark, where)
    system.deleteOnExit(path)
    if getattr(_open, "blocks", None):
        _open.blocks[-1].append(where)
    return spark.read.schema(df.schema).parquet(where)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that this thread stages inside go at the end, and what else is listed; what is read from them must have been written by then."""
    _open.blocks = [*getattr(_open, "blocks", []), []]
    try:
        yield _open.blocks[-1]
    finally:
        for where in _open.blocks.pop():
            path, system = _path(spark, where)
            system.delete(path, True)


def _path(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_name(columns: Iterable[str], base: str) -> str:
    """``base``, lengthened until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def columns_of(df: DataFrame) -> list[Column]:
    """All columns by their exact names, whatever characters these hold."""
    return [named(c) for c in df.columns]


def named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


#: Rows of a text table that one Arrow batch holds, at most.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches: rows hold whole texts, and a batch is in memory on both sides of a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(key))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def repeatable(df: DataFrame) -> DataFrame:
    """``df`` itself where it only selects from files, so that a task that runs again reads the same rows; else staged."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter") and plan.children().size() == 1:
        plan = plan.children().apply(0)
    return df if plan.nodeName().startswith("Relation") or plan.nodeName() in ("LogicalRelation", "RelationV2") else staged(df)


def map_rows(docs: DataFrame, run, into: str, kind: T.DataType) -> DataFrame:
    """``mapInArrow`` that keeps all columns and adds ``into``: ``run`` names its batches' columns c0, c1 and so on.

    Columns go by position meanwhile, as mapInArrow cannot name all that Spark can.
    """
    if into != fresh_name(docs.columns, into):
        raise ValueError(f"the input has a column {into}")
    plain = [f"c{i}" for i in range(len(docs.columns) + 1)]
    fields = [*docs.schema.fields, T.StructField(into, kind)]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(plain, fields, strict=True)])
    return docs.toDF(*plain[:-1]).mapInArrow(run, schema).toDF(*docs.columns, into)

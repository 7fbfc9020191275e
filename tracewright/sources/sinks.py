"""Sinks: replaced tables, appended tables, and reports rendered from aggregates."""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_json(df: DataFrame, where: str) -> None:
    """Write beside the target, move the old table aside and the new one in; a failure puts the old one back.

    Between the two renames a reader may find nothing, never a part of a table.
    """
    spark = df.sparkSession
    fresh = f"{where.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.json(fresh)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(where).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = f"{fresh}.old"
    had = fs.exists(path(where))
    if had and not fs.rename(path(where), path(aside)):
        fs.delete(path(fresh), True)
        raise OSError(f"{where} could not be moved aside; it stays as it was")
    if not fs.rename(path(fresh), path(where)):
        if had:
            fs.rename(path(aside), path(where))
        raise OSError(f"{fresh} could not be moved to {where}; the old table is back")
    if had:
        fs.delete(path(aside), True)


def write_named(rows: DataFrame, where: str) -> list[str]:
    """(name, nth, raw) as a tree: one text file below ``where`` for each name, lines by ``nth``; gives the files' paths.

    Names may hold slashes; a file that is there already is replaced.  Each
    name is moved to its place by the driver, so this is for trees of days or
    shards, some thousands of files, not for a file of each session of a large
    table.
    """
    spark = rows.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(where).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    staged = f"{where.rstrip('/')}.{uuid.uuid4().hex}"
    rows.repartition("name").sortWithinPartitions("name", "nth").select("raw", "name").write.partitionBy("name").text(staged)
    out = []
    for folder in fs.globStatus(path(f"{staged}/name=*")):
        target = path(f"{where.rstrip('/')}/{unquote(folder.getPath().getName().removeprefix('name='))}")
        (part,) = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
        fs.mkdirs(target.getParent())
        fs.delete(target, False)
        if not fs.rename(part, target):
            raise OSError(f"{part.toString()} could not be moved to {target.toString()}")
        out.append(target.toString())
    fs.delete(path(staged), True)
    return sorted(out)


def append_trace(events: DataFrame, where: str) -> None:
    """Append traced events (kind, payload) as JSON lines, stamped with the time of writing."""
    events.select(F.current_timestamp().alias("ts"), "kind", "payload").write.mode("append").json(where)


def append_incidents(df: DataFrame, where: str) -> None:
    df.write.mode("append").partitionBy("corpus", "detector").parquet(where)


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    """Rows of an aggregate, already collected, as a table."""
    show = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [f"| {' | '.join(columns)} |", f"|{'|'.join(' --- ' for _ in columns)}|"]
    return "\n".join(lines + [f"| {' | '.join(show(r[c]) for c in columns)} |" for r in rows])


def metrics_json(summary: DataFrame) -> str:
    """A one-row summary as JSON; raw rows are no part of it."""
    return json.dumps(json.loads(summary.select(F.to_json(F.struct("*"))).first()[0]), indent=2, sort_keys=True)

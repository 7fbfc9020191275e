"""A kept table of files: what each is, how old, how large, and its first line.

A refresh lists the tree without reading it and reads the first lines of files
that are new or changed alone, so its cost follows what changed.  Sessions,
their sub-agents' files and the transcripts of a folder are then joins and
groupings on the table, at any number of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import listing, plain_path, there
from .shared import written
from .versions import read_table, replace_table, versions

SCHEMA = "path string, modified timestamp, bytes bigint, head string, seen bigint"
_SAME = ["path", "modified", "bytes"]


def refresh_index(spark: SparkSession, root: str, where: str, glob: str | None = None) -> DataFrame:
    """Bring the index at ``where`` up to date with the files below ``root``, and give it: (path, modified, bytes, head, seen).

    ``seen`` is the number of the refresh that last read the file.  Files that
    are gone leave the index; a file of another time or size is read again, one
    whose time and size are as before is taken to be the same.  Files without a
    byte are skipped by Spark's scans and are no part of it.  A refresh that finds nothing new writes nothing.  The new table
    becomes visible at once, as a version of its own.
    """
    known = versions(spark, where)
    old = read_table(spark, where) if known else spark.createDataFrame([], SCHEMA)
    files = listing(spark, root, glob, recursive=True) if there(spark, root) else spark.createDataFrame([], "path string, modified timestamp, bytes bigint")
    now = written(files.select(plain_path(F.col("path")).alias("path"), "modified", "bytes"))
    changed = now.join(old, _SAME, "left_anti")
    oldest = changed.agg(F.date_format(F.to_utc_timestamp(F.min("modified"), F.current_timezone()) - F.expr("INTERVAL 1 SECOND"), "yyyy-MM-dd'T'HH:mm:ss")).first()[0]
    if oldest is None and known and old.join(now, _SAME, "left_anti").isEmpty():
        return old
    number = F.lit(max([n for n, _ in known], default=0) + 1).cast("long")
    table = old.join(now, _SAME, "left_semi")
    if oldest is not None:
        heads = first_lines(spark, root, glob, oldest)
        table = table.unionByName(changed.join(heads, "path", "left").select(*_SAME, "head", number.alias("seen")))
    replace_table(table, where)
    return read_table(spark, where)


def first_lines(spark: SparkSession, root: str, glob: str | None = None, modified_after: str | None = None) -> DataFrame:
    """(path, head) of files below ``root``; those not after ``modified_after`` (a time in UTC, as text) stay unread."""
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after).option("timeZone", "UTC")
    rows = reader.text(root).where(F.col("_metadata.file_block_start") == 0)
    each = rows.select(plain_path(F.col("_metadata.file_path")).alias("path"), F.monotonically_increasing_id().alias("nth"), "value")
    return each.groupBy("path").agg(F.min_by("value", "nth").alias("head"))


def session_files(index: DataFrame, root: str) -> DataFrame:
    """(…, project, session, kind): main files lie directly in a project's folder, sub-agents' at any depth below ``session/subagents``.

    What is neither is left out.
    """
    base = plain_path(F.lit(root.rstrip("/") + "/"))
    rel = F.when(F.startswith("path", base), F.substring(F.col("path"), F.length(base) + 1, F.length("path")))
    main, sub = r"^([^/]+)/([^/]+)\.jsonl$", r"^([^/]+)/([^/]+)/subagents/(?:.+/)?[^/]+\.jsonl$"
    kind = F.when(rel.rlike(main), "main").when(rel.rlike(sub), "sub")
    part = lambda k: F.when(kind == "main", F.regexp_extract(rel, main, k)).otherwise(F.regexp_extract(rel, sub, k))
    return index.select("*", part(1).alias("project"), part(2).alias("session"), kind.alias("kind")).where("kind IS NOT NULL")


def newest_of(index: DataFrame, field: str) -> DataFrame:
    """(value, path, modified, seen): for each value of a field of the first lines, such as a working folder, the newest file; ties by path."""
    value = F.try_variant_get(F.try_parse_json("head"), field, "string")
    named = index.withColumn("value", value).where("value IS NOT NULL")
    return named.groupBy("value").agg(F.max(F.struct("modified", "path", "seen")).alias("x")).select("value", "x.path", "x.modified", "x.seen")

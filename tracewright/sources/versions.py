"""Tables that are replaced whole, as versions beside one another and a pointer to the newest.

A version is a folder that nobody changes once it is named.  A file in the
folder of pointers names it by its number; it is put there by one rename that
fails where the number is taken.  Readers take the highest pointer, so they find
one whole version at any moment, and of two writers one learns that it was late.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_POINTERS, _DATA = "_versions", "data"


class Overtaken(RuntimeError):
    """Another writer has replaced the table meanwhile; nothing of this one's is seen."""


def _files(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(where).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, where: str) -> list[tuple[int, str]]:
    """(number, folder) of the table's versions that are still named, the newest last."""
    path, fs = _files(spark, where)
    top = path(f"{where.rstrip('/')}/{_POINTERS}")
    if not fs.exists(top):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(top)]
    found = [n.split("-", 1) for n in names if "-" in n and not n.startswith(("_", "."))]
    return sorted((int(n), f"{where.rstrip('/')}/{_DATA}/{folder}") for n, folder in found)


def stage_version(df: DataFrame, where: str) -> str:
    """Write a version that no reader sees yet, and give its folder."""
    folder = f"{where.rstrip('/')}/{_DATA}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return folder


def name_version(spark: SparkSession, where: str, folder: str, number: int) -> None:
    """Let readers see a staged version as the given number; Overtaken if another has that number already.

    The number's claim is a folder, which one writer alone can create; the
    pointer follows by a rename.  A claim whose writer is lost before that is
    taken over by ``expire``.
    """
    path, fs = _files(spark, where)
    base = f"{where.rstrip('/')}/{_POINTERS}"
    fs.mkdirs(path(base))
    claim = path(f"{base}/_claim-{number:012d}")
    if any(n == number for n, _ in versions(spark, where)) or not _created(fs, claim):
        raise Overtaken(f"version {number} of {where} is taken")
    name = path(f"{base}/{number:012d}-{folder.rstrip('/').rsplit('/', 1)[-1]}")
    fs.create(name, False).close()


def _created(fs, claim) -> bool:
    """Whether this call has created the file: creation without overwriting is the file system's own decision."""
    from py4j.protocol import Py4JJavaError

    try:
        fs.create(claim, False).close()
    except Py4JJavaError:
        return False
    return True


def replace_table(df: DataFrame, where: str, keep: int = 2) -> int:
    """Replace the table by ``df`` and give the new version's number.

    ``df`` may read the table itself: it reads the version that was newest when
    it was made.  A failure leaves the table as it was.  The ``keep`` newest
    versions stay for readers that have begun.
    """
    spark = df.sparkSession
    number = max([n for n, _ in versions(spark, where)], default=0) + 1
    folder = stage_version(df, where)
    try:
        name_version(spark, where, folder, number)
    except Overtaken:
        path, fs = _files(spark, where)
        fs.delete(path(folder), True)
        raise
    expire(spark, where, keep)
    return number


def read_table(spark: SparkSession, where: str, number: int | None = None) -> DataFrame:
    """The newest version, or a given one that is still there."""
    found = dict(versions(spark, where))
    if not found or (number is not None and number not in found):
        raise FileNotFoundError(f"{where} has no version{'' if number is None else f' {number}'}")
    return spark.read.parquet(found[max(found) if number is None else number])


def expire(spark: SparkSession, where: str, keep: int) -> None:
    """Drop all but the ``keep`` newest versions, pointers first, and claims of numbers that are older."""
    path, fs = _files(spark, where)
    base = f"{where.rstrip('/')}/{_POINTERS}"
    named = versions(spark, where)
    for number, folder in named[: max(0, len(named) - max(keep, 1))]:
        fs.delete(path(f"{base}/{number:012d}-{folder.rsplit('/', 1)[-1]}"), False)
        fs.delete(path(folder), True)
    newest = max([n for n, _ in named], default=0)
    for f in fs.listStatus(path(base)):
        name = f.getPath().getName()
        if name.startswith("_claim-") and int(name.split("-")[1]) < newest:
            fs.delete(f.getPath(), False)

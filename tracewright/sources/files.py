"""File sources: records, line-ordered text, listings, and small reference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

CORRUPT = "_corrupt_record"


class BadRecords(ValueError):
    """Files that do not hold exactly one readable record, all of them."""

    def __init__(self, paths: list[str]):
        super().__init__(f"{len(paths)} unreadable record files: " + ", ".join(paths))
        self.paths = paths


def listing(spark: SparkSession, where: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(path, modified, bytes) of files; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(where).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def digests(spark: SparkSession, where: str) -> DataFrame:
    """(path, sha256) of whole files."""
    return spark.read.format("binaryFile").load(where).select("path", F.sha2("content", 256).alias("sha256"))


def json_records(spark: SparkSession, where: str, schema: str, glob: str = "*.json") -> DataFrame:
    """One record per file, with its path; what is not one readable object keeps its text in a column of its own.

    The path orders records: files are read in no order.
    """
    whole = spark.read.option("pathGlobFilter", glob).text(where, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), "value")
    parsed = F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    rows = whole.select("file_path", "value", parsed.alias("x"), is_object.alias("o"))
    return rows.select("x.*", "file_path", "value", "o").withColumn(CORRUPT, F.when(~F.col("o"), F.col("value")).otherwise(F.col(CORRUPT))).drop("value", "o")


def bad_record_files(spark: SparkSession, where: str, schema: str, glob: str = "*.json") -> DataFrame:
    """Paths of files that do not hold one readable record.  Scans skip files of no bytes: those are listed apart."""
    held = json_records(spark, where, schema, glob).where(F.col(CORRUPT).isNull()).select(plain_path(F.col("file_path")).alias("path"))
    files = listing(spark, where, glob).select(plain_path(F.col("path")).alias("path"))
    unreadable = files.join(held, "path", "left_anti")
    none = empty_files(spark, where, glob)
    return unreadable.unionByName(spark.createDataFrame([(p,) for p in none], "path string")).distinct() if none else unreadable


def empty_files(spark: SparkSession, where: str, glob: str) -> list[str]:
    """Paths of files without a byte, from the file system's own listing."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{where}/{glob}")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    return [f.getPath().toUri().getPath() for f in found or [] if f.isFile() and f.getLen() == 0]


def load_records(spark: SparkSession, where: str, schema: str, glob: str = "*.json") -> DataFrame:
    """The records, or one error that names all bad files; a folder that is not there holds none."""
    if not there(spark, where):
        return spark.createDataFrame([], f"{schema}, file_path string")
    bad = sorted(r["path"] for r in bad_record_files(spark, where, schema, glob).toLocalIterator())
    if bad:
        raise BadRecords(bad)
    return json_records(spark, where, schema, glob).drop(CORRUPT)


def load_run(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The call and the judge records of a run's folder; both are checked before either is used."""
    from ..schemas import CALL, JUDGE

    bad, out = [], []
    for kind, schema in (("calls", CALL), ("judge", JUDGE)):
        try:
            out.append(load_records(spark, f"{folder.rstrip('/')}/{kind}", schema))
        except BadRecords as e:
            bad += e.paths
    if bad:
        raise BadRecords(bad)
    return out[0], out[1]


def locate_rollout(lines: DataFrame, files: DataFrame, cwd: str) -> DataFrame:
    """The newest transcript whose first line names ``cwd``: lines (path, line_no, raw), files (path, modified); no row without one."""
    head = F.try_variant_get(F.try_parse_json("raw"), "$.payload.cwd", "string")
    named = lines.where((F.col("line_no") == 1) & (head == cwd)).select("path")
    return files.join(named, "path", "left_semi").orderBy(F.desc("modified"), "path").limit(1)


def plain_path(path: Column) -> Column:
    """Without the scheme and its slashes."""
    return F.regexp_replace(path, "^[a-z0-9]+:/+", "/")


def run_key(path: Column) -> Column:
    """The results folder and tier of a record file: record ids repeat over rescored runs, folders do not."""
    return F.regexp_extract(path, r"/([^/]+/[^/]+)/(?:calls|judge)/[^/]+$", 1)


def text_lines(spark: SparkSession, where: str | list[str], recursive: bool = False, glob: str | None = None, modified_after: str | None = None) -> DataFrame:
    """(path, line_no, raw): physical lines from 1, in the files' order; a last line break ends a line and begins none.

    Files are split where they are large.  A line's number is its place in its
    split plus the lines of the file's splits before; a file's splits are few.
    ``modified_after`` (a time as text) leaves older files unread.  Folders that
    are not there are empty tables.
    """
    paths = [where] if isinstance(where, str) else list(where)
    paths = [p for p in paths if there(spark, p)]
    if not paths:
        return spark.createDataFrame([], "path string, line_no bigint, raw string")
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    rows = reader.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth"), F.col("value").alias("raw"))
    # a split's rows are numbered one after the other, so its first number and its count tell all places: no row is sorted
    sizes = rows.groupBy("path", "split").agg(F.count(F.lit(1)).alias("lines"), F.min("nth").alias("first"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("path", "split", (before - F.col("first") + 1).alias("base"))
    return rows.join(bases, ["path", "split"]).select("path", (F.col("base") + F.col("nth")).alias("line_no"), "raw")


def bundled_lines(spark: SparkSession, where: str | list[str], sep: str = "\t") -> DataFrame:
    """(path, line_no, raw) of files that hold many transcripts: each line is a transcript's path, ``sep`` and one of its lines.

    A transcript stands in one file; its lines are numbered from 1, in the
    file's order.  Lines without ``sep`` have no path and are whole.
    """
    lines = text_lines(spark, where)
    at = F.instr("raw", sep)
    named = F.when(at > 0, F.substring_index("raw", sep, 1))
    number = F.row_number().over(Window.partitionBy("path").orderBy("file", "in_file")).cast("long")
    parts = lines.select(F.col("path").alias("file"), F.col("line_no").alias("in_file"), named.alias("path"), F.when(at > 0, F.col("raw").substr(at + len(sep), F.length("raw"))).otherwise(F.col("raw")).alias("raw"))
    return parts.select("path", number.alias("line_no"), "raw")


def there(spark: SparkSession, where: str) -> bool:
    """Whether a path or pattern names anything."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def day_folders(spark: SparkSession, root: str, day: str) -> list[str]:
    """The YYYY/MM/DD folders below ``root`` that are not before ``day`` (YYYY-MM-DD): older ones are never listed further."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*/*/*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    folders = [f.getPath().toString() for f in found or [] if f.isDirectory()]
    return sorted(f for f in folders if "-".join(f.rsplit("/", 3)[1:]) >= day)


def first_files(files: DataFrame, n: int) -> list[str]:
    """The first ``n`` paths of a listing, in order: what a trial run reads."""
    return [r["path"] for r in files.orderBy("path").limit(n).collect()]


def main_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified, bytes) of session files: those directly in the folders below ``root``."""
    where = f"{root.rstrip('/')}/*/*.jsonl"
    return listing(spark, where) if there(spark, where) else spark.createDataFrame([], "path string, modified timestamp, bytes bigint")


def json_lines(lines: DataFrame) -> DataFrame:
    """(path, line_no, raw) -> the same with v (a variant or null), blank lines gone, and the number among readable lines.

    Only objects are readable; repeated keys and NaN are not JSON here.
    """
    parsed = lines.where(F.length(F.trim("raw")) > 0).withColumn("v", F.try_parse_json("raw"))
    parsed = parsed.withColumn("v", F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v")))
    ok = F.when(F.col("v").isNotNull(), 1).otherwise(0)
    number = F.sum(ok).over(Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return parsed.withColumn("line_no_valid", F.when(F.col("v").isNotNull(), number))


def transcript_messages(lines: DataFrame) -> DataFrame:
    """Messages of transcripts whose lines are {type, timestamp, cwd, uuid, isSidechain, isMeta, message}.

    ``content`` is a text or a list of blocks; texts of blocks are joined by
    line breaks, tool calls become (name, input as JSON).  ``user_text`` is the
    first block with words of the user's own, ``scanned`` all that a detector
    may read: texts, thoughts, tool results, as text or as blocks, and shell
    commands.
    """
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    blocks = get("$.message.content", "array<variant>")
    kind_of = lambda b: F.try_variant_get(b, "$.type", "string")
    texts = F.array_compact(F.transform(F.filter(blocks, lambda b: kind_of(b) == "text"), lambda b: F.try_variant_get(b, "$.text", "string")))
    text = F.when(blocks.isNull(), get("$.message.content", "string")).otherwise(F.array_join(texts, "\n"))
    tools = F.transform(
        F.filter(blocks, lambda b: kind_of(b) == "tool_use"),
        lambda b: F.struct(F.try_variant_get(b, "$.name", "string").alias("name"), F.to_json(F.try_variant_get(b, "$.input", "variant")).alias("input")),
    )
    return lines.where(F.col("v").isNotNull()).select(
        "path", F.col("line_no_valid").alias("line_no"), get("$.type", "string").alias("role"), get("$.timestamp", "string").alias("ts"),
        get("$.message.model", "string").alias("model"), get("$.cwd", "string").alias("cwd"), get("$.uuid", "string").alias("uuid"),
        F.coalesce(get("$.isSidechain", "boolean"), F.lit(False)).alias("sidechain"), F.coalesce(get("$.isMeta", "boolean"), F.lit(False)).alias("meta"),
        text.alias("text"), F.coalesce(tools, F.array().cast("array<struct<name:string,input:string>>")).alias("tools"),
        first_own_text(blocks, get("$.message.content", "string")).alias("user_text"), scanned_texts(blocks, get("$.message.content", "string")).alias("scanned"),
    )


def first_own_text(blocks: Column, text: Column) -> Column:
    """Of a text or of a list of blocks, the first that holds words beside tagged insertions; null without one."""
    own = lambda t: X.without_wrappers(t)
    texts = F.transform(F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "text"), lambda b: own(F.try_variant_get(b, "$.text", "string")))
    first = F.try_element_at(F.filter(texts, lambda t: F.length(t) > 0), F.lit(1))
    return F.when(blocks.isNotNull(), first).otherwise(F.nullif(own(text), F.lit("")))


def scanned_texts(blocks: Column, text: Column) -> Column:
    """array of the texts of a message, in order."""
    part = lambda b, path, kind="string": F.try_variant_get(b, path, kind)
    listed = lambda b: F.transform(F.filter(part(b, "$.content", "array<variant>"), lambda s: part(s, "$.type") == "text"), lambda s: part(s, "$.text"))

    def of(b: Column) -> Column:
        kind = part(b, "$.type")
        # a list is no string, though a cast would make it one
        result = F.when(F.schema_of_variant(part(b, "$.content", "variant")) == "STRING", F.array(part(b, "$.content"))).otherwise(listed(b))
        return (
            F.when(kind == "text", F.array(part(b, "$.text"))).when(kind == "thinking", F.array(part(b, "$.thinking"))).when(kind == "tool_result", result)
            .when((kind == "tool_use") & (part(b, "$.name") == "Bash"), F.array(part(b, "$.input.command")))
        )

    each = F.array_compact(F.flatten(F.array_compact(F.transform(blocks, of))))
    return F.when(blocks.isNotNull(), F.filter(each, lambda t: F.length(t) > 0)).otherwise(F.array_compact(F.array(text)))


def rollout_events(lines: DataFrame) -> DataFrame:
    """Events of transcripts whose lines are {type, timestamp, payload}: (path, line_no, type, ts, kind, model, cwd, last_message, text)."""
    get = lambda path: F.try_variant_get("v", path, "string")
    whole = F.try_variant_get("v", "$.payload.output", "variant")
    content = F.try_variant_get("v", "$.payload.output.content", "variant")
    # a text, an object's text, or else the object as JSON
    output = F.when(F.schema_of_variant(content) == "STRING", get("$.payload.output.content")).when(F.schema_of_variant(whole) == "STRING", get("$.payload.output")).otherwise(F.to_json(whole))
    return lines.where(F.col("v").isNotNull()).select(
        "path", F.col("line_no_valid").alias("line_no"), get("$.type").alias("type"), get("$.timestamp").alias("ts"), get("$.payload.type").alias("kind"),
        get("$.payload.model").alias("model"), get("$.payload.cwd").alias("cwd"), get("$.payload.last_agent_message").alias("last_message"), F.substring(output, 1, 2000).alias("text"),
    )


def since(rows: DataFrame, day: str, path: str = "path") -> DataFrame:
    """Rows of files below a YYYY/MM/DD folder not before ``day`` (YYYY-MM-DD); ``day_folders`` leaves older folders unread."""
    stamp = F.regexp_replace(F.regexp_extract(path, r"/([0-9]{4}/[0-9]{2}/[0-9]{2})/", 1), "/", "-")
    return rows.where(stamp >= day)


def parent_session(path: Column) -> Column:
    """The session that a sub-agent's file belongs to."""
    return F.regexp_extract(path, r"/([^/]+)/subagents/", 1)


def newest(files: DataFrame, key: str) -> DataFrame:
    """The newest path per key, ties by path."""
    return files.groupBy(key).agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def queue_rows(lines: DataFrame) -> DataFrame:
    """Nominations from a written queue: ``## class — N`` headings and ``- [ ] time `session` Lnn`` items."""
    head = F.regexp_extract("raw", r"^##\s+(\S+)\s+—", 1)
    held = lines.withColumn("h", F.when(head != "", head))
    order = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    item = r"^- \[[ x]\] (\S+) `([^`]+)` L([0-9]+)"
    return (
        held.withColumn("class", F.last("h", ignorenulls=True).over(order)).where(F.col("raw").rlike(item))
        .select("path", "class", F.regexp_extract("raw", item, 1).alias("ts"), F.regexp_extract("raw", item, 2).alias("session"), F.regexp_extract("raw", item, 3).cast("long").alias("line"))
    )


def yaml_table(spark: SparkSession, text: str, schema: str, at: str | None = None) -> DataFrame:
    """A small hand-written YAML list (or one under a key) as a table."""
    import yaml

    rows = yaml.safe_load(text)
    return spark.createDataFrame([dict(r) for r in (rows[at] if at else rows)], schema)


def first_items(rows: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows in the manifest's order."""
    return rows.orderBy(order).limit(n)


def item_texts(items: DataFrame, max_items: int | None = None) -> DataFrame:
    """(position, id, context, diff) -> the first items in the manifest's order, context and diff as one text."""
    kept = items if max_items is None else first_items(items, max_items, "position")
    return kept.select("position", "id", F.concat_ws("\n\n", "context", "diff").alias("text"))


def misnamed(rows: DataFrame, id: str, path: str) -> DataFrame:
    """Rows whose id is not the name of their file, without its ending."""
    name = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return rows.where(~F.col(id).cast("string").eqNullSafe(name))


def stale(files: DataFrame, since) -> DataFrame:
    """Files that are older than a run that should have written them."""
    return files.where(F.col("modified") < since)


def arm_counts(files: DataFrame) -> DataFrame:
    """Record files per run folder, kind and arm, from paths like …/run/tier/calls/arm-task.json."""
    part = lambda k: F.regexp_extract("path", r"/([^/]+/[^/]+)/(calls|judge)/([^/-]+)-[^/]*$", k)
    return files.select(part(1).alias("run"), part(2).alias("kind"), part(3).alias("arm")).where("kind <> ''").groupBy("run", "kind", "arm").agg(F.count(F.lit(1)).alias("n"))

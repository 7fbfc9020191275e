"""Signature detection driven by a catalog of expressions.

A catalog is a short list of (detector, bucket, priority, pattern, role).  It
compiles to column expressions, so one scan of the messages serves all
detectors; per message and detector the bucket of least priority wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.stats import truthy
from .containment import contains_join
from .sessions import carried, reached

def detect(messages: DataFrame, catalog: tuple[tuple[str, str, int, str, str], ...], flags: str = "(?dU)") -> DataFrame:
    """Incident rows (detector, bucket, snippet) of every message that fits, with the message's columns."""
    text = F.col("text")
    by: dict[str, list] = {}
    for row in sorted(catalog, key=lambda r: r[2]):
        by.setdefault(row[0], []).append(row)
    told = []
    for detector, rows in by.items():
        found = None
        for _, bucket, _, pattern, role in rows:
            full = flags + pattern
            hit = F.struct(F.lit(detector).alias("detector"), F.lit(bucket).alias("bucket"), X.snippet(text, full).alias("snippet"))
            fits = (F.col("role") == role) & text.rlike(full)
            found = F.when(fits, hit) if found is None else found.when(fits, hit)
        told.append(found)
    return messages.withColumn("_hits", F.array_compact(F.array(*told))).where(F.size("_hits") > 0).select("*", F.explode("_hits").alias("_hit")).select(
        *[c for c in messages.columns], "_hit.*"
    )


def admissible(messages: DataFrame) -> DataFrame:
    """The messages that detectors look at: users' own words, and assistants' with the model carried forward.

    Messages of the synthetic model, meta turns, sub-agents' user turns and
    turns with a command wrapper are left out.
    """
    real_model = F.when(F.col("model") != P.SYNTHETIC_MODEL, F.col("model"))
    known = messages.withColumn("_model", real_model).withColumn("_model", carried("_model"))
    wrapped = F.contains("text", F.lit("<local-command-caveat>")) | F.contains("text", F.lit("<command-name>"))
    user = (F.col("role") == "user") & ~truthy("meta") & ~truthy("sidechain") & ~F.coalesce(wrapped, F.lit(False))
    spoken = (F.col("role") == "assistant") & (F.coalesce("model", F.lit("")) != P.SYNTHETIC_MODEL)
    bare = F.when(F.col("role") == "user", F.regexp_replace("text", r"(?s)<system-reminder>.*?</system-reminder>", "")).otherwise(F.col("text"))
    return known.where(user | spoken).withColumn("model", F.col("_model")).drop("_model").withColumn("text", bare).where(F.length(X.stripped(F.col("text"))) > 0)


def truncated_pipes(messages: DataFrame) -> DataFrame:
    """Shell calls whose output is cut by a pipe: of tests, else of checks."""
    calls = messages.select(*messages.columns, F.explode("tools").alias("_tool")).where(F.col("_tool.name") == "Bash")
    command = F.coalesce(F.try_variant_get(F.try_parse_json(F.col("_tool.input")), "$.command", "string"), F.lit(""))
    cut = calls.withColumn("_command", command).where(F.col("_command").rlike(P.TRUNCATING_PIPE))
    kind = F.when(F.col("_command").rlike(P.TEST_COMMAND), "test").when(F.col("_command").rlike(P.CHECK_COMMAND), "check")
    return (
        cut.withColumn("bucket", kind).where(F.col("bucket").isNotNull())
        .select(*messages.columns, F.concat(F.lit("pipe_truncated_"), "bucket").alias("detector"), "bucket", F.substring(X.collapsed(F.col("_command")), 1, 220).alias("snippet"))
    )


def null_finals(lines: DataFrame) -> DataFrame:
    """Tasks that end without a last message, told apart by whether any output came before.

    lines: (path, line_no, kind, last_message, total_tokens); ``kind`` is output
    or task_complete among others.
    """
    seen = lines.withColumn("had_output", reached(F.col("kind") == "output")).withColumn("tokens", carried("total_tokens"))
    empty = F.length(X.stripped(F.coalesce("last_message", F.lit("")))) == 0
    return seen.where((F.col("kind") == "task_complete") & empty).select(
        "path", "line_no", F.lit("null_final").alias("detector"), F.when(F.col("had_output"), "after_output").otherwise("zero_output").alias("bucket"), "tokens"
    )


def synthetic_errors(messages: DataFrame) -> DataFrame:
    """Assistant lines of the synthetic model: errors that the program wrote itself."""
    own = messages.where((F.col("role") == "assistant") & (F.col("model") == P.SYNTHETIC_MODEL))
    return _told(own, "synthetic_error", "synthetic_error")


def patch_failures(events: DataFrame) -> DataFrame:
    """Tool outputs that report a patch that did not apply: events of (path, line_no, kind, text, …)."""
    outputs = events.where(F.col("kind").isin(*P.TOOL_OUTPUTS) & F.contains("text", F.lit(P.PATCH_FAILED)))
    return _told(outputs, "apply_patch_failed", "failed")


def _told(rows: DataFrame, detector: str, bucket: str) -> DataFrame:
    snippet = F.substring(X.collapsed(F.coalesce("text", F.lit(""))), 1, 220)
    return rows.select(*rows.columns, F.lit(detector).alias("detector"), F.lit(bucket).alias("bucket"), snippet.alias("snippet"))


def authored(messages: DataFrame) -> DataFrame:
    """Texts that the assistant wrote into files: (…, tool, file_path, authored)."""
    calls = messages.select(*messages.columns, F.explode("tools").alias("_tool")).where(F.col("_tool.name").isin(*P.EDIT_TOOLS))
    given = F.try_parse_json(F.col("_tool.input"))
    edits = F.try_variant_get(given, "$.edits", "array<struct<new_string string>>")
    texts = (
        F.when(F.col("_tool.name") == "Write", F.array(F.try_variant_get(given, "$.content", "string")))
        .when(F.col("_tool.name") == "Edit", F.array(F.try_variant_get(given, "$.new_string", "string")))
        .otherwise(F.transform(edits, lambda e: e["new_string"]))
    )
    return calls.select(*messages.columns, F.col("_tool.name").alias("tool"), F.try_variant_get(given, "$.file_path", "string").alias("file_path"), F.explode_outer(F.array_compact(texts)).alias("authored"))


def counts(incidents: DataFrame, by: tuple[str, ...] = ("detector", "bucket"), session: str = "session") -> DataFrame:
    """Rows and distinct sessions per key, exact."""
    return incidents.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(session).alias("sessions"))


def daily_series(incidents: DataFrame, day: Column, by: tuple[str, ...] = ("detector",), buckets: tuple[str, ...] | None = None, month: str | None = None) -> DataFrame:
    """Counts per day on which any fell; ``buckets`` and ``month`` (YYYY-MM) narrow them."""
    rows = incidents.withColumn("day", day)
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(*buckets))
    if month is not None:
        rows = rows.where(F.col("day").startswith(month))
    return rows.groupBy(*by, "day").agg(F.count(F.lit(1)).alias("n"))


def recurrent(incidents: DataFrame, least: int = 2, session: str = "session") -> DataFrame:
    """Sessions with at least ``least`` incidents."""
    return incidents.groupBy(session).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def queue(incidents: DataFrame, by: tuple[str, ...], ts: str, top: int, session: str | None = None, tie: tuple[str, ...] = ()) -> DataFrame:
    """The newest rows per key, null times last; with ``session`` only the newest of each session counts."""
    order = [F.col(ts).desc_nulls_last(), *[F.col(c).asc() for c in tie]]
    if session is not None:
        incidents = incidents.withColumn("_n", F.row_number().over(Window.partitionBy(*by, session).orderBy(*order))).where("_n = 1").drop("_n")
    return incidents.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= top)


def known_found(known: DataFrame, incidents: DataFrame) -> DataFrame:
    """For each known incident (label, detector prefix, session part, snippet expression or null) whether it was found.

    Sessions and parts meet by the parts' rarest pieces, so that neither list
    need be short; a part that is empty is in every session.  Equal conditions
    of several labels are tried once.
    """
    asked = known.select("detector_prefix", "session_part", "snippet_pattern").distinct()
    rows = incidents.select("detector", "session", "snippet")
    sessions = rows.select("session", F.col("session").alias("_s")).distinct()
    parts = asked.select("session_part", F.col("session_part").alias("_p")).distinct()
    met = contains_join(sessions, parts, "session", "_s", "session_part", "_p")
    prefix = F.startswith("detector", "detector_prefix")
    plain, told = asked.where("snippet_pattern IS NULL").drop("snippet_pattern"), asked.where("snippet_pattern IS NOT NULL")
    by_session = lambda df: df.join(met, "session")
    pairs = rows.select("detector", "session").distinct()
    found = by_session(pairs).join(plain, "session_part").where(prefix).select("detector_prefix", "session_part", F.lit(None).cast("string").alias("snippet_pattern"))
    fits = F.regexp_like("snippet", F.col("snippet_pattern"))
    found = found.unionByName(by_session(rows).join(told, "session_part").where(prefix & fits).select("detector_prefix", "session_part", "snippet_pattern"))
    # empty parts: any session will do, so distinct detectors and snippets are all that counts
    empty = asked.where("session_part = ''")
    anywhere = rows.select("detector", "snippet").distinct().join(empty, prefix & (F.col("snippet_pattern").isNull() | F.coalesce(fits, F.lit(False))))
    found = found.unionByName(anywhere.select("detector_prefix", "session_part", "snippet_pattern")).distinct().withColumn("hit", F.lit(True))
    same = F.lit(True)
    for c in ("detector_prefix", "session_part", "snippet_pattern"):
        same = same & F.col(f"k.{c}").eqNullSafe(F.col(f"f.{c}"))
    return known.alias("k").join(found.alias("f"), same, "left").groupBy("label").agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("found"))


def after_first(incidents: DataFrame, first_detector: str, key: str = "session", order: str = "line_no") -> DataFrame:
    """Per session: incidents of other detectors after the first one of ``first_detector``."""
    start = F.min(F.when(F.col("detector") == first_detector, F.col(order))).over(Window.partitionBy(key))
    return incidents.withColumn("_start", start).where((F.col(order) > F.col("_start")) & (F.col("detector") != first_detector)).groupBy(key).agg(F.count(F.lit(1)).alias("n_after"))


def cadence(rows: DataFrame, key: str, ts: str, least_seconds: float) -> DataFrame:
    """Per key: gaps between consecutive rows, their mean, and how many are below a limit."""
    at = F.col(ts).cast("timestamp").cast("double")
    gap = at - F.lag(at).over(Window.partitionBy(key).orderBy(ts))
    return rows.withColumn("gap", gap).groupBy(key).agg(F.count("gap").alias("gaps"), F.avg("gap").alias("mean_gap"), F.count_if(F.col("gap") < least_seconds).alias("short_gaps"))


def checkpoint_cadence(messages: DataFrame, least: int = 3) -> DataFrame:
    """Sessions with at least ``least`` edits of checkpoint files: (session, n, first_line, last_ts, paths), two paths named."""
    edits = authored(messages).where(F.col("file_path").rlike(P.CHECKPOINT_PATH)).dropDuplicates(["path", "line_no", "tool", "file_path"])
    folded = edits.groupBy(F.col("path").alias("session")).agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"), F.max_by("ts", "line_no").alias("last_ts"), F.sort_array(F.collect_set("file_path")).alias("_paths")
    )
    shown = F.array_join(F.slice("_paths", 1, 2), ", ")
    rest = F.when(F.size("_paths") > 2, F.format_string("%s (+%d more)", shown, F.size("_paths") - 2)).otherwise(shown)
    return folded.where(F.col("n") >= least).select("session", "n", "first_line", "last_ts", rest.alias("paths"))


def rerun_pairs(rows: DataFrame, key: str, order: str, failed: Column, again: Column) -> DataFrame:
    """Per key: how often a failed row is followed at once by a row that tries again."""
    following = F.lead(again).over(Window.partitionBy(key).orderBy(order))
    return rows.select(key, (failed & F.coalesce(following, F.lit(False))).alias("_pair"), failed.alias("_failed")).groupBy(key).agg(F.count_if("_failed").alias("failed"), F.count_if("_pair").alias("rerun"))

"""Sessionization: message rows to one row per session.

A message has (path, line_no, role, ts, model, cwd, sidechain, meta, text,
tools).  Everything of a session comes from one shuffle by path: the folds are
grouped aggregates, ordered ones by min_by / max_by, never a sorted list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.stats import truthy


def real_user(messages: DataFrame) -> Column:
    """A human's own turn: not meta, not of a sub-agent, with words left after insertions are removed."""
    own = X.without_wrappers(F.col("text"))
    return (F.col("role") == "user") & ~truthy("meta") & ~truthy("sidechain") & (F.length(own) > 0)


def carried(column: str, key: str = "path", order: str = "line_no") -> Column:
    """The last non-null value up to and with this line."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def reached(flag: Column, key: str = "path", order: str = "line_no") -> Column:
    """Whether the flag held on this line or any before."""
    return F.coalesce(F.max(flag).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))


def histogram(rows: DataFrame, key: str, value: str, top: int | None = None, order: str = "line_no") -> DataFrame:
    """(key, items): counts of a value per key as an array of (value, n), most frequent first, ties by first line."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    listed = counts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("r"), "first", F.col(value).alias("value"), "n"))).alias("x"))
    items = F.transform("x", lambda s: F.struct(s["value"].alias("value"), s["n"].alias("n")))
    return listed.select(key, (F.slice(items, 1, top) if top else items).alias("items"))


def outcome_columns() -> dict[str, Column]:
    """Aggregates over a session's texts: passed tests, commits, errors."""
    text = F.coalesce("text", F.lit(""))
    errors = reduce(lambda a, w: a + X.occurrences(text, w), P.ERROR_WORDS[1:], X.occurrences(text, P.ERROR_WORDS[0]))
    commits = F.regexp_count(text, F.lit(P.COMMIT_MENTION)) + F.regexp_count(text, F.lit(P.COMMIT_BANNER))
    return {
        "mentions_tests_passed": F.bool_or(text.rlike(P.TEST_WORD) & text.rlike(P.TEST_PASSED)),
        "n_commits": F.sum(commits).cast("long"), "error_hits": F.sum(errors).cast("long"),
    }


def sessions(messages: DataFrame) -> DataFrame:
    """One row per path.

    Start and end are the least and greatest time strings, as written; the
    first and last texts those of the least and greatest line; a synthetic
    model is no model.  Lines of sub-agents count apart.
    """
    main = ~truthy("sidechain")
    user = real_user(messages)
    spoke = main & (F.col("role") == "assistant") & (F.length(X.stripped(F.col("text"))) > 0)
    tool_names = F.coalesce(F.transform("tools", lambda t: t["name"]), F.array().cast("array<string>"))
    n_orch = F.size(F.filter(tool_names, lambda t: t.isin(*P.ORCHESTRATION_TOOLS)))
    folded = messages.groupBy("path").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count_if(user).alias("n_user_turns"),
        F.count_if(main & (F.col("role") == "assistant") & (F.coalesce("model", F.lit("")) != P.SYNTHETIC_MODEL)).alias("n_assistant_turns"),
        F.count_if(truthy("sidechain")).alias("n_sidechain_lines"),
        F.min_by(F.when(user, X.without_wrappers(F.col("text"))), F.when(user, F.col("line_no"))).alias("first_user_text"),
        F.max_by(F.when(spoke, F.col("text")), F.when(spoke, F.col("line_no"))).alias("last_assistant_text"),
        F.sum(F.size(tool_names)).cast("long").alias("n_tools"), F.sum(n_orch).cast("long").alias("n_orchestration"),
        F.count_if(user & F.col("text").rlike(P.FRUSTRATION)).alias("user_frustration"), F.count(F.lit(1)).alias("n_lines"),
        *[c.alias(n) for n, c in outcome_columns().items()],
    )
    kind = X.task_type(F.col("first_user_text"), F.col("n_tools"), F.col("n_orchestration"))
    return folded.select(
        "*", kind["type"].alias("task_type"), kind["confidence"].alias("task_type_confidence"),
        X.minutes_between(F.col("start_ts"), F.col("end_ts")).alias("duration_min"),
        (F.col("error_hits") * 100.0 / F.greatest("n_lines", F.lit(1))).alias("error_density"),
    )


def session_models(messages: DataFrame) -> DataFrame:
    """(path, model, turns, side_turns): turns by model, those of sub-agents apart."""
    spoken = messages.where((F.col("role") == "assistant") & F.col("model").isNotNull() & (F.col("model") != P.SYNTHETIC_MODEL))
    return spoken.groupBy("path", "model").agg(F.count_if(~truthy("sidechain")).alias("turns"), F.count_if(truthy("sidechain")).alias("side_turns"))


def session_index(messages: DataFrame, files: DataFrame) -> DataFrame:
    """Sessions with their models (of sub-agents apart) and tools as histograms, project, bytes and unreadable lines.

    files: (path, bytes, parse_failures).  All joins are on path, on which the
    sessions are already dealt.
    """
    spoken = messages.where((F.col("role") == "assistant") & F.col("model").isNotNull() & (F.col("model") != P.SYNTHETIC_MODEL))
    main = histogram(spoken.where(~truthy("sidechain")), "path", "model").withColumnRenamed("items", "models")
    side = histogram(spoken.where(truthy("sidechain")), "path", "model").withColumnRenamed("items", "sidechain_models")
    calls = messages.select("path", "line_no", F.explode("tools").alias("t")).select("path", "line_no", F.col("t.name").alias("tool"))
    tools = histogram(calls, "path", "tool", top=10).withColumnRenamed("items", "tool_histogram")
    cwd = messages.groupBy("path").agg(F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("line_no"))).alias("cwd"))
    out = sessions(messages)
    for more in (main, side, tools, cwd, files.select("path", F.col("bytes").alias("total_bytes"), "parse_failures")):
        out = out.join(more, "path", "left")
    project = F.coalesce("cwd", X.project_path(F.regexp_extract("path", r"([^/]+)/[^/]*$", 1)))
    return out.withColumn("project", project).na.fill(0, ["total_bytes", "parse_failures"])


def fork_pairs(edges: DataFrame, n: int = 20) -> DataFrame:
    """The first n pairs of a lineage, for a report."""
    return edges.orderBy("child", "parent").limit(n)


def rolled_up(sessions_: DataFrame, subagents: DataFrame) -> DataFrame:
    """Sessions with the line and turn counts of their sub-agents' files; sessions without any get zeros."""
    own = subagents.groupBy("parent").agg(F.sum("n_lines").cast("long").alias("sub_lines"), F.count(F.lit(1)).alias("sub_files"))
    return sessions_.join(own, sessions_["path"] == own["parent"], "left").drop("parent").na.fill(0, ["sub_lines", "sub_files"])


def orphans(sessions_: DataFrame, subagents: DataFrame) -> DataFrame:
    """Sub-agent files whose parent session is not there."""
    return subagents.join(sessions_.select("path"), subagents["parent"] == F.col("path"), "left_anti")


def fork_edges(lines: DataFrame) -> DataFrame:
    """(child, parent): files whose first content line also stands in another file.

    Of two files with one first line the later by path owns it.
    """
    content = lines.where(F.col("role").isin("user", "assistant") & ~truthy("sidechain") & F.col("uuid").isNotNull())
    firsts = content.groupBy("path").agg(F.min_by("uuid", "line_no").alias("uuid")).groupBy("uuid").agg(F.max("path").alias("child"))
    return content.join(firsts, "uuid").where(F.col("child") != F.col("path")).select("child", F.col("path").alias("parent")).distinct()


def idle_gaps(events: DataFrame, key: str, ts: str, minutes: int) -> DataFrame:
    """Sessions by idle time: (key, session, start, end, n); a longer gap begins the next."""
    order = Window.partitionBy(key).orderBy(ts)
    gap = F.col(ts).cast("timestamp").cast("double") - F.lag(F.col(ts).cast("timestamp").cast("double")).over(order)
    number = F.sum(F.when(gap.isNull() | (gap > minutes * 60), 1).otherwise(0)).over(order)
    return events.withColumn("_gap", gap).select(key, ts, number.alias("session")).groupBy(key, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n"))

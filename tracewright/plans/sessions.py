"""Session queries over conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..operators import sessions as O
from . import adapters as A
from .registry import query

_USER = "role = 'user' AND NOT sidechain AND length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) > 0"
_STRIP = "trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query("a18_session_index", f"""WITH {A.MESSAGES} SELECT path, min(ts) AS start_ts, max(ts) AS end_ts, count(*) FILTER ({_USER}) AS n_user_turns, count(*) FILTER (role = 'assistant' AND NOT sidechain) AS n_assistant_turns,
count(*) FILTER (sidechain) AS n_sidechain_lines, arg_min({_STRIP}, line_no) FILTER ({_USER}) AS first_user_text, arg_max(text, line_no) FILTER (role = 'assistant' AND NOT sidechain AND length({_STRIP}) > 0) AS last_assistant_text,
count(tool) AS n_tools, count(*) FILTER (tool = 'Task') AS n_orchestration, count(*) AS n_lines FROM messages GROUP BY path""")
def _(t):
    return O.sessions(A.messages(t("conversations"))).select("path", "start_ts", "end_ts", "n_user_turns", "n_assistant_turns", "n_sidechain_lines", "first_user_text", "last_assistant_text", "n_tools", "n_orchestration", "n_lines")


@query("a31_session_outcomes", f"""WITH {A.MESSAGES} SELECT path, bool_or(regexp_matches(text, '(?i)test') AND regexp_matches(text, 'passed|PASS|✓')) AS mentions_tests_passed, sum(len(regexp_extract_all(text, '(?i)git commit')))::BIGINT AS n_commits,
sum((length(text) - length(replace(text, 'Error', ''))) // 5 + (length(text) - length(replace(text, 'Traceback', ''))) // 9 + (length(text) - length(replace(text, 'FAILED', ''))) // 6)::BIGINT AS error_hits,
count(*) FILTER ({_USER} AND regexp_matches(text, '(?i)no,|wrong|stop|not what')) AS user_frustration, round(date_diff('second', min(ts)::TIMESTAMP, max(ts)::TIMESTAMP) / 60.0, 6) AS duration_min FROM messages GROUP BY path""")
def _(t):
    return O.sessions(A.messages(t("conversations"))).select("path", "mentions_tests_passed", "n_commits", "error_hits", "user_frustration", F.round("duration_min", 6).alias("duration_min"))


@query("a19_model_histogram", f"WITH {A.MESSAGES}, c AS (SELECT path, model, count(*) AS n, min(line_no) AS first FROM messages WHERE model IS NOT NULL GROUP BY path, model), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, first, model) AS k FROM c) SELECT path, string_agg(model || '=' || n, ',' ORDER BY k) AS models FROM r WHERE k <= 10 GROUP BY path")
def _(t):
    h = O.histogram(A.messages(t("conversations")), "path", "model", top=10)
    return h.select("path", F.array_join(F.transform("items", lambda i: F.concat_ws("=", i["value"], i["n"])), ",").alias("models"))


@query("w01_carried_model", f"WITH {A.MESSAGES} SELECT path, line_no, last_value(model IGNORE NULLS) OVER w AS model, last_value(cwd IGNORE NULLS) OVER w AS cwd FROM messages WINDOW w AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def _(t):
    return A.messages(t("conversations")).select("path", "line_no", O.carried("model").alias("model"), O.carried("cwd").alias("cwd"))


@query("w02_first_cwd", f"WITH {A.MESSAGES} SELECT path, arg_min(cwd, line_no) FILTER (cwd IS NOT NULL) AS cwd FROM messages GROUP BY path")
def _(t):
    return A.messages(t("conversations")).groupBy("path").agg(F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("line_no"))).alias("cwd"))


@query("w03_had_output", f"WITH {A.MESSAGES} SELECT path, line_no, coalesce(bool_or(role = 'assistant') OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS had_output FROM messages")
def _(t):
    return A.messages(t("conversations")).select("path", "line_no", O.reached(F.col("role") == "assistant").alias("had_output"))


@query("p03_real_user_turns", f"WITH {A.MESSAGES} SELECT path, line_no FROM messages WHERE {_USER}")
def _(t):
    m = A.messages(t("conversations"))
    return m.where(O.real_user(m)).select("path", "line_no")


@query("p04_sidechain_routing", f"WITH {A.MESSAGES} SELECT role, count(*) FILTER (NOT sidechain) AS main_lines, count(*) FILTER (sidechain) AS side_lines FROM messages GROUP BY role")
def _(t):
    return A.messages(t("conversations")).groupBy("role").agg(F.count_if(~F.col("sidechain")).alias("main_lines"), F.count_if("sidechain").alias("side_lines"))


@query("j05_fork_edges", f"WITH {A.MESSAGES}, c AS (SELECT path, uuid, line_no FROM messages WHERE role IN ('user', 'assistant') AND NOT sidechain), f AS (SELECT max(path) AS child, uuid FROM (SELECT path, arg_min(uuid, line_no) AS uuid FROM c GROUP BY path) GROUP BY uuid) SELECT DISTINCT child, path AS parent FROM c JOIN f USING (uuid) WHERE child <> path")
def _(t):
    return O.fork_edges(A.messages(t("conversations")))


@query("j08_subagent_rollup", f"WITH {A.MESSAGES}, s AS (SELECT path, count(*) AS n_lines FROM messages GROUP BY path), sub AS (SELECT (path::BIGINT // 3)::VARCHAR AS parent, n_lines FROM s WHERE path::BIGINT % 3 <> 0) SELECT s.path, s.n_lines, coalesce(sum(sub.n_lines), 0)::BIGINT AS sub_lines, count(sub.n_lines) AS sub_files FROM s LEFT JOIN sub ON s.path = sub.parent GROUP BY s.path, s.n_lines")
def _(t):
    s = A.messages(t("conversations")).groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"))
    n = F.col("path").cast("long")
    return O.rolled_up(s, s.where(n % 3 != 0).select(F.floor(n / 3).cast("string").alias("parent"), "n_lines"))


@query("j09_orphan_subagents", "WITH s AS (SELECT DISTINCT conv_id AS path FROM conversations), sub AS (SELECT path * 2 AS parent, path AS file FROM s) SELECT file FROM sub WHERE parent NOT IN (SELECT path FROM s)")
def _(t):
    s = t("conversations").select(F.col("conv_id").alias("path")).distinct()
    return O.orphans(s, s.select((F.col("path") * 2).alias("parent"), F.col("path").alias("file"))).select("file")


@query("x01_idle_sessions", "WITH g AS (SELECT user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events), n AS (SELECT user_id, ts, sum(CASE WHEN gap IS NULL OR gap > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, session::BIGINT AS session, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n FROM n GROUP BY user_id, session")
def _(t):
    s = O.idle_gaps(t("events"), "user_id", "ts", 720)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return s.select("user_id", "session", us("start").alias("start_us"), us("end").alias("end_us"), "n")


#: First words of sessions, and the kind of task that they tell.
TASKS = (
    ("reply with exactly OK", "probe_check", "med"), ("answer with exactly yes or no", "eval_harness", "med"), ("a code review and critique", "review", "med"),
    ("re-review please", "review", "low"), ("brainstorm with me", "plan_design", "low"), ("debug the crash", "debug", "med"), ("refactor it", "refactor", "low"),
    ("a dockerfile for kubernetes", "infra_config", "med"), ("readme and changelog", "writing_docs", "med"), ("the dataset", "data_analysis", "low"),
    ("investigate it", "research_analysis", "low"), ("implement it", "implement", "low"), ("hello there", "other", "low"),
)


@query("f03_task_types", f"""WITH {A.MESSAGES}, f AS (SELECT path, count(tool) AS tools, count(*) FILTER (tool = 'Task') AS tasks, count(*) FILTER (role = 'user' AND NOT sidechain) AS own FROM messages GROUP BY path)
SELECT CASE WHEN tasks >= 3 AND tasks > 0.15 * tools THEN 'orchestration' WHEN own = 0 THEN 'other' ELSE type END AS task_type, CASE WHEN tasks >= 3 AND tasks > 0.15 * tools THEN 'med' WHEN own = 0 THEN 'low' ELSE sure END AS task_type_confidence, count(*) AS n
FROM f JOIN {A.values(TASKS, 'words, type, sure')} ON i = path::BIGINT % {len(TASKS)} GROUP BY ALL""")
def _(t):
    rows = A.opened_with(A.messages(t("conversations")), F.col("path").cast("long"), tuple(w for w, _, _ in TASKS))
    return O.sessions(rows).groupBy("task_type", "task_type_confidence").agg(F.count(F.lit(1)).alias("n"))


@query("a18_index_columns", f"""WITH {A.MESSAGES}, m AS (SELECT path, sidechain, model, count(*) AS n, min(line_no) AS first FROM messages WHERE model IS NOT NULL GROUP BY ALL),
l AS (SELECT path, string_agg(model || '=' || n, ',' ORDER BY n DESC, first) FILTER (NOT sidechain) AS models, string_agg(model || '=' || n, ',' ORDER BY n DESC, first) FILTER (sidechain) AS sidechain_models FROM m GROUP BY path),
t AS (SELECT path, string_agg(tool || '=' || n, ',') AS tools FROM (SELECT path, tool, count(*) AS n FROM messages WHERE tool IS NOT NULL GROUP BY ALL) GROUP BY path),
f AS (SELECT path, sum(strlen(text))::BIGINT AS total_bytes, count(*) FILTER (line_no % 5 = 3) AS parse_failures, arg_min(cwd, line_no) FILTER (cwd IS NOT NULL) AS project FROM messages GROUP BY path)
SELECT path, models, sidechain_models, tools, total_bytes, parse_failures, project FROM f LEFT JOIN l USING (path) LEFT JOIN t USING (path)""")
def _(t):
    rows = A.messages(t("conversations"))
    files = rows.groupBy("path").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if(F.col("line_no") % 5 == 3).alias("parse_failures"))
    shown = lambda c: F.array_join(F.transform(c, lambda i: F.concat_ws("=", i["value"], i["n"])), ",")
    return O.session_index(rows, files).select("path", shown("models").alias("models"), shown("sidechain_models").alias("sidechain_models"), shown("tool_histogram").alias("tools"), "total_bytes", "parse_failures", "project")


@query("t10_fork_pairs", f"WITH {A.MESSAGES}, c AS (SELECT path, uuid, line_no FROM messages WHERE role IN ('user', 'assistant') AND NOT sidechain), f AS (SELECT max(path) AS child, uuid FROM (SELECT path, arg_min(uuid, line_no) AS uuid FROM c GROUP BY path) GROUP BY uuid) SELECT DISTINCT child, path AS parent FROM c JOIN f USING (uuid) WHERE child <> path ORDER BY child, parent LIMIT 20")
def _(t):
    # twenty pairs are the report
    return O.fork_pairs(O.fork_edges(A.messages(t("conversations"))))


@query("f06_joined_turn_texts", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def _(t):
    rows = t("conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return rows.select("conv_id", F.array_join(F.transform("x", lambda s: s["text"]), "\n").alias("text"))


@query("f02_truncated_texts", "SELECT doc_id, CASE WHEN length(text) > 0 THEN substr(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1, 120) END AS head FROM documents")
def _(t):
    return t("documents").select("doc_id", X.truncated(F.col("text"), 120).alias("head"))


@query("p05_model_turns", f"WITH {A.MESSAGES} SELECT path, model, count(*) FILTER (NOT sidechain) AS turns, count(*) FILTER (sidechain) AS side_turns FROM messages WHERE model IS NOT NULL AND line_no % 5 <> 1 GROUP BY path, model")
def _(t):
    """Lines of the synthetic model are no model's turns."""
    rows = A.messages(t("conversations"))
    own = F.when((F.col("line_no") % 5 == 1) & F.col("model").isNotNull(), P.SYNTHETIC_MODEL).otherwise(F.col("model"))
    return O.session_models(rows.withColumn("model", own))

"""Signature queries over conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import signatures as O
from ..operators.catalogs import detect_by_table
from . import adapters as A
from .registry import query

_DAY = "substr(ts, 1, 10)"


def incidents(t):
    found = O.detect(A.messages(t("conversations")), A.CATALOG)
    return found.withColumn("session", F.col("path"))


def _catalog(spark, rules):
    return spark.createDataFrame(rules, "detector string, bucket string, priority int, pattern string, role string")


@query("f11_incidents", f"WITH {A.INCIDENTS} SELECT path, line_no, detector, bucket FROM incidents")
def _(t):
    rows = A.messages(t("conversations"))
    return detect_by_table(rows, _catalog(rows.sparkSession, A.CATALOG)).select("path", "line_no", "detector", "bucket")


_PAIR = "array_to_string(regexp_extract_all(text, '[A-Za-z]+')[1:2], ' ')"


@query("f11_rules_of_a_table", f"""WITH {A.MESSAGES}, r AS (SELECT DISTINCT {_PAIR} AS p, lang FROM documents WHERE length({_PAIR}) > 4),
h AS (SELECT path, line_no, lang, CASE WHEN length(p) > 12 THEN 'long' ELSE 'short' END AS bucket, row_number() OVER (PARTITION BY path, line_no, lang ORDER BY CASE WHEN length(p) > 12 THEN 1 ELSE 2 END, p) AS k
      FROM messages JOIN r ON contains(text, p) WHERE role = 'assistant')
SELECT path, line_no, lang AS detector, bucket FROM h WHERE k = 1""")
def _(t):
    """A catalog of as many rules as there are openings of documents: a message's text holds the first two words of one, by language."""
    pair = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), 1, 2), " ")
    opened = t("documents").select(pair.alias("pattern"), "lang").where("length(pattern) > 4").distinct()
    long = F.length("pattern") > 12
    rules = opened.select(F.col("lang").alias("detector"), F.when(long, "long").otherwise("short").alias("bucket"), F.when(long, 1).otherwise(2).alias("priority"), "pattern", F.lit("assistant").alias("role"))
    return detect_by_table(A.messages(t("conversations")), rules).select("path", "line_no", "detector", "bucket")


@query("f10_snippets", f"""WITH {A.MESSAGES}, h AS (SELECT path, line_no, text, regexp_extract(text, 'tion[a-z]*') AS hit FROM messages WHERE role = 'assistant' AND regexp_matches(text, 'tion[a-z]*')),
s AS (SELECT *, strpos(text, hit) - 1 AS before FROM h)
SELECT path, line_no, substr(trim(regexp_replace(substr(text, greatest(0, before - 80) + 1, before - greatest(0, before - 80) + length(hit) + 80), '\\s+', ' ', 'g')), 1, 220) AS snippet FROM s""")
def _(t):
    catalog = (("suffix", "any", 1, "tion[a-z]*", "assistant"),)
    return O.detect(A.messages(t("conversations")), catalog).select("path", "line_no", "snippet")


@query("a15_rows_and_sessions", f"WITH {A.INCIDENTS} SELECT detector, bucket, count(*) AS rows, count(DISTINCT session) AS sessions FROM incidents GROUP BY detector, bucket")
def _(t):
    return O.counts(incidents(t))


@query("a14_keyed_counts", f"WITH {A.INCIDENTS} SELECT 'c.' || detector || '.' || bucket AS key, count(*) AS n FROM incidents GROUP BY ALL")
def _(t):
    return incidents(t).groupBy(F.concat_ws(".", F.lit("c"), "detector", "bucket").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("a16_daily_series", f"WITH {A.INCIDENTS} SELECT detector, {_DAY} AS day, count(*) AS n FROM incidents WHERE bucket = 'strong' AND {_DAY} LIKE '2024-01%' GROUP BY ALL")
def _(t):
    return O.daily_series(incidents(t), F.substring("ts", 1, 10), buckets=("strong",), month="2024-01")


@query("a16_daily_events", "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    return O.daily_series(t("events"), F.date_format("ts", "yyyy-MM-dd"), by=("event_type",))


@query("a17_recurrent_sessions", f"WITH {A.INCIDENTS} SELECT session, count(*) AS n FROM incidents WHERE bucket = 'strong' AND NOT sidechain GROUP BY session HAVING count(*) >= 2")
def _(t):
    return O.recurrent(incidents(t).where("bucket = 'strong' and not sidechain"), 2)


@query("t01_top_recurrence", f"WITH {A.INCIDENTS} SELECT session, count(*) AS n FROM incidents GROUP BY session HAVING count(*) >= 2 ORDER BY n DESC, session LIMIT 10")
def _(t):
    # ten rows are the report
    return O.recurrent(incidents(t), 2).orderBy(F.desc("n"), "session").limit(10)


@query("t02_queues", f"WITH {A.INCIDENTS}, q AS (SELECT detector, path, line_no, row_number() OVER (PARTITION BY detector ORDER BY ts DESC NULLS LAST, path, line_no) AS place FROM incidents) SELECT detector, path, line_no, place::INTEGER AS place FROM q WHERE place <= 15")
def _(t):
    return O.queue(incidents(t), ("detector",), "ts", 15, tie=("path", "line_no")).select("detector", "path", "line_no", "place")


@query("w06_newest_per_session", f"WITH {A.INCIDENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY detector, session ORDER BY ts DESC NULLS LAST, line_no) AS k FROM incidents), q AS (SELECT detector, session, line_no, row_number() OVER (PARTITION BY detector ORDER BY ts DESC NULLS LAST, line_no, session) AS place FROM o WHERE k = 1) SELECT detector, session, line_no, place::INTEGER AS place FROM q WHERE place <= 10")
def _(t):
    return O.queue(incidents(t), ("detector",), "ts", 10, session="session", tie=("line_no", "session")).select("detector", "session", "line_no", "place")


@query("j06_known_incidents", f"WITH {A.INCIDENTS}, k AS (SELECT * FROM (VALUES ('a', 'admission', '1', NULL), ('b', 'user', '99', NULL), ('c', 'missing', '1', NULL), ('d', 'admission', 'zzz', NULL)) AS k(label, p, s, r)) SELECT label, bool_or(i.session IS NOT NULL) AS found FROM k LEFT JOIN incidents i ON starts_with(detector, p) AND contains(session, s) GROUP BY label")
def _(t):
    rows = incidents(t)
    known = rows.sparkSession.createDataFrame([("a", "admission", "1", None), ("b", "user", "99", None), ("c", "missing", "1", None), ("d", "admission", "zzz", None)], "label string, detector_prefix string, session_part string, snippet_pattern string")
    return O.known_found(known, rows)


@query("j06_known_from_orders", f"WITH {A.INCIDENTS}, k AS (SELECT o_orderkey::VARCHAR AS label, CASE o_orderkey % 3 WHEN 0 THEN 'admission' WHEN 1 THEN 'user' ELSE 'missing' END AS p, (o_custkey % 700)::VARCHAR AS s FROM orders), i AS (SELECT DISTINCT detector, session FROM incidents), d AS (SELECT DISTINCT p, s FROM k), f AS (SELECT DISTINCT p, s FROM d JOIN i ON starts_with(detector, p) AND contains(session, s)) SELECT label, f.p IS NOT NULL AS found FROM k LEFT JOIN f USING (p, s)")
def _(t):
    """A known incident for each order: more of them than could be broadcast."""
    k = F.col("o_orderkey")
    prefix = F.when(k % 3 == 0, "admission").when(k % 3 == 1, "user").otherwise("missing")
    known = t("orders").select(k.cast("string").alias("label"), prefix.alias("detector_prefix"), (F.col("o_custkey") % 700).cast("string").alias("session_part"), F.lit(None).cast("string").alias("snippet_pattern"))
    return O.known_found(known, incidents(t))


@query("x02_after_first_admission", f"WITH {A.INCIDENTS}, f AS (SELECT session, min(line_no) FILTER (detector = 'admission') AS start FROM incidents GROUP BY session) SELECT i.session, count(*) AS n_after FROM incidents i JOIN f USING (session) WHERE line_no > start AND detector <> 'admission' GROUP BY i.session")
def _(t):
    return O.after_first(incidents(t), "admission")


@query("x03_probe_cadence", "WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS gap FROM events) SELECT user_id, count(gap) AS gaps, round(avg(gap), 3) AS mean_gap, count(*) FILTER (gap < 86400) AS short_gaps FROM g GROUP BY user_id")
def _(t):
    return O.cadence(t("events"), "user_id", "ts", 86400.0).withColumn("mean_gap", F.round("mean_gap", 3))


@query("w04_last_total_before", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events")
def _(t):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t("events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(order).alias("last_purchase"))


def _spoken(t):
    """Messages whose turns open with the phrases of signatures."""
    rows = A.messages(t("conversations"))
    return A.opened_with(rows, F.col("path").cast("long") + F.col("line_no"), tuple(p[0] for p in A.PHRASES))


@query("f15_prose_detectors", f"WITH {A.MESSAGES} SELECT detector, bucket, count(*) AS rows, count(DISTINCT path) AS sessions FROM messages JOIN {A.values(A.PHRASES, 'phrase, who, detector, bucket')} ON i = (path::BIGINT + line_no) % {len(A.PHRASES)} AND who = role WHERE detector IS NOT NULL AND NOT (role = 'user' AND sidechain) GROUP BY detector, bucket")
def _(t):
    rows = O.admissible(_spoken(t))
    return O.counts(detect_by_table(rows, _catalog(rows.sparkSession, P.FAILURE_SIGNATURES + P.SUCCESS_SIGNATURES)).withColumn("session", F.col("path")))


@query("f14_synthetic_errors", f"WITH {A.MESSAGES} SELECT path, line_no, 'synthetic_error' AS detector, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 220) AS snippet FROM messages WHERE role = 'assistant' AND (path::BIGINT + line_no) % 9 = 4")
def _(t):
    rows = A.messages(t("conversations"))
    own = (F.col("role") == "assistant") & ((F.col("path").cast("long") + F.col("line_no")) % 9 == 4)
    return O.synthetic_errors(rows.withColumn("model", F.when(own, P.SYNTHETIC_MODEL).otherwise(F.col("model")))).select("path", "line_no", "detector", "snippet")


def _outputs(t):
    """Events as a program's outputs: errors are patches that did not apply."""
    failed = F.when(F.col("event_type") == "error", "apply_patch verification failed:   x").otherwise("done")
    kind = F.when(F.col("event_id") % 2 == 0, "function_call_output").when(F.col("event_id") % 5 == 0, "message").otherwise("custom_tool_call_output")
    return t("events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("line_no"), kind.alias("kind"), failed.alias("text"))


_FAILED = "event_type = 'error' AND (event_id % 2 = 0 OR event_id % 5 <> 0)"


@query("f14_patch_failures", f"SELECT event_id AS line_no, 'apply_patch_failed' AS detector, 'failed' AS bucket, 'apply_patch verification failed: x' AS snippet FROM events WHERE {_FAILED}")
def _(t):
    return O.patch_failures(_outputs(t)).select("line_no", "detector", "bucket", "snippet")


@query("a17_patch_loops", f"SELECT user_id::VARCHAR AS path, count(*) AS n FROM events WHERE {_FAILED} GROUP BY user_id HAVING count(*) >= 3")
def _(t):
    return O.recurrent(O.patch_failures(_outputs(t)), 3, session="path")


@query("f14_null_finals", """WITH e AS (SELECT user_id::VARCHAR AS path, event_id, CASE event_type WHEN 'purchase' THEN 'output' WHEN 'error' THEN 'task_complete' ELSE 'other' END AS kind, event_id % 3 AS m, value FROM events),
w AS (SELECT *, bool_or(kind = 'output') OVER o AS had, last_value(CASE WHEN event_id % 4 = 0 THEN event_id END IGNORE NULLS) OVER o AS tokens FROM e WINDOW o AS (PARTITION BY path ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id AS line_no, CASE WHEN had THEN 'after_output' ELSE 'zero_output' END AS bucket, tokens FROM w WHERE kind = 'task_complete' AND m < 2""")
def _(t):
    e = F.col("event_type")
    kind = F.when(e == "purchase", "output").when(e == "error", "task_complete").otherwise("other")
    message = F.when(F.col("event_id") % 3 == 0, F.lit(" \n")).when(F.col("event_id") % 3 == 2, "done")
    tokens = F.when(F.col("event_id") % 4 == 0, F.col("event_id"))
    rows = t("events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("line_no"), kind.alias("kind"), message.alias("last_message"), tokens.alias("total_tokens"))
    return O.null_finals(rows).select("line_no", "bucket", "tokens")


_TRIM = "trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query("f12_admissible", f"WITH {A.MESSAGES} SELECT path, line_no FROM messages WHERE length({_TRIM}) > 0 AND ((role = 'user' AND NOT sidechain AND line_no % 4 <> 0) OR (role = 'assistant' AND line_no % 5 <> 1))")
def _(t):
    rows = A.messages(t("conversations"))
    wrapped = (F.col("role") == "user") & (F.col("line_no") % 4 == 0)
    rows = rows.withColumn("text", F.when(wrapped, F.concat(F.lit("<command-name>x</command-name>"), "text")).otherwise(F.col("text")))
    return O.admissible(rows.withColumn("model", F.when((F.col("role") == "assistant") & (F.col("line_no") % 5 == 1), P.SYNTHETIC_MODEL).otherwise(F.col("model")))).select("path", "line_no")


def _calling(t, name, **given):
    """Messages that call a tool with an input of the given columns."""
    made = F.to_json(F.struct(*[c.alias(k) for k, c in given.items()]))
    return A.messages(t("conversations")).withColumn("tools", F.array(F.struct(name.alias("name"), made.alias("input"))))


@query("f12_truncated_pipes", f"WITH {A.MESSAGES} SELECT path, line_no, CASE line_no % 4 WHEN 0 THEN 'pipe_truncated_test' ELSE 'pipe_truncated_check' END AS detector FROM messages WHERE line_no % 4 < 2")
def _(t):
    n = F.col("line_no") % 4
    command = F.when(n == 0, "pytest -q suite | tail -5").when(n == 1, "make verify | head").when(n == 2, "ls | tail -3").otherwise("pytest -q")
    return O.truncated_pipes(_calling(t, F.lit("Bash"), command=command)).select("path", "line_no", "detector")


@query("f18_authored", f"WITH {A.MESSAGES} SELECT path, line_no, unnest(CASE line_no % 4 WHEN 0 THEN ['c' || line_no] WHEN 1 THEN ['n' || line_no] WHEN 2 THEN ['e1', 'e2'] END) AS authored FROM messages WHERE line_no % 4 < 3")
def _(t):
    n = F.col("line_no") % 4
    name = F.when(n == 0, "Write").when(n == 1, "Edit").when(n == 2, "MultiEdit").otherwise("Read")
    edits = F.array(F.struct(F.lit("e1").alias("new_string")), F.struct(F.lit("e2").alias("new_string")))
    rows = _calling(t, name, file_path=F.lit("/a/b.md"), content=F.concat(F.lit("c"), F.col("line_no").cast("string")), new_string=F.concat(F.lit("n"), F.col("line_no").cast("string")), edits=edits)
    return O.authored(rows).select("path", "line_no", "authored")


@query("f19_checkpoint_cadence", f"WITH {A.MESSAGES} SELECT path AS session, count(*) AS n, min(line_no) AS first_line, arg_max(ts, line_no) AS last_ts FROM messages WHERE line_no % 2 = 0 GROUP BY path HAVING count(*) >= 3")
def _(t):
    named = F.when(F.col("line_no") % 2 == 0, F.concat(F.lit("/w/HANDOFF-"), (F.col("line_no") % 3).cast("string"), F.lit(".md"))).otherwise("/w/notes.md")
    return O.checkpoint_cadence(_calling(t, F.lit("Edit"), file_path=named, new_string=F.lit("x"))).select("session", "n", "first_line", "last_ts")


@query("f13_phantom_tools", f"WITH {A.MESSAGES} SELECT path, line_no FROM messages WHERE role = 'assistant' AND line_no % 3 <> 2")
def _(t):
    """A tool named near its being missing, in one sentence; a full stop between them parts the two."""
    n = F.col("line_no") % 3
    said = F.when(n == 0, "prism is here but not available").when(n == 1, "falling back, since the LSP is gone").otherwise("prism is up. All else is not available")
    catalog = tuple(r for r in P.FAILURE_SIGNATURES if r[0] == "phantom_tool")
    return O.detect(A.messages(t("conversations")).withColumn("text", said), catalog).select("path", "line_no")


@query("f16_refutations", f"WITH {A.MESSAGES} SELECT path, line_no FROM messages WHERE role = 'assistant' AND line_no % 4 IN (0, 3)")
def _(t):
    """A refutation counts unless one of the words shortly before it denies it."""
    n = F.col("line_no") % 4
    said = F.when(n == 0, "the claim was refuted").when(n == 1, "the claim was never refuted").when(n == 2, "it didn't get overturned, nor disproven").otherwise("not one, as I had said a long while before: refuted")
    catalog = tuple(r for r in P.SUCCESS_SIGNATURES if r[0] == "refutation_accepted")
    return O.detect(A.messages(t("conversations")).withColumn("text", said), catalog).select("path", "line_no")


@query("f17_falsify_probes", f"WITH {A.MESSAGES} SELECT path, line_no FROM messages WHERE role = 'assistant' AND line_no % 3 <> 2")
def _(t):
    """A falsification with a hypothesis, probe or expectation within 400 characters to either side."""
    n = F.col("line_no") % 3
    far = F.repeat(F.lit("x "), 250)
    said = F.when(n == 0, F.concat(F.lit("a probe "), F.repeat(F.lit("y "), 100), F.lit("would falsify it"))).when(n == 1, F.lit("to falsify the claim, I expect 3")).otherwise(F.concat(F.lit("a probe "), far, F.lit("would falsify it")))
    catalog = tuple(r for r in P.SUCCESS_SIGNATURES if r[0] == "expect_falsify_probe")
    return O.detect(A.messages(t("conversations")).withColumn("text", said), catalog).select("path", "line_no")

"""Scalar functions over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as X
from ..operators import integrity as I
from .registry import query


@query("f05_pattern_counts", "SELECT doc_id, regexp_matches(text, '(?i)no,|wrong|stop|not what') AS frustrated, len(regexp_extract_all(text, '(?i)tion'))::BIGINT AS suffixes FROM documents")
def _(t):
    return t("documents").select("doc_id", F.col("text").rlike("(?i)no,|wrong|stop|not what").alias("frustrated"), F.regexp_count("text", F.lit("(?i)tion")).cast("long").alias("suffixes"))


@query("f07_project_paths", "SELECT page_id, replace(replace(url, '/', '-'), '-', '/') AS path FROM pages")
def _(t):
    return t("pages").select("page_id", X.project_path(F.replace("url", F.lit("/"), F.lit("-"))).alias("path"))


@query("f08_minutes", "SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 60000000::DOUBLE AS minutes FROM events")
def _(t):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return t("events").select("event_id", X.minutes_between(F.lit("2024-01-01T00:00:00Z"), stamp).alias("minutes"))


@query("f24_booleans", "SELECT o_orderkey, lower(trim(v)) IN ('true', '1', 'yes') AS flag FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN ' TRUE ' WHEN 1 THEN '1' WHEN 2 THEN 'Yes' WHEN 3 THEN 'no' ELSE '' END AS v FROM orders)")
def _(t):
    k = F.col("o_orderkey") % 6
    v = F.when(k == 0, " TRUE ").when(k == 1, "1").when(k == 2, "Yes").when(k == 3, "no").otherwise("")
    return t("orders").select("o_orderkey", X.as_boolean(v).alias("flag"))


@query("f30_tokens_used", "SELECT l_orderkey, l_linenumber, (l_partkey * 1000 + l_suppkey) AS tokens FROM lineitem")
def _(t):
    n = F.col("l_partkey") * 1000 + F.col("l_suppkey")
    log = F.concat(F.lit("work done\ntokens used: "), F.format_number(n, 0), F.lit("\nbye"))
    return t("lineitem").select("l_orderkey", "l_linenumber", X.tokens_used(log).alias("tokens"))


@query("f21_last_section", "SELECT item_id, CASE WHEN contains(text, 'the') THEN string_split(text, 'the')[-1] END AS tail FROM benchmark")
def _(t):
    return t("benchmark").select("item_id", X.last_section(F.col("text"), "the").alias("tail"))


@query("f33_json_objects", """SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events""")
def _(t):
    body = X.json_object(F.concat(F.lit("noise "), "props", F.lit(" noise")))
    return t("events").select("event_id", F.try_variant_get(F.try_parse_json(body), "$.k", "bigint").alias("k"))


@query("f31_without_comments", "SELECT page_id, length(regexp_replace(html, '<!--.*?-->', '', 'gs'))::BIGINT AS chars FROM pages")
def _(t):
    return t("pages").select("page_id", F.length(X.without_comments(F.col("html"))).cast("long").alias("chars"))


@query("a35_passed_tests", "SELECT o_orderkey, (o_orderkey % 50 + o_custkey % 20)::BIGINT AS passed FROM orders")
def _(t):
    log = F.format_string("running\ntest result: ok. %d passed; 0 failed\n== %d passed in 1s ==\nend", F.col("o_orderkey") % 50, F.col("o_custkey") % 20)
    return t("orders").select("o_orderkey", X.passed_tests(log).alias("passed"))


@query("f25_quote_keys", "SELECT item_id, lower(trim(regexp_replace(regexp_replace(replace(replace('“' || text || '”', '“', '\"'), '”', '\"'), '[*_`]', '', 'g'), '\\s+', ' ', 'g'))) AS key FROM benchmark")
def _(t):
    return t("benchmark").select("item_id", X.quote_key(F.concat(F.lit("“"), "text", F.lit("”"))).alias("key"))


@query("f36_formats", "SELECT l_returnflag, printf('%+.1f%%', round(sum(l_quantity) / 1000.0, 1)) AS shown FROM lineitem GROUP BY l_returnflag")
def _(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("q")).select("l_returnflag", S.signed_percent(F.round(F.col("q") / 1000.0, 1)).alias("shown"))


@query("f38_digests", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("a02_wilson_grid", "WITH g AS (SELECT DISTINCT l_linenumber::BIGINT AS k, l_quantity::BIGINT AS n FROM lineitem WHERE l_linenumber <= l_quantity), w AS (SELECT k, n, k / n::DOUBLE AS p FROM g) SELECT k, n, round(greatest(0.0, (p + 3.841458820694124 / (2 * n) - 1.959963984540054 * sqrt(p * (1 - p) / n + 3.841458820694124 / (4.0 * n * n))) / (1 + 3.841458820694124 / n)), 9) AS lo, round(least(1.0, (p + 3.841458820694124 / (2 * n) + 1.959963984540054 * sqrt(p * (1 - p) / n + 3.841458820694124 / (4.0 * n * n))) / (1 + 3.841458820694124 / n)), 9) AS hi FROM w")
def _(t):
    grid = t("lineitem").select(F.col("l_linenumber").cast("long").alias("k"), F.col("l_quantity").cast("long").alias("n")).where("k <= n").distinct()
    ci = S.wilson("k", "n")
    return grid.select("k", "n", F.round(ci["lo"], 9).alias("lo"), F.round(ci["hi"], 9).alias("hi"))


@query("a08_mcnemar_grid", "WITH g AS (SELECT DISTINCT l_linenumber::BIGINT AS b, l_quantity::BIGINT AS c FROM lineitem) SELECT b, c, round(1e-9 + least(1.0, 2 * list_sum([exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * 0.6931471805599453) FOR i IN range(0, least(b, c) + 1)])), 5) AS p_value FROM g")
def _(t):
    grid = t("lineitem").select(F.col("l_linenumber").cast("long").alias("b"), F.col("l_quantity").cast("long").alias("c")).distinct()
    return grid.select("b", "c", F.round(S.mcnemar_p("b", "c") + 1e-9, 5).alias("p_value"))


@query("x05_adjusted_prevalence", "SELECT l_linestatus, round(least(1.0, greatest(0.0, (avg((l_returnflag = 'R')::INT) + 0.95 - 1) / (0.9 + 0.95 - 1))), 9) AS prevalence FROM lineitem GROUP BY l_linestatus")
def _(t):
    observed = t("lineitem").groupBy("l_linestatus").agg(F.avg((F.col("l_returnflag") == "R").cast("int")).alias("p"))
    return observed.select("l_linestatus", F.round(S.adjusted_prevalence("p", F.lit(0.9), F.lit(0.95)), 9).alias("prevalence"))


_HUNKS = """WITH h AS (SELECT o_custkey::VARCHAR AS path, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS hunk FROM orders),
c AS (SELECT path, hunk, hunk * 10 AS old_start, 3::BIGINT AS old_declared, hunk * 10 AS new_start, (3 + o_orderkey % 2)::BIGINT AS new_declared, 3::BIGINT AS old_counted, 4::BIGINT AS new_counted, 2::BIGINT AS added, 1::BIGINT AS removed FROM h)
SELECT *, hunk - 1 AS shift, true AS old_ok, new_declared = new_counted AS new_ok, false AS overlaps, hunk = 1 AS placed_ok FROM c"""


def _diff_lines(t):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    orders = t("orders")
    dealt = orders.repartition(orders.count() // I.TASK_LINES + 1, "o_custkey")  # a count that files keep
    hunks = dealt.select(F.col("o_custkey").cast("string").alias("path"), n.alias("n"), (F.col("o_orderkey") % 2).alias("odd"))
    body = F.array(F.format_string("@@ -%d,3 +%d,%d @@", F.col("n") * 10, F.col("n") * 10, F.col("odd") + 3), F.lit(" a"), F.lit("-b"), F.lit("+c"), F.lit("+d"), F.lit(" e"))
    lines = hunks.select("path", "n", F.posexplode(body).alias("i", "line")).select("path", (F.col("n") * 10 + F.col("i")).alias("line_no"), "line")
    return lines


@query("a40_hunk_audit", _HUNKS)
def _(t):
    return I.hunks(_diff_lines(t))


@query("x28_table_function_hunks", _HUNKS)
def _(t):
    """The same by a function that takes a table, dealt by path and ordered by line, in blocks of lines."""
    from ..functions.registered import line_blocks, register

    lines = line_blocks(_diff_lines(t))
    register(lines.sparkSession)
    return lines.sparkSession.sql("SELECT * FROM tw_hunks(TABLE({lines}))", lines=lines)


@query("f36_intervals", "SELECT l_returnflag, printf('[%.1f%%, %.1f%%]', round(min(l_discount) * 100, 1), round(max(l_discount) * 100, 1)) AS shown FROM lineitem GROUP BY l_returnflag")
def _(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.min("l_discount").alias("lo"), F.max("l_discount").alias("hi")).select("l_returnflag", S.interval("lo", "hi").alias("shown"))


@query("f31_open_slots", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'diff,task' WHEN 1 THEN '' ELSE 'task' END AS slots FROM orders")
def _(t):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, "a {{diff}} b {{ task }} c {{diff}}").when(k == 1, "a {{ }} {x} {{1}}").otherwise("{{task}}")
    return t("orders").select("o_orderkey", F.array_join(X.open_slots(text), ",").alias("slots"))


@query("f37_harvested_strings", "SELECT event_id, event_type || '|deep|' || CASE WHEN event_id % 2 = 0 THEN 'x' ELSE 'y' END AS strings FROM events")
def _(t):
    raw = F.concat(F.lit('{"a": "'), "event_type", F.lit('", "b": [1, null, {"c": "deep"}], "d": {"e": {"f": {"g": "'), F.when(F.col("event_id") % 2 == 0, "x").otherwise("y"), F.lit('", "h": {"i": "too deep"}}}}}'))
    found = I.harvested_strings(t("events").select("event_id", raw.alias("raw")), "event_id", "raw")
    return found.select("event_id", F.array_join("strings", "|").alias("strings"))


@query("f01_own_words", "SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS own FROM conversations")
def _(t):
    wrapped = F.concat(F.lit("<system-reminder>a\nb</system-reminder> "), "text", F.lit("\n<command-args>y</command-args>"))
    return t("conversations").select("conv_id", "turn", X.without_wrappers(wrapped).alias("own"))


@query("f04_prompts", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'p' || doc_id WHEN doc_id % 3 = 1 THEN '{\"agent_name\": \"a\", \"prompt\": \" \"}' ELSE '{\"prompt\": \"x\"}' END AS prompt FROM labels")
def _(t):
    """The prompt inside a dispatch envelope; an empty one, or an object of another kind, stays as it is."""
    d = F.col("doc_id")
    text = F.when(d % 3 == 0, F.concat(F.lit('{"agent_name": "a", "prompt": "p'), d.cast("string"), F.lit('"}'))).when(d % 3 == 1, '{"agent_name": "a", "prompt": " "}').otherwise('{"prompt": "x"}')
    return t("labels").select("doc_id", X.unwrapped_prompt(text).alias("prompt"))


@query("f32_sections", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '## A' || chr(10) || 'body ' || doc_id || chr(10) END AS section FROM labels")
def _(t):
    d = F.col("doc_id")
    text = F.when(d % 2 == 0, F.concat(F.lit("# t\n## A\nbody "), d.cast("string"), F.lit("\n## B\nx"))).otherwise("# t\n## AB\nx")
    return t("labels").select("doc_id", X.section(text, "A").alias("section"))

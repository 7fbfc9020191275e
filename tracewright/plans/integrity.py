"""Integrity queries over documents, benchmark items and the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import integrity as O
from ..sources.shared import written
from . import adapters as A
from .experiment import run_summary
from .registry import query


@query("p13_required_fields", "SELECT o_orderkey, 'o_orderstatus' AS field, 'not allowed' AS problem FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT o_orderkey, 'priority', 'missing' FROM orders WHERE o_orderkey % 10 = 0")
def _(t):
    rows = t("orders").withColumn("priority", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderpriority")).otherwise("  "))
    return O.required_fields(rows, "o_orderkey", ("o_orderdate", "priority"), {"o_orderstatus": ("F", "O")})


@query("u04_repeated_ids", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def _(t):
    return O.repeated_ids(t("lineitem"), "l_orderkey")


@query("j14_manifest_against_truth", "SELECT coalesce(m.doc_id, t.doc_id) AS doc_id, stated, actual, CASE WHEN t.doc_id IS NULL THEN 'no truth' WHEN m.doc_id IS NULL THEN 'orphan' ELSE 'differs' END AS problem FROM (SELECT doc_id, lang = 'en' AS stated FROM documents) m FULL JOIN (SELECT doc_id, quality = 1 AS actual FROM labels) t ON m.doc_id = t.doc_id WHERE t.doc_id IS NULL OR m.doc_id IS NULL OR stated IS DISTINCT FROM actual")
def _(t):
    m = t("documents").select("doc_id", (F.col("lang") == "en").alias("seeded"))
    return O.flag_mismatches(m, t("labels").select("doc_id", (F.col("quality") == 1).alias("seeded")), "doc_id", "seeded")


@query("u08_record_drift", "WITH a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, 4::BIGINT AS n FROM orders) SELECT k, n, 'recomputed' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT k, n, 'committed' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def _(t):
    a = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return O.record_drift(a, t("orders").select(F.col("o_orderkey").alias("k"), F.lit(4).cast("long").alias("n")))


@query("p18_touched", "SELECT o_orderkey FROM orders WHERE o_orderkey % 9 = 0 OR o_orderstatus = 'P'")
def _(t):
    before = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    after = before.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"), F.when(F.col("o_orderkey") % 9 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return O.touched(before, after, "o_orderkey", ("o_orderstatus", "o_totalprice"))


def _cites(docs):
    """One citation per document: a line's first characters, cited up to seven lines off, some misquoted, spliced or of no file."""
    lines = O.line_rows(docs.select(F.col("doc_id").cast("string").alias("path"), "text"), "path", "text")
    picked = lines.where("length(line) > 20").groupBy("path").agg(F.min(F.struct("line_no", "line")).alias("x"))
    n = F.col("path").cast("long")
    line = F.col("x.line")
    quote = F.when(n % 11 == 5, F.concat(F.lit("no such words "), "path")).when(n % 11 == 7, F.concat(F.substring(line, 1, 8), F.lit(" ... "), F.substring(line, -8, 8))).otherwise(F.substring(line, 1, 18))
    off = F.when(n % 3 == 0, 0).when(n % 3 == 1, 3).otherwise(7)
    path = F.when(n % 13 == 6, F.concat(F.lit("no-"), "path")).otherwise(F.col("path"))
    return lines, picked.select(F.concat(F.lit("c"), "path").alias("cite"), path.alias("path"), (F.col("x.line_no") + off).alias("line"), quote.alias("quote"))


_LINES = """l AS (SELECT path, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM (SELECT doc_id::VARCHAR AS path, string_split(text, chr(10)) AS ls FROM documents)),
p AS (SELECT path, path::BIGINT AS i, min(line_no) AS first, arg_min(line, line_no) AS line FROM l WHERE length(line) > 20 GROUP BY path),
c AS (SELECT 'c' || path AS cite, CASE WHEN i % 13 = 6 THEN 'no-' || path ELSE path END AS path, first + CASE i % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 7 END AS ln,
      CASE WHEN i % 11 = 5 THEN 'no such words ' || path WHEN i % 11 = 7 THEN substr(line, 1, 8) || ' ... ' || line[-8:] ELSE substr(line, 1, 18) END AS quote FROM p)"""


def _key(text: str) -> str:
    """The form in which quotes compare, for texts without compatibility characters."""
    return f"lower(trim(regexp_replace(regexp_replace({text}, '[*_`]', '', 'g'), '\\s+', ' ', 'g')))"


_GRADES = rf"""{_LINES}, k AS MATERIALIZED (SELECT path, line_no, {_key('line')} AS key FROM l), q AS (SELECT cite, path, ln, {_key('quote')} AS q FROM c), n AS (SELECT path, count(*) AS n FROM l GROUP BY path),
h AS (SELECT cite, arg_min(line_no, abs(line_no - ln) * 100000000 + line_no) AS nearest FROM q JOIN k ON q.path = k.path WHERE contains(key, q) GROUP BY cite),
e AS (SELECT cite, path, unnest(regexp_split_to_array(q, '\s*(?:\.\.\.|…)\s*')) AS part FROM q),
s AS (SELECT cite, count(*) > 1 AND bool_and(EXISTS (SELECT 1 FROM k WHERE k.path = e.path AND contains(key, part))) AS spliced FROM e WHERE length(part) > 0 GROUP BY cite),
g AS (SELECT q.cite, q.path, q.ln AS line, nearest, CASE WHEN n IS NULL THEN 'NO-FILE' WHEN nearest = q.ln THEN 'VALID' WHEN abs(nearest - q.ln) <= 5 THEN 'DRIFT' WHEN nearest IS NOT NULL THEN 'ELSEWHERE' WHEN coalesce(spliced, false) THEN 'SPLICE?' ELSE 'NOT-FOUND' END AS grade
      FROM q LEFT JOIN n ON q.path = n.path LEFT JOIN h ON q.cite = h.cite LEFT JOIN s ON q.cite = s.cite)"""


@query("f27_cited_lines", f"WITH {_LINES}, n AS (SELECT path, count(*) AS n FROM l GROUP BY path), w AS (SELECT cite, string_agg(l.line, ' ' ORDER BY line_no) AS win FROM c JOIN l USING (path) WHERE abs(line_no - ln) <= 5 GROUP BY cite) SELECT c.cite, c.path, ln AS line, CASE WHEN n IS NULL THEN 'missing file' WHEN ln > n THEN 'out of range' WHEN NOT contains(trim(regexp_replace(coalesce(win, ''), '\\s+', ' ', 'g')), trim(regexp_replace(quote, '\\s+', ' ', 'g'))) THEN 'bad quote' ELSE 'ok' END AS status FROM c LEFT JOIN n USING (path) LEFT JOIN w USING (cite)")
def _(t):
    lines, cites = _cites(t("documents"))
    return O.check_ranges(cites, lines)


@query("f26_citation_grades", f"WITH {_GRADES} SELECT cite, path, line, nearest, grade FROM g")
def _(t):
    lines, cites = _cites(t("documents"))
    return O.grade_citations(cites, lines)


_FILES = "files AS (SELECT doc_id, '/w/' || coalesce(source, 'x') || '/' || substr(md5(doc_id::VARCHAR), 1, 10) || '.jsonl' AS path FROM documents)"


@query("f26_citations_by_short_name", f"""WITH {_FILES}, c AS (SELECT doc_id, path, CASE doc_id % 4 WHEN 0 THEN path WHEN 1 THEN substr(md5(doc_id::VARCHAR), 1, 8) WHEN 2 THEN '…/' || string_split(path, '/')[-1] ELSE '…/nowhere/' || doc_id END AS said FROM files)
SELECT 'c' || doc_id AS cite, CASE WHEN doc_id % 4 = 3 THEN said ELSE path END AS path, CASE doc_id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'short id' WHEN 2 THEN 'suffix' ELSE 'none' END AS how, CASE WHEN doc_id % 4 = 3 THEN 'NO-FILE' ELSE 'VALID' END AS grade FROM c""")
def _(t):
    """Citations that name files in full, by the first eight characters of their names, or by the ends of their paths, and quote their first lines."""
    d, m = F.col("doc_id"), F.col("doc_id") % 4
    name = F.md5(d.cast("string"))
    path = F.concat(F.lit("/w/"), F.coalesce("source", F.lit("x")), F.lit("/"), F.substring(name, 1, 10), F.lit(".jsonl"))
    files = t("documents").select("doc_id", path.alias("path"), "text")
    lines = O.line_rows(files, "path", "text")
    said = F.when(m == 0, path).when(m == 1, F.substring(name, 1, 8)).when(m == 2, F.concat(F.lit("…/"), F.substring(name, 1, 10), F.lit(".jsonl"))).otherwise(F.concat(F.lit("…/nowhere/"), d.cast("string")))
    quote = F.substring(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), 1, 30)
    cites = t("documents").select(F.concat(F.lit("c"), d.cast("string")).alias("cite"), said.alias("path"), F.lit(1).cast("long").alias("line"), quote.alias("quote"))
    named = written(O.resolve_paths(cites, files, lines))
    return O.grade_citations(named, lines).join(named.select("cite", "how"), "cite").select("cite", "path", "how", "grade")


@query("a36_grade_tallies", f"WITH {_GRADES} SELECT grade, count(*) AS n FROM g GROUP BY grade")
def _(t):
    lines, cites = _cites(t("documents"))
    return O.grade_tallies(O.grade_citations(cites, lines))


@query("s22_basename_index", "WITH p AS (SELECT '/r' || (doc_id % 7) || '/f' || (doc_id % 50) AS path FROM documents) SELECT string_split(path, '/')[-1] AS name, min(path) AS path, count(*) AS n_paths FROM p GROUP BY 1")
def _(t):
    d = F.col("doc_id")
    return O.basename_index(t("documents").select(F.concat(F.lit("/r"), (d % 7).cast("string"), F.lit("/f"), (d % 50).cast("string")).alias("path")))


@query("f28_text_rules", "SELECT doc_id, 'R1' AS rule, 'gate' AS severity FROM documents WHERE NOT regexp_matches(text, 'tion') UNION ALL SELECT doc_id, 'R2', 'note' FROM documents WHERE regexp_matches(text, '[|] ')")
def _(t):
    return O.text_rules(t("documents"), "doc_id", "text", (("R1", "gate", "tion", True), ("R2", "note", "[|] ", False)))


@query("f29_paragraphs", r"SELECT item_id, (i - 1)::INTEGER AS paragraph_no, p AS paragraph FROM (SELECT item_id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT item_id, regexp_split_to_array(replace(text, '.' || chr(10), '.' || chr(10) || ' ' || chr(10)), '\n\s*\n') AS ps FROM benchmark)) WHERE length(trim(p)) > 0")
def _(t):
    return O.paragraphs(t("benchmark").select("item_id", F.replace("text", F.lit(".\n"), F.lit(".\n \n")).alias("text")), "item_id", "text")


@query("a39_budgets", "SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS lines, length(text)::BIGINT AS chars FROM documents WHERE len(string_split(text, chr(10))) > 10 OR length(text) > 4000")
def _(t):
    return O.budgets(t("documents"), "doc_id", "text", 10, 4000)


@query("a39_token_budgets")
def _(t):
    """Turns over a budget of tokens; no SQL counts tokens."""
    import public_tokenizers

    return O.token_budgets(t("conversations"), ("conv_id", "turn"), "text", 128, public_tokenizers.path("byte_bpe_50k.json"))


_RECORDS = "r AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'baseline' ELSE 'treatment' END AS arm, CASE WHEN doc_id % 50 = 7 THEN 'other' WHEN doc_id % 2 = 0 THEN 'baseline' ELSE 'treatment' END AS said, doc_id % 40 AS out, CASE WHEN doc_id % 30 <> 1 THEN true END AS ok, doc_id % 11 = 0 AS error FROM labels), n AS (SELECT arm, count(*) AS n FROM r GROUP BY arm)"


@query("p19_artifact_gate", f"""WITH {_RECORDS}
SELECT 'metrics.json' AS place, 'missing' AS problem UNION ALL SELECT 'report.md', 'lacks Estimand:'
UNION ALL SELECT kind || '/' || arm, 'expected 100 records, found ' || n FROM n, (VALUES ('calls'), ('judge')) AS k(kind) WHERE n <> 100
UNION ALL SELECT arm || '-' || doc_id, 'another arm' FROM r WHERE said <> arm UNION ALL SELECT arm || '-' || doc_id, 'no output tokens' FROM r WHERE out <= 0
UNION ALL SELECT arm || '-' || doc_id, 'item_pass is no flag' FROM r WHERE ok IS NULL UNION ALL SELECT arm || '-' || doc_id, 'judge error' FROM r WHERE error""")
def _(t):
    d = F.col("doc_id")
    arm = F.when(d % 2 == 0, "baseline").otherwise("treatment")
    file = F.concat_ws("-", arm, d).alias("file")
    rows = t("labels")
    calls = rows.select(file, arm.alias("arm"), F.when(d % 50 == 7, "other").otherwise(arm).alias("said"), (d % 40).alias("output_tokens"))
    judge = rows.select(file, arm.alias("arm"), F.when(d % 30 != 1, F.lit(True)).alias("item_pass"), (d % 11 == 0).alias("judge_error"))
    texts = t("region").where("r_regionkey = 0").select(F.lit("report.md").alias("name"), F.lit("PROVISIONAL report").alias("text"))
    return O.artifact_gate(texts.select("name"), calls, judge, texts, ("report.md", "metrics.json"), {"report.md": ("PROVISIONAL", "Estimand:")}, ("baseline", "treatment"), 100)


@query("p19_metric_keys", "SELECT 'metrics.json' AS place, 'lacks the field ' || k AS problem FROM (VALUES ('baseline_median'), ('flips')) AS x(k) UNION ALL SELECT 'bad.json', 'is no JSON object' UNION ALL SELECT 'report.md', 'lacks Estimand:'")
def _(t):
    """A run's own summary as its metrics, against the fields that a run must report; two of them it lacks."""
    row = run_summary(t)
    text = lambda name, value: row.select(F.lit(name).alias("name"), value.alias("text"))
    texts = text("metrics.json", F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).unionByName(text("bad.json", F.lit("[1]"))).unionByName(text("report.md", F.concat(F.lit("PROVISIONAL "), "caveats")))
    texts = written(texts)
    none = A.judge(t("labels")).limit(0).select(F.lit("").alias("file"), "arm", F.col("arm").alias("said"), F.col("seq").alias("output_tokens"), "item_pass", "judge_error")
    keys = {"metrics.json": ("baseline_rate", "treatment_wilson_hi", "p_value", "logical_pct", "parse_failures", "baseline_median", "flips"), "bad.json": ("x",)}
    return O.artifact_gate(texts.select("name"), none, none, texts, ("metrics.json", "report.md"), {"report.md": ("PROVISIONAL", "Estimand:")}, ("baseline", "treatment"), 0, keys)


@query("p13_unexpected_fields", "SELECT event_id, 'extra' AS field FROM events WHERE event_id % 3 = 0")
def _(t):
    raw = F.when(F.col("event_id") % 3 == 0, F.lit('{"k": 1, "extra": 2}')).otherwise(F.col("props"))
    return O.unexpected_fields(t("events").select("event_id", raw.alias("raw")), "event_id", "raw", ("k",))


@query("j13_missing_files", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def _(t):
    return t("part").join(t("lineitem").where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")

"""Verdict queries: blocks, answers and documents composed from labels, items and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import verdicts as V
from . import adapters as A
from .registry import query


def _blocks(t):
    d = F.col("doc_id")
    verdict = F.when(d % 7 == 0, "**VERDICT**: approve").when(d % 7 == 1, "## VERDICT: REJECT").when(d % 7 == 2, "no verdict here").otherwise("VERDICT: **REJECT**")
    findings = F.when(d % 5 == 0, "No findings.").when(d % 5 == 1, F.concat(F.lit("1. a"), d.cast("string"), F.lit("\n- b"))).when(d % 5 == 2, F.concat(F.lit("* c"), d.cast("string"))).otherwise("")
    return t("labels").select("doc_id", "toxic", F.concat(F.lit("CHECKLIST done\n## FINDINGS old\n## FINDINGS\n"), verdict, F.lit("\n"), findings, F.lit("\n")).alias("output"))


_BLOCKS = """b AS (SELECT doc_id, toxic, CASE WHEN doc_id % 7 = 0 THEN 'APPROVE' WHEN doc_id % 7 = 2 THEN '' ELSE 'REJECT' END AS word,
CASE WHEN doc_id % 5 = 1 THEN ['a' || doc_id, 'b'] WHEN doc_id % 5 = 2 THEN ['c' || doc_id] ELSE [] END AS f, doc_id % 5 = 0 AS none FROM labels),
r AS (SELECT *, word <> '' AND (len(f) > 0 OR (word <> 'REJECT' AND none)) AS ok FROM b)"""


@query("f20_verdict_blocks", f"WITH {_BLOCKS} SELECT doc_id, CASE WHEN NOT ok THEN '' WHEN len(f) = 2 THEN '## FINDINGS' || chr(10) || 'VERDICT: ' || word || chr(10) || '1. ' || f[1] || chr(10) || '2. ' || f[2] || chr(10) WHEN len(f) = 1 THEN '## FINDINGS' || chr(10) || 'VERDICT: ' || word || chr(10) || '1. ' || f[1] || chr(10) ELSE '## FINDINGS' || chr(10) || 'VERDICT: ' || word || chr(10) || 'No findings.' || chr(10) END AS normalized, ok AS parse_ok, word = 'REJECT' AS flagged FROM r")
def _(t):
    _, block = V.split_block(F.col("output"))
    return _blocks(t).select("doc_id", V.read_block(block).alias("x")).select("doc_id", "x.normalized", "x.parse_ok", "x.flagged")


@query("f22_directives", "SELECT doc_id, doc_id % 2 = 0 AS checklist, doc_id % 3 = 0 AS disconfirm, doc_id % 5 = 1 AS verify FROM labels")
def _(t):
    """Labels in the working text count in upper case and as whole words; those after the findings heading do not."""
    d = F.col("doc_id")
    work = F.concat(
        F.when(d % 2 == 0, "CHECKLIST done. ").otherwise("CHECKLISTS "), F.when(d % 3 == 0, "DISCONFIRM: x ").otherwise("disconfirm "),
        F.when(d % 5 == 1, "VERIFY\n").otherwise("VERIFYING\n"), F.lit("## FINDINGS\nCHECKLIST DISCONFIRM VERIFY\n"),
    )
    before, _ = V.split_block(F.col("output"))
    return t("labels").select("doc_id", work.alias("output")).select("doc_id", V.directives_followed(before).alias("x")).select("doc_id", "x.*")


@query("x06_asserted_precision", f"WITH {_BLOCKS} SELECT toxic, sum(CASE WHEN ok THEN len(f) ELSE 0 END)::BIGINT AS asserted, sum(doc_id % 2)::BIGINT AS false, round(sum(doc_id % 2) / sum(CASE WHEN ok THEN len(f) ELSE 0 END)::DOUBLE, 9) AS false_share FROM r GROUP BY toxic")
def _(t):
    _, block = V.split_block(F.col("output"))
    rows = _blocks(t).select("toxic", V.read_block(block)["n_findings"].alias("n_findings"), (F.col("doc_id") % 2).alias("false_findings"))
    return V.asserted_precision(rows, ("toxic",)).withColumn("false_share", F.round("false_share", 9))


@query("f34_judge_answers", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'not an object' WHEN 1 THEN 'missing false_findings' WHEN 2 THEN 'bad defect entry' WHEN 3 THEN 'neutral_matched is no integer' END AS problem FROM events""")
def _(t):
    e = F.col("event_id") % 5
    good = '{"defects": [{"defect_id": "D1", "found": true}], "false_findings": 0, "neutral_matched": 1}'
    raw = (
        F.when(e == 0, F.lit("[1]")).when(e == 1, F.lit('{"defects": [], "neutral_matched": 1}')).when(e == 2, F.lit(good.replace("true", '"yes"')))
        .when(e == 3, F.lit(good.replace("1}", "true}"))).otherwise(F.lit(good))
    )
    return t("events").select("event_id", V.judge_answer(raw).alias("problem"))


@query("p12_evidence_passed", "SELECT l_orderkey, l_linenumber, l_returnflag <> 'R' AND l_quantity < 45 AND (l_partkey % 3 = 0 OR l_quantity >= 10) AS passed FROM lineitem")
def _(t):
    row = {
        "error": F.col("l_returnflag") == "R", "timed_out": F.lit(None).cast("boolean"), "returncode": F.when(F.col("l_quantity") < 45, 0).otherwise(1),
        "expect_min_tests": F.when(F.col("l_partkey") % 3 != 0, 10), "matched_tests": F.col("l_quantity").cast("long"),
    }
    return t("lineitem").select("l_orderkey", "l_linenumber", V.evidence_passed(row).alias("passed"))


@query("p20_needs_verification", "SELECT o_orderkey, o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 AS needed FROM orders")
def _(t):
    k = F.col("o_orderkey")
    paths = F.array(F.lit("docs/a.py"), F.when(k % 2 == 0, "src/a.py").otherwise("README.md"), F.when(k % 3 == 0, "Makefile").otherwise("x.rst"))
    return t("orders").select("o_orderkey", V.needs_verification(paths).alias("needed"))


_GATE = """g AS (SELECT event_id, event_id % 5 IN (1, 2) OR event_id % 4 = 1 AS due, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN event_type || chr(10) || '## VERIFIED' || chr(10) || user_id || ' tests passed' ELSE '## not verified' || chr(10) || props END AS note FROM events)"""


@query("p20_verify_gate", f"WITH {_GATE} SELECT event_id, CASE WHEN NOT due THEN '' WHEN length(note) = 0 THEN 'missing' WHEN note LIKE '%## VERIFIED%' THEN 'not verified section' ELSE 'test total,verified section' END AS problems FROM g")
def _(t):
    """Sessions whose changes need a verification note, and what theirs lacks; files that are not tracked and documents need none."""
    e = F.col("event_id")
    status = F.concat(
        F.lit("?? scratch/new.py\n"), F.when(e % 5 == 1, F.lit(" M src/a.py\n")).when(e % 5 == 2, F.lit("R  docs/a.md -> lib/b.rs\n")).otherwise(F.lit(" M docs/a.py\nM  README.md\n")),
        F.when(e % 4 == 1, F.lit("A  Makefile")).otherwise(F.lit(" M VERIFICATION.md")),
    )
    note = F.when(e % 3 == 0, "").when(e % 3 == 1, F.concat(F.col("event_type"), F.lit("\n## VERIFIED\n"), F.col("user_id").cast("string"), F.lit(" tests passed"))).otherwise(F.concat(F.lit("## not verified\n"), F.col("props")))
    return t("events").select("event_id", F.array_join(V.gate_problems(status, note), ",").alias("problems"))


@query("f40_ground_truths", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'Seeded item. Its defects:' || chr(10) || '- id: D' || doc_id || chr(10) || '  description: d' || chr(10) || 'Neither credited nor counted:' || chr(10) || '- n' ELSE 'Clean item. It has no defects.' || chr(10) || 'Rationale: why' END AS truth FROM labels")
def _(t):
    none = F.lit(None).cast("string")
    d = F.struct(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id"), F.lit("d").alias("description"), none.alias("acceptable_match"), none.alias("reject_if"))
    return t("labels").select("doc_id", V.ground_truth(F.col("toxic") == 1, F.array(d), F.array(F.lit("n")), F.lit("why"), F.array().cast("array<string>")).alias("truth"))


#: Openings of briefs, and the rules that they break, by severity and name.
BRIEFS = (
    ("the bug is here", "VIOLATION", "R1 premise-without-license"), ("the bug is here, which may be wrong", None, None), ("choose one of them", "WARN", "R2 option-menu"),
    ("see src/a.rs:12 for it", "WARN", "R3 line-number-anchors"), ("independently verify: treat this as given", "VIOLATION", "R4 given-facts-no-probe"),
    ("independently verify: treat this as given, see out.log", None, None), ("an open brief: choose one", None, None),
)


@query("f28_brief_rules", f"SELECT conv_id || '-' || turn AS id, severity, rule FROM conversations JOIN {A.values(BRIEFS, 'words, severity, rule')} ON i = (conv_id + turn) % {len(BRIEFS)} WHERE rule IS NOT NULL")
def _(t):
    briefs = A.opened_with(t("conversations"), F.col("conv_id") + F.col("turn"), tuple(w for w, _, _ in BRIEFS))
    return V.brief_findings(briefs.withColumn("id", F.concat_ws("-", "conv_id", "turn")), "id", "text", role="implement")


@query("f29_verification_rules", "SELECT item_id, 'VIOLATION' AS severity, 'S1 structure' AS rule FROM benchmark WHERE item_id % 4 <> 0 UNION ALL SELECT item_id, 'WARN', 'S3 provenance' FROM benchmark WHERE item_id % 4 <> 1 UNION ALL SELECT item_id, 'VIOLATION', 'S2 linked-totals' FROM benchmark WHERE item_id % 4 = 2 UNION ALL SELECT item_id, 'WARN', 'S4 tier-marker' FROM benchmark WHERE item_id % 4 = 3")
def _(t):
    """Items with sections, with a rerun, with totals that no capture backs, and with a verdict without evidence."""
    k = F.col("item_id") % 4
    more = F.when(k == 0, "\n\n## Verified\nx\n## Not verified\ny").when(k == 1, "\n\nre-ran it").when(k == 2, "\n\n12 tests passed\n\n9 passed, see run.log").otherwise("\n\nverdict: APPROVE")
    return V.verification_findings(t("benchmark").select("item_id", F.concat("text", more).alias("text")), "item_id", "text")


@query("p12_tests_passed_guess", """WITH e AS (SELECT user_id % 97 AS task_id, bool_or(event_id % 211 = 0) AS broken, bool_or(event_id % 101 = 0) AS late, bool_and(NOT (event_id % 211 = 0) AND NOT (event_id % 101 = 0) AND event_id % 13 <> 0 AND (event_id % 2 = 0 OR value >= 1)) AS passed FROM events GROUP BY 1),
t AS (SELECT DISTINCT c_custkey AS task_id, c_custkey % 4 = 0 AS dry FROM customer)
SELECT t.task_id, CASE WHEN passed IS NULL THEN 'unknown (no evidence commands)' WHEN broken THEN 'fail (a command could not run)' WHEN late THEN 'fail (a command timed out)' WHEN dry AND passed THEN 'pass (suspicious before the work)' WHEN dry THEN 'fail (expected before the work)' WHEN passed THEN 'pass' ELSE 'fail' END AS guess FROM t LEFT JOIN e USING (task_id)""")
def _(t):
    e = F.col("event_id")
    rows = t("events").select(
        (F.col("user_id") % 97).alias("task_id"), (e % 211 == 0).alias("error"), (e % 101 == 0).alias("timed_out"), F.when(e % 13 != 0, 0).otherwise(1).alias("returncode"),
        F.when(e % 2 != 0, 1).alias("expect_min_tests"), F.floor("value").cast("long").alias("matched_tests"),
    )
    return V.tests_passed_guess(rows, t("customer").select(F.col("c_custkey").alias("task_id"), (F.col("c_custkey") % 4 == 0).alias("dry_run")).distinct())


@query("f39_blind_order")
def _(t):
    return t("labels").select("doc_id", V.blind_order(F.col("doc_id"), 7).alias("first"))

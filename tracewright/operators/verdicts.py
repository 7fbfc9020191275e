"""Verdicts: reading a reviewer's block, grading rules, and the texts that judges see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.stats import truthy


def split_block(output: Column) -> tuple[Column, Column]:
    """What stands before the last findings heading, and from it on; all and nothing without one."""
    has = F.contains(output, F.lit(P.FINDINGS_HEADING))
    tail = F.when(has, F.concat(F.lit(P.FINDINGS_HEADING), F.substring_index(output, P.FINDINGS_HEADING, -1))).otherwise(F.lit(""))
    return F.substring(output, F.lit(1), F.length(output) - F.length(tail)), tail


def directives_followed(workspace: Column) -> Column:
    """struct of flags: the directive labels in the working text, case-sensitive."""
    return F.struct(*[workspace.rlike(p).alias(n) for n, p in P.DIRECTIVES.items()])


def read_block(block: Column) -> Column:
    """struct(normalized, parse_ok, flagged, n_findings) of a findings block.

    Unusable are blocks without a verdict, a rejection without findings, and
    an approval with neither findings nor an explicit lack of them.  Findings
    are numbered anew in the canonical text.
    """
    word = F.upper(F.regexp_extract(block, P.VERDICT, 1))
    flagged = word == "REJECT"
    found = F.transform(F.regexp_extract_all(block, F.lit(P.FINDING), F.lit(1)), X.stripped)
    found = F.filter(found, lambda f: (F.length(f) > 0) & ~f.rlike(P.NO_FINDINGS))
    n = F.size(found)
    ok = (word != "") & ((n > 0) | (~flagged & block.rlike(P.NO_FINDINGS)))
    numbered = F.transform(found, lambda f, i: F.concat((i + 1).cast("string"), F.lit(". "), f))
    body = F.when(n > 0, F.array_join(numbered, "\n")).otherwise(F.lit("No findings."))
    text = F.concat(F.lit(P.FINDINGS_HEADING + "\nVERDICT: "), word, F.lit("\n"), body, F.lit("\n"))
    return F.struct(F.when(ok, text).otherwise(F.lit("")).alias("normalized"), F.coalesce(ok, F.lit(False)).alias("parse_ok"), F.coalesce(flagged, F.lit(False)).alias("flagged"), F.when(ok, n).otherwise(0).cast("long").alias("n_findings"))


def judge_answer(raw: Column) -> Column:
    """The problem of a judge's JSON answer, or null: not an object, keys missing, or a value of the wrong type.

    Types are those of the JSON itself: a quoted flag is no flag.
    """
    v = F.try_parse_json(raw)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    entries = get("$.defects", "array<variant>")
    typed = F.forall(
        entries,
        lambda d: F.coalesce((F.schema_of_variant(F.try_variant_get(d, "$.defect_id", "variant")) == "STRING") & (F.schema_of_variant(F.try_variant_get(d, "$.found", "variant")) == "BOOLEAN"), F.lit(False)),
    )
    missing = F.array_compact(F.array(*[F.when(F.try_variant_get(v, f"$.{k}", "variant").isNull(), F.lit(k)) for k in ("defects", "false_findings", "neutral_matched")]))
    whole = lambda k: F.coalesce(F.schema_of_variant(get(f"$.{k}", "variant")).isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.lit(False))
    return (
        F.when(~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "not an object")
        .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ",")))
        .when(entries.isNull(), "defects is no list").when(~typed, "bad defect entry")
        .when(~whole("neutral_matched"), "neutral_matched is no integer")
    )


def ground_truth(seeded: Column, defects: Column, neutral: Column, rationale: Column, tempting: Column) -> Column:
    """The truth as a judge reads it: an item's defects, or why a clean item is clean."""
    line = lambda label, c: F.when(F.length(c) > 0, F.concat(F.lit(label), c))
    one = lambda d: F.concat_ws("\n", F.concat(F.lit("- id: "), d["id"]), line("  description: ", d["description"]), line("  acceptable_match: ", d["acceptable_match"]), line("  reject_if: ", d["reject_if"]))
    listed = lambda title, items: F.when(F.size(items) > 0, F.concat(F.lit(title + "\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")))
    dirty = F.concat_ws("\n", F.lit("Seeded item. Its defects:"), F.array_join(F.transform(defects, one), "\n"), listed("Neither credited nor counted:", neutral))
    clean = F.concat_ws("\n", F.lit("Clean item. It has no defects."), line("Rationale: ", rationale), listed("False findings if reported:", tempting))
    return F.when(truthy(seeded) & (F.size(defects) > 0), dirty).otherwise(clean)


def blind_order(key: Column, seed: int) -> Column:
    """Which arm is shown first: fixed by the key and a seed."""
    return F.when(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(2)) == 0, "baseline").otherwise("treatment")


def evidence_passed(row: dict[str, Column]) -> Column:
    """A command counts when it ended, returned 0 and matched enough tests, where a number is asked for."""
    enough = row["expect_min_tests"].isNull() | (F.coalesce(row["matched_tests"], F.lit(0)) >= row["expect_min_tests"])
    return ~truthy(row["error"]) & ~truthy(row["timed_out"]) & F.coalesce(row["returncode"] == 0, F.lit(False)) & enough


def tests_passed_guess(results: DataFrame, tasks: DataFrame, key: str = "task_id") -> DataFrame:
    """(key, guess) of each task from its evidence commands' rows (error, timed_out, returncode, expect_min_tests, matched_tests).

    A command that could not run comes before one that ran out of time, and
    that before a failure.  In a dry run, before any work, passing is what is
    suspicious.  tasks: (key, dry_run).
    """
    row = {c: F.col(c) for c in ("error", "timed_out", "returncode", "expect_min_tests", "matched_tests")}
    folded = results.groupBy(key).agg(
        F.bool_or(truthy("error")).alias("broken"), F.bool_or(truthy("timed_out")).alias("late"), F.bool_and(evidence_passed(row)).alias("passed")
    )
    dry = truthy("dry_run")
    guess = (
        F.when(F.col("passed").isNull(), "unknown (no evidence commands)").when(F.col("broken"), "fail (a command could not run)").when(F.col("late"), "fail (a command timed out)")
        .when(dry & F.col("passed"), "pass (suspicious before the work)").when(dry, "fail (expected before the work)").when(F.col("passed"), "pass").otherwise("fail")
    )
    return tasks.join(folded, key, "left").select(key, guess.alias("guess"))


def asserted_precision(reviews: DataFrame, by: tuple[str, ...] = ("arm",)) -> DataFrame:
    """Per group: findings asserted in normalized blocks, those counted false, and their share."""
    totals = reviews.groupBy(*by).agg(F.sum("n_findings").cast("long").alias("asserted"), F.sum(F.coalesce("false_findings", F.lit(0))).cast("long").alias("false"))
    return totals.withColumn("false_share", F.try_divide(F.col("false").cast("double"), F.col("asserted")))


def cite_rates(reviews: DataFrame, by: tuple[str, ...] = ("arm",), text: str = "text") -> DataFrame:
    """Per group: reviews, those that cite a line of a file, and their share."""
    counts = reviews.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(text).rlike(P.LINE_ANCHOR)).alias("citing"))
    return counts.withColumn("rate", F.try_divide(F.col("citing").cast("double"), F.col("n")))


def brief_findings(briefs: DataFrame, key: str, text: str, role: str = "review") -> DataFrame:
    """(key, severity, rule): premises without licence, option menus, line anchors (of implementers), facts without a probe nearby."""
    t = F.col(text)
    found = lambda severity, rule: F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"))
    told = [
        F.when(t.rlike(P.PREMISE) & ~t.rlike(P.LICENSE), found("VIOLATION", "R1 premise-without-license")),
        F.when(t.rlike(P.OPTION_MENU) & ~t.rlike(P.MENU_LICENSE), found("WARN", "R2 option-menu")),
    ]
    if role == "implement":
        told.append(F.when(t.rlike(P.LINE_ANCHOR), found("WARN", "R3 line-number-anchors")))
    # around each declaration of given facts: 200 characters to either side
    parts, hits = F.split(t, P.GIVEN, -1), F.regexp_extract_all(t, F.lit(P.GIVEN), F.lit(0))
    ahead = F.transform(F.sequence(F.lit(1), F.size(hits)), lambda i: F.array_join(F.zip_with(F.slice(parts, i + 1, F.size(parts)), F.slice(hits, i + 1, F.size(parts)), lambda p, h: F.concat(p, F.coalesce(h, F.lit("")))), ""))
    behind = F.transform(F.sequence(F.lit(1), F.size(hits)), lambda i: F.concat(F.array_join(F.zip_with(F.slice(parts, 1, i - 1), F.slice(hits, 1, i - 1), lambda p, h: F.concat(p, h)), ""), F.element_at(parts, i)))
    around = F.zip_with(F.zip_with(behind, hits, lambda b, h: F.concat(F.substring(b, -200, 200), h)), ahead, lambda b, a: F.concat(b, F.substring(a, 1, 200)))
    bare = F.when(F.size(hits) > 0, F.transform(F.filter(around, lambda w: ~w.rlike(P.PROBE_REFERENCE)), lambda w: found("VIOLATION", "R4 given-facts-no-probe"))).otherwise(F.array().cast("array<struct<severity:string,rule:string>>"))
    return briefs.select(key, F.explode(F.concat(F.array_compact(F.array(*told)), bare)).alias("x")).select(key, "x.*")


def verification_findings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, severity, rule): missing sections, totals without a capture in their paragraph, no provenance, a verdict without evidence."""
    t = F.col(text)
    found = lambda severity, rule: F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"))
    sections = F.contains(t, F.lit("## Verified")) & F.contains(t, F.lit("## Not verified"))
    loose = F.filter(F.split(t, r"\n\s*\n"), lambda p: p.rlike(P.TEST_TOTAL) & ~p.rlike(P.CAPTURE))
    told = F.array(
        F.when(~sections, found("VIOLATION", "S1 structure")), F.when(~t.rlike(P.RERUN), found("WARN", "S3 provenance")),
        F.when(t.rlike(P.VERDICT_WORD) & ~t.rlike(P.TEST_EVIDENCE) & ~t.rlike(P.STATIC_ONLY), found("WARN", "S4 tier-marker")),
    )
    totals = F.transform(loose, lambda p: found("VIOLATION", "S2 linked-totals"))
    return docs.select(key, F.explode(F.concat(F.array_compact(told), totals)).alias("x")).select(key, "x.*")


def tracked_paths(status: Column) -> Column:
    """Paths of a short status listing, the last field of each line; files that are not tracked (``??``) do not count."""
    lines = F.filter(F.split(status, "\n"), lambda x: (F.length(F.trim(x)) > 0) & ~F.startswith(x, F.lit("??")))
    return F.transform(lines, lambda x: F.regexp_extract(x, r"(\S+)\s*$", 1))


def verification_problems(text: Column) -> Column:
    """array of what a verification note lacks: a total of tests or the lack of a suite, and both sections, in any case; ``missing`` alone without a text."""
    lacks = lambda pattern, name: F.when(~text.rlike(pattern), F.lit(name))
    told = F.array_compact(F.array(lacks(P.TEST_TOTAL, "test total"), lacks(P.VERIFIED_SECTION, "verified section"), lacks(P.NOT_VERIFIED_SECTION, "not verified section")))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array(F.lit("missing"))).otherwise(told)


def gate_problems(status: Column, text: Column) -> Column:
    """What keeps a session from its end: nothing where no tracked file but documents changed, else what the note lacks."""
    return F.when(needs_verification(tracked_paths(status)), verification_problems(text)).otherwise(F.array().cast("array<string>"))


def needs_verification(paths: Column) -> Column:
    """Whether any changed path is no document."""
    return F.exists(paths, lambda p: ~p.rlike(P.DOCUMENT_PATH))

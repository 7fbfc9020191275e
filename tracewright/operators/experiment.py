"""Experiment analytics: paired arms of judged items and of model calls.

Arms are never looped over: one grouped pass, or one pivot, serves all.
Records of older runs may lack columns and hold nulls; flags count as false
and counters as zero, but a cost that is not known stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import Z95, mcnemar_p, percent_change, rate, ratio_variance, truthy, wilson

#: Thresholds of the decision flags.
COST_FLAG_PERCENT, BASE_RATE_FLOOR = 20.0, 0.15
ARMS = ("baseline", "treatment")
TOKEN_COLUMNS = ("fresh_input_tokens", "cache_creation_tokens", "cache_read_tokens", "output_tokens", "input_tokens_logical")


def item_pass(seeded: Column, truth: Column, found: Column, false_findings: Column, flagged: Column) -> Column:
    """A seeded item passes with all true defects found, none invented, and a flagged verdict; a clean one unflagged."""
    none = F.coalesce(false_findings, F.lit(0)) == 0
    all_found = (F.size(truth) > 0) & (F.size(F.array_except(truth, found)) == 0)
    return F.when(truthy(seeded), all_found & none & truthy(flagged)).otherwise(none & ~truthy(flagged))


def _named(counts: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in counts.items()]


def _rate_counts() -> dict[str, Column]:
    error, passed = truthy("judge_error"), truthy("item_pass")
    return {"k": F.count_if(~error & passed), "n": F.count_if(~error), "judge_errors": F.count_if(error)}


def _rate_columns() -> dict[str, Column]:
    ci = wilson("k", "n")
    return {"rate": rate("k", "n"), "wilson_lo": ci["lo"], "wilson_hi": ci["hi"]}


def pass_rates(judge: DataFrame, by: tuple[str, ...] = ("arm",)) -> DataFrame:
    """k, n, rate, Wilson bounds and judge errors per group; errors count in no rate."""
    return judge.groupBy(*by).agg(*_named(_rate_counts())).withColumns(_rate_columns()).select(*by, *RATES)


def token_totals(calls: DataFrame, by: tuple[str, ...] = ("arm",)) -> DataFrame:
    """Sums of the token columns and of cost, nulls as zero."""
    sums = [F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in TOKEN_COLUMNS]
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), *sums, F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd"))


def _judge_token_sums() -> dict[str, Column]:
    return {"judge_tokens": F.coalesce(F.sum("judge_tokens"), F.lit(0)).cast("long"), "missing": F.count_if(F.col("judge_tokens").isNull())}


def judge_token_totals(judge: DataFrame, by: tuple[str, ...] = ("arm",)) -> DataFrame:
    """Judge tokens, how many records miss them, and cost: null unless any record is priced."""
    return judge.groupBy(*by).agg(*_named(_judge_token_sums()), F.sum("judge_cost_usd").alias("judge_cost_usd"))


def arm_deltas(totals: DataFrame, metrics: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(…, metric, baseline, treatment, abs, pct): the treatment's change of every metric."""
    stacked = totals.select(*by, "arm", F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "value"))
    wide = stacked.groupBy(*by, "metric").pivot("arm", list(ARMS)).agg(F.first("value"))
    return wide.withColumn("abs", F.col("treatment") - F.col("baseline")).withColumn("pct", percent_change("baseline", "treatment"))


def _confusion_counts() -> dict[str, Column]:
    ok = ~truthy("judge_error")
    seeded, flagged = truthy("seeded"), truthy("verdict_flagged")
    total = lambda c: F.sum(F.when(ok, c).otherwise(0)).cast("long")
    return {
        "tp": F.count_if(ok & seeded & flagged), "fp": F.count_if(ok & ~seeded & flagged),
        "tn": F.count_if(ok & ~seeded & ~flagged), "fn": F.count_if(ok & seeded & ~flagged), "n": F.count_if(ok),
        "found": total(F.when(seeded, F.size(F.array_intersect("truth_defect_ids", "found"))).otherwise(0)),
        "total": total(F.when(seeded, F.size("truth_defect_ids")).otherwise(0)), "mismatches": total(F.size(F.array_except("found", "truth_defect_ids"))),
        "false_findings": total(F.coalesce("false_findings", F.lit(0))), "neutral_matched": total(F.coalesce("neutral_matched", F.lit(0))),
    }


def _confusion_columns() -> dict[str, Column]:
    return {"base_rate": rate(F.col("tp") + F.col("fn"), "n"), "recall": rate("found", "total")}


def confusion(judge: DataFrame, by: tuple[str, ...] = ("arm",)) -> DataFrame:
    """The verdict's confusion, defect recall and findings of each group.

    ``found`` and ``truth_defect_ids`` are compared as arrays within the row;
    ids that the judge reports but the truth lacks count as mismatches.
    """
    return judge.groupBy(*by).agg(*_named(_confusion_counts())).withColumns(_confusion_columns())


def paired(judge: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per task judged without error in both arms: (…, task_id, baseline, treatment).

    A repeated record replaces the earlier one by ``seq``.  One grouped pass
    with a pivot: no self-join.
    """
    # the two flags as one number keep the aggregate's buffer of fixed width, so it hashes instead of sorting
    code = truthy("item_pass").cast("int") + 2 * truthy("judge_error").cast("int")
    wide = judge.groupBy(*by, "task_id").pivot("arm", list(ARMS)).agg(F.max_by(code, "seq"))
    # 0 or 1: judged without error; a missing arm is null and compares to nothing
    return wide.where("baseline < 2 and treatment < 2").select(*by, "task_id", *[(F.col(arm) == 1).alias(arm) for arm in ARMS])


def flips(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The paired two-by-two table and its exact test."""
    b, t = F.col("baseline"), F.col("treatment")
    table = pairs.groupBy(*by).agg(
        F.count_if(b & t).alias("both_pass"), F.count_if(~b & ~t).alias("both_fail"), F.count_if(b & ~t).alias("only_baseline"), F.count_if(~b & t).alias("only_treatment")
    )
    return table.withColumn("p_value", mcnemar_p("only_baseline", "only_treatment"))


def _adherence_counts(directives: tuple[str, ...], arm: str) -> dict[str, Column]:
    """Counts over one arm's rows that carry labels; ``followed`` names keep apart from other counts."""
    labels = F.col("adherence_labels")
    has = (F.col("arm") == arm) & labels.isNotNull()
    every, counts = has, {"adherence_n": F.count_if(has)}
    for d in directives:
        every = every & truthy(labels[d])
        counts[f"followed_{d}"] = F.count_if(has & truthy(labels[d]))
    return counts | {"followed_all": F.count_if(every)}


def _adherence_rates(directives: tuple[str, ...]) -> list[Column]:
    return [rate(f"followed_{c}", "adherence_n").alias(f"{c}_rate") for c in (*directives, "all")]


def adherence(judge: DataFrame, directives: tuple[str, ...], arm: str = "treatment") -> DataFrame:
    """Rates of one arm's followed directives and of all together; n counts rows that carry labels."""
    counts = judge.agg(*_named(_adherence_counts(directives, arm)))
    return counts.select(F.col("adherence_n").alias("n"), *_adherence_rates(directives))


def triggering(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall and base rate of a trigger: ``fired`` against ``should_fire``."""
    fired, due = truthy("fired"), truthy("should_fire")
    counts = rows.groupBy(*by).agg(F.count_if(fired & due).alias("tp"), F.count_if(fired & ~due).alias("fp"), F.count_if(~fired & due).alias("fn"), F.count_if(~fired & ~due).alias("tn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counts.withColumn("precision", rate("tp", F.col("tp") + F.col("fp"))).withColumn("recall", rate("tp", F.col("tp") + F.col("fn"))).withColumn("base_rate", rate(F.col("tp") + F.col("fn"), n))


def decision_flags(row: DataFrame) -> DataFrame:
    """(cost_pct, base_rate, rate_baseline, rate_treatment) -> the flags of a run; limits are strict."""
    return row.select(
        "*", F.coalesce(F.col("cost_pct") > COST_FLAG_PERCENT, F.lit(False)).alias("cost_flag"),
        F.coalesce(F.col("base_rate") < BASE_RATE_FLOOR, F.lit(False)).alias("base_rate_flag"), (F.col("rate_treatment") > F.col("rate_baseline")).alias("win"),
    )


def _parse_failures() -> Column:
    return F.count_if(~truthy("judge_error") & ~truthy("parse_ok"))


def parse_failures(judge: DataFrame, by: tuple[str, ...] = ("arm",)) -> DataFrame:
    return judge.groupBy(*by).agg(_parse_failures().alias("parse_failures"))


def caveats(summary: DataFrame, n_small: int = 30) -> DataFrame:
    """(recall, lo/hi of both arms, p_value, n) -> array of warnings that a reader needs."""
    overlap = (F.col("lo_baseline") <= F.col("hi_treatment")) & (F.col("lo_treatment") <= F.col("hi_baseline"))
    notes = F.array_compact(F.array(
        F.when(F.col("recall") >= 1.0, "recall at ceiling"), F.when(overlap, "intervals overlap"),
        F.when(F.col("p_value") > 0.05, "within noise"), F.when(F.col("n") < n_small, "few items"),
    ))
    return summary.withColumn("caveats", notes)


def spot_check(judge: DataFrame, seeded: int = 7, clean: int = 3, cap: int = 20) -> DataFrame:
    """A stratified sample: per arm the first seeded and clean tasks, dealt round-robin over the arms.

    A short stratum is not filled from the other.  Ungraded rows do not count.
    """
    graded = judge.where(truthy("parse_ok") & ~truthy("judge_error")).withColumn("is_seeded", truthy("seeded"))
    within = F.row_number().over(Window.partitionBy("arm").orderBy("task_id"))
    # two limits that are plain numbers, so that each task keeps no more than these before the shuffle
    first = lambda flag, n: graded.where(F.col("is_seeded") if flag else ~F.col("is_seeded")).withColumn("place", within).where(F.col("place") <= n)
    picked = first(True, seeded).unionByName(first(False, clean))
    lane = F.row_number().over(Window.partitionBy("arm").orderBy(F.col("is_seeded").desc(), "task_id"))
    # at most ``cap`` rows leave the ordered limit
    return picked.withColumn("lane", lane).orderBy("lane", "arm").limit(cap).select("arm", "task_id", "is_seeded", "lane")


def disagreement(checks: DataFrame, stop: float = 0.20) -> DataFrame:
    """How often a human disagreed, over filled rows; provisional without any."""
    counts = checks.agg(F.count("agree").alias("filled"), F.count_if(~F.col("agree")).alias("disagreed"))
    share = F.try_divide(F.col("disagreed").cast("double"), F.col("filled"))
    return counts.select("filled", "disagreed", share.alias("rate"), F.when(share.isNull(), "PROVISIONAL").when(share > stop, "STOP").otherwise("OK").alias("status"))


def projected_cost(calls: DataFrame, cap: float) -> DataFrame:
    """The baseline's cost, twice that for both arms, and whether it passes the cap."""
    spent = F.coalesce(F.sum(F.when(F.col("arm") == "baseline", F.col("cost_usd"))), F.lit(0.0))
    return calls.agg(spent.alias("spent")).select("spent", (2 * F.col("spent")).alias("projected"), (2 * F.col("spent") > cap).alias("over_cap"))


def id_mismatches(expected: DataFrame, got: DataFrame, key: str = "task_id") -> DataFrame:
    """Ids on one side only, with the side that lacks them."""
    a, b = expected.select(key).distinct().withColumn("e", F.lit(True)), got.select(key).distinct().withColumn("g", F.lit(True))
    return a.join(b, key, "full_outer").where(F.col("e").isNull() | F.col("g").isNull()).select(key, F.when(F.col("g").isNull(), "missing").otherwise("unexpected").alias("problem"))


def unblinded(verdicts: DataFrame, key: DataFrame) -> DataFrame:
    """(pair, judge, pick) with (pair, side, arm): the arm that each judge preferred."""
    named = key.select(F.col("pair").alias("_pair"), F.col("side").alias("_side"), "arm")
    return verdicts.join(named, (F.col("pair") == F.col("_pair")) & (F.col("pick") == F.col("_side")), "left").select("pair", "judge", F.coalesce("arm", F.lit("tie")).alias("arm"))


def agreement(preferred: DataFrame) -> DataFrame:
    """Over pairs seen by two or more judges: how many agree."""
    pairs = preferred.groupBy("pair").agg(F.count_distinct("judge").alias("judges"), F.count_distinct("arm").alias("arms")).where("judges >= 2")
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("arms") == 1).alias("agreed")).withColumn("rate", rate("agreed", "pairs"))


def lens_accounting(findings: DataFrame, known: DataFrame, lenses: tuple[str, str] = ARMS) -> DataFrame:
    """What two reviewers of the same items found: alone, both and neither, with an estimate of what both missed.

    findings: (item, finding, lens), repeats count once; known: (item, finding)
    of the truth.  One row for each of ``true`` and ``stray`` findings, those
    that the truth has and lacks.  ``unseen`` is Chapman's estimate of true
    findings outside both lenses, which takes no truth to compute.  One
    grouped pass over findings and truth together, keyed by item and finding.
    """
    a, b = lenses
    rows = findings.select("item", "finding", (F.col("lens") == a).alias("a"), (F.col("lens") == b).alias("b"), F.lit(False).alias("known"))
    told = known.select("item", "finding", F.lit(False).alias("a"), F.lit(False).alias("b"), F.lit(True).alias("known"))
    each = rows.unionByName(told).groupBy("item", "finding").agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("a", "b", "known")])
    by = each.groupBy(F.when(F.col("known"), "true").otherwise("stray").alias("kind")).agg(
        F.count_if(F.col("a") & ~F.col("b")).alias(f"only_{a}"), F.count_if(F.col("b") & ~F.col("a")).alias(f"only_{b}"),
        F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(~F.col("a") & ~F.col("b")).alias("neither"),
    )
    chapman = (F.col(f"only_{a}") * F.col(f"only_{b}")).cast("double") / (F.col("both") + 1)
    return by.withColumn("unseen", F.when(F.col("kind") == "true", chapman))


def clustered_ratio(rows: DataFrame, top: str, bottom: str, cluster: tuple[str, ...], by: tuple[str, ...] = ("arm",)) -> DataFrame:
    """The ratio of two sums per group with its delta-method standard error: (…, clusters, ratio, se, lo, hi).

    Rows of one cluster (a task, a session) are not independent: they are
    summed first, and the variance comes from the clusters' covariance.  Both
    passes are grouped aggregates; with fewer than two clusters there is no error.
    """
    each = rows.groupBy(*by, *cluster).agg(*[F.sum(F.coalesce(F.col(c), F.lit(0)).cast("double")).alias(n) for c, n in ((top, "y"), (bottom, "x"))])
    folded = each.groupBy(*by).agg(F.count(F.lit(1)).alias("clusters"), F.avg("y").alias("my"), F.avg("x").alias("mx"), F.var_samp("y").alias("vy"), F.var_samp("x").alias("vx"), F.covar_samp("y", "x").alias("cov"))
    told = folded.withColumn("ratio", F.try_divide("my", "mx")).withColumn("se", F.sqrt(ratio_variance("clusters", "my", "mx", "vy", "vx", "cov")))
    return told.select(*by, "clusters", "ratio", "se", (F.col("ratio") - Z95 * F.col("se")).alias("lo"), (F.col("ratio") + Z95 * F.col("se")).alias("hi"))


def run_status(row: dict[str, Column]) -> Column:
    """The first failure of a run that applies; ``ok`` without any."""
    order = ("timeout", "parse_error", "nonzero_exit", "api_error", "transcript_missing")
    out = F.when(truthy(row[order[0]]), order[0])
    for name in order[1:]:
        out = out.when(truthy(row[name]), name)
    return out.otherwise("ok")


def single_tier(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows' one tier per group; a mix raises when the result is computed."""
    tiers = rows.groupBy(*by).agg(F.count_distinct("tier").alias("n"), F.min("tier").alias("tier"))
    return tiers.select(*by, F.when(F.col("n") > 1, F.raise_error(F.lit("records of several tiers in one group"))).otherwise(F.col("tier")).alias("tier"))


def _sides(columns: tuple[str, ...]) -> list[Column]:
    return [F.max(F.when(F.col("arm") == arm, F.col(c))).alias(f"{arm}_{c}") for arm in ARMS for c in columns]


def one_row(by_arm: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows of arms as one row: baseline_… and treatment_… of each column."""
    return by_arm.agg(*_sides(columns))


RATES = ("k", "n", "rate", "wilson_lo", "wilson_hi", "judge_errors")
CELLS = ("tp", "fp", "tn", "fn", "found", "total", "recall", "base_rate", "mismatches", "false_findings", "neutral_matched")


def summary(calls: DataFrame, judge: DataFrame, directives: tuple[str, ...], negative_control: bool = False) -> DataFrame:
    """One wide row of a run: rates, confusion, tokens and judge tokens of both arms, their deltas, flips with
    McNemar's test, adherence, parse failures, flags and caveats.

    One grouped pass over the calls, one over the judged items, and one by task for the flips; each comes to one row,
    and the row that joins the three is small whatever the run holds.
    """
    whole = _adherence_counts(directives, "treatment") | {"parse_failures": _parse_failures()}
    by_arm = judge.groupBy("arm").agg(*_named(_rate_counts() | _confusion_counts() | _judge_token_sums() | whole))
    sides = _sides((*RATES, *CELLS, "judge_tokens", "missing"))
    judged = by_arm.withColumns(_rate_columns() | _confusion_columns()).agg(*sides, *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in whole])
    judged = judged.withColumns({f"{d}_rate": rate(f"followed_{d}", "adherence_n") for d in (*directives, "all")}).drop(*[c for c in whole if c.startswith("followed_")])
    tokens = one_row(token_totals(calls), (*TOKEN_COLUMNS, "cost_usd"))
    row = tokens.crossJoin(F.broadcast(judged)).crossJoin(F.broadcast(flips(paired(judge))))  # one row each
    change = lambda c: percent_change(f"baseline_{c}", f"treatment_{c}")
    row = row.withColumns({"logical_pct": change("input_tokens_logical"), "cost_pct": change("cost_usd"), "rate_delta": F.col("treatment_rate") - F.col("baseline_rate")})
    win = F.col("treatment_rate") > F.col("baseline_rate")
    row = row.withColumns({
        "cost_adjusted_verdict": win & F.coalesce(F.col("logical_pct") > COST_FLAG_PERCENT, F.lit(False)), "harness_broken": win & F.lit(negative_control),
        "composite_floored": (F.col("baseline_rate") < BASE_RATE_FLOOR) & (F.col("treatment_rate") < BASE_RATE_FLOOR),
        "judge_errors": F.col("baseline_judge_errors") + F.col("treatment_judge_errors"),
    })
    overlap = (F.col("baseline_wilson_lo") <= F.col("treatment_wilson_hi")) & (F.col("treatment_wilson_lo") <= F.col("baseline_wilson_hi"))
    ceiling = lambda arm: F.when((F.col(f"{arm}_total") > 0) & (F.col(f"{arm}_recall") >= 1.0), F.lit(f"{arm} recall at ceiling"))
    noise = F.when(overlap & (F.col("p_value") > 0.05), "overlapping intervals and McNemar within noise").when(overlap, "overlapping intervals").when(F.col("p_value") > 0.05, "McNemar within noise")
    return row.withColumn("caveats", F.array_join(F.array_compact(F.array(*[ceiling(a) for a in ARMS], noise)), "; "))


def report(row: dict) -> str:
    """A summary's row, already collected, as a report; a floored composite leads with the confusion."""
    pair = lambda title, names: [f"## {title}", "", "| metric | baseline | treatment |", "| --- | --- | --- |", *[f"| {n} | {_shown(row[f'baseline_{n}'])} | {_shown(row[f'treatment_{n}'])} |" for n in names], ""]
    rates, cells = pair("Pass rates", RATES), pair("Confusion and recall", CELLS)
    flagged = [n for n in ("harness_broken", "composite_floored", "cost_adjusted_verdict") if row[n]]
    out = ["# Experiment report (provisional: awaits a human spot-check)", ""]
    out += ["## Caveats", "", *[f"- {c}" for c in row["caveats"].split("; ")], ""] if row["caveats"] else []
    out += [f"> {n}" for n in flagged] + ([""] if flagged else [])
    out += cells + rates if row["composite_floored"] else rates + cells
    out += pair("Tokens", (*TOKEN_COLUMNS, "cost_usd", "judge_tokens", "missing"))
    alone = lambda title, names: [f"## {title}", "", *[f"- {n}: {_shown(row[n])}" for n in names], ""]
    out += alone("Deltas", ("rate_delta", "logical_pct", "cost_pct"))
    out += alone("Flips", ("both_pass", "both_fail", "only_baseline", "only_treatment", "p_value"))
    out += alone("Adherence", [n for n in row if n == "adherence_n" or (n.endswith("_rate") and not n.startswith(("baseline_", "treatment_")))])
    return "\n".join(out + alone("Flags", ("cost_adjusted_verdict", "harness_broken", "composite_floored", "judge_errors", "parse_failures")))


def _shown(v) -> str:
    return "none" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)


def spot_check_join(checks: DataFrame, judge: DataFrame, truth: DataFrame) -> DataFrame:
    """Filled spot-check rows (arm, task_id, agree) beside the judge's verdict and the truth; what a side lacks is null."""
    said = judge.select("arm", "task_id", "verdict_flagged", "item_pass", "false_findings")
    return checks.join(said, ["arm", "task_id"], "left").join(truth.select("task_id", F.col("seeded").alias("true_seeded")), "task_id", "left")


def same_family(executor: str, judge: str, families: dict[str, str]) -> bool:
    """Whether two models are known to be of one family; a judge should not grade its own."""
    a, b = (next((f for prefix, f in families.items() if m.startswith(prefix)), None) for m in (executor, judge))
    return a is not None and a == b

"""Experiment queries over labels (judged items) and line items (calls)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import experiment as E
from . import adapters as A
from .registry import query

_WILSON = """
  CASE WHEN n = 0 THEN 0.0 ELSE round(greatest(0.0, (k / n::DOUBLE + 3.841458820694124 / (2 * n) - 1.959963984540054 * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + 3.841458820694124 / (4.0 * n * n))) / (1 + 3.841458820694124 / n)), 9) END AS wilson_lo,
  CASE WHEN n = 0 THEN 0.0 ELSE round(least(1.0, (k / n::DOUBLE + 3.841458820694124 / (2 * n) + 1.959963984540054 * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + 3.841458820694124 / (4.0 * n * n))) / (1 + 3.841458820694124 / n)), 9) END AS wilson_hi"""


def rounded(df, *columns, places=9):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query("a01_pass_rate_wilson", f"WITH {A.JUDGE}, c AS (SELECT arm, count(*) FILTER (NOT judge_error AND item_pass) AS k, count(*) FILTER (NOT judge_error) AS n, count(*) FILTER (judge_error) AS judge_errors FROM judge GROUP BY arm) SELECT arm, k, n, round(k / n::DOUBLE, 9) AS rate, {_WILSON}, judge_errors FROM c")
def _(t):
    return rounded(E.pass_rates(A.judge(t("labels"))), "rate", "wilson_lo", "wilson_hi")


@query("p01_arm_pass_rates_by_run", f"WITH {A.CALLS}, c AS (SELECT run, arm, count(*) FILTER (NOT judge_error AND item_pass) AS k, count(*) FILTER (NOT judge_error) AS n, count(*) FILTER (judge_error) AS judge_errors FROM calls GROUP BY run, arm) SELECT run, arm, k, n, round(k / n::DOUBLE, 9) AS rate, {_WILSON}, judge_errors FROM c")
def _(t):
    return rounded(E.pass_rates(A.calls(t("lineitem")), ("run", "arm")).withColumn("run", F.col("run").cast("long")), "rate", "wilson_lo", "wilson_hi")


@query("a03_token_totals", f"WITH {A.CALLS} SELECT arm, count(*) AS calls, sum(fresh_input_tokens)::BIGINT AS fresh_input_tokens, sum(cache_creation_tokens)::BIGINT AS cache_creation_tokens, coalesce(sum(cache_read_tokens), 0)::BIGINT AS cache_read_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(input_tokens_logical)::BIGINT AS input_tokens_logical, round(sum(coalesce(cost_usd, 0)), 4) AS cost_usd FROM calls GROUP BY arm")
def _(t):
    return rounded(E.token_totals(A.calls(t("lineitem"))), "cost_usd", places=4)


@query("a04_judge_token_totals", f"WITH {A.JUDGE} SELECT arm, coalesce(sum(judge_tokens), 0)::BIGINT AS judge_tokens, count(*) FILTER (judge_tokens IS NULL) AS missing, sum(judge_cost_usd) AS judge_cost_usd FROM judge GROUP BY arm")
def _(t):
    return E.judge_token_totals(A.judge(t("labels")))


@query("a05_arm_deltas", f"""WITH {A.CALLS}, s AS (SELECT arm, sum(fresh_input_tokens)::DOUBLE AS fresh_input_tokens, sum(output_tokens)::DOUBLE AS output_tokens, round(sum(coalesce(cost_usd, 0)), 4) AS cost_usd FROM calls GROUP BY arm),
u AS (UNPIVOT s ON fresh_input_tokens, output_tokens, cost_usd INTO NAME metric VALUE v), w AS (SELECT metric, max(v) FILTER (arm = 'baseline') AS baseline, max(v) FILTER (arm = 'treatment') AS treatment FROM u GROUP BY metric)
SELECT metric, baseline, treatment, round(treatment - baseline, 6) AS abs, round((treatment - baseline) * 100 / nullif(baseline, 0), 6) AS pct FROM w""")
def _(t):
    totals = rounded(E.token_totals(A.calls(t("lineitem"))), "cost_usd", places=4)
    return rounded(E.arm_deltas(totals, ("fresh_input_tokens", "output_tokens", "cost_usd")), "abs", "pct", places=6)


@query("a06_confusion", f"""WITH {A.JUDGE}, j AS (SELECT *, coalesce(verdict_flagged, false) AS flagged FROM judge WHERE NOT judge_error), c AS (
SELECT arm, count(*) FILTER (seeded AND flagged) AS tp, count(*) FILTER (NOT seeded AND flagged) AS fp, count(*) FILTER (NOT seeded AND NOT flagged) AS tn, count(*) FILTER (seeded AND NOT flagged) AS fn, count(*) AS n,
sum(CASE WHEN seeded THEN f1::INT + f2::INT ELSE 0 END)::BIGINT AS found, sum(n_truth)::BIGINT AS total, sum(f9::INT + CASE WHEN seeded THEN 0 ELSE f1::INT + f2::INT END)::BIGINT AS mismatches,
sum(coalesce(false_findings, 0))::BIGINT AS false_findings, sum(neutral_matched)::BIGINT AS neutral_matched FROM j GROUP BY arm)
SELECT *, round((tp + fn) / n::DOUBLE, 9) AS base_rate, round(found / total::DOUBLE, 9) AS recall FROM c""")
def _(t):
    return rounded(E.confusion(A.judge(t("labels"))), "base_rate", "recall")


_PAIRS = """last AS (SELECT run, task_id, arm, arg_max(item_pass, seq) AS ok, arg_max(judge_error, seq) AS error FROM calls GROUP BY run, task_id, arm),
pairs AS (SELECT b.run, b.task_id, b.ok AS baseline, t.ok AS treatment FROM last b JOIN last t ON b.run = t.run AND b.task_id = t.task_id AND b.arm = 'baseline' AND t.arm = 'treatment' WHERE NOT b.error AND NOT t.error)"""


@query("j01_paired_arms", f"WITH {A.CALLS}, {_PAIRS} SELECT run, task_id, baseline, treatment FROM pairs")
def _(t):
    return E.paired(A.calls(t("lineitem")).withColumn("run", F.col("run").cast("long")), ("run",))


@query("a07_flips_mcnemar", f"""WITH {A.CALLS}, {_PAIRS}, f AS (SELECT run, count(*) FILTER (baseline AND treatment) AS both_pass, count(*) FILTER (NOT baseline AND NOT treatment) AS both_fail, count(*) FILTER (baseline AND NOT treatment) AS only_baseline, count(*) FILTER (NOT baseline AND treatment) AS only_treatment FROM pairs GROUP BY run)
SELECT *, round(1e-9 + CASE WHEN only_baseline + only_treatment = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum([exp(lgamma(only_baseline + only_treatment + 1) - lgamma(i + 1) - lgamma(only_baseline + only_treatment - i + 1) - (only_baseline + only_treatment) * 0.6931471805599453) FOR i IN range(0, least(only_baseline, only_treatment) + 1)])) END, 5) AS p_value FROM f""")
def _(t):
    pairs = E.paired(A.calls(t("lineitem")).withColumn("run", F.col("run").cast("long")), ("run",))
    return E.flips(pairs, ("run",)).withColumn("p_value", F.round(F.col("p_value") + 1e-9, 5))  # no ties of the last digit


@query("a09_adherence", f"WITH {A.JUDGE}, c AS (SELECT count(*) FILTER (labelled) AS n, count(*) FILTER (labelled AND checklist) AS a, count(*) FILTER (labelled AND disconfirm) AS b, count(*) FILTER (labelled AND verify) AS c, count(*) FILTER (labelled AND checklist AND disconfirm AND verify) AS d FROM judge WHERE arm = 'treatment') SELECT n, round(a / n::DOUBLE, 9) AS checklist_rate, round(b / n::DOUBLE, 9) AS disconfirm_rate, round(c / n::DOUBLE, 9) AS verify_rate, round(d / n::DOUBLE, 9) AS all_rate FROM c")
def _(t):
    names = ("checklist", "disconfirm", "verify")
    return rounded(E.adherence(A.judge(t("labels")), names), *[f"{x}_rate" for x in (*names, "all")])


@query("a10_triggering", "WITH c AS (SELECT toxic AS slice, count(*) FILTER (fired AND due) AS tp, count(*) FILTER (fired AND NOT due) AS fp, count(*) FILTER (NOT fired AND due) AS fn, count(*) FILTER (NOT fired AND NOT due) AS tn FROM (SELECT toxic, quality = 0 AS fired, doc_id % 3 = 0 AS due FROM labels) GROUP BY toxic) SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE round(tp / (tp + fp)::DOUBLE, 9) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE round(tp / (tp + fn)::DOUBLE, 9) END AS recall, round((tp + fn) / (tp + fp + fn + tn)::DOUBLE, 9) AS base_rate FROM c")
def _(t):
    rows = t("labels").select(F.col("toxic").alias("slice"), (F.col("quality") == 0).alias("fired"), (F.col("doc_id") % 3 == 0).alias("should_fire"))
    return rounded(E.triggering(rows, ("slice",)), "precision", "recall", "base_rate")


@query("a11_decision_flags", f"WITH {A.CALLS}, c AS (SELECT run, sum(coalesce(cost_usd, 0)) FILTER (arm = 'baseline') AS b, sum(coalesce(cost_usd, 0)) FILTER (arm = 'treatment') AS t, count(*) FILTER (NOT judge_error AND arm = 'baseline' AND item_pass) / nullif(count(*) FILTER (NOT judge_error AND arm = 'baseline'), 0)::DOUBLE AS rb, count(*) FILTER (NOT judge_error AND arm = 'treatment' AND item_pass) / nullif(count(*) FILTER (NOT judge_error AND arm = 'treatment'), 0)::DOUBLE AS rt FROM calls GROUP BY run) SELECT run, coalesce((t - b) * 100 / nullif(b, 0) > 20, false) AS cost_flag, coalesce(coalesce(rb, 0) < 0.15, false) AS base_rate_flag, coalesce(rt, 0) > coalesce(rb, 0) AS win FROM c")
def _(t):
    calls = A.calls(t("lineitem")).withColumn("run", F.col("run").cast("long"))
    ok = ~F.col("judge_error")
    part = lambda arm: (F.count_if(ok & (F.col("arm") == arm) & F.col("item_pass")), F.count_if(ok & (F.col("arm") == arm)))
    cost = lambda arm: F.sum(F.when(F.col("arm") == arm, F.coalesce("cost_usd", F.lit(0.0))))
    wide = calls.groupBy("run").agg(*[x.alias(f"{n}_{arm}") for arm in E.ARMS for n, x in zip("kn", part(arm), strict=True)], *[cost(arm).alias(f"cost_{arm}") for arm in E.ARMS])
    row = wide.select("run", S.percent_change("cost_baseline", "cost_treatment").alias("cost_pct"), *[S.rate(f"k_{arm}", f"n_{arm}").alias(f"rate_{arm}") for arm in E.ARMS])
    return E.decision_flags(row.withColumn("base_rate", F.col("rate_baseline"))).select("run", "cost_flag", "base_rate_flag", "win")


@query("a13_parse_failures", f"WITH {A.JUDGE} SELECT arm, count(*) FILTER (NOT judge_error AND NOT parse_ok) AS parse_failures FROM judge GROUP BY arm")
def _(t):
    return E.parse_failures(A.judge(t("labels")))


@query("p14_item_pass_rule", f"WITH {A.JUDGE} SELECT seq, CASE WHEN seeded THEN f1 AND f2 AND coalesce(false_findings, 0) = 0 AND coalesce(verdict_flagged, false) ELSE coalesce(false_findings, 0) = 0 AND NOT coalesce(verdict_flagged, false) END AS passed FROM judge")
def _(t):
    c = F.col
    return A.judge(t("labels")).select("seq", E.item_pass(c("seeded"), c("truth_defect_ids"), c("found"), c("false_findings"), c("verdict_flagged")).alias("passed"))


@query("w05_spot_check_sample", f"""WITH {A.JUDGE}, p AS (SELECT arm, task_id, seeded AS is_seeded, row_number() OVER (PARTITION BY arm, seeded ORDER BY task_id) AS place FROM judge WHERE parse_ok AND NOT judge_error),
l AS (SELECT arm, task_id, is_seeded, row_number() OVER (PARTITION BY arm ORDER BY is_seeded DESC, task_id) AS lane FROM p WHERE place <= CASE WHEN is_seeded THEN 7 ELSE 3 END) SELECT arm, task_id, is_seeded, lane::INTEGER AS lane FROM l ORDER BY lane, arm LIMIT 20""")
def _(t):
    return E.spot_check(A.judge(t("labels")))


@query("a33_disagreement", "WITH c AS (SELECT count(agree) AS filled, count(*) FILTER (NOT agree) AS disagreed FROM (SELECT CASE WHEN doc_id % 4 <> 0 THEN quality = 1 END AS agree FROM labels)) SELECT filled, disagreed, round(disagreed / filled::DOUBLE, 9) AS rate, CASE WHEN filled = 0 THEN 'PROVISIONAL' WHEN disagreed / filled::DOUBLE > 0.2 THEN 'STOP' ELSE 'OK' END AS status FROM c")
def _(t):
    return rounded(E.disagreement(t("labels").select(F.when(F.col("doc_id") % 4 != 0, F.col("quality") == 1).alias("agree"))), "rate")


@query("a32_projected_cost", f"WITH {A.CALLS} SELECT round(s, 4) AS spent, round(2 * s, 4) AS projected, 2 * s > 100 AS over_cap FROM (SELECT sum(cost_usd) FILTER (arm = 'baseline') AS s FROM calls)")
def _(t):
    return rounded(E.projected_cost(A.calls(t("lineitem")), 100.0), "spent", "projected", places=4)


@query("j03_expected_against_got", "SELECT coalesce(d.doc_id, l.doc_id) AS task_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'unexpected' END AS problem FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def _(t):
    return E.id_mismatches(t("documents").select(F.col("doc_id").alias("task_id")), t("labels").select(F.col("doc_id").alias("task_id")))


_VERDICTS = "v AS (SELECT doc_id // 2 AS pair, doc_id % 2 AS judge, CASE WHEN quality = 1 THEN 'A' ELSE 'B' END AS pick FROM labels), kk AS (SELECT DISTINCT pair, 'A' AS side, CASE WHEN pair % 2 = 0 THEN 'baseline' ELSE 'treatment' END AS arm FROM v UNION SELECT DISTINCT pair, 'B', CASE WHEN pair % 2 = 0 THEN 'treatment' ELSE 'baseline' END FROM v)"


def _verdicts(t):
    v = t("labels").select(F.floor(F.col("doc_id") / 2).alias("pair"), (F.col("doc_id") % 2).alias("judge"), F.when(F.col("quality") == 1, "A").otherwise("B").alias("pick"))
    even = F.col("pair") % 2 == 0
    key = v.select("pair").distinct().select("pair", F.explode(F.array(F.struct(F.lit("A").alias("side"), F.when(even, "baseline").otherwise("treatment").alias("arm")), F.struct(F.lit("B").alias("side"), F.when(even, "treatment").otherwise("baseline").alias("arm")))).alias("x")).select("pair", "x.*")
    return E.unblinded(v, key)


@query("j10_unblinded_verdicts", f"WITH {_VERDICTS} SELECT v.pair, judge, coalesce(arm, 'tie') AS arm FROM v LEFT JOIN kk ON v.pair = kk.pair AND pick = side")
def _(t):
    return _verdicts(t)


@query("j11_judge_agreement", f"WITH {_VERDICTS}, u AS (SELECT v.pair, judge, coalesce(arm, 'tie') AS arm FROM v LEFT JOIN kk ON v.pair = kk.pair AND pick = side), p AS (SELECT pair, count(DISTINCT judge) AS j, count(DISTINCT arm) AS a FROM u GROUP BY pair HAVING count(DISTINCT judge) >= 2) SELECT count(*) AS pairs, count(*) FILTER (a = 1) AS agreed, CASE WHEN count(*) = 0 THEN 0.0 ELSE round(count(*) FILTER (a = 1) / count(*)::DOUBLE, 9) END AS rate FROM p")
def _(t):
    return rounded(E.agreement(_verdicts(t)), "rate")


@query("a38_design_scores", "SELECT arm, sum(a::INT + b::INT + c::INT + d::INT)::BIGINT AS score, count(*) * 4 AS possible FROM (SELECT toxic AS arm, quality = 1 AS a, doc_id % 2 = 0 AS b, doc_id % 3 = 0 AS c, doc_id % 5 = 0 AS d FROM labels) GROUP BY arm")
def _(t):
    d = F.col("doc_id")
    rows = t("labels").select(F.col("toxic").alias("arm"), (F.col("quality") == 1).alias("a"), (d % 2 == 0).alias("b"), (d % 3 == 0).alias("c"), (d % 5 == 0).alias("d"))
    long = rows.unpivot("arm", ["a", "b", "c", "d"], "field", "yes")
    return long.groupBy("arm").agg(F.count_if("yes").alias("score"), F.count(F.lit(1)).alias("possible"))


@query("a34_taskset_base_rate", f"WITH {A.JUDGE} SELECT count(*) AS n, count(*) FILTER (seeded) AS seeded, round(count(*) FILTER (seeded) / count(*)::DOUBLE, 9) AS base_rate FROM judge")
def _(t):
    return rounded(A.judge(t("labels")).agg(F.count(F.lit(1)).alias("n"), F.count_if("seeded").alias("seeded")).withColumn("base_rate", S.rate("seeded", "n")), "base_rate")


@query("p11_run_status", "SELECT event_id, CASE WHEN value > 95 THEN 'timeout' WHEN event_id % 7 = 0 THEN 'parse_error' WHEN event_type = 'error' THEN 'nonzero_exit' WHEN user_id % 5 = 0 THEN 'api_error' WHEN event_id % 11 = 0 THEN 'transcript_missing' ELSE 'ok' END AS run_status FROM events")
def _(t):
    c = F.col
    return t("events").select("event_id", E.run_status({"timeout": c("value") > 95, "parse_error": c("event_id") % 7 == 0, "nonzero_exit": c("event_type") == "error", "api_error": c("user_id") % 5 == 0, "transcript_missing": c("event_id") % 11 == 0}).alias("run_status"))


def _cells(table: str, columns: tuple[str, ...]) -> str:
    return ", ".join(f"(SELECT {c} FROM {table} WHERE arm = '{arm}') AS {arm}_{c}" for arm in E.ARMS for c in columns)


_DIRECTIVES = ("checklist", "disconfirm", "verify")
_EXACT = "CASE WHEN b + t = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum([exp(lgamma(b + t + 1) - lgamma(i + 1) - lgamma(b + t - i + 1) - (b + t) * 0.6931471805599453) FOR i IN range(0, least(b, t) + 1)])) END"
SUMMARY_SQL = f"""WITH {A.CALLS}, {A.JUDGE},
c AS (SELECT arm, count(*) FILTER (NOT judge_error AND item_pass) AS k, count(*) FILTER (NOT judge_error) AS n, count(*) FILTER (judge_error) AS judge_errors FROM judge GROUP BY arm),
w AS (SELECT arm, k, n, round(k / n::DOUBLE, 9) AS rate, {_WILSON}, judge_errors FROM c),
f AS (SELECT arm, count(*) FILTER (seeded AND flagged) AS tp, count(*) FILTER (NOT seeded AND flagged) AS fp, count(*) FILTER (NOT seeded AND NOT flagged) AS tn, count(*) FILTER (seeded AND NOT flagged) AS fn,
  sum(CASE WHEN seeded THEN f1::INT + f2::INT ELSE 0 END)::BIGINT AS found, sum(n_truth)::BIGINT AS total, sum(f9::INT + CASE WHEN seeded THEN 0 ELSE f1::INT + f2::INT END)::BIGINT AS mismatches,
  sum(coalesce(false_findings, 0))::BIGINT AS false_findings, sum(neutral_matched)::BIGINT AS neutral_matched, count(*) AS all_n FROM (SELECT *, coalesce(verdict_flagged, false) AS flagged FROM judge WHERE NOT judge_error) GROUP BY arm),
g AS (SELECT *, round((tp + fn) / all_n::DOUBLE, 9) AS base_rate, round(found / total::DOUBLE, 9) AS recall FROM f),
j AS (SELECT arm, coalesce(sum(judge_tokens), 0)::BIGINT AS judge_tokens, count(*) FILTER (judge_tokens IS NULL) AS missing FROM judge GROUP BY arm),
s AS (SELECT arm, sum(fresh_input_tokens)::BIGINT AS fresh_input_tokens, sum(cache_creation_tokens)::BIGINT AS cache_creation_tokens, coalesce(sum(cache_read_tokens), 0)::BIGINT AS cache_read_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(input_tokens_logical)::BIGINT AS input_tokens_logical, round(sum(coalesce(cost_usd, 0)), 4) AS cost_usd FROM calls GROUP BY arm),
l AS (SELECT task_id, arm, arg_max(item_pass, seq) AS ok, arg_max(judge_error, seq) AS error FROM judge GROUP BY task_id, arm),
q AS (SELECT count(*) FILTER (b.ok AND t.ok) AS both_pass, count(*) FILTER (NOT b.ok AND NOT t.ok) AS both_fail, count(*) FILTER (b.ok AND NOT t.ok) AS b, count(*) FILTER (NOT b.ok AND t.ok) AS t FROM l b JOIN l t ON b.task_id = t.task_id AND b.arm = 'baseline' AND t.arm = 'treatment' WHERE NOT b.error AND NOT t.error),
d AS (SELECT count(*) FILTER (labelled) AS n, count(*) FILTER (labelled AND checklist) AS a, count(*) FILTER (labelled AND disconfirm) AS b, count(*) FILTER (labelled AND verify) AS c, count(*) FILTER (labelled AND checklist AND disconfirm AND verify) AS d FROM judge WHERE arm = 'treatment'),
r AS (SELECT {_cells("w", E.RATES)}, {_cells("g", E.CELLS)}, {_cells("j", ("judge_tokens", "missing"))}, {_cells("s", (*E.TOKEN_COLUMNS, "cost_usd"))},
  both_pass, both_fail, q.b AS only_baseline, q.t AS only_treatment, round(1e-9 + (SELECT {_EXACT} FROM q), 5) AS p_value,
  d.n AS adherence_n, round(d.a / d.n::DOUBLE, 9) AS checklist_rate, round(d.b / d.n::DOUBLE, 9) AS disconfirm_rate, round(d.c / d.n::DOUBLE, 9) AS verify_rate, round(d.d / d.n::DOUBLE, 9) AS all_rate,
  (SELECT count(*) FILTER (NOT judge_error AND NOT parse_ok) FROM judge) AS parse_failures FROM q, d),
z AS (SELECT *, round((treatment_input_tokens_logical - baseline_input_tokens_logical) * 100.0::DOUBLE / baseline_input_tokens_logical, 6) AS logical_pct, round((treatment_cost_usd - baseline_cost_usd) * 100 / baseline_cost_usd, 6) AS cost_pct,
  round(treatment_rate - baseline_rate, 6) AS rate_delta, treatment_rate > baseline_rate AS win, baseline_wilson_lo <= treatment_wilson_hi AND treatment_wilson_lo <= baseline_wilson_hi AS meets FROM r)
SELECT * EXCLUDE (win, meets), win AND coalesce(logical_pct > 20, false) AS cost_adjusted_verdict, false AS harness_broken, baseline_rate < 0.15 AND treatment_rate < 0.15 AS composite_floored, baseline_judge_errors + treatment_judge_errors AS judge_errors,
  concat_ws('; ', CASE WHEN baseline_recall >= 1 THEN 'baseline recall at ceiling' END, CASE WHEN treatment_recall >= 1 THEN 'treatment recall at ceiling' END,
    CASE WHEN meets AND p_value > 0.05 THEN 'overlapping intervals and McNemar within noise' WHEN meets THEN 'overlapping intervals' WHEN p_value > 0.05 THEN 'McNemar within noise' END) AS caveats FROM z"""


def run_summary(t):
    row = E.summary(A.calls(t("lineitem")), A.judge(t("labels")), _DIRECTIVES)
    row = rounded(row, *[f"{a}_{c}" for a in E.ARMS for c in ("rate", "wilson_lo", "wilson_hi", "recall", "base_rate")], *[f"{d}_rate" for d in (*_DIRECTIVES, "all")])
    row = rounded(rounded(row, "baseline_cost_usd", "treatment_cost_usd", places=4), "logical_pct", "cost_pct", "rate_delta", places=6)
    return row.withColumn("p_value", F.round(F.col("p_value") + 1e-9, 5))


query("a12_summary", SUMMARY_SQL)(run_summary)


@query("j12_spot_check_join", f"""WITH {A.JUDGE}, truth AS (SELECT doc_id // 2 AS t_task, bool_or(toxic = 1) AS true_seeded FROM labels GROUP BY 1), checks AS (SELECT doc_id // 2 AS c_task, CASE WHEN doc_id % 2 = 0 THEN 'baseline' ELSE 'treatment' END AS c_arm, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 3 <> 0 END AS agree FROM labels)
SELECT c_task AS task_id, c_arm AS arm, agree, verdict_flagged, item_pass, false_findings, true_seeded FROM checks LEFT JOIN judge ON task_id = c_task AND arm = c_arm LEFT JOIN truth ON t_task = c_task""")
def _(t):
    """Every item is on the sheet; a fourth is not filled in."""
    d = F.col("doc_id")
    task = F.floor(d / 2).cast("long").alias("task_id")
    checks = t("labels").select(task, F.when(d % 2 == 0, "baseline").otherwise("treatment").alias("arm"), F.when(d % 4 != 0, d % 3 != 0).alias("agree"))
    truth = t("labels").groupBy(task).agg(F.bool_or(F.col("toxic") == 1).alias("seeded"))
    return E.spot_check_join(checks, A.judge(t("labels")), truth)


@query("a41_two_lenses", f"""WITH {A.JUDGE}, e AS (SELECT task_id AS item, 'D1' AS finding, arm, f1 AS said, n_truth > 0 AS due FROM judge UNION ALL SELECT task_id, 'D2', arm, f2, n_truth > 0 FROM judge UNION ALL SELECT task_id, 'D9', arm, f9, false FROM judge),
p AS (SELECT item, finding, bool_or(said AND arm = 'baseline') AS a, bool_or(said AND arm = 'treatment') AS b, bool_or(due) AS due FROM e GROUP BY item, finding),
c AS (SELECT CASE WHEN due THEN 'true' ELSE 'stray' END AS kind, count(*) FILTER (a AND NOT b) AS only_baseline, count(*) FILTER (b AND NOT a) AS only_treatment, count(*) FILTER (a AND b) AS "both", count(*) FILTER (NOT a AND NOT b) AS neither FROM p WHERE a OR b OR due GROUP BY 1)
SELECT *, CASE WHEN kind = 'true' THEN round(only_baseline * only_treatment / ("both" + 1)::DOUBLE, 9) END AS unseen FROM c""")
def _(t):
    """Two arms as two lenses on one task: what each finds alone, both and neither, and how much neither may have seen."""
    j = A.judge(t("labels"))
    found = j.select(F.col("task_id").alias("item"), F.explode("found").alias("finding"), F.col("arm").alias("lens"))
    known = j.select(F.col("task_id").alias("item"), F.explode("truth_defect_ids").alias("finding"))
    return rounded(E.lens_accounting(found, known), "unseen")


@query("x34_proxy_bounds", """WITH c AS (SELECT l_linestatus, count(*) AS n, avg((l_returnflag = 'R')::INT) AS p FROM lineitem GROUP BY l_linestatus)
SELECT l_linestatus, n, round(p, 9) AS observed, round(least(1.0, greatest(0.0, (p - 0.05) / 0.85)), 9) AS at_least, round(least(1.0, greatest(0.0, (p - 0.05) / 0.85)), 9) AS estimate, round(sqrt(p * (1 - p) / n) / 0.85, 9) AS se, NULL::DOUBLE AS worse_than_chance FROM c""")
def _(t):
    """A rate read off a proxy that is right in 90 % of true and 95 % of false cases: bound, estimate and the error that the proxy inflates."""
    sure, spared = F.lit(0.9), F.lit(0.95)
    c = t("lineitem").groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("l_returnflag") == "R").cast("int")).alias("observed"))
    told = c.select("l_linestatus", "n", "observed", S.proxy_bound("observed", sure, spared).alias("at_least"), S.adjusted_prevalence("observed", sure, spared).alias("estimate"), F.sqrt(S.proxy_variance("observed", "n", sure, spared)).alias("se"), S.proxy_bound("observed", F.lit(0.3), F.lit(0.6)).alias("worse_than_chance"))
    return rounded(told, "observed", "at_least", "estimate", "se")


@query("x35_ratio_errors", f"""WITH {A.CALLS}, e AS (SELECT arm, task_id, sum(output_tokens)::DOUBLE AS y, sum(fresh_input_tokens)::DOUBLE AS x FROM calls GROUP BY arm, task_id),
f AS (SELECT arm, count(*) AS clusters, avg(y) / avg(x) AS ratio, sqrt((var_samp(y) - 2 * avg(y) / avg(x) * covar_samp(y, x) + (avg(y) / avg(x)) ^ 2 * var_samp(x)) / count(*)) / avg(x) AS se FROM e GROUP BY arm)
SELECT arm, clusters, round(ratio, 8) AS ratio, round(se, 8) AS se, round(ratio - 1.959963984540054 * se, 8) AS lo, round(ratio + 1.959963984540054 * se, 8) AS hi FROM f""")
def _(t):
    """Output tokens for each input token and arm; calls of one task vary together."""
    return rounded(E.clustered_ratio(A.calls(t("lineitem")), "output_tokens", "fresh_input_tokens", ("task_id",)), "ratio", "se", "lo", "hi", places=8)


@query("p15_priced_or_null", f"WITH {A.CALLS} SELECT run, arm, count(*) AS n, round(sum(cost), 6) AS cost, count(cost) AS priced FROM (SELECT run, arm, cache_read_tokens / 1000000.0::DOUBLE * CASE WHEN run % 2 = 0 THEN 3.0 END AS cost FROM calls) GROUP BY run, arm")
def _(t):
    rows = A.calls(t("lineitem")).withColumn("run", F.col("run").cast("long")).withColumn("cost", S.priced("cache_read_tokens", F.when(F.col("run") % 2 == 0, F.lit(3.0))))
    return rounded(rows.groupBy("run", "arm").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"), F.count("cost").alias("priced")), "cost", places=6)


@query("a37_caveats", f"WITH {A.CALLS}, c AS (SELECT arm, count(*) FILTER (NOT judge_error AND item_pass) AS k, count(*) FILTER (NOT judge_error) AS n FROM calls GROUP BY arm), w AS (SELECT arm, n, {_WILSON} FROM c), s AS (SELECT max(wilson_lo) FILTER (arm = 'baseline') AS lb, max(wilson_hi) FILTER (arm = 'baseline') AS hb, max(wilson_lo) FILTER (arm = 'treatment') AS lt, max(wilson_hi) FILTER (arm = 'treatment') AS ht, min(n) AS n FROM w) SELECT n, concat_ws('; ', 'recall at ceiling', CASE WHEN lb <= ht AND lt <= hb THEN 'intervals overlap' END, CASE WHEN n < 30 THEN 'few items' END) AS caveats FROM s")
def _(t):
    rates = E.pass_rates(A.calls(t("lineitem")))
    of = lambda c, arm: F.max(F.when(F.col("arm") == arm, F.col(c)))
    row = rates.agg(*[of(f"wilson_{side}", arm).alias(f"{side}_{arm}") for side in ("lo", "hi") for arm in E.ARMS], F.min("n").alias("n")).withColumn("recall", F.lit(1.0)).withColumn("p_value", F.lit(0.01))
    return E.caveats(row).select("n", F.array_join("caveats", "; ").alias("caveats"))


@query("p16_single_tier", f"WITH {A.JUDGE} SELECT arm, min(CASE arm WHEN 'baseline' THEN 'mid' ELSE 'high' END) AS tier FROM judge GROUP BY arm")
def _(t):
    rows = A.judge(t("labels")).withColumn("tier", F.when(F.col("arm") == "baseline", "mid").otherwise("high"))
    return E.single_tier(rows, ("arm",))

import pytest
from pyspark.sql import functions as F

from tracewright import schemas
from tracewright.operators import experiment as E


def judge(spark, rows):
    base = dict(arm="baseline", seeded=True, truth_defect_ids=["D1"], found=[], false_findings=0, neutral_matched=0, verdict_flagged=True, item_pass=True, judge_error=False, parse_ok=True, seq=0, task_id="t")
    schema = "arm string, seeded boolean, truth_defect_ids array<string>, found array<string>, false_findings long, neutral_matched long, verdict_flagged boolean, item_pass boolean, judge_error boolean, parse_ok boolean, seq long, task_id string"
    return spark.createDataFrame([{**base, **r} for r in rows], schema)


def test_rates_leave_errors_out(spark):
    got = E.pass_rates(judge(spark, [{}, {"item_pass": False}, {"judge_error": True}, {"item_pass": None}])).first()
    assert (got["k"], got["n"], got["judge_errors"], got["rate"]) == (1, 3, 1, pytest.approx(1 / 3))


def test_confusion_and_hallucinated_ids(spark):
    rows = [{"found": ["D1"]}, {"found": ["D9"], "verdict_flagged": None}, {"seeded": False, "truth_defect_ids": [], "verdict_flagged": False}, {"seeded": False, "truth_defect_ids": [], "false_findings": 2}, {"judge_error": True, "found": ["D1"]}]
    got = E.confusion(judge(spark, rows)).first()
    assert [got[c] for c in ("tp", "fp", "tn", "fn", "n", "found", "total", "mismatches", "false_findings")] == [1, 1, 1, 1, 4, 1, 2, 1, 2]


def test_pairs_take_the_last_record(spark):
    rows = [{"task_id": "a", "item_pass": True, "seq": 1}, {"task_id": "a", "item_pass": False, "seq": 2}, {"task_id": "a", "arm": "treatment"}, {"task_id": "b"}, {"task_id": "c"}, {"task_id": "c", "arm": "treatment", "judge_error": True}]
    pairs = E.paired(judge(spark, rows))
    assert [tuple(r) for r in pairs.collect()] == [("a", False, True)]
    got = E.flips(pairs).first()
    assert (got["only_treatment"], got["p_value"]) == (1, 1.0)


def test_item_pass(spark):
    rows = [(True, ["D1"], ["D1"], 0, True), (True, ["D1"], ["D1"], 0, None), (True, [], [], 0, True), (True, ["D1"], ["D1", "D2"], None, True), (False, [], [], 0, False), (False, [], [], 1, False), (False, [], [], 0, True)]
    df = spark.createDataFrame(rows, "s boolean, t array<string>, f array<string>, n long, v boolean")
    assert [r[0] for r in df.select(E.item_pass(*map(F.col, "stfnv"))).collect()] == [True, False, False, True, True, False, False]


def test_spot_check_quotas_do_not_refill(spark):
    rows = [{"arm": a, "task_id": f"s{i}"} for a in E.ARMS for i in range(9)] + [{"arm": "baseline", "task_id": f"c{i}", "seeded": False} for i in range(5)] + [{"arm": "treatment", "task_id": "c0", "seeded": False}, {"arm": "treatment", "task_id": "s9", "parse_ok": False}]
    got = [tuple(r)[:3] for r in E.spot_check(judge(spark, rows)).collect()]
    assert len(got) == 18 and sum(1 for a, t, s in got if a == "treatment") == 8 and got[0][0] == "baseline" and got[1][0] == "treatment"


def test_deltas_flags_and_costs(spark):
    calls = spark.createDataFrame([("baseline", 10, 1.0), ("treatment", 12, None), ("treatment", 12, 1.5)], "arm string, output_tokens long, cost_usd double")
    for c in E.TOKEN_COLUMNS:
        if c not in calls.columns:
            calls = calls.withColumn(c, F.lit(None).cast("long"))
    got = {r["metric"]: r for r in E.arm_deltas(E.token_totals(calls), ("output_tokens", "cost_usd", "cache_read_tokens")).collect()}
    assert (got["output_tokens"]["abs"], got["cost_usd"]["pct"], got["cache_read_tokens"]["pct"]) == (14.0, 50.0, None)
    assert tuple(E.projected_cost(calls, 1.9).first()) == (1.0, 2.0, True)
    flags = spark.createDataFrame([(20.0, 0.15, 0.5, 0.5), (20.1, 0.149, 0.5, 0.6), (None, None, 0.0, 0.0)], "cost_pct double, base_rate double, rate_baseline double, rate_treatment double")
    assert [tuple(r)[4:] for r in E.decision_flags(flags).collect()] == [(False, False, False), (True, True, True), (False, False, False)]


def test_judge_costs_stay_unknown(spark):
    rows = spark.createDataFrame([("a", None, None), ("a", 5, None), ("b", 1, 0.5), ("b", 2, None)], "arm string, judge_tokens long, judge_cost_usd double")
    assert sorted(map(tuple, E.judge_token_totals(rows).collect())) == [("a", 5, 1, None), ("b", 3, 0, 0.5)]


def test_ids_agreement_and_status(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "task_id string")
    assert sorted(map(tuple, E.id_mismatches(ids("a", "b", "b"), ids("b", "c")).collect())) == [("a", "missing"), ("c", "unexpected")]
    verdicts = spark.createDataFrame([("p", "x", "A"), ("p", "y", "A"), ("q", "x", "A"), ("q", "y", "B"), ("r", "x", "A"), ("s", "x", "tie"), ("s", "y", "tie")], "pair string, judge string, pick string")
    key = spark.createDataFrame([(p, s, a) for p in "pqrs" for s, a in (("A", "baseline"), ("B", "treatment"))], "pair string, side string, arm string")
    assert tuple(E.agreement(E.unblinded(verdicts, key)).first()) == (3, 2, pytest.approx(2 / 3))
    checks = spark.createDataFrame([(True,), (False,), (None,)], "agree boolean")
    assert tuple(E.disagreement(checks).first()) == (2, 1, 0.5, "STOP")
    assert E.disagreement(checks.where("agree is null")).first()["status"] == "PROVISIONAL"


def test_schemas_parse(spark):
    for s in (schemas.CALL, schemas.JUDGE, schemas.INCIDENT, schemas.EVIDENCE, schemas.CATALOG, schemas.MESSAGE):
        assert spark.createDataFrame([], s).count() == 0


def test_tiers_and_families(spark):
    rows = spark.createDataFrame([("a", "mid"), ("a", "mid"), ("b", "mid"), ("b", "weak")], "run string, tier string")
    assert E.single_tier(rows.where("run = 'a'"), ("run",)).first()["tier"] == "mid"
    with pytest.raises(Exception, match="several tiers"):
        E.single_tier(rows, ("run",)).collect()
    families = {"m-": "m", "g-": "g"}
    assert E.same_family("m-1", "m-2", families) and not E.same_family("m-1", "g-1", families) and not E.same_family("x", "x", families)


def test_two_lenses(spark):
    found = spark.createDataFrame([(1, "D1", "baseline"), (1, "D1", "baseline"), (1, "D2", "treatment"), (2, "D1", "baseline"), (2, "D1", "treatment"), (2, "X", "treatment"), (3, "D4", None)], "item long, finding string, lens string")
    known = spark.createDataFrame([(1, "D1"), (1, "D2"), (1, "D3"), (2, "D1"), (3, "D4")], "item long, finding string")
    got = {r["kind"]: tuple(r)[1:] for r in E.lens_accounting(found, known).collect()}
    # a finding of no lens counts as seen by neither; one true finding each alone, one by both: half a finding unseen
    assert got == {"true": (1, 1, 1, 2, 0.5), "stray": (0, 1, 0, 0, None)}
    assert E.lens_accounting(found.limit(0), known.limit(0)).count() == 0


def test_ratios_by_cluster(spark):
    import statistics as st

    rows = [("a", 1, 3, 1), ("a", 1, 1, 1), ("a", 2, 9, 4), ("a", 3, None, 2), ("b", 1, 5, 2), ("c", 1, 5, 0), ("c", 2, 1, 0)]
    got = {r["arm"]: r for r in E.clustered_ratio(spark.createDataFrame(rows, "arm string, task long, y long, x long"), "y", "x", ("task",)).collect()}
    y, x = [4, 9, 0], [2, 4, 2]
    r = sum(y) / sum(x)
    residuals = [b - r * a for a, b in zip(x, y, strict=True)]  # the delta method is the variance of these
    assert got["a"]["ratio"] == pytest.approx(r) and got["a"]["se"] == pytest.approx((st.variance(residuals) / 3) ** 0.5 / st.mean(x))
    assert (got["b"]["ratio"], got["b"]["se"]) == (2.5, None) and got["c"]["ratio"] is None

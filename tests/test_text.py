import pytest
from pyspark.sql import functions as F

from tracewright.functions import patterns as P
from tracewright.functions import text as X


def each(spark, function, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


def test_wrappers_and_truncation(spark):
    got = each(spark, X.without_wrappers, "<command-name>x\n</command-name> hi ", "<system-reminder>a</system-reminder>", None, "<other>a</other>", "<command-args>a</command-name>b</command-args>c")
    assert got == ["hi", "", "", "<other>a</other>", "c"]
    assert each(spark, lambda c: X.truncated(c, 3), "  \tabcd ", "", None, "🙂🙂🙂🙂") == ["abc", None, None, "🙂🙂🙂"]


def test_snippets_count_code_points(spark):
    text = "🙂" * 100 + "my mistake " + "z" * 100
    got = each(spark, lambda c: X.snippet(c, "(?dU)" + P.FAILURE_SIGNATURES[0][3]), text, "nothing", "see  my mistake\n\n here")
    assert got == ["🙂" * 80 + "my mistake " + "z" * 79, None, "see my mistake here"]


@pytest.mark.parametrize(
    "text,tools,orch,want",
    [
        ("please review this diff and the pull request", 0, 0, ("review", "med")), ("refactor it", 0, 0, ("refactor", "low")), ("", 0, 0, ("other", "low")), (None, 10, 3, ("orchestration", "med")),
        ("x", 20, 3, ("other", "low")), ("x", 19, 3, ("orchestration", "med")), ("Reply with exactly: OK", 0, 0, ("probe_check", "med")), ("z" * 600 + " connectivity probe", 0, 0, ("other", "low")),
        ("Issue:\nbug", 0, 0, ("eval_harness", "med")), ('{"agent_name": "a", "prompt": "write a plan for the rfc"}', 0, 0, ("plan_design", "med")), ('{"agent_name": "crash", "prompt": ""}', 0, 0, ("debug", "low")),
        ("there is a bug in it, the crash is a regression", 0, 0, ("debug", "med")), ("implement a new feature", 0, 0, ("implement", "med")),
    ],
)
def test_task_types(spark, text, tools, orch, want):
    df = spark.createDataFrame([(text, tools, orch)], "t string, n int, o int")
    assert tuple(df.select(X.task_type(F.col("t"), F.col("n"), F.col("o")).alias("x")).first()["x"]) == want


def test_small_parsers(spark):
    assert each(spark, X.tokens_used, "tokens used: 12,345\n", "Tokens used\n7", "none", None) == [12345, 7, None, None]
    assert each(spark, lambda c: X.last_section(c, "## F"), "a ## F b ## F c", "none") == [" c", None]
    assert each(spark, X.json_object, 'x {"a": {"b": 1}} y', "x {a} y", "none") == ['{"a": {"b": 1}}', None, None]
    assert each(spark, X.as_boolean, " TRUE", "1", "yes", "no", None) == [True, True, True, False, False]
    assert each(spark, X.without_comments, "---\na: 1\n---\nx<!-- y\n -->z") == ["xz"]
    assert each(spark, lambda c: X.section(c, "two"), "## one\na\n## two\nb\nc\n## three\n", "## two\nend", "none") == ["## two\nb\nc\n", "## two\nend", None]
    assert each(spark, X.passed_tests, "test result: ok. 3 passed; 0 failed\n==== 4 passed, 1 failed ====", "", None) == [7, 0, 0]
    assert each(spark, X.quote_key, "“A  ﬁne—*Quote*”", None) == ['"a fine-quote"', None]
    assert each(spark, lambda c: X.minutes_between(c, F.lit("2026-07-01T10:30:00Z")), "2026-07-01T10:00:00Z", "2026-07-01T12:00:00+02:00", "bad", None) == [30.0, 30.0, None, None]
    assert each(spark, X.project_path, "-w-a") == ["/w/a"]


def test_guarded_patterns(spark):
    refuted = next(p for d, _, _, p, _ in P.SUCCESS_SIGNATURES if d == "refutation_accepted")
    got = each(spark, lambda c: c.rlike("(?dU)" + refuted), "the claim was refuted", "not refuted", "there is no label refutation", "neither confirms nor refutes", "no way. It is long after that, and it was refuted")
    assert got == [True, False, False, False, True]
    falsify = next(p for d, _, _, p, _ in P.SUCCESS_SIGNATURES if d == "expect_falsify_probe")
    near, far = "falsified" + " x" * 100 + " hypothesis", "falsified" + " x" * 300 + " hypothesis"
    assert each(spark, lambda c: c.rlike("(?dU)" + falsify), near, far, "predict it, then falsify", "falsify") == [True, False, True, False]
    phantom = next(p for d, _, _, p, _ in P.FAILURE_SIGNATURES if d == "phantom_tool")
    assert each(spark, lambda c: c.rlike("(?dU)" + phantom), "the prism tool is not available", "prism. It is not available") == [True, False]

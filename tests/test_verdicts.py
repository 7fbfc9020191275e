import pytest
from pyspark.sql import functions as F

from tracewright.operators import verdicts as V


def read(spark, *blocks):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "i int, b string")
    return [tuple(r["x"]) for r in df.select("i", V.read_block(F.col("b")).alias("x")).orderBy("i").collect()]


def test_blocks(spark):
    got = read(
        spark, "## FINDINGS\n**VERDICT**: reject\n1) a \n- b\n", "VERDICT: APPROVE\n- No findings.\n", "VERDICT: REJECT\nNo findings", "VERDICT: APPROVE\nlooks fine", "nothing", "> VERDICT: **APPROVE**\n2.x\n**bold** text", "",
    )
    assert got == [
        ("## FINDINGS\nVERDICT: REJECT\n1. a\n2. b\n", True, True, 2), ("## FINDINGS\nVERDICT: APPROVE\nNo findings.\n", True, False, 0), ("", False, True, 0), ("", False, False, 0), ("", False, False, 0),
        ("## FINDINGS\nVERDICT: APPROVE\n1. x\n", True, False, 1), ("", False, False, 0),
    ]


def test_last_heading_splits(spark):
    df = spark.createDataFrame([("a VERIFY ## FINDINGS b ## FINDINGS c",), ("plain checklist",)], "o string")
    work, block = V.split_block(F.col("o"))
    rows = df.select(work.alias("w"), block.alias("b"), V.directives_followed(work).alias("d")).collect()
    assert [(r["w"], r["b"], tuple(r["d"])) for r in rows] == [("a VERIFY ## FINDINGS b ", "## FINDINGS c", (False, False, True)), ("plain checklist", "", (False, False, False))]


@pytest.mark.parametrize(
    "raw,want",
    [
        ('{"defects": [], "false_findings": 1, "neutral_matched": 0}', None), ("{bad", "not an object"), ('{"defects": 1, "false_findings": 1, "neutral_matched": 0}', "defects is no list"),
        ('{"defects": [{"found": true}], "false_findings": 1, "neutral_matched": 0}', "bad defect entry"), ('{"false_findings": 1}', "missing defects,neutral_matched"), ('{"defects": [], "false_findings": 1, "neutral_matched": true}', "neutral_matched is no integer"),
    ],
)
def test_answers(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "r string").select(V.judge_answer(F.col("r"))).first()[0] == want


def test_brief_and_verification_rules(spark):
    briefs = [("clean", "Look for problems."), ("r1", "The bug is in the parser."), ("ok", "The bug is here; it may be wrong."), ("r2", "Choose one of these"), ("r3", "edit a/b.py:12"), ("r4", "observed facts as given"), ("probe", "observed facts as given, see out.log"), ("far", "observed facts as given" + " x" * 150 + " out.log")]
    got = sorted((r["id"], r["rule"][:2]) for r in V.brief_findings(spark.createDataFrame(briefs, "id string, t string"), "id", "t", "implement").collect())
    assert got == [("far", "R4"), ("r1", "R1"), ("r2", "R2"), ("r3", "R3"), ("r4", "R4")]
    docs = [("good", "## Verified\n12 passed, see run.log (re-ran this turn)\n\n## Not verified\nnone"), ("bad", "12 passed"), ("static", "verdict: fine, supplied STATIC-ONLY ## Verified ## Not verified")]
    got = sorted((r["id"], r["rule"][:2]) for r in V.verification_findings(spark.createDataFrame(docs, "id string, t string"), "id", "t").collect())
    assert got == [("bad", "S1"), ("bad", "S2"), ("bad", "S3")]


def test_order_is_fixed(spark):
    df = spark.range(50)
    a = [r[0] for r in df.select(V.blind_order(F.col("id"), 1)).collect()]
    assert a == [r[0] for r in df.select(V.blind_order(F.col("id"), 1)).collect()] and set(a) == {"baseline", "treatment"}


def test_verify_gate(spark):
    from tracewright.operators import verdicts as V

    note = "## verified\n12 passed\n## Not Verified"
    rows = [("?? a.py", None, []), ("", None, []), (None, None, None), (" M docs/x.py\n?? b.py", "", []), (" M src/x.py", "", ["missing"]), (" M src/x.py", None, ["missing"]), ("R  a.md -> b.c", note, []), ("D  a b.c", "No test suite\n## not verified", ["verified section"])]
    df = spark.createDataFrame([r[:2] for r in rows], "s string, t string")
    got = [r[0] for r in df.select(V.gate_problems(df["s"], df["t"])).collect()]
    assert got[:2] + got[3:] == [r[2] for r in rows if r[2] is not None] and got[2] == []  # no listing: nothing changed

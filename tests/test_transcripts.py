import json

import pytest

from tracewright.functions import patterns as P
from tracewright.operators import sessions as S
from tracewright.operators import signatures as G
from tracewright.sources import files as R
from tracewright.sources import sinks


def line(kind, text=None, **more):
    out = {"type": kind, "timestamp": more.pop("ts", "2026-07-01T10:00:00Z")}
    message = {"role": kind, "content": text if text is not None else more.pop("content", "")}
    if "model" in more:
        message["model"] = more.pop("model")
    return json.dumps(out | {"message": message} | more)


@pytest.fixture(scope="module")
def messages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("t")
    tool = lambda name, **i: {"type": "tool_use", "name": name, "input": i}
    one = [
        "", line("user", "<command-name>x</command-name>please review this diff", uuid="u1", cwd="/w/p"), "{broken", "[1]", '{"a":1,"a":2}',
        line("user", "meta", isMeta=True), line("assistant", content=[{"type": "text", "text": "That was my mistake 🙂"}, tool("Bash", command="pytest | tail -8")], model="m-a", uuid="u2"),
        line("assistant", "oops", model="<synthetic>"), line("assistant", content=[{"type": "text", "text": "my mistake"}], isSidechain=True, model="m-b"),
        line("user", "you didn't read it; wrong, stop", ts="2026-07-01T10:30:00Z"), line("assistant", content=[{"type": "text", "text": "tests passed"}, tool("Write", file_path="/a/HANDOFF.md", content="round 3 is the cap")], model="m-a"),
    ]
    two = [line("user", "hello", uuid="u9", ts="x"), line("user", "copied", uuid="u1")]
    (root / "one.jsonl").write_text("\n".join(one))
    (root / "two.jsonl").write_text("\r\n".join(two))
    return R.transcript_messages(R.json_lines(R.text_lines(spark, str(root)))).cache()


def test_line_numbers_and_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('\n{"a": 1}\nbad\n[1]\n{"b": 2}\n')
    rows = R.json_lines(R.text_lines(spark, str(tmp_path))).orderBy("line_no").collect()
    assert [(r["line_no"], r["line_no_valid"], r["v"] is None) for r in rows] == [(2, 1, False), (3, None, True), (4, None, True), (5, 2, False)]


def test_sessions(messages):
    got = {r["path"].rsplit("/", 1)[1]: r for r in S.sessions(messages).collect()}
    a, b = got["one.jsonl"], got["two.jsonl"]
    assert (a["n_user_turns"], a["n_assistant_turns"], a["n_sidechain_lines"], a["n_lines"]) == (2, 2, 1, 7)
    assert (a["first_user_text"], a["last_assistant_text"], a["task_type"]) == ("please review this diff", "tests passed", "review")
    assert (a["duration_min"], a["mentions_tests_passed"], a["user_frustration"], a["n_tools"]) == (30.0, True, 1, 2)
    assert b["duration_min"] is None and b["n_user_turns"] == 2
    turns = sorted((r["model"], r["turns"], r["side_turns"]) for r in S.session_models(messages).collect())
    assert turns == [("m-a", 2, 0), ("m-b", 0, 1)]
    assert [(r["child"].rsplit("/", 1)[1], r["parent"].rsplit("/", 1)[1]) for r in S.fork_edges(messages).collect()] == [("one.jsonl", "two.jsonl")]


def test_signatures(messages):
    found = G.detect(G.admissible(messages), P.FAILURE_SIGNATURES + P.SUCCESS_SIGNATURES)
    got = sorted((r["detector"], r["bucket"], r["sidechain"], r["model"]) for r in found.collect())
    assert got == [("admission", "strong", False, "m-a"), ("admission", "strong", True, "m-b"), ("user_correction", "strong", False, "m-b")]
    pipes = G.truncated_pipes(messages).collect()
    assert [(r["detector"], r["snippet"]) for r in pipes] == [("pipe_truncated_test", "pytest | tail -8")]
    docs = G.authored(messages).collect()
    assert [(r["tool"], r["file_path"], r["authored"]) for r in docs] == [("Write", "/a/HANDOFF.md", "round 3 is the cap")]


def test_null_finals(spark):
    rows = [("a", 1, "other", "x", None), ("a", 2, "task_complete", None, None), ("b", 1, "output", None, 7), ("b", 2, "task_complete", None, None), ("c", 1, "task_complete", "done", None)]
    got = G.null_finals(spark.createDataFrame(rows, "path string, line_no long, kind string, last_message string, total_tokens long")).collect()
    assert sorted((r["path"], r["bucket"], r["tokens"]) for r in got) == [("a", "zero_output", None), ("b", "after_output", 7)]


def test_queues_and_known_incidents(spark):
    rows = [("d", "s1", "t2", "alpha"), ("d", "s1", "t3", "beta"), ("d", "s2", None, "gamma"), ("e", "s3", "t1", "x")]
    df = spark.createDataFrame(rows, "detector string, session string, ts string, snippet string")
    assert [(r["session"], r["snippet"], r["place"]) for r in G.queue(df, ("detector",), "ts", 5, session="session").where("detector = 'd'").orderBy("place").collect()] == [("s1", "beta", 1), ("s2", "gamma", 2)]
    known = spark.createDataFrame([("hit", "d", "s1", "be"), ("miss", "d", "s1", "zeta"), ("any", "e", "3", None), ("none", "f", "", None)], "label string, detector_prefix string, session_part string, snippet_pattern string")
    assert dict(map(tuple, G.known_found(known, df).collect())) == {"hit": True, "miss": False, "any": True, "none": False}


def test_histogram_ties_and_rollup(spark):
    rows = spark.createDataFrame([("p", i, v) for i, v in enumerate(["b", "a", "a", "b", "c"])], "path string, line_no long, tool string")
    assert [(x["value"], x["n"]) for x in S.histogram(rows, "path", "tool", top=2).first()["items"]] == [("b", 2), ("a", 2)]
    s, sub = spark.createDataFrame([("x",), ("y",)], "path string"), spark.createDataFrame([("x", 3), ("x", 4), ("z", 1)], "parent string, n_lines long")
    assert sorted((r["path"], r["sub_lines"], r["sub_files"]) for r in S.rolled_up(s, sub).collect()) == [("x", 7, 2), ("y", 0, 0)]
    assert [r["parent"] for r in S.orphans(s, sub).collect()] == ["z"]


def test_records(spark, tmp_path):
    good = tmp_path / "results" / "run" / "mid" / "calls"
    good.mkdir(parents=True)
    (good / "a.json").write_text('{"arm": "baseline",\n "cost_usd": null}')
    rows = R.load_records(spark, str(good), "arm string, cost_usd double")
    assert [(r["arm"], r["cost_usd"]) for r in rows.collect()] == [("baseline", None)]
    from pyspark.sql import functions as F

    assert rows.select(R.run_key(F.col("file_path"))).first()[0] == "run/mid"
    (good / "b.json").write_text("{bad")
    (good / "c.json").write_text("")
    (good / "d.json").write_text('[{"arm": "x"}, {"arm": "y"}]')
    with pytest.raises(R.BadRecords) as e:
        R.load_records(spark, str(good), "arm string, cost_usd double")
    assert sorted(p.rsplit("/", 1)[1] for p in e.value.paths) == ["b.json", "c.json", "d.json"]


def test_queue_markdown_listing_and_sinks(spark, tmp_path):
    (tmp_path / "q.md").write_text("# x\n## admission — 2 total\n- [ ] 2026-07-01T10:00:00Z `s-1` L12 text\n- [x] 2026-07-02 `s-2` L3\n## other — 1 rows\n- [ ] 2026 `s-3` L1\n")
    got = R.queue_rows(R.text_lines(spark, str(tmp_path), glob="*.md")).orderBy("session").collect()
    assert [(r["class"], r["session"], r["line"]) for r in got] == [("admission", "s-1", 12), ("admission", "s-2", 3), ("other", "s-3", 1)]
    files = R.listing(spark, str(tmp_path), "*.md")
    assert files.count() == 1 and len(R.digests(spark, str(tmp_path / "q.md")).first()["sha256"]) == 64
    where = str(tmp_path / "out")
    sinks.replace_json(spark.range(3), where)
    sinks.replace_json(spark.range(2), where)
    assert spark.read.json(where).count() == 2
    assert sinks.markdown_table([{"a": 1, "b": 0.5}, {"a": None, "b": 2.0}], ["a", "b"]).splitlines()[2:] == ["| 1 | 0.500 |", "|  | 2.000 |"]
    assert '"id": 0' in sinks.metrics_json(spark.range(1))


def test_paths(spark):
    df = spark.createDataFrame([("/c/2026/07/20/a.jsonl",), ("/c/2026/07/01/b.jsonl",), ("/p/u-1/subagents/x/y.jsonl",)], "path string")
    assert [r[0] for r in R.since(df, "2026-07-10").collect()] == ["/c/2026/07/20/a.jsonl"]
    assert [r[0] for r in df.select(R.parent_session(df["path"])).collect()][2] == "u-1"


def test_checkpoints_and_reruns(spark):
    tool = lambda path: [{"name": "Edit", "input": json.dumps({"file_path": path, "new_string": "x"})}]
    rows = [("s", i, f"t{i}", tool(f"/w/HANDOFF-{i % 3}.md")) for i in range(4)] + [("r", 1, "t", tool("/w/HANDOFF.md")), ("r", 2, "t", tool("/w/other.md"))]
    df = spark.createDataFrame(rows, "path string, line_no long, ts string, tools array<struct<name:string,input:string>>")
    assert [tuple(r) for r in G.checkpoint_cadence(df).collect()] == [("s", 4, 0, "t3", "/w/HANDOFF-0.md, /w/HANDOFF-1.md (+1 more)")]
    events = spark.createDataFrame([("a", 1, True, False), ("a", 2, False, True), ("a", 3, True, False), ("b", 1, True, True)], "k string, n int, f boolean, g boolean")
    from pyspark.sql import functions as F

    assert sorted(map(tuple, G.rerun_pairs(events, "k", "n", F.col("f"), F.col("g")).collect())) == [("a", 2, 1), ("b", 1, 0)]


def test_items_and_counts(spark):
    items = spark.createDataFrame([(2, "b", "c2", "d2"), (1, "a", "c1", None)], "position int, id string, context string, diff string")
    assert [(r["id"], r["text"]) for r in R.item_texts(items, 1).collect()] == [("a", "c1")]
    files = spark.createDataFrame([("/r/x/mid/calls/baseline-1.json",), ("/r/x/mid/calls/baseline-2.json",), ("/r/x/mid/judge/treatment-1.json",), ("/r/readme",)], "path string")
    assert sorted(map(tuple, R.arm_counts(files).collect())) == [("x/mid", "calls", "baseline", 2), ("x/mid", "judge", "treatment", 1)]


def test_lines_of_a_split_file_are_numbered_in_order(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"line {i}\n" for i in range(20000)))
    (tmp_path / "small.txt").write_text("x")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = R.text_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    big = sorted((r["line_no"], r["raw"]) for r in rows if r["path"].endswith("big.txt"))
    assert big == [(i + 1, f"line {i}") for i in range(20000)] and len(rows) == 20001


def test_folders_by_day_and_missing_ones(spark, tmp_path):
    for day in ("2026/07/01", "2026/07/20", "2026/08/02"):
        (tmp_path / day).mkdir(parents=True)
        (tmp_path / day / "r.jsonl").write_text(day)
    folders = R.day_folders(spark, str(tmp_path), "2026-07-20")
    assert [f[-10:] for f in folders] == ["2026/07/20", "2026/08/02"]
    assert sorted(r["raw"] for r in R.text_lines(spark, folders).collect()) == ["2026/07/20", "2026/08/02"]
    assert R.text_lines(spark, str(tmp_path / "none")).count() == 0
    assert R.load_records(spark, str(tmp_path / "none"), "a int").count() == 0
    assert R.text_lines(spark, str(tmp_path), recursive=True, modified_after="2099-01-01T00:00:00").count() == 0
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "s.jsonl").write_text("x")
    (tmp_path / "p" / "deep").mkdir()
    (tmp_path / "p" / "deep" / "t.jsonl").write_text("x")
    assert [r["path"].rsplit("/", 1)[1] for r in R.main_files(spark, str(tmp_path)).collect()] == ["s.jsonl"]


def test_content_texts(spark, tmp_path):
    text = lambda t: {"type": "text", "text": t}
    content = [
        text("<system-reminder>x</system-reminder>"), text("own words"), {"type": "thinking", "thinking": "hm"}, {"type": "tool_result", "content": "as text"},
        {"type": "tool_result", "content": [text("as block"), {"type": "image"}]}, {"type": "tool_use", "name": "Bash", "input": {"command": "ls"}}, {"type": "tool_use", "name": "Read", "input": {}},
    ]
    (tmp_path / "a.jsonl").write_text("\n".join([line("user", content), line("user", "plain"), line("user", [text("<command-name>x</command-name>")])]))
    rows = R.transcript_messages(R.json_lines(R.text_lines(spark, str(tmp_path)))).orderBy("line_no").collect()
    assert [r["user_text"] for r in rows] == ["own words", "plain", None]
    assert rows[0]["scanned"] == ["<system-reminder>x</system-reminder>", "own words", "hm", "as text", "as block", "ls"] and rows[1]["scanned"] == ["plain"]


def test_runs_of_calls_and_judge_records(spark, tmp_path):
    for kind in ("calls", "judge"):
        (tmp_path / kind).mkdir()
        (tmp_path / kind / "baseline-1.json").write_text('{"arm": "baseline", "task_id": "t1", "item_pass": true}')
    calls, judge = R.load_run(spark, str(tmp_path))
    assert (calls.first()["task_id"], judge.first()["item_pass"]) == ("t1", True)
    (tmp_path / "calls" / "x.json").write_text("{")
    (tmp_path / "judge" / "y.json").write_text("[]")
    with pytest.raises(R.BadRecords) as e:
        R.load_run(spark, str(tmp_path))
    assert sorted(p.rsplit("/", 1)[1] for p in e.value.paths) == ["x.json", "y.json"]


def test_many_transcripts_in_one_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("p/1\tone\np/2\tx\ty\np/1\ttwo\n\nplain\np/1\t\n")
    from tracewright.sources import files

    got = sorted(map(tuple, files.bundled_lines(spark, str(tmp_path / "*.txt")).collect()), key=str)
    assert got == sorted([("p/1", 1, "one"), ("p/1", 2, "two"), ("p/1", 3, ""), ("p/2", 1, "x\ty"), (None, 1, ""), (None, 2, "plain")], key=str)

import hashlib

from pyspark.sql import functions as F

from tracewright.llm import chat

ROWS = [
    (1, 0, "user", r"a < b \l \s </turn> <turn>x<text>"), (1, 1, "assistant", "\\"), (1, 2, "user", None), (1, 3, "assistant", "<|end|>\n\n<"),
    (2, 0, "assistant", "only"), (3, None, "user", "late"), (3, 5, None, "x"), (None, 0, "user", "no id"), (None, 1, "assistant", "🙂 ok"),
    (4, 0, "user", "same"), (4, 0, "user", "same"), (4, 1, "assistant", ""), (5, 0, "user", "é" * 5000),
]


def test_digests_are_read_back(spark):
    rows = [*ROWS, *((9, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(70))]
    rows += [(10, 0, "user", "long < " * 100_000), (10, 1, "assistant", "\\<" * 150_000 + "🙂")]
    more = "score string, tree string, node string, parent string, n string, formatted string, loss string, turns string"
    df = spark.createDataFrame([(*r, *"yzyzyzyz") for r in rows], "conv_id long, turn long, role string, text string, " + more)
    got = {r["conv_id"]: r for r in chat.conversation_digests(df).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns = [x[2:] for x in sorted(turns)]
        learned = "".join(t for role, t in turns if role == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), sha(learned))
        extra = lambda s: len(s) + s.count("\\") + s.count("<")
        assert r["formatted_chars"] == sum(20 + extra(a) + extra(b) for a, b in turns)


def test_branches_rank_by_mean_score(spark):
    nodes = [
        ("t", 1, None, "user", "q", 1.0), ("t", 2, 1, "assistant", "good", 5.0), ("t", 3, 1, "assistant", "bad", 0.0), ("t", 4, 2, "user", "more", 3.0),
        ("t", 5, 4, "assistant", "end", 3.0), ("t", 6, 99, "user", "orphan", 0.5), ("t", 7, 8, "user", "loop", 9.0), ("t", 8, 7, "user", "loop", 9.0), ("u", 1, None, "user", "alone", None),
    ]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    got = {(r["tree"], r["rank"]): r for r in chat.format_reply_trees(df, branches=3).select("*", F.col("formatted")).collect()}
    said = {k: [t["text"] for t in spark.createDataFrame([(r["formatted"],)], "f string").select(chat.read_back(F.col("f")).alias("x")).first()["x"]] for k, r in got.items()}
    assert said == {("kt", 1): ["q", "good", "more", "end"], ("kt", 2): ["orphan"], ("kt", 3): ["q", "bad"], ("ku", 1): ["alone"]}
    r = got["kt", 1]
    assert [r["formatted"][s["start"] : s["end"]] for s in r["loss"]] == ["good", "end"]


def test_empty_table(spark):
    assert chat.conversation_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0

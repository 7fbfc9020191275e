"""The standard tables seen as judge records, calls and messages, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judge(labels: DataFrame) -> DataFrame:
    """Labelled documents as judged items: two neighbouring ids are one task in two arms."""
    d = F.col("doc_id")
    ids = lambda *pairs: F.array_compact(F.array(*[F.when(c, F.lit(v)) for v, c in pairs]))
    seeded = (F.col("toxic") == 1) | (d % 3 == 0)
    return labels.select(
        F.floor(d / 2).cast("long").alias("task_id"), F.when(d % 2 == 0, "baseline").otherwise("treatment").alias("arm"), d.alias("seq"),
        seeded.alias("seeded"), (d % 11 == 0).alias("judge_error"), (d % 13 != 0).alias("parse_ok"),
        ((F.col("quality") == 1) & (d % 5 != 0)).alias("item_pass"),
        F.when(d % 17 != 0, (F.col("quality") == 0) | (d % 4 == 1)).alias("verdict_flagged"),
        ids(("D1", seeded), ("D2", seeded)).alias("truth_defect_ids"),
        ids(("D1", (F.col("quality") == 0) | (d % 2 == 0)), ("D2", d % 5 < 2), ("D9", d % 7 == 0)).alias("found"),
        F.when(d % 9 != 0, d % 4).alias("false_findings"), (d % 3).alias("neutral_matched"),
        F.when(d % 6 != 0, d % 1000).alias("judge_tokens"), F.when(d % 8 == 0, F.lit(0.5)).alias("judge_cost_usd"),
        F.when(d % 10 != 0, F.struct((d % 2 == 1).alias("checklist"), (d % 3 == 1).alias("disconfirm"), (d % 4 != 0).alias("verify"))).alias("adherence_labels"),
    )


JUDGE = """judge AS (
  SELECT doc_id // 2 AS task_id, CASE WHEN doc_id % 2 = 0 THEN 'baseline' ELSE 'treatment' END AS arm, doc_id AS seq,
         toxic = 1 OR doc_id % 3 = 0 AS seeded, doc_id % 11 = 0 AS judge_error, doc_id % 13 <> 0 AS parse_ok,
         quality = 1 AND doc_id % 5 <> 0 AS item_pass,
         CASE WHEN doc_id % 17 <> 0 THEN quality = 0 OR doc_id % 4 = 1 END AS verdict_flagged,
         CASE WHEN toxic = 1 OR doc_id % 3 = 0 THEN 2 ELSE 0 END AS n_truth,
         quality = 0 OR doc_id % 2 = 0 AS f1, doc_id % 5 < 2 AS f2, doc_id % 7 = 0 AS f9,
         CASE WHEN doc_id % 9 <> 0 THEN doc_id % 4 END AS false_findings, doc_id % 3 AS neutral_matched,
         CASE WHEN doc_id % 6 <> 0 THEN doc_id % 1000 END AS judge_tokens, CASE WHEN doc_id % 8 = 0 THEN 0.5::DOUBLE END AS judge_cost_usd,
         doc_id % 10 <> 0 AS labelled, doc_id % 2 = 1 AS checklist, doc_id % 3 = 1 AS disconfirm, doc_id % 4 <> 0 AS verify
  FROM labels)"""


def calls(lineitem: DataFrame) -> DataFrame:
    """Line items as model calls; the line status is the arm, an order the task."""
    return lineitem.select(
        F.col("l_orderkey").alias("task_id"), F.when(F.col("l_linestatus") == "O", "baseline").otherwise("treatment").alias("arm"),
        (F.col("l_linenumber") * F.lit(10**12) + F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("seq"), F.year("l_shipdate").alias("run"), F.col("l_quantity").cast("long").alias("fresh_input_tokens"), F.col("l_suppkey").alias("cache_creation_tokens"),
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey")).alias("cache_read_tokens"), (F.col("l_linenumber") * 100).cast("long").alias("output_tokens"),
        (F.col("l_quantity").cast("long") + F.col("l_suppkey")).alias("input_tokens_logical"), F.when(F.col("l_linenumber") != 7, F.col("l_discount")).alias("cost_usd"),
        (F.col("l_returnflag") != "R").alias("item_pass"), (F.col("l_quantity") >= 49).alias("judge_error"),
    )


CALLS = """calls AS (
  SELECT l_orderkey AS task_id, CASE WHEN l_linestatus = 'O' THEN 'baseline' ELSE 'treatment' END AS arm, l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey AS seq, year(l_shipdate) AS run,
         l_quantity::BIGINT AS fresh_input_tokens, l_suppkey AS cache_creation_tokens, CASE WHEN l_partkey % 5 <> 0 THEN l_partkey END AS cache_read_tokens,
         l_linenumber * 100 AS output_tokens, l_quantity::BIGINT + l_suppkey AS input_tokens_logical, CASE WHEN l_linenumber <> 7 THEN l_discount END AS cost_usd,
         l_returnflag <> 'R' AS item_pass, l_quantity >= 49 AS judge_error
  FROM lineitem)"""


def messages(conversations: DataFrame) -> DataFrame:
    """Conversations as transcript messages: one path each, a turn per line."""
    c, t = F.col("conv_id"), F.col("turn")
    return conversations.select(
        c.cast("string").alias("path"), t.alias("line_no"), "role",
        F.format_string("2024-01-%02dT%02d:00:00Z", c % 28 + 1, t % 24).alias("ts"),
        F.when(F.col("role") == "assistant", F.concat(F.lit("m-"), ((c + t) % 3).cast("string"))).alias("model"),
        F.when(t == 0, F.concat(F.lit("/w/p"), (c % 5).cast("string"))).alias("cwd"), F.concat_ws("-", c % 40, t).alias("uuid"),
        (t % 7 == 6).alias("sidechain"), F.lit(False).alias("meta"), "text",
        F.when(t % 3 == 1, F.array(F.struct(F.when(c % 2 == 0, "Bash").otherwise("Task").alias("name"), F.lit("{}").alias("input")))).alias("tools"),
    )


MESSAGES = """messages AS (
  SELECT conv_id::VARCHAR AS path, turn AS line_no, role, printf('2024-01-%02dT%02d:00:00Z', conv_id % 28 + 1, turn % 24) AS ts,
         CASE WHEN role = 'assistant' THEN 'm-' || ((conv_id + turn) % 3) END AS model, CASE WHEN turn = 0 THEN '/w/p' || (conv_id % 5) END AS cwd,
         (conv_id % 40) || '-' || turn AS uuid, turn % 7 = 6 AS sidechain, text,
         CASE WHEN turn % 3 = 1 THEN CASE WHEN conv_id % 2 = 0 THEN 'Bash' ELSE 'Task' END END AS tool
  FROM conversations)"""

#: What is said in invented turns, by role, and the signature that it bears.
PHRASES = (
    ("That was my mistake", "assistant", "admission", "strong"), ("You are right about it", "assistant", "admission", "weak"),
    ("you never read it", "user", "user_correction", "strong"), ("this is wrong", "user", "user_correction", "weak"),
    ("base control holds", "assistant", "attribution_control", "prose"), ("a pre-existing failure", "assistant", "attribution_control", "prose_weak"),
    ("the claim was refuted", "assistant", "refutation_accepted", "prose"), ("round 3 is the cap", "assistant", "cap_honored", "prose"),
    ("we stopped retrying", "assistant", "cap_honored", "prose_weak"), ("operator-authored text", "assistant", "provenance_disclosed", "prose"),
    ("provenance-marked text", "assistant", "provenance_disclosed", "prose_weak"), ("falsify the hypothesis", "assistant", "expect_falsify_probe", "prose"),
    ("prism not available", "assistant", "phantom_tool", "near"), ("it was not refuted", "assistant", None, None), ("nothing to see", "user", None, None),
)


def opened_with(texts: DataFrame, number, phrases: tuple[str, ...]) -> DataFrame:
    """The texts with the phrase of each row's number (modulo their count) put before them."""
    said = F.element_at(F.array(*[F.lit(p) for p in phrases]), (F.pmod(number, F.lit(len(phrases))) + 1).cast("int"))
    return texts.withColumn("text", F.concat(said, F.lit(". "), F.col("text")))


def values(rows, columns: str) -> str:
    """Rows as a SQL table, numbered from 0 as i."""
    shown = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join(f"({n}, {', '.join(map(shown, r))})" for n, r in enumerate(rows)) + f") AS said(i, {columns})"


#: Signatures that the invented prose holds; the expressions read alike in both engines.
CATALOG = (
    ("admission", "strong", 1, "thing[a-z]* of|ement[a-z]* de", "assistant"),
    ("admission", "weak", 2, "tion[a-z]*", "assistant"),
    ("user_correction", "strong", 1, "er[a-z]*ing |que[a-z]* la ", "user"),
    ("user_correction", "weak", 2, "en[a-z]*", "user"),
)

INCIDENTS = (
    MESSAGES
    + """,
incidents AS (
  SELECT *, path AS session FROM (
    SELECT path, line_no, role, ts, model, sidechain, text, 'admission' AS detector,
           CASE WHEN regexp_matches(text, 'thing[a-z]* of|ement[a-z]* de') THEN 'strong' WHEN regexp_matches(text, 'tion[a-z]*') THEN 'weak' END AS bucket
    FROM messages WHERE role = 'assistant'
    UNION ALL
    SELECT path, line_no, role, ts, model, sidechain, text, 'user_correction',
           CASE WHEN regexp_matches(text, 'er[a-z]*ing |que[a-z]* la ') THEN 'strong' WHEN regexp_matches(text, 'en[a-z]*') THEN 'weak' END
    FROM messages WHERE role = 'user') WHERE bucket IS NOT NULL)"""
)

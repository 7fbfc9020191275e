r"""Chat formatting: root-to-leaf paths of reply trees as conversations.

Trees may be of any depth.  Ancestors are found by pointer doubling: each
self-join doubles the distance that the known jumps span, so a path of n
turns takes log2(n) joins.  Branches are ranked by their mean node score, and
only chosen leaves are walked back to their root.  All of it is DataFrame
operations.

Template: ``<turn>role<text>text</turn>`` and a line break per turn.  In roles
and texts ``\`` becomes ``\s`` and ``<`` becomes ``\l``, so no control string
can occur inside them, and reading back undoes it: first ``\l``, then ``\s``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

TURN, TEXT, END = "<turn>", "<text>", "</turn>\n"
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def text_key(column: Column) -> Column:
    """A string that differs for all values, null among them, so that joins keep null keys."""
    return F.when(column.isNull(), F.lit("n")).otherwise(F.concat(F.lit("k"), column.cast("string")))


def reply_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, node, parent, score) -> (tree, leaf, rank, node, depth), the nodes of the best branches.

    tree and node are non-null strings, unique together.  A parent that is null
    or not in the tree makes a root.  Nodes on a cycle reach no root and are in
    no path.  Branches rank by mean score, then the shorter, then the leaf.
    """
    known = nodes.select(F.col("tree").alias("p_tree"), F.col("node").alias("p_node"))
    linked = nodes.join(known, (F.col("tree") == F.col("p_tree")) & (F.col("parent") == F.col("p_node")), "left")
    jump = staged(
        linked.select("tree", "node", F.col("p_node").alias("up"), F.lit(1).cast("long").alias("steps"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total"))
    )
    # rows whose jump reached the root are done and take no part in later joins but as targets
    done, jumps, limit = [jump.where(F.col("up").isNull())], [jump], max(2, jump.count())
    while (1 << (len(jumps) - 1)) < limit:
        near = jump.where(F.col("up").isNotNull())
        if not near.limit(1).count():
            break
        far = near
        for part in done:
            far = far.unionByName(part)
        near, far = near.alias("near"), far.alias("far")
        jump = staged(
            near.join(far, (F.col("near.tree") == F.col("far.tree")) & (F.col("near.up") == F.col("far.node"))).select(
                "near.tree", "near.node", F.col("far.up").alias("up"),
                (F.col("near.steps") + F.col("far.steps")).alias("steps"), (F.col("near.total") + F.col("far.total")).alias("total"),
            )
        )
        jumps.append(jump)
        done.append(jump.where(F.col("up").isNull()))
    reached = done[0]
    for part in done[1:]:
        reached = reached.unionByName(part)
    parents = jumps[0].where(F.col("up").isNotNull()).select("tree", F.col("up").alias("node")).distinct()
    leaves = reached.join(parents, ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy((F.col("total") / F.col("steps")).desc(), "steps", "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    walked = chosen.select("tree", F.col("node").alias("leaf"), "rank", "node", F.col("steps").alias("depth"))
    for k, hop in enumerate(jumps):
        up = hop.where(F.col("up").isNotNull()).select("tree", "node", "up")
        walked = staged(walked)
        farther = walked.join(up, ["tree", "node"]).select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        walked = walked.unionByName(farther)
    return walked


def format_reply_trees(nodes: DataFrame, *, branches: int = 1) -> DataFrame:
    """(tree, node, parent, role, text, score) -> one conversation per chosen path.

    Returns tree (as text_key gives it), rank, formatted, loss (spans
    ``[start, end)`` of assistant texts in ``formatted``, in code points).

    Cases: null roles and texts are empty; of rows with one (tree, node) the
    least by parent, role and text is kept; a very long text is whole in each
    chosen path that holds it, and a path is one string, made in one task; an
    empty table gives no rows; other columns are ignored.
    """
    kept = (
        nodes.select(
            text_key(F.col("tree")).alias("tree"), text_key(F.col("node")).alias("node"),
            F.when(F.col("parent").isNotNull(), text_key(F.col("parent"))).alias("parent"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("score").cast("double").alias("score"),
        )
        .groupBy("tree", "node")
        .agg(F.min(F.struct("parent", "role", "text", "score")).alias("x"))
        .select("tree", "node", "x.*")
    )
    kept = staged(kept)
    paths = reply_paths(kept.select("tree", "node", "parent", "score"), branches)
    turn = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT), escaped(F.col("text")), F.lit(END))
    told = paths.join(kept.select("tree", "node", "role", "text"), ["tree", "node"]).select(
        "tree", "leaf", "rank", "depth", "role", turn.alias("turn"), F.length(escaped(F.col("text"))).cast("long").alias("own")
    )
    until = Window.partitionBy("tree", "leaf", "rank").orderBy("depth")
    placed = told.withColumn("stop", F.sum(F.length("turn").cast("long")).over(until) - len(END))
    whole = placed.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "turn", "own", "stop"))).alias("turns"))
    said = F.filter("turns", lambda t: t["role"] == ASSISTANT)
    return whole.select(
        "tree", "rank", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.transform(said, lambda t: F.struct((t["stop"] - t["own"]).alias("start"), t["stop"].alias("end"))).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    parts = F.split(formatted, END, -1)
    return F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda p: F.struct(
            unescaped(F.substring(F.substring_index(p, TEXT, 1), len(TURN) + 1, 1 << 30)).alias("role"),
            unescaped(F.substring_index(p, TEXT, -1)).alias("text"),
        ),
    )


def turn_chain(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as trees of one branch: each row answers the one before."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    n = F.row_number().over(order).cast("long")
    return conversations.select("conv_id", "role", "text", n.alias("n")).select(
        F.col("conv_id").alias("tree"), F.col("n").alias("node"), F.when(F.col("n") > 1, F.col("n") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """Format every conversation and read the digests back from the output.

    Cases: null roles and texts are empty; a null conv_id is a conversation of
    its own; rows without a turn come last, and ties go by role, then text, so
    repeated rows are turns each; a very long conversation is one string, made
    in one task; an empty table gives no rows; other columns are ignored.
    """
    told = format_reply_trees(turn_chain(conversations)).select(
        "tree", "formatted", read_back(F.col("formatted")).alias("turns"),
        F.array_join(F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "").alias("learned"),
    )
    kind = conversations.schema["conv_id"].dataType
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        F.when(F.col("tree") != "n", F.substring("tree", 2, 1 << 30).cast(kind)).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, length(role) + length(role) - length(replace(replace(role, '\', ''), '<', ''))
             + length(text) + length(text) - length(replace(replace(text, '\', ''), '<', '')) AS inner_chars FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(inner_chars) + 20 * count(*))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

"""Coverage queries over conversations and the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import rate
from ..operators import coverage as O
from ..operators import sessions as S
from . import adapters as A
from .registry import query

_TURNS = A.MESSAGES + ", turns AS (SELECT path, model, count(*) FILTER (NOT sidechain) AS turns, count(*) FILTER (sidechain) AS side_turns FROM messages WHERE model IS NOT NULL GROUP BY path, model)"


def turns(t):
    return S.session_models(A.messages(t("conversations")))


@query("a20_primary_model", f"WITH {_TURNS} SELECT path, arg_max(model, (turns, model)) AS primary_model FROM turns GROUP BY path")
def _(t):
    return O.primary_model(turns(t))


@query("a27_turn_totals", f"WITH {_TURNS} SELECT model, sum(turns)::BIGINT AS main_turns, sum(side_turns)::BIGINT AS side_turns, sum(turns + side_turns)::BIGINT AS all_turns FROM turns GROUP BY model")
def _(t):
    return O.turn_totals(turns(t))


@query("a21_cross_tab", "WITH c AS (SELECT c_mktsegment AS segment, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P, count(*) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment UNION ALL SELECT 'NONE', 0, 0, 0, 0) SELECT * FROM c UNION ALL SELECT 'TOTAL', sum(F)::BIGINT, sum(O)::BIGINT, sum(P)::BIGINT, sum(total)::BIGINT FROM c")
def _(t):
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).withColumnRenamed("c_mktsegment", "segment")
    listed = t("customer").select(F.col("c_mktsegment").alias("segment")).union(t("region").limit(1).select(F.lit("NONE"))).distinct()
    return O.cross_tab(rows, "segment", "o_orderstatus", ["F", "O", "P"], F.count(F.lit(1)), listed)


@query("a22_top_rows_by_status", "WITH top AS (SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 30) SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders WHERE o_custkey IN (SELECT o_custkey FROM top) GROUP BY o_custkey")
def _(t):
    return O.top_rows(t("orders"), "o_custkey", 30).groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@query("a23_mean_turns", f"WITH {_TURNS}, s AS (SELECT path, arg_max(model, (turns, model)) AS model, sum(turns) AS n FROM turns GROUP BY path) SELECT model, count(*) AS sessions, round(avg(n), 6) AS mean_turns FROM s GROUP BY model")
def _(t):
    own = turns(t)
    s = own.groupBy("path").agg(F.max_by("model", F.struct("turns", "model")).alias("model"), F.sum("turns").alias("n"))
    return s.groupBy("model").agg(F.count(F.lit(1)).alias("sessions"), F.round(F.avg("n"), 6).alias("mean_turns"))


@query("a24_gap_shares", "SELECT c_mktsegment, count(*) FILTER (n_name = (SELECT min(n_name) FROM nation)) AS k, count(*) AS n, round(count(*) FILTER (n_name = (SELECT min(n_name) FROM nation)) / count(*)::DOUBLE, 9) AS share FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment")
def _(t):
    first = t("nation").agg(F.min("n_name").alias("of"))
    rows = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(first), F.col("n_name") == F.col("of"), "left")
    counts = rows.groupBy("c_mktsegment").agg(F.count("of").alias("k"), F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(rate("k", "n"), 9))


@query("a25_date_ranges", f"WITH {A.MESSAGES}, s AS (SELECT path, min(ts) AS a, max(ts) AS b, arg_min(model, line_no) FILTER (model IS NOT NULL) AS model FROM messages GROUP BY path) SELECT model, min(a) AS first, max(b) AS last, count(*) AS sessions FROM s GROUP BY model")
def _(t):
    s = A.messages(t("conversations")).groupBy("path").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.min_by("model", F.when(F.col("model").isNotNull(), F.col("line_no"))).alias("model"))
    return O.date_ranges(s, "model", "a", "b")


@query("a26_strong_outcomes", f"WITH {A.MESSAGES}, s AS (SELECT path, bool_or(regexp_matches(text, '(?i)test') AND regexp_matches(text, 'passed|PASS|✓')) AS ok, sum(len(regexp_extract_all(text, '(?i)git commit'))) AS c FROM messages GROUP BY path) SELECT count(*) AS sessions, count(*) FILTER (ok OR c > 0) AS strong FROM s")
def _(t):
    return S.sessions(A.messages(t("conversations"))).agg(F.count(F.lit(1)).alias("sessions"), F.count_if(O.strong_outcome()).alias("strong"))


@query("a28_no_model_sessions", f"WITH {A.MESSAGES} SELECT count(*) FILTER (m = 0) AS without_model, count(*) AS sessions FROM (SELECT path, count(model) AS m FROM messages GROUP BY path)")
def _(t):
    s = A.messages(t("conversations")).groupBy("path").agg(F.count("model").alias("m"))
    return s.agg(F.count_if(F.col("m") == 0).alias("without_model"), F.count(F.lit(1)).alias("sessions"))


@query("u01_union_of_corpora", "SELECT 'a' AS corpus, conv_id AS id FROM conversations WHERE turn = 0 UNION ALL SELECT 'b', doc_id FROM documents")
def _(t):
    a = t("conversations").where("turn = 0").select(F.lit("a").alias("corpus"), F.col("conv_id").alias("id"))
    return a.unionByName(t("documents").select(F.lit("b").alias("corpus"), F.col("doc_id").alias("id")))


@query("t04_gap_order", "WITH c AS (SELECT c_mktsegment, count(*) FILTER (c_nationkey = 3) AS k, count(*) AS n FROM customer GROUP BY c_mktsegment) SELECT c_mktsegment, k, n, round(k / n::DOUBLE, 9) AS share, row_number() OVER (ORDER BY k / n::DOUBLE, c_mktsegment) AS place FROM c")
def _(t):
    told = O.shares(t("customer").withColumn("nation", F.col("c_nationkey").cast("string")), "c_mktsegment", "nation", "3")
    return O.placed(told, F.col("share").asc(), F.col("c_mktsegment").asc()).withColumn("share", F.round("share", 9))


@query("t05_latest_first", f"WITH {A.MESSAGES}, s AS (SELECT path, min(ts) AS a, max(ts) AS b, arg_min(model, line_no) FILTER (model IS NOT NULL) AS model FROM messages GROUP BY path), r AS (SELECT model, min(a) AS first, max(b) AS last FROM s WHERE model IS NOT NULL GROUP BY model) SELECT model, first, last, row_number() OVER (ORDER BY last DESC, model) AS place FROM r")
def _(t):
    s = A.messages(t("conversations")).groupBy("path").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.min_by("model", F.when(F.col("model").isNotNull(), F.col("line_no"))).alias("model"))
    return O.placed(O.date_ranges(s.where("model is not null"), "model", "a", "b").drop("sessions"), F.col("last").desc(), F.col("model").asc())


@query("t06_most_turns_first", f"WITH {_TURNS}, r AS (SELECT model, sum(turns + side_turns)::BIGINT AS all_turns FROM turns GROUP BY model) SELECT model, all_turns, row_number() OVER (ORDER BY all_turns DESC, model) AS place FROM r")
def _(t):
    return O.placed(O.turn_totals(turns(t)).select("model", "all_turns"), F.col("all_turns").desc(), F.col("model").asc())

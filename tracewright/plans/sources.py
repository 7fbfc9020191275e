"""Source and sink queries: the standard tables written as files into the shared folder and read back by the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import experiment as E
from ..operators import sessions as S
from ..operators import signatures as G
from ..sources import file_index as I
from ..sources import files as R
from ..sources import sinks
from ..sources.shared import new_folder
from ..streaming import evidence
from . import adapters as A
from .experiment import SUMMARY_SQL, run_summary
from .registry import query
from .triage import nominations

_NATION = "n_nationkey bigint, n_name string, n_regionkey bigint"


def _record_files(t, broken: bool) -> str:
    """Nations as one JSON file each; with ``broken`` some are no object."""
    n = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    where = new_folder(n.sparkSession, "records")
    good = F.to_json(F.struct("*"))
    k = F.col("n_nationkey") % 5
    raw = F.when(k == 0, "{broken").when(k == 1, F.concat(F.lit("["), good, F.lit(","), good, F.lit("]"))).otherwise(good) if broken else good
    n.select(raw.alias("raw"), F.col("n_nationkey").alias("k")).write.partitionBy("k").text(where)
    return f"{where}/*"


@query("s01_record_files", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t):
    return R.load_records(t("nation").sparkSession, _record_files(t, False), _NATION, glob="*.txt").drop("file_path")


@query("s02_bad_record_files", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 5 < 2")
def _(t):
    bad = R.bad_record_files(t("nation").sparkSession, _record_files(t, True), _NATION, glob="*.txt")
    return bad.select(F.regexp_extract("path", "/k=([0-9]+)/", 1).cast("long").alias("k"))


@query("s04_json_lines", "SELECT sum((event_id % 10 NOT IN (3, 7))::INT)::BIGINT AS readable, sum((event_id % 10 = 3)::INT)::BIGINT AS bad, sum(CASE WHEN event_id % 10 NOT IN (3, 7) THEN event_id END)::BIGINT AS ids FROM events")
def _(t):
    e = t("events").select("event_id", "event_type")
    where = new_folder(e.sparkSession, "lines")
    kind = F.col("event_id") % 10
    e.select(F.when(kind == 3, "{bad").when(kind == 7, "  ").otherwise(F.to_json(F.struct("*"))).alias("raw")).repartition(4).write.text(where)
    lines = R.json_lines(R.text_lines(e.sparkSession, where))
    return lines.agg(F.count("v").alias("readable"), F.count_if(F.col("v").isNull()).alias("bad"), F.sum(F.try_variant_get("v", "$.event_id", "bigint")).alias("ids"))


def _transcripts(t):
    """Conversations as lines of few files, each with its transcript's path before it, a turn a line in order, read back as messages."""
    c = t("conversations")
    where = new_folder(c.sparkSession, "transcripts")
    turn = F.col("turn")
    block = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    line = F.to_json(F.struct(
        F.col("role").alias("type"), F.format_string("2024-01-01T%02d:00:00Z", turn % 24).alias("timestamp"), (turn % 7 == 6).alias("isSidechain"),
        F.struct("role", F.array(block).alias("content"), F.when(F.col("role") == "assistant", "m-1").alias("model")).alias("message"),
    ))
    rows = c.select("conv_id", "turn", line.alias("raw")).repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    rows.select(F.concat(F.col("conv_id").cast("string"), F.lit("\t"), "raw").alias("raw")).write.text(where)
    return R.transcript_messages(R.json_lines(R.bundled_lines(c.sparkSession, where)))


@query("s05_transcripts", f"WITH {A.MESSAGES} SELECT path, count(*) AS n_lines, count(*) FILTER (role = 'user' AND NOT sidechain AND length(trim(text, ' ' || chr(10))) > 0) AS n_user_turns, arg_min(text, line_no) AS first, arg_max(text, line_no) AS last, max(line_no) + 1 AS lines FROM messages GROUP BY path")
def _(t):
    m = _transcripts(t)
    folded = m.groupBy("path").agg(F.min_by("text", "line_no").alias("first"), F.max_by("text", "line_no").alias("last"), F.max("line_no").alias("lines"))
    return S.sessions(m).select("path", "n_lines", "n_user_turns").join(folded, "path")


@query("f06_user_texts", "SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS user_text, text AS scanned FROM conversations")
def _(t):
    m = _transcripts(t)
    return m.select(F.col("path").cast("long").alias("conv_id"), (F.col("line_no") - 1).alias("turn"), "user_text", F.array_join("scanned", "|").alias("scanned"))


@query("s08_since", "SELECT event_id FROM events WHERE strftime(ts, '%Y-%m-%d') >= '2024-01-20'")
def _(t):
    rows = t("events").select("event_id", F.concat(F.lit("/r/sessions/"), F.date_format("ts", "yyyy/MM/dd"), F.lit("/x.jsonl")).alias("path"))
    return R.since(rows, "2024-01-20").select("event_id")


@query("s09_first_files", "SELECT n_nationkey AS k FROM nation ORDER BY n_nationkey::VARCHAR LIMIT 7")
def _(t):
    spark = t("nation").sparkSession
    paths = R.first_files(R.listing(spark, _record_files(t, False), "*.txt"), 7)
    return R.text_lines(spark, paths).select(F.regexp_extract("path", "/k=([0-9]+)/", 1).cast("long").alias("k"))


@query("s10_missing_folder", "SELECT 'there' AS asked, count(*) AS n, count(DISTINCT event_id) AS ids FROM events UNION ALL SELECT 'missing', 0, 0")
def _(t):
    """Two folders of which one is not there: its lines are none, the other's all."""
    e = t("events").select(F.col("event_id").cast("string").alias("raw"))
    spark = e.sparkSession
    there, missing = new_folder(spark, "lines"), new_folder(spark, "nothing")
    e.write.text(there)
    tally = lambda where, name: R.text_lines(spark, where).agg(F.lit(name).alias("asked"), F.count(F.lit(1)).alias("n"), F.count_distinct("raw").alias("ids"))
    return tally([missing, there], "there").unionByName(tally(missing, "missing"))


@query("s13_replaced_table", "SELECT r_regionkey, r_name FROM region")
def _(t):
    spark = t("region").sparkSession
    where = new_folder(spark, "replaced")
    sinks.replace_json(t("nation"), where)
    sinks.replace_json(t("region").select("r_regionkey", "r_name"), where)
    return spark.read.schema("r_regionkey bigint, r_name string").json(where)


@query("s14_incident_store", f"WITH {A.INCIDENTS} SELECT detector, count(*) AS n FROM incidents GROUP BY detector")
def _(t):
    found = G.detect(A.messages(t("conversations")), A.CATALOG).withColumn("corpus", F.lit("c")).drop("tools")
    where = new_folder(found.sparkSession, "incidents")
    sinks.append_incidents(found, where)
    return found.sparkSession.read.parquet(where).where("corpus = 'c'").groupBy("detector").agg(F.count(F.lit(1)).alias("n"))


@query("s15_evidence_stream", "SELECT count(*) AS n, count(DISTINCT key) AS keys, min(key) AS first FROM (SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN 'failure' ELSE 'success' END || '|' || event_type || '|' || user_id || '|L' || (event_id % 50) AS key FROM events)")
def _(t):
    """Two passes over what has arrived, each with its own part of the rows: keys met twice are stored once."""
    rows = nominations(t)
    spark = rows.sparkSession
    where, store, checkpoint = (new_folder(spark, n) for n in ("nominations", "store", "progress"))
    early = F.col("ts") < "2024-01-16"
    for part in (early, ~early | F.col("session").endswith("7")):
        rows.where(part).write.mode("append").json(where)
        evidence.collect_against_store(evidence.nominations(spark, where), store, checkpoint, "2024-01-31").awaitTermination()
    return spark.read.parquet(store).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys"), F.min("key").alias("first"))


@query("s17_traces", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def _(t):
    spark = t("events").sparkSession
    where = new_folder(spark, "trace")
    for part in (0, 1):
        sinks.append_trace(t("events").where(F.col("event_id") % 2 == part).select(F.col("event_type").alias("kind"), F.col("props").alias("payload")), where)
    return spark.read.schema("ts timestamp, kind string, payload string").json(where).where("ts is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("s18_metrics_report", f"SELECT *, true AS provisional FROM ({SUMMARY_SQL})")
def _(t):
    """The summary rendered as JSON and as a report, both written, and all that the JSON says."""
    row = run_summary(t)
    spark = row.sparkSession
    where = new_folder(spark, "report")
    text = sinks.metrics_json(row)  # one row
    spark.createDataFrame([(text, E.report(row.first().asDict()))], "metrics string, report string").write.parquet(where)
    read = spark.read.parquet(where).select(F.from_json("metrics", row.schema).alias("m"), F.contains("report", F.lit("provisional")).alias("provisional"))
    return read.select("m.*", "provisional")


def _nation_files(t):
    """(name, nth, raw, k): each nation's customers as a transcript in its region's folder, headed by a line that names the region."""
    n = t("nation").select("n_nationkey", "n_regionkey")
    k, r = F.col("n_nationkey"), F.col("n_regionkey").cast("string")
    name = F.format_string("proj-%s/s%02d.jsonl", r, k)
    head = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("/w/"), r).alias("cwd")).alias("payload")))
    heads = n.select(name.alias("name"), F.lit(-1).cast("long").alias("nth"), head.alias("raw"), k.alias("k"))
    own = t("customer").join(n, F.col("c_nationkey") == k)
    rows = own.select(name.alias("name"), F.col("c_custkey").alias("nth"), F.to_json(F.struct("c_custkey", "c_mktsegment")).alias("raw"), k.alias("k"))
    return heads.unionByName(rows)


@query("s23_locators", "SELECT '/w/' || r AS cwd, k, CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS seen, (SELECT count(*) FROM customer WHERE c_nationkey = k) AS n FROM (SELECT n_regionkey AS r, arg_max(n_nationkey, (n_nationkey * 7) % 25) AS k FROM nation GROUP BY 1)")
def _(t):
    """The newest transcript of each working folder, from an index that was refreshed twice: the second reads what came since."""
    rows = _nation_files(t)
    spark = rows.sparkSession
    root, where = new_folder(spark, "tree"), new_folder(spark, "index")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for part in (0, 1):
        for file in sinks.write_named(rows.where(F.col("k") % 2 == part).drop("k"), root):  # one file a nation
            k = int(file.rsplit("/s", 1)[1].removesuffix(".jsonl"))
            fs.setTimes(path(file), 1_700_000_000_000 + k * 7 % 25 * 86_400_000, -1)
        index = I.refresh_index(spark, root, where, "*.jsonl")
    newest = I.newest_of(index, "$.payload.cwd")
    lines = R.text_lines(spark, root, recursive=True).where("line_no > 1").select(R.plain_path(F.col("path")).alias("path"))
    sizes = lines.join(newest, "path", "left_semi").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return newest.join(sizes, "path", "left").select(F.col("value").alias("cwd"), F.regexp_extract("path", r"/s([0-9]+)[.]jsonl$", 1).cast("long").alias("k"), "seen", F.coalesce("n", F.lit(0)).alias("n"))


@query("s07_nested_files", "WITH c AS (SELECT n_nationkey AS k, n_regionkey AS r, c_mktsegment AS m, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL) SELECT 'proj-' || r AS project, printf('s%02d', k) AS path, 1 + sum(n)::BIGINT AS n_lines, sum(n)::BIGINT AS sub_lines, count(m) AS sub_files FROM c GROUP BY r, k")
def _(t):
    """Main transcripts with what their sub-agents' files, a folder or two below them, add."""
    main = _nation_files(t).drop("k")
    spark = main.sparkSession
    segment = F.get_json_object("raw", "$.c_mktsegment")
    below = F.when(F.length(segment) % 2 == 0, "/subagents/").otherwise("/subagents/deeper/")
    sub = main.where("nth >= 0").withColumn("name", F.concat(F.substring_index("name", ".", 1), below, F.lower(segment), F.lit(".jsonl")))
    root = new_folder(spark, "tree")
    sinks.write_named(main.unionByName(sub), root)
    files = I.session_files(I.refresh_index(spark, root, new_folder(spark, "index"), "*.jsonl"), root)
    lines = R.text_lines(spark, root, recursive=True).groupBy(R.plain_path(F.col("path")).alias("path")).agg(F.count(F.lit(1)).alias("n_lines"))
    sized = files.join(lines, "path").select("project", "session", "kind", "n_lines")
    mains = sized.where("kind = 'main'").select(F.col("session").alias("path"), "project", "n_lines")
    return S.rolled_up(mains, sized.where("kind = 'sub'").select(F.col("session").alias("parent"), "n_lines"))


@query("s08_day_tree", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE strftime(ts, '%Y-%m-%d') >= '2024-01-20' GROUP BY 1")
def _(t):
    """Events as a tree of days, four files each: folders before the asked day are neither listed nor read."""
    e = t("events").select("event_id", "ts")
    spark = e.sparkSession
    name = F.concat(F.date_format("ts", "yyyy/MM/dd"), F.lit("/p"), F.pmod("event_id", F.lit(4)).cast("string"), F.lit(".jsonl"))
    root = new_folder(spark, "days")
    sinks.write_named(e.select(name.alias("name"), F.col("event_id").alias("nth"), F.to_json(F.struct("event_id")).alias("raw")), root)
    lines = R.json_lines(R.text_lines(spark, [f"{d}/*" for d in R.day_folders(spark, root, "2024-01-20")]))
    day = F.replace(F.regexp_extract("path", "/([0-9]{4}/[0-9]{2}/[0-9]{2})/[^/]+$", 1), F.lit("/"), F.lit("-"))
    return lines.groupBy(day.alias("day")).agg(F.count("v").alias("n"), F.sum(F.try_variant_get("v", "$.event_id", "bigint")).alias("ids"))


@query("s12_queue_rows", "SELECT 'c' || (l_suppkey % 4) AS class, 's' || l_orderkey AS session, l_linenumber::BIGINT AS line FROM lineitem")
def _(t):
    """Written queues: a heading for each class of a file, items under it, and other lines between."""
    own = t("lineitem")
    item = F.format_string("- [ ] 2024-01-01T00:00:00Z `s%d` L%d text", "l_orderkey", "l_linenumber")
    head = F.format_string("## c%d \u2014 9 total", F.col("l_suppkey") % 4)
    lines = own.select(
        F.concat_ws("-", F.lit("/q"), "l_orderkey", "l_linenumber", "l_suppkey", F.xxhash64("l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")).alias("path"), F.posexplode(F.array(F.lit("# x"), head, F.lit("text"), item)).alias("n", "raw")
    ).withColumn("line_no", (F.col("n") + 1).cast("long"))
    return R.queue_rows(lines).select("class", "session", "line")


@query("s20_arm_counts", "SELECT 'run' || (doc_id % 3) || '/mid' AS run, CASE WHEN doc_id % 5 < 3 THEN 'calls' ELSE 'judge' END AS kind, CASE WHEN doc_id % 2 = 0 THEN 'baseline' ELSE 'treatment' END AS arm, count(*) AS n FROM labels GROUP BY ALL")
def _(t):
    d = F.col("doc_id")
    path = F.format_string("/r/run%d/mid/%s/%s-%d.json", d % 3, F.when(d % 5 < 3, "calls").otherwise("judge"), F.when(d % 2 == 0, "baseline").otherwise("treatment"), d)
    return R.arm_counts(t("labels").select(path.alias("path")))


@query("s21_misnamed", "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 3")
def _(t):
    k = F.col("o_orderkey")
    name = F.when(k % 7 == 3, F.concat(F.lit("/t/x"), k.cast("string"), F.lit(".yaml"))).otherwise(F.concat(F.lit("/t/"), k.cast("string"), F.lit(".yaml")))
    return R.misnamed(t("orders").select("o_orderkey", name.alias("path")), "o_orderkey", "path").select("o_orderkey")


@query("p21_stale_files", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-10'")
def _(t):
    files = t("events").select("event_id", F.col("ts").alias("modified"))
    return R.stale(files, F.lit("2024-01-10").cast("timestamp")).select("event_id")


@query("f09_rollout_outputs", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'plain ' || event_type WHEN 1 THEN 'inner ' || event_type ELSE '{\"code\":' || event_id || '}' END AS text FROM events")
def _(t):
    """Tool outputs as a text, as an object with a text, and as another object."""
    e = F.col("event_id")
    output = F.when(e % 3 == 0, F.concat(F.lit('"plain '), "event_type", F.lit('"'))).when(e % 3 == 1, F.concat(F.lit('{"content": "inner '), "event_type", F.lit('"}'))).otherwise(F.concat(F.lit('{"code": '), e.cast("string"), F.lit("}")))
    raw = F.concat(F.lit('{"type": "response_item", "payload": {"type": "function_call_output", "output": '), output, F.lit("}}"))
    lines = t("events").select(e.cast("string").alias("path"), F.lit(1).cast("long").alias("line_no"), raw.alias("raw"))
    return R.rollout_events(R.json_lines(lines)).select(F.col("path").cast("long").alias("event_id"), "text")

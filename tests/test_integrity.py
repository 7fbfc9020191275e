from tracewright.operators import coverage as C
from tracewright.operators import integrity as I
from tracewright.streaming import evidence as V


def test_citation_grades(spark):
    lines = spark.createDataFrame([("f", i, f"line {i} unique{i} same") for i in range(1, 31)], "path string, line_no long, line string")
    cites = [("a", "f", 5, "unique5"), ("b", "f", 5, "Unique7"), ("c", "f", 5, "unique20"), ("d", "f", 5, "unique9 … unique30"), ("e", "f", 5, "absent"), ("g", "nofile", 1, "x"), ("h", "f", 25, "same")]
    got = {r["cite"]: (r["grade"], r["nearest"]) for r in I.grade_citations(spark.createDataFrame(cites, "cite string, path string, line long, quote string"), lines).collect()}
    assert got == {"a": ("VALID", 5), "b": ("DRIFT", 7), "c": ("ELSEWHERE", 20), "d": ("SPLICE?", None), "e": ("NOT-FOUND", None), "g": ("NO-FILE", None), "h": ("VALID", 25)}
    checked = [("a", "f", 5, "unique5 same line 6"), ("b", "f", 31, None), ("c", "nofile", 1, None), ("d", "f", 5, "unique30"), ("e", "f", 30, None)]
    got = {r["cite"]: r["status"] for r in I.check_ranges(spark.createDataFrame(checked, "cite string, path string, line long, quote string"), lines).collect()}
    assert got == {"a": "ok", "b": "out of range", "c": "missing file", "d": "bad quote", "e": "ok"}


def test_hunks(spark):
    diff = ["diff", "@@ -1,3 +1,4 @@", " a", "-b", "+c", "+d", " e", "@@ -3,2 +4 @@ x", " f", "-g", "@@ -20 +20,2 @@", "+h"]
    got = I.hunks(spark.createDataFrame([("p", i, x) for i, x in enumerate(diff)], "path string, line_no long, line string")).orderBy("hunk").collect()
    assert [(r["old_ok"], r["new_ok"], r["shift"], r["overlaps"], r["placed_ok"]) for r in got] == [(True, True, 0, False, True), (True, True, 1, True, True), (False, False, 0, False, True)]


def test_fields_flags_and_drift(spark):
    rows = spark.createDataFrame([("a", "x", "ok"), ("b", " ", "bad"), ("c", None, None)], "id string, name string, kind string")
    assert sorted(map(tuple, I.required_fields(rows, "id", ("name",), {"kind": ("ok",)}).collect())) == [("b", "kind", "not allowed"), ("b", "name", "missing"), ("c", "name", "missing")]
    m, t = spark.createDataFrame([("a", True), ("b", True), ("c", None)], "id string, s boolean"), spark.createDataFrame([("b", False), ("c", None), ("d", True)], "id string, s boolean")
    assert sorted((r["id"], r["problem"]) for r in I.flag_mismatches(m, t, "id", "s").collect()) == [("a", "no truth"), ("b", "differs"), ("d", "orphan")]
    assert I.record_drift(m, m).count() == 0 and I.record_drift(m, t).count() == 4
    assert [r[0] for r in I.touched(m, t, "id", ("s",)).collect()] == ["b"]
    assert [(r["grade"], r["n"]) for r in I.grade_tallies(spark.createDataFrame([("DRIFT(3)",), ("DRIFT(2)",)], "grade string")).collect()] == [("DRIFT", 2)]


def test_rules_paragraphs_and_budgets(spark):
    docs = spark.createDataFrame([("a", "one\n \ntwo\nthree\n\n"), ("b", "x")], "id string, text string")
    assert [(r["id"], r["paragraph"]) for r in I.paragraphs(docs, "id", "text").collect()] == [("a", "one"), ("a", "two\nthree"), ("b", "x")]
    assert [r["id"] for r in I.budgets(docs, "id", "text", 3, 100).collect()] == ["a"]
    assert sorted(map(tuple, I.text_rules(docs, "id", "text", (("R", "gate", "one", True), ("S", "note", "x", False))).collect())) == [("b", "R", "gate"), ("b", "S", "note")]


def test_cross_tab_lists_empty_rows(spark):
    rows = spark.createDataFrame([("a", "m"), ("a", "n"), ("b", "m"), ("z", "m")], "kind string, model string")
    listed = spark.createDataFrame([("a",), ("b",), ("c",)], "kind string")
    from pyspark.sql import functions as F

    got = {r["kind"]: (r["m"], r["n"], r["total"]) for r in C.cross_tab(rows, "kind", "model", ["m", "n"], F.count(F.lit(1)), listed).collect()}
    assert got == {"a": (1, 1, 2), "b": (1, 0, 1), "c": (0, 0, 0), "TOTAL": (2, 1, 3)}
    turns = spark.createDataFrame([("p", "x", 2), ("p", "y", 2), ("q", "x", 1)], "path string, model string, turns long")
    assert dict(map(tuple, C.primary_model(turns).collect())) == {"p": "y", "q": "x"}


def test_evidence_streams_emit_new_keys_only(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = lambda *x: spark.createDataFrame([("failure", "c", "t", s, n) for s, n in x], V.NOMINATION)
    for name, collect in (("state", V.collect_evidence), ("store", V.collect_against_store)):
        inbox, store, mark = (str(tmp_path / name / x) for x in ("in", "store", "mark"))
        rows(("s", 1), ("s", 1), ("s", 2)).coalesce(1).write.mode("append").json(inbox)
        collect(V.nominations(spark, inbox), store, mark, "2026-07-01").awaitTermination()
        rows(("s", 2), ("s", 3)).coalesce(1).write.mode("append").json(inbox)
        collect(V.nominations(spark, inbox), store, mark, "2026-07-02").awaitTermination()
        got = sorted((r["key"], str(r["first_seen"])) for r in spark.read.parquet(store).collect())
        assert got == [("failure|c|s|L1", "2026-07-01"), ("failure|c|s|L2", "2026-07-01"), ("failure|c|s|L3", "2026-07-02")]
    timed = spark.createDataFrame([("2026-07-01 00:00:00", "a")], "ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    assert V.windowed_counts(timed, "ts", "k").count() == 1


def test_every_document_is_graded(spark, tmp_path):
    from tracewright.plans import registry

    docs = [(i, f"heading {i}\na first line of document {i}\nmore") for i in range(1, 46)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    graded = registry.queries()["f26_citation_grades"](spark, str(tmp_path)).collect()
    assert sorted(int(r["cite"][1:]) for r in graded) == list(range(1, 46))
    assert sum(r["n"] for r in registry.queries()["a36_grade_tallies"](spark, str(tmp_path)).collect()) == 45


def test_short_ids_of_several_files_are_told_apart_by_the_quote(spark, tmp_path):
    """The MD5 sums of 25302 and 82945 begin with the same eight characters; so do those of 3447 and 102617."""
    from tracewright.plans import registry

    docs = [(i, "web", f"heading {i}\nmore") for i in (25302, 82945, 3447, 102617, 1)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["cite"]: (r["how"], r["grade"]) for r in registry.queries()["f26_citations_by_short_name"](spark, str(tmp_path)).collect()}
    assert got == {"c25302": ("suffix", "VALID"), "c82945": ("short id", "VALID"), "c3447": ("none", "NO-FILE"), "c102617": ("short id", "VALID"), "c1": ("short id", "VALID")}


def test_a_name_of_several_files_stays_ambiguous_where_the_quote_does_not_tell(spark):
    lines = spark.createDataFrame([("/a/0123abcd.x", 1, "one"), ("/a/0123abcd.x", 2, "both"), ("/b/0123abcd.x", 1, "two"), ("/b/0123abcd.x", 2, "both"), ("/b/0123abcd.x", 3, None)], "path string, line_no long, line string")
    cites = [("c0", "0123abcd", 1, "TWO", "short id", "/b/0123abcd.x"), ("c1", "0123abcd", 2, "both", "ambiguous", "0123abcd"), ("c2", "…/0123abcd.x", 1, "one", "suffix", "/a/0123abcd.x"), ("c3", "0123abcd", 3, "one", "ambiguous", "0123abcd"), ("c4", "…/0123abcd.x", 1, None, "ambiguous", "…/0123abcd.x"), ("c5", "/b/0123abcd.x", 1, "one", "exact", "/b/0123abcd.x")]
    df = spark.createDataFrame([c[:4] for c in cites], "cite string, path string, line long, quote string")
    got = I.resolve_paths(df, lines.select("path").distinct(), lines)
    assert sorted((r["cite"], r["how"], r["path"]) for r in got.collect()) == [(c, how, path) for c, _, _, _, how, path in cites]


def test_hunks_are_dealt_to_more_tasks_as_lines_grow(spark, monkeypatch):
    monkeypatch.setattr(I, "TASK_LINES", 3)
    lines = spark.createDataFrame([(f"p{k}", i, x) for k in range(7) for i, x in enumerate(["@@ -1,1 +1,2 @@", " a", "+b"])], "path string, line_no long, line string")
    got = I.hunks(lines)
    assert got.rdd.getNumPartitions() == 8
    assert sorted((r["path"], r["hunk"], r["old_ok"], r["new_ok"]) for r in got.collect()) == [(f"p{k}", 1, True, True) for k in range(7)]

import pytest

from tracewright.functions.registered import line_blocks, register
from tracewright.operators import integrity as I
from tracewright.sources import versions as V


def rows(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "n long")


def values(df):
    return sorted(r["n"] for r in df.collect())


def test_a_reader_finds_one_whole_version_between_all_steps(spark, tmp_path):
    where = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        V.read_table(spark, where)
    assert V.replace_table(rows(spark, 1, 2), where) == 1
    begun = V.read_table(spark, where)
    folder = V.stage_version(rows(spark, 3), where)  # written, not named
    assert values(V.read_table(spark, where)) == [1, 2]
    V.name_version(spark, where, folder, 2)
    assert values(V.read_table(spark, where)) == [3] and values(begun) == [1, 2]
    V.expire(spark, where, 2)
    assert values(begun) == [1, 2] and values(V.read_table(spark, where, 1)) == [1, 2]
    assert V.replace_table(V.read_table(spark, where).selectExpr("n + 1 AS n"), where) == 3  # from the table itself
    assert values(V.read_table(spark, where)) == [4] and [n for n, _ in V.versions(spark, where)] == [2, 3]
    with pytest.raises(FileNotFoundError):
        V.read_table(spark, where, 1)


def test_of_two_writers_one_is_late(spark, tmp_path):
    where = str(tmp_path / "table")
    V.replace_table(rows(spark, 0), where)
    folders = [V.stage_version(rows(spark, i), where) for i in (7, 8)]
    V.name_version(spark, where, folders[0], 2)
    with pytest.raises(V.Overtaken):
        V.name_version(spark, where, folders[1], 2)
    assert values(V.read_table(spark, where)) == [7]


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    where = str(tmp_path / "table")
    V.replace_table(rows(spark, 5), where)
    with pytest.raises(Exception, match="no good"):
        V.replace_table(rows(spark, 1).selectExpr("raise_error('no good') AS n"), where)
    assert values(V.read_table(spark, where)) == [5]


def test_hunks_by_a_table_function(spark):
    diff = ["diff", "+x", "@@ -1,3 +1,4 @@", " a", "-b", "+c", "+d", " e", None, "@@ -3,2 +4 @@ x", " f", "-g", "@@ nonsense", "@@ -20 +20,2 @@", "+h"]
    lines = spark.createDataFrame([(p, i, x) for p in "pq" for i, x in enumerate(diff)] + [("none", 1, "text")], "path string, line_no long, line string").repartition(3)
    register(spark)
    got = spark.sql("SELECT * FROM tw_hunks(TABLE({t}))", t=lines)
    want = I.hunks(lines)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 8
    with pytest.raises(Exception, match="line_no"):
        spark.sql("SELECT * FROM tw_hunks(TABLE({t}))", t=lines.drop("line_no")).collect()
    spread = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 4.0), ("b", None), ("c", None)], "k string, v double")
    found = dict(map(tuple, spark.sql("SELECT k, round(tw_concentration(v), 6) FROM {s} GROUP BY k", s=spread).collect()))
    assert found == {"a": 0.0, "b": 0.5, "c": 0.0}


def test_hunks_of_lines_in_blocks(spark):
    diff = ["diff", "+x", "@@ -1,3 +1,4 @@", " a", "-b", "+c", "+d", " e", None, "@@ -3,2 +4 @@ x", " f", "-g", "@@ nonsense", "@@ -20 +20,2 @@", "+h", None]
    lines = spark.createDataFrame([(p, i - 4, x) for p in ("p", "q", None) for i, x in enumerate(diff)] + [("none", 1, "text"), ("null", 1, None)], "path string, line_no long, line string").repartition(3)
    register(spark)
    want = sorted(map(str, I.hunks(lines).collect()))
    assert len(want) == 12
    for size in (1, 2, 3, 5, 100):  # hunks end within blocks, at their ends and blocks later
        blocks = line_blocks(lines, size)
        assert sorted(map(str, spark.sql("SELECT * FROM tw_hunks(TABLE({t}))", t=blocks).collect())) == want
    assert blocks.count() == 3 * 2 + 2  # negative numbers are blocks as well


def test_the_hunk_query_hands_python_blocks_not_lines(spark):
    from tracewright.plans import registry

    df = registry.queries()["x28_table_function_hunks"](spark, "/root/testdata/sf0.001")
    assert df.count() == 1500
    assert "collect_list" in df._jdf.queryExecution().optimizedPlan().toString()

import os

from tracewright.sources import file_index as I
from tracewright.sources import sinks
from tracewright.sources.versions import versions


def put(root, name, text, at):
    file = os.path.join(root, name)
    os.makedirs(os.path.dirname(file), exist_ok=True)
    with open(file, "w") as f:
        f.write(text)
    os.utime(file, (at, at))


def test_a_refresh_reads_what_changed(spark, tmp_path):
    root, where = str(tmp_path / "tree"), str(tmp_path / "index")
    assert I.refresh_index(spark, root, where).count() == 0  # no folder, no files
    put(root, "a/x.jsonl", "one\nmore\n", 1_700_000_000)
    put(root, "a/x/subagents/d/y.jsonl", "two\n", 1_700_000_100)
    put(root, "a/none.jsonl", "", 1_700_000_200)  # no byte, no entry
    seen = lambda df: {r["path"].split("/tree/")[1]: (r["head"], r["seen"]) for r in df.collect()}
    first = seen(I.refresh_index(spark, root, where))
    assert first == {"a/x.jsonl": ("one", 2), "a/x/subagents/d/y.jsonl": ("two", 2)}
    n = len(versions(spark, where))
    assert seen(I.refresh_index(spark, root, where)) == first and len(versions(spark, where)) == n  # nothing new, nothing written
    put(root, "a/x.jsonl", "ONE\nmore\n", 1_700_000_000)  # same time and size: taken for the same file, not read
    put(root, "a/x/subagents/d/y.jsonl", "changed\n", 1_700_000_300)
    put(root, "b/old.jsonl", "older than all\n", 1_600_000_000)  # new here, though its time is old
    assert seen(I.refresh_index(spark, root, where)) == {"a/x.jsonl": ("one", 2), "a/x/subagents/d/y.jsonl": ("changed", 3), "b/old.jsonl": ("older than all", 3)}
    os.remove(os.path.join(root, "b/old.jsonl"))
    assert set(seen(I.refresh_index(spark, root, where))) == {"a/x.jsonl", "a/x/subagents/d/y.jsonl"}


def test_older_files_stay_unread(spark, tmp_path):
    root = str(tmp_path)
    put(root, "a.jsonl", "old\n", 1_600_000_000)
    put(root, "b/b.jsonl", "new\n", 1_700_000_000)
    heads = I.first_lines(spark, root, "*.jsonl", "2023-01-01T00:00:00")
    assert [r["head"] for r in heads.collect()] == ["new"]
    scans = [f.rsplit("/", 1)[1] for f in spark.read.option("recursiveFileLookup", "true").option("modifiedAfter", "2023-01-01T00:00:00").text(root).inputFiles()]
    assert scans == ["b.jsonl"]


def test_places_and_heads(spark, tmp_path):
    rows = [("/r/p/s1.jsonl", 1, '{"cwd": "/w"}'), ("/r/p/s1/subagents/a/b.jsonl", 2, "{}"), ("/r/p/s1/tools/x.jsonl", 2, None), ("/r/s0.jsonl", 2, "no json"), ("/q/p/s2.jsonl", 3, '{"cwd": "/w"}'), ("/r/p/s3.jsonl", 3, '{"cwd": "/w"}')]
    index = spark.createDataFrame([(p, m, h, 1) for p, m, h in rows], "path string, modified long, head string, seen long")
    assert sorted((r["path"], r["session"], r["kind"]) for r in I.session_files(index, "/r").collect()) == [("/r/p/s1.jsonl", "s1", "main"), ("/r/p/s1/subagents/a/b.jsonl", "s1", "sub"), ("/r/p/s3.jsonl", "s3", "main")]
    assert [tuple(r) for r in I.newest_of(index, "$.cwd").collect()] == [("/w", "/r/p/s3.jsonl", 3, 1)]  # ties by path


def test_named_files(spark, tmp_path):
    rows = spark.createDataFrame([("a/b c.txt", 2, "y"), ("a/b c.txt", 1, "x"), ("d.txt", 1, "z")], "name string, nth long, raw string")
    where = str(tmp_path / "t")
    assert len(sinks.write_named(rows, where)) == 2 and open(f"{where}/a/b c.txt").read() == "x\ny\n"
    sinks.write_named(rows.where("name = 'd.txt'").withColumn("raw", rows["nth"].cast("string")), where)
    assert open(f"{where}/d.txt").read() == "1\n" and sorted(os.listdir(tmp_path)) == ["t"]

import random

import pytest

from tracewright.operators import intervals as I


def spans(rng, n, far):
    out = []
    for i in range(n):
        a = rng.randint(-far, far)
        out.append((i, a, a + rng.choice([0, 0, 1, 5, rng.randint(0, far), 3 * far])))
    return out + [(n, None, 3), (n + 1, 3, None), (n + 2, 5, 4), (n, 7, 7)]


def meets(a, b):
    return None not in (*a, *b) and a[1] <= a[2] and b[1] <= b[2] and a[1] <= b[2] and b[1] <= a[2]


@pytest.mark.parametrize(("unit", "far"), [(1, 40), (7, 1000), (60, 10**12)])
def test_interval_join_is_all_pairs_that_meet(spark, unit, far):
    rng = random.Random(unit)
    a, b = spans(rng, 60, far), spans(rng, 80, far)
    left, right = spark.createDataFrame(a, "a long, s long, e long"), spark.createDataFrame(b, "b long, start long, stop long")
    got = I.interval_join(left, right, ("s", "e"), ("start", "stop"), unit=unit).collect()
    assert sorted(map(tuple, got)) == sorted((*x, *y) for x in a for y in b if meets((0, *x[1:]), (0, *y[1:])))
    counts = I.overlap_counts(left, right, "a", ("s", "e"), ("start", "stop")).collect()
    want = {x[0]: 0 for x in a}
    for x in a:
        want[x[0]] += sum(meets((0, *x[1:]), (0, *y[1:])) for y in b)
    assert dict(map(tuple, counts)) == want


def test_interval_join_of_nothing_and_of_clashing_names(spark):
    left, right = spark.createDataFrame([(1, 0, 9)], "a long, s long, e long"), spark.createDataFrame([], "b long, start long, stop long")
    assert I.interval_join(left, right, ("s", "e"), ("start", "stop")).count() == 0
    with pytest.raises(ValueError, match="s"):
        I.interval_join(left, left, ("s", "e"), ("s", "e"))


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("keyed", [False, True])
def test_as_of_is_the_last_row_before(spark, strict, keyed):
    """One key holds most rows, so that it spans blocks; some keys have no right row."""
    rng = random.Random(8)
    key = lambda: rng.choice([1, 1, 1, 1, 2, 3, None])
    a = [(i, key(), rng.choice([None, rng.randint(0, 60)])) for i in range(150)] + [(900, 9, 30)]
    b = [(i, key(), rng.choice([None, *[rng.randint(5, 55)] * 9])) for i in range(60)]
    left, right = spark.createDataFrame(a, "a long, k long, t long").repartition(5), spark.createDataFrame(b, "b long, k2 long, t2 long")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = I.as_of(left, right, "t", "t2", by=(("k", "k2"),) if keyed else (), tie="b", strict=strict).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = []
    for i, k, t in a:
        fits = [r for r in b if t is not None and r[2] is not None and (r[2] < t if strict else r[2] <= t) and (not keyed or (k is not None and r[1] == k))]
        want.append((i, k, t, *(max(fits, key=lambda r: (r[2], r[0])) if fits else (None, None, None))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_rows_of_equal_spans_meet_once(spark, monkeypatch):
    """1,000 rows of each of few spans: what is joined are the spans, and each row has its span's figures; counts go over several blocks."""
    joined = []
    whole = I.interval_join
    monkeypatch.setattr(I, "interval_join", lambda left, right, *a, **k: joined.append((left.count(), right.count())) or whole(left, right, *a, **k))
    monkeypatch.setattr(I, "BLOCK_ROWS", 3)
    rng = random.Random(3)
    a, b = spans(rng, 12, 50), spans(rng, 15, 50)
    left = spark.createDataFrame(a, "a long, s long, e long").crossJoin(spark.range(1000).withColumnRenamed("id", "copy"))
    right = spark.createDataFrame([(i + 100 * k, x, y) for i, x, y in b for k in range(20)], "b long, start long, stop long")
    got = I.overlap_summaries(left, right, ("s", "e"), ("start", "stop"), "b").groupBy("a", "s", "e").agg({"n": "max", "first": "max", "longest": "max", "copy": "count"}).collect()
    want = {}
    for x in a:
        met = [y for y in b if meets((0, *x[1:]), (0, *y[1:]))]
        if met:
            want[x] = (20 * len(met), min(y[0] for y in met), max(min(x[2], y[2]) - max(x[1], y[1]) for y in met), 1000)
    assert {(r["a"], r["s"], r["e"]): (r["max(n)"], r["max(first)"], r["max(longest)"], r["count(copy)"]) for r in got} == want
    assert joined[0][0] <= 14 and joined[0][1] <= 17
    counts = dict(map(tuple, I.overlap_counts(left, right, "a", ("s", "e"), ("start", "stop")).collect()))
    assert counts == {i: 1000 * sum(want.get(x, (0,))[0] for x in a if x[0] == i) for i in {x[0] for x in a}}

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tracewright.llm import mixing

from .helpers import SPACED


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total >= cap * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def corpus(n=400):
    rng = random.Random(2)
    sources = ["a", "b", "B", "é", None, "zz", "hot", "hot", "hot", "hot"]
    return [(i, rng.choice(sources), " ".join("w#" if rng.random() < 0.2 else "word" for _ in range(rng.randint(0, 60)))) for i in range(n)] + [(900, "only", None), (901, "only", ""), (None, "a", "x y z"), (7, "a", "x y z"), (7, "a", "x y z w")]


@pytest.mark.parametrize("bucket_rows", [4096, 5])
def test_mix(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(mixing, "FEW_ROWS", 10 * bucket_rows)
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, size int")
    got = mixing.mix_sources(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(df.repartition(7)).collect()), key=str)
    size = lambda t: len(re.findall(SPACED, t or ""))
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = targets(sizes)
    taken, largest, order = {}, {}, {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    for i, s, t in rows:
        n = size(t)
        u = (int(hashlib.md5((hashlib.md5((t or "").encode()).hexdigest() if i is None else str(i)).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        quality = max(0.25, 1 - sum(c in "#*$%&|<>" for c in t or "") / max(n, 1))
        order.setdefault(s, []).append((-math.log(u) / quality, i or 0, n, i))
    copies = {(r["doc_id"], r["size"]): r["taken"] for r in got}
    for s, keyed in order.items():
        epochs = math.floor(want[s] / sizes[s] + 1e-12) if sizes[s] else 0
        rest, prefix = want[s] - epochs * sizes[s], 0
        for _, _, n, i in sorted(keyed):
            assert copies[i, n] == n * (epochs + (2 * prefix + n <= 2 * rest + 1e-9)), (s, i)
            prefix += n


def test_many_rows_that_are_alike_share_what_is_left(spark):
    """A budget that ends among equal rows takes as many of them as fit, null ids among them."""
    rows = [(None, "a", "x y z")] * 40 + [(7, "a", "x y z")] * 40 + [(i, "b", "p q " * 50) for i in range(3)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)).collect()
    for s in "ab":
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2
    copies = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["copies"] * len(r["text"].split())) for r in copies) == sorted((r["doc_id"] or -1, r["taken"]) for r in got)


def test_a_million_rows_that_are_alike(spark):
    """One text repeated a million times is one row where the cut is found, and counted out by parts."""
    rows = spark.range(1_000_000).selectExpr("7L as doc_id", "'a' as source", "'x y z' as text")
    other = spark.range(1000).selectExpr("id + 100 as doc_id", "'b' as source", "repeat('p ', 9000) as text")
    mixed = mixing.mix_sources(rows.unionByName(other).repartition(8))
    told = {r["source"]: r for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count(F.lit(1)).alias("n")).collect()}
    assert told["a"]["n"] == 1_000_000 and abs(told["a"]["taken"] - told["a"]["target"]) <= 1.5
    assert abs(told["b"]["taken"] - told["b"]["target"]) <= 4500


def test_many_sources(spark, monkeypatch):
    """More sources than are broadcast, over several ranges."""
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(mixing, "FEW_ROWS", 3)
    rng = random.Random(8)
    rows = [(i, f"s{rng.randrange(60):02}", "w " * rng.randint(0, 50)) for i in range(500)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = targets(sizes)
    assert len(got) == 500 and all(r["target"] == pytest.approx(want[r["source"]]) for r in got)


def test_empty_table(spark):
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_mixed_documents_keep_their_columns(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(corpus())], "doc_id long, source string, text string, size int")
    mixed = mixing.mix_documents(df)
    assert mixed.columns == [*df.columns, "copies"]
    rows = mixed.collect()
    assert sorted((tuple(r)[:4] for r in rows), key=str) == sorted(map(tuple, df.collect()), key=str)
    words = lambda t: len(re.findall(SPACED, t or ""))
    taken = sorted(((r["doc_id"], r["source"], words(r["text"]) * r["copies"]) for r in rows), key=str)
    assert taken == sorted(((r["doc_id"], r["source"], r["taken"]) for r in mixing.mix_sources(df).collect()), key=str)

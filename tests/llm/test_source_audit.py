import random
import re
from collections import Counter, defaultdict

import pytest

from tracewright.llm import source_audit as A

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def brute(rows, least=3, top=200):
    rows = [(x or "", s or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(TERM, t or "")]) for t, x, s in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        held, counts = Counter(), defaultdict(Counter)
        for x, s, words in rows:
            if x == lang:
                held.update(set(words))
                counts[s].update(words)
        kept = {w for w, n in held.items() if n >= least}
        v = len(kept)
        whole = Counter()
        for c in counts.values():
            whole.update({w: n for w, n in c.items() if w in kept})

        def shares(c):
            n = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 1) // (n + v) for w in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in p:
            pairs = [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in p if o != s]
            terms = [(f(p[s][w], q[w]), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found, limit in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda r: (-r[0], r[1].encode()))[:limit], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def corpus(n=250, seed=5):
    rng = random.Random(seed)
    words = ["the", "The", "of", "été", "Éa", "x1y", "don't", "日本", "zz", "q"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    text = lambda: " ".join(rng.choice(words[: rng.randint(3, len(words))]) for _ in range(rng.randint(0, 40)))
    rows = [(text(), rng.choice(["en", "en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "B", "é", None])) for _ in range(n)]
    return rows + [(None, "en", "quiet"), ("", "de", "quiet"), ("one two", "fr", "a"), ("one", "fr", "b"), ("1 2 3", "it", "only"), ("word " * 50_000, "en", "long")] + [("same same text", "en", "copies")] * 40


def got(spark, rows):
    df = spark.createDataFrame([(i, t, x, s, 0, "n") for i, (t, x, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, n int, term string")
    out = [tuple(r) for r in A.audit_sources(df.repartition(5)).collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_equals_plain_computation(spark):
    rows = corpus()
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("held", [30])
def test_blocks_and_batches_of_any_size(spark, monkeypatch, held):
    """Blocks that are given away early, and terms that span batches and ranges."""
    monkeypatch.setattr(A, "HELD", held)
    monkeypatch.setattr(A, "BLOCK_BYTES", 200)
    monkeypatch.setattr(A, "small_batches", lambda spark: spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        rows = corpus(120, seed=6)
        assert got(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_empty_table(spark):
    assert A.audit_sources(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_are_exact(spark):
    numbers = [(c, d) for d in (1, 3, 7, 10**9 + 7, 8 * 10**15 + 3) for c in (1, d // 2 + 1, d)]
    df = spark.createDataFrame(numbers, "c long, d long").selectExpr("c", "d", f"{A.share('c', 'd')} AS p")
    assert all(r["p"] == 1 + 10**9 * r["c"] // r["d"] for r in df.collect())

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tracewright.llm import lexical_search as S

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(TERM, text or "")]


def brute(docs, items, k):
    docs = [(i, Counter(words(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, length = len(docs), sum(n for *_, n in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i].update(words(t))
    out = []
    for item, wanted in asked.items():
        found = []
        for place, (doc, c, n) in enumerate(docs):
            m = 75 + 25 * n * n_docs // length
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, times in wanted.items() if c[w])
            if score > 0:
                found.append((-score, doc is None, doc or 0, place, doc))
        out += [(item, rank, f[-1], -f[0]) for rank, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus(n=200, seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["The", "the", "été", "ÉTÉ", "日本", "a1"]
    text = lambda most: " ".join(rng.choice(vocabulary[: rng.randint(2, len(vocabulary))]) for _ in range(rng.randint(0, most)))
    docs = [(i, text(60)) for i in range(n)] + [(900, None), (901, ""), (902, "?!"), (None, "the w1 w2"), (5, "the w1 w2"), (5, "the w1 w2"), (903, "w3 " * 60_000)] + [(1000 + i, "w1 w2 w3") for i in range(60)]
    return docs, [(i, text(12)) for i in range(12)] + [(50, None), (51, "unknownterm"), (52, "w1 w2 W1"), (52, "w3"), (None, "été w7")]


def ran(spark, docs, items, k=20):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, row int, term string")
    i = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    out = S.search(d, i, k=k)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("held", [(200_000, 500_000), (200_000, 0), (0, 0)])
def test_equals_plain_computation(spark, monkeypatch, held):
    """With terms and rows that tasks hold, and with joins that shuffle."""
    monkeypatch.setattr(S, "HELD_TERMS", held[0])
    monkeypatch.setattr(S, "HELD_ROWS", held[1])
    docs, items = corpus()
    assert ran(spark, docs, items) == brute(docs, items, 20)


def test_empty_tables(spark):
    docs, items = corpus(20)
    for d, i in (([], items), (docs, []), ([(1, None)], items), (docs, [(1, "")])):
        assert ran(spark, d, i) == []


def test_postings_are_dealt_by_term_and_hold_every_document(spark):
    docs, _ = corpus(50)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = S.postings(df).collect()
    held = [r for r in rows if r["term"] is not None]
    assert sum(r["tf"] for r in rows if r["term"] is None) == sum(r["tf"] for r in held) == sum(len(words(t)) for _, t in docs)
    assert Counter((r["doc_id"], r["term"], r["tf"]) for r in held) == Counter((i, w, n) for i, t in docs for w, n in Counter(words(t)).items())

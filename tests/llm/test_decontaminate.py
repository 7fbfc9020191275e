import hashlib
import random
import re

import pytest

from tracewright.llm import decontaminate as D

from .helpers import lower

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def fixture():
    rng = random.Random(9)
    word = lambda: rng.choice(["the", "of", "cat", "dog", "été", "x1", "run", "日本"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(12)] + [(12, None), (None, "a null id has these words too you know"), (3, "a second text of item three"), (3, "a second text of item three")]
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(60)]
    for i in range(60, 120):
        parts = [" ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.randint(0, 8)))]
        for _ in range(rng.randint(1, 3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(w) - 10))
            parts += [rng.choice([" ", ", ", "\n"]).join(w[a : a + rng.randint(8, 30)]).upper(), f"z{rng.randint(0, 9)}"]
        docs.append((i, " ".join(parts)))
    return docs + [(200, None), (201, ""), (202, "?!"), (None, docs[70][1]), (70, docs[70][1])], items


def brute(text, items, window=10):
    find = lambda t: re.findall(WORD, lower(t))
    w, hit, owners = find(text), set(), set()
    for name, t in items:
        own = find(t)
        k = min(window, len(own))
        for i in range(len(own) - k + 1 if k else 0):
            for j in range(len(w) - k + 1):
                if w[j : j + k] == own[i : i + k]:
                    hit |= set(range(j, j + k))
                    owners.add("" if name is None else str(name))
    return len(w), hit, sorted(owners)


@pytest.mark.parametrize("drop_short,pass_bytes", [(False, 1 << 20), (True, 1 << 20), (False, 300)])
def test_equals_brute_force(spark, monkeypatch, drop_short, pass_bytes):
    docs, items = fixture()
    items = [x for x in items if not drop_short or len((x[1] or "").split()) >= 9]
    monkeypatch.setattr(D, "SHARD_BYTES", 1500)
    d, b = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, items int"), spark.createDataFrame(items, "item_id long, text string")
    marked = D.mark_benchmark(d, b, pass_bytes=pass_bytes, cut=True).collect()
    assert len(marked) == len(docs)
    texts = {}
    for i, t in docs:
        texts.setdefault(i, t)
    for r in marked:
        n, hit, owners = brute(texts[r["doc_id"]], items)
        assert r["items"] == 1  # a column of the input
        m = r["marks"]
        spans = {k for s in m["spans"] for k in range(s["first"], s["last"] + 1)}
        assert (m["n_words"], spans, sorted(m["items"])) == (n, hit, owners)
        assert texts[r["doc_id"]] is not None or r["text"] is None
        if not drop_short:
            w = re.findall(WORD, lower(texts[r["doc_id"]]))
            assert re.findall(WORD, lower(r["text"])) == [x for k, x in enumerate(w) if k not in hit]
    got = D.contamination(d, b).collect()
    for r in got:
        n, hit, owners = brute(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, len(hit), len(owners), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(owners).encode()).hexdigest()


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.contamination(docs.limit(0), items).count() == 0
    assert [r["n_hit"] for r in D.contamination(docs, items.limit(0)).collect()] == [0]
    assert [r["n_hit"] for r in D.contamination(docs, items).collect()] == [2]

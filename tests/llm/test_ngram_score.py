import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tracewright.llm import ngram_score as L

DOCS = [
    (1, "the cat sat on the mat"), (2, "The cat sat on the hat"), (3, "a dog"), (4, ""), (5, None), (6, "the cat sat on the mat"),
    (7, "zzz qqq the"), (8, "été the cat été"), (9, "cat " * 300), (10, "the  cat\tsat\non"), (None, "the cat"), (12, "the end"), (12, "the end"),
]


WORDS = r"[^\x20\x09-\x0D]+"


def words(t):
    return re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\0end"]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


class Model:
    """The interpolated model of order three, by dictionaries and recursion."""

    def __init__(self, docs):
        grams = [Counter(), Counter(), Counter()]
        for i, t in docs:
            if not held(i):
                w = ["\0start", *words(t)]
                for n in (1, 2, 3):
                    grams[n - 1].update(tuple(w[k - n + 1 : k + 1]) for k in range(max(1, n - 1), len(w)))
        self.grams = grams
        self.n, self.v = sum(grams[0].values()), len(grams[0])
        self.stay = {}
        for n in (2, 3):
            once, tokens = Counter(), Counter()
            for g, c in grams[n - 1].items():
                k = self.level(self.count(g[:-1]))
                tokens[k] += c
                once[k] += c == 1
            self.stay[n] = {k: min(1 - once[k] / tokens[k], 1 - 1e-6) for k in tokens}

    @staticmethod
    def level(c):
        return math.ceil(math.log2(c + 1))

    def count(self, h):
        return self.grams[0]["\0end",] if h == ("\0start",) else self.grams[len(h) - 1][h]

    def p(self, h, x):
        if not h:
            return (self.grams[0][x,] or max(self.v, 1)) / max(self.n + self.v, 1)
        c = self.count(h)
        stay = self.stay[len(h) + 1].get(self.level(c), 0.0) if c else 0.0
        return stay * self.grams[len(h)][*h, x] / max(c, 1) + (1 - stay) * self.p(h[1:], x)


def brute(docs):
    m, out = Model(docs), []
    for i, t in docs:
        w = ["\0start", *words(t)]
        score = sum(math.log10(m.p(tuple(w[max(0, k - 2) : k]), w[k])) for k in range(1, len(w)))
        base = sum(math.log10((m.grams[0][x,] + 0.5) / (m.n + 0.5 * (m.v + 1))) for x in w[1:])
        out.append((i, held(i), len(w) - 1, sum(m.grams[0][x,] > 0 for x in w[1:]), m.n, base, score))
    return out


def texts(n=300):
    """Word soup of a skewed vocabulary, with copies, so that triples repeat within and across blocks."""
    rng = random.Random(5)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 60}"
    docs = [(100 + i, " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(n)]
    return docs + [(1000 + i, docs[rng.randrange(n)][1]) for i in range(n // 4)]


@pytest.mark.parametrize("block_bytes,bits,docs", [(1 << 20, 7, DOCS), (200, 7, DOCS), (1 << 20, 3, texts()), (900, 1, texts()), (2500, 2, texts())])
def test_equals_brute_force(spark, block_bytes, bits, docs):
    got = L.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), block_bytes=block_bytes, bits=bits, lane=16).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(brute(docs), key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])


def test_repeated_rows_and_a_long_text_take_several_blocks(spark):
    docs = [(1, "same words here")] * 400 + [(2, "one two " * 3000)]
    got = L.score_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), block_bytes=1000).collect()
    want = {r[0]: r for r in brute(docs)}
    assert len(got) == 401
    for r in got:
        assert tuple(r)[:5] == want[r["doc_id"]][:5] and r["score"] == pytest.approx(want[r["doc_id"]][6])


def test_empty_table_and_clashing_columns(spark):
    assert L.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    extra = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, block int, score string")
    assert L.score_texts(extra).columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def told(asked, totals):
    """What the counting nodes of one level answer, without Spark."""
    rows = pa.concat_tables(asked)
    out = []
    for node in sorted(set(rows.column("node").to_pylist())):
        own = rows.filter(pc.equal(rows.column("node"), node))
        m = L.Merged(own)
        out.append(m.answers(own, m.counts * np.uint64(2) + m.shared, [int(x) for x in totals(m.counts, m.levels, m.stats)]))
    return pa.concat_tables(out)


def test_every_state_s_probabilities_sum_to_one():
    """Over all words and one unseen, from the root, the start, every word and every pair, by the automaton's own steps."""
    docs = [d for d in texts(60) if not held(d[0])]
    schema = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("text", pa.large_string())])
    rows = pa.table({"doc_id": [i for i, _ in docs] + [0], "train": [True] * len(docs) + [False], "text": [t for _, t in docs] + ["unseen"]}, schema)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(rows)
    block = pa.table({"block": pa.array([0], pa.int64()), "packed": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
    t = L.Tokens(rows)
    none = np.zeros(len(t.words))
    answers = told([L._ask(0, 0, 1, 0, t.words, (t.word_count, none, none), [], L.FAN_BITS)], L.word_totals)
    answers = answers.append_column("kind", pa.array([0] * len(answers), pa.int32()))
    for order in (1, 2):
        more = told([L.Known(block, answers, order).asks(1)], L.level_totals)
        answers = pa.concat_tables([answers, more.append_column("kind", pa.array([order] * len(more), pa.int32()))])
    k = L.Known(block, answers, 3)
    a = L.Automaton(k)
    every = np.arange(len(k.t.words))
    states = [0, a.start, *a.of_word[a.of_word > 0].tolist(), *a.of_pair[(k.pair_count > 0)].tolist()]
    assert len(set(states)) > 200
    end = np.searchsorted(k.t.words, L.END)
    for s in set(states) - {int(a.of_word[end])}:  # nothing follows an end
        _, gained = a.step(np.full(len(every), s), every)
        assert (10.0**gained).sum() == pytest.approx(1)


def test_pack_round_trip():
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    n, one = np.arange(1000, dtype=np.uint64), np.ones(1000, np.uint8)
    a, b, c, d = L.unpack(L.pack(h, n, one, one))
    assert (a == h).all() and (b == n).all() and (c == 1).all() and (d == 1).all()
    assert [len(x) for x in L.unpack(L.pack(h[:0], n[:0], one[:0], one[:0]))] == [0, 0, 0, 0]

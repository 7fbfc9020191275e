import random
import re
from collections import Counter

import numpy as np
import pytest

from tracewright.llm import quality_knn as K
from tracewright.llm import quality_rules as Q

from .helpers import SPACED

ODD = [None, "", "\n\n", "a b c a b c\na b c\na b c\n  \n  \nx", "# $a\n# $a\né|", "w " * 60, "one\n" * 60, "🙂 " * 55 + "\x0b\x0c end", " ".join(f"w{i}" for i in range(60))]


def counts(text):
    text = text or ""
    w = re.findall(SPACED, text)
    often = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j + k for j in range(len(w) - 2) if often[tuple(w[j : j + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(SPACED, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def corpus(n=600):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 8)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(60, 200))]
        bad = i % 7 == 0
        if bad:
            w = [x.upper() + "!!" for x in w] if i % 2 else [x + rng.choice(["###", "$$$", " |"]) for x in w]
        docs.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, 0 if bad else 1))
    return docs, labels


def test_statistics_equal_brute_force(spark):
    docs, labels = corpus()
    rows = [(i, t, 5) for i, t in [*docs, *((1000 + k, t) for k, t in enumerate(ODD)), (None, ODD[3])]]
    got = Q.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, n_words int"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        want = counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in Q.COUNTS[:5]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    unseen = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and r["doc_id"] % 3 == 0]
    good = [r["kept"] for r in unseen if r["doc_id"] % 7]
    bad = [r["kept"] for r in unseen if r["doc_id"] % 7 == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.5


def test_rules_without_labels_and_empty_tables(spark):
    docs, labels = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    assert [r["kept"] for r in Q.judge_documents(docs, labels).collect()] == [True]
    assert Q.judge_documents(docs.limit(0), labels).count() == 0
    assert [r["score"] for r in K.score_quality(docs, labels).collect()] == [0.5]
    assert K.score_quality(docs.limit(0), labels).count() == 0


def test_isolation_forest_sets_outliers_apart():
    rng = np.random.default_rng(1)
    rows = np.vstack([rng.normal(size=(500, 3)), [[9, 9, 9], [-9, 9, 0]]])
    score = Q.IsolationForest(rows, trees=50).score(rows)
    assert (score[-2:] > np.quantile(score[:-2], 0.99)).all()
    assert Q.calibrated(np.array([0.1, 0.2, 0.9]), np.array([True, True, False]), 0.0) == pytest.approx(0.55)
    # a bad row among the good ones is let go, and none are lost for it
    assert Q.calibrated(np.array([0.1, 0.5, 0.3, 0.8, 0.9]), np.array([True, True, False, False, False]), 0.0) == pytest.approx(0.65)
    assert Q.calibrated(np.array([0.1, 0.5]), np.array([True, True]), 0.0) == 0.5 and Q.calibrated(np.array([0.1]), np.array([False])) == np.inf


def test_the_forest_s_verdict_equals_path_lengths_by_hand():
    """Scores of the arrays against a walk over each tree's nodes, and the verdict against both rules."""
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(200, 6))
    rules = Q.Rules(rows, rng.random(200) < 0.8)
    forest = rules.forest
    probe = rng.normal(size=(40, 6)) * 2

    def path(t, x):
        at = 0
        while forest.feature[t, at] >= 0:
            at = forest.left[t, at] if x[forest.feature[t, at]] <= forest.value[t, at] else forest.right[t, at]
        return forest.path[t, at]

    want = [2 ** (-np.mean([path(t, x) for t in range(Q.TREES)]) / Q._mean_path(forest.size)) for x in probe]
    assert forest.score(probe) == pytest.approx(want)
    s = {c: rng.integers(0, 400, 40) for c in Q.COUNTS}
    want = ~Q.base_failed(s) & np.array([forest.score(Q.features(s))[i] <= rules.threshold for i in range(40)])
    assert (rules.keeps(s) == want).all()


def test_votes_on_held_out_rows(spark):
    docs, labels = corpus()
    rows = [(i, t, 0.5) for i, t in [*docs, *((1000 + k, t) for k, t in enumerate(ODD)), (None, ODD[3])]]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame([*labels, (5000, 1), (None, 0), (4, None)], "doc_id long, quality int")
    got = K.score_quality(d, lab).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert held and np.mean([r["predicted"] == int(r["doc_id"] % 7 != 0) for r in held]) > 0.95


def test_cosines_are_exact_and_labels_out_of_fold_do_not_matter(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    import zlib

    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    a = sorted(map(tuple, K.score_quality(d, spark.createDataFrame(labels, "doc_id long, quality int")).collect()))
    b = sorted(map(tuple, K.score_quality(d, spark.createDataFrame(flipped, "doc_id long, quality int")).collect()))
    assert a == b
    terms = np.abs(np.random.default_rng(0).normal(size=(50, K.TERMS))).astype(np.float32)
    space = K.Space(terms, np.arange(50) % 2)
    cosines = space.vectors @ space.vectors.T
    near = np.argsort(-cosines[0])[: K.NEIGHBOURS]
    w = np.maximum(cosines[0][near], 0).astype(np.float64) ** K.SHARPNESS
    assert space.score(terms[:1])[0] == pytest.approx(((w * (near % 2)).sum() + 0.1 * 0.5) / (w.sum() + 0.1), rel=1e-4)


def terms_by_hand(text):
    """The terms of one text, byte by byte and word by word."""
    out = np.zeros(K.TERMS)
    raw = (text or "").encode()
    kinds = [K.BYTE_CLASS[b] for b in raw]
    for a, b in zip(kinds, kinds[1:], strict=False):
        out[a * K._CLASSES + b] += 1000 / len(raw)
    w = re.findall(SPACED, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    from tracewright.llm.kernels import NON_SPACE, Words

    for x in w:  # the hash of a word is the kernel's; that it falls to words alike is what counts here
        data = np.frombuffer(x.encode(), np.uint8)
        h = int(Words(data, np.array([0, len(data)]), NON_SPACE).hash()[0])
        out[K.PAIR_TERMS + (h >> 40) % K.WORD_TERMS] += 1000 / len(w)
    triples = list(zip(w, w[1:], w[2:], strict=False))
    repeated = 1 - len(set(triples)) / len(triples) if triples else 0
    step = min(int(repeated * K.REPEAT_TERMS * 2), K.REPEAT_TERMS - 1)
    if step:
        out[K.PAIR_TERMS + K.WORD_TERMS + step] = 300
    return np.log1p(out)


def test_terms_and_scores_equal_those_by_hand(spark):
    """Terms, the projection, exact cosines and weighted votes of whole texts, without kernels or blocks."""
    import pyarrow as pa
    import zlib

    docs, labels = corpus(150)
    docs += [(1000 + k, t) for k, t in enumerate(ODD)] + [(2000, " ".join(t for _, t in docs) * 3)]  # and a long text
    terms = np.array([terms_by_hand(t) for _, t in docs])
    assert K.term_counts(pa.array([t for _, t in docs], pa.string())) == pytest.approx(terms, abs=2e-3)
    place = {i: k for k, (i, _) in enumerate(docs)}
    known = sorted((str(i), q) for i, q in labels if zlib.crc32(str(i).encode()) % 5)
    own = np.array([terms[place[int(i)]] for i, _ in known]).astype(np.float16).astype(np.float64)
    good = np.array([q for _, q in known], float)
    weighed = own * (np.log((1 + len(own)) / (1 + (own > 0).sum(axis=0))) + 0.1)
    _, _, axes = np.linalg.svd(weighed, full_matrices=False)
    idf = np.log((1 + len(own)) / (1 + (own > 0).sum(axis=0))) + 0.1
    place_of = lambda m: (lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9))((m * idf) @ axes[: K.DIMENSIONS].T)
    cosines = place_of(terms) @ place_of(own).T
    got = {r["doc_id"]: r["score"] for r in K.score_quality(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    off = 0
    for k, (i, _) in enumerate(docs):
        near = np.argsort(-cosines[k])[: K.NEIGHBOURS]
        w = np.maximum(cosines[k][near], 0) ** K.SHARPNESS
        want = (w @ good[near] + 0.1 * good.mean()) / (w.sum() + 0.1) if terms[k].any() and w.sum() else good.mean()
        off += abs(got[i] - want) > 0.02  # a neighbour at the edge may be another where cosines tie
    assert off <= 3


def test_rules_are_learned_from_all_labelled_rows(spark):
    """9,000 labelled rows: leaves hold the whole growing half, and the threshold is that of the whole other half."""
    rng = np.random.default_rng(3)
    n = 9000
    s = {c: rng.integers(0, 300, n) for c in Q.COUNTS} | {"n_words": rng.integers(60, 400, n), "n_repeat_words": rng.integers(0, 20, n)}
    columns = "d_id long, " + ", ".join(f"{c} long" for c in Q.COUNTS)
    counts = spark.createDataFrame([(i, *(int(s[c][i]) for c in Q.COUNTS)) for i in range(n)], columns)
    x, good = Q.features(s), rng.random(n) < 0.9
    good[x[:, 1] > np.quantile(x[:, 1], 0.95)] = False
    labels = spark.createDataFrame([(i, int(good[i])) for i in range(n)], "doc_id long, quality int")
    rules = Q.learn(counts, labels)
    even = np.array([r[0] for r in counts.selectExpr("d_id", "pmod(xxhash64(string(d_id)), 2) = 0 AS even").orderBy("d_id").select("even").collect()])
    forest = rules.forest
    assert 4000 < even.sum() < 5000
    for t, at in enumerate(forest.leaves(x[even])):
        held = np.bincount(at, minlength=forest.feature.shape[1])
        want = forest.deep[t] + [0 if m <= 1 else Q._mean_path(m) if m >= 2 else (m - 1) * Q._mean_path(2) for m in held * forest.size / even.sum()]
        assert forest.path[t][held > 0] == pytest.approx(want[held > 0])
    assert rules.threshold == pytest.approx(Q.calibrated(forest.score(x[~even]), good[~even]))
    fewer = Q.learn(counts, labels.where("doc_id < 8990"))
    assert fewer.threshold != rules.threshold or (fewer.forest.path != forest.path).any()


def test_one_labelled_row_serves_both_halves(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(60 + i))) for i in range(3)], "doc_id long, text string")
    assert [r["kept"] for r in Q.judge_documents(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect()] == [True] * 3

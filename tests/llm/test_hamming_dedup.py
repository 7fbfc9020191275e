import math
import random

import numpy as np
import pytest

from tracewright.llm import hamming_dedup as H


def good(label, v):
    return label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, threshold):
    """Links and components by all pairs of rows (id, vector, label)."""
    links, low = [[] for _ in rows], list(range(len(rows)))
    for i, (_, a, x) in enumerate(rows):
        for j in range(i):
            _, b, y = rows[j]
            if good(x, a) and good(y, b) and x == y and len(a) == len(b):
                a1, b1 = (np.array(z, float) / max(abs(t) for t in z) for z in (a, b))
                if a1 @ b1 / math.sqrt((a1 @ a1) * (b1 @ b1)) >= threshold:
                    links[i].append(j)
                    links[j].append(i)
    changed = True
    while changed:
        changed = False
        for i, to in enumerate(links):
            m = min([low[i], *(low[j] for j in to)])
            changed, low[i] = changed or m != low[i], m
    out = []
    for i, (id_, _, _) in enumerate(rows):
        component = min((rows[j][0] for j in range(len(rows)) if low[j] == low[i] and rows[j][0] is not None), default=None)
        out.append((id_, len(links[i]), component, id_ is not None and id_ == component))
    return out


def turned(rng, v, cosine):
    v = v / np.linalg.norm(v)
    aside = rng.normal(size=len(v))
    aside -= (aside @ v) * v
    return cosine * v + math.sqrt(1 - cosine**2) * aside / np.linalg.norm(aside)


def family(n, dims, seed=3):
    """Vectors in labels, chains of near ones at and about the threshold, and a crowd of near ones on one centre."""
    rng = np.random.default_rng(seed)
    vectors = [rng.normal(size=dims) for _ in range(n)]
    for i in range(0, n, 5):
        vectors.append(turned(rng, vectors[i], rng.choice([0.975, 0.9799, 0.9801, 0.985, 0.995])))
    centre = rng.normal(size=dims)
    vectors += [turned(rng, centre, rng.uniform(0.985, 0.999)) * rng.uniform(0.1, 50) for _ in range(n // 2)]
    vectors += [vectors[-1]] * 5 + [vectors[0]] * 3 + [vectors[1] * 2]
    labels = [int(i % 2) for i in range(n)] + [int((5 * i) % 2) for i in range(n // 5 + (n % 5 > 0))]
    labels += [1] * (len(vectors) - len(labels) - 4) + [0, 0, 0, 1]
    order = rng.permutation(len(vectors))
    return [(int(p), [float(x) for x in v], x) for p, v, x in zip(order, vectors, labels, strict=True)]


SCHEMA = "vec_id long, embedding array<float>, label int"


def rounded(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], x) for i, v, x in rows]


@pytest.mark.parametrize(("dims", "block", "tile"), [(24, 8192, 1024), (8, 40, 16), (100, 50, 1024)])
def test_equals_all_pairs(spark, monkeypatch, dims, block, tile):
    """Also where a crowd is dealt into many blocks and products into many tiles."""
    for name, value in (("BLOCK", block), ("TILE", tile)):
        monkeypatch.setattr(H, name, value)
    rows = rounded(family(240, dims))
    got = H.vector_components(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 0.98))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 1), (4, [0.0, 0.0], 1), (5, None, 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1),
        (9, [1.0, 0.0], None), (10, [1.0, 0.0], 2), (None, [1.0, 0.0], 1), (None, None, None), (11, [], 1), (12, [-1.0, 0.0], 1), (13, [1e-40, 0.0], 1), (14, [3e38, 3e38], 1), (15, [1.0, 1.0], 1), (-5, [-3.0, 0.0], 1), (None, [5.0, 5.0, 5.0], 9), (None, [5.0, 5.0, 5.0], 9),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rounded(rows)], SCHEMA + ", node string, component_id int")
    got = sorted(map(tuple, H.vector_components(df).collect()), key=str)
    assert got == sorted(brute(rounded(rows), 0.98), key=str)


def test_empty_and_unusable(spark):
    assert H.vector_components(spark.createDataFrame([], SCHEMA)).count() == 0
    got = H.vector_components(spark.createDataFrame([(1, None, 1), (None, [0.0], 1)], SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == [(1, 0, 1, True), (None, 0, None, False)]


def test_recall_of_candidates_at_the_threshold():
    """Of pairs at the very threshold, fewer than one in a thousand meets in no table or is beyond the radius."""
    rng = np.random.default_rng(1)
    points = rng.normal(size=(4000, 64))
    codes = H.fit(points, np.full(4000, "a"), 0.98, 1000)
    a = H.unit(rng.normal(size=(5000, 64)))
    b = np.stack([turned(rng, x, 0.98) for x in a])
    bits = [codes.bits(x, np.full(5000, "a")) for x in (a, b)]
    met = (codes.substrings(bits[0]) == codes.substrings(bits[1])).any(axis=1)
    near = (bits[0][:, :64] != bits[1][:, :64]).sum(axis=1) <= codes.radius
    assert (met & near).mean() > 0.999
    assert abs(bits[0].mean() - 0.5) < 0.05  # balanced


def test_a_rotation_lowers_the_distance_to_signs():
    rng = random.Random(2)
    points = np.array([[rng.gauss(0, 1) for _ in range(16)] for _ in range(500)])
    loss = lambda turn: np.abs(points @ turn - np.where(points @ turn > 0, 1, -1)).sum()
    turn = H.rotation(points, 0)
    assert np.allclose(turn @ turn.T, np.eye(16)) and loss(turn) < loss(np.linalg.qr(np.random.default_rng(0).normal(size=(16, 16)))[0])

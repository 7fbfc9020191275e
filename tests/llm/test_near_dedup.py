import random

import numpy as np
import pyarrow as pa
import pytest

from tracewright.llm import components as CC
from tracewright.llm import near_dedup as N

from .helpers import components


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([2, 3, 5, 12, 60, 150]))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 60))):
                copy[rng.randrange(len(copy))] = word()
            out.append(("  " if rng.random() < 0.2 else " ").join(copy).upper() if rng.random() < 0.1 else " ".join(copy))
    return [*out, None, "", "  \n", "one", "One", "one two", "x " * 500, "x " * 500]


@pytest.fixture(params=[{}, {"region": 6, "part_shingles": 300}, {"region": 2, "part_shingles": 40}], ids=["whole", "split", "tiny"])
def how(request, monkeypatch):
    if request.param:
        for k, v in {"HUBS": 2, "BROADCAST_ROWS": 0}.items():
            monkeypatch.setattr(N, k, v)
    return request.param


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_components_equal_all_pairs(spark, how, width, percent):
    texts = corpus()
    want, sets = components(texts, width, percent)
    got = N.document_components(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string"), width=width, percent=percent, **how).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["component_id"], r["n_shingles"]) == (want[r["doc_id"]], len(sets[r["doc_id"]]))
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def family(n, seed=3):
    """Distinct texts on one template, of which some pairs are near copies."""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(150)]
    texts = []
    for i in range(n):
        if i % 10 == 9:
            copy = texts[-1].split()
            for at in rng.sample(range(len(copy)), 5):  # a similarity of about 0.87
                copy[at] = f"c{i}"
            texts.append(" ".join(copy))
        else:
            texts.append(" ".join([*template, *(f"v{rng.randrange(10**6)}" for _ in range(rng.randint(40, 90)))]))
    return texts


@pytest.mark.parametrize("region", [8, 2])
def test_a_dense_family_loses_no_link(spark, monkeypatch, region):
    """Regions cut to a few nodes drive the forest to its greatest depths; what it parts, the rarest shingles join."""
    monkeypatch.setattr(N, "BROADCAST_ROWS", 0)
    texts = family(400)
    want, _ = components(texts, 3, 85)
    pairs = sum(r != i for i, r in enumerate(want))
    assert pairs >= 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in N.document_components(df, region=region, part_shingles=5000).collect()}
    assert [got[i] for i in range(len(texts))] == want
    alone = {r["doc_id"]: r["component_id"] for r in N.document_components(df, region=region, part_shingles=5000, fallback=False).collect()}
    found = sum(alone[i] != i for i in range(len(texts)))
    print(f"region {region}: the forest alone finds {found} of {pairs} links")


def test_a_run_is_split_at_its_shortest_prefixes():
    regions, dense = N.split_run(np.array([0, 3, 3, 9, 9, 3, 9] + [9] * 20), 4, 10)
    assert not dense or all(b - a > 10 for a, b in dense)
    assert all(b - a <= 16 for a, b in regions)
    regions, dense = N.split_run(np.array([0] + [24] * 25), 4, 10)
    assert regions == [(0, 10), (10, 20), (20, 26)] and dense == [(0, 26)]
    order = np.array([[1] * 24, [1] * 20 + [2] * 4, [2] * 24, [2] * 24], np.uint16)
    assert N.common_prefixes(np.array([0, 0, 0, 1]), order).tolist() == [-1, 20, 0, -1]


def test_runs_span_batches():
    """Runs longer than a batch come out whole, whatever the batches' size."""
    rng = np.random.default_rng(3)
    order = rng.integers(0, 3, (300, N.ORDER)).astype(np.uint16)
    order[40:90] = order[40]
    keys = sorted((0, row.tobytes(), i) for i, row in enumerate(order))
    schema = pa.schema([("tree", pa.int32()), ("order", pa.binary()), ("node", pa.int64())])

    def regions(size):
        batches = [pa.record_batch([list(x) for x in zip(*keys[i : i + size], strict=True)], schema=schema) for i in range(0, 300, size)]
        out = {}
        for b in N._neighbours(4, 20)(iter(batches)):
            for region, node, dense in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out.setdefault((region, dense), set()).add(node)
        return out

    assert regions(300) == regions(7) == regions(1) and any(dense for _, dense in regions(7))


@pytest.mark.parametrize("limit", [45, 120, 400])
def test_long_runs_are_cut_where_they_are_split(limit):
    """With few rows held, whatever meets in a run taken whole meets still, and batches do not matter."""
    rng = np.random.default_rng(4)
    order = np.ones((1500, N.ORDER), np.uint16)
    order[:, 2:] = rng.integers(0, 4, (1500, N.ORDER - 2))
    order[300:900, :] = order[300]
    order[1200:, 0] = 2
    keys = sorted((0, row.tobytes(), i) for i, row in enumerate(order))
    schema = pa.schema([("tree", pa.int32()), ("order", pa.binary()), ("node", pa.int64())])

    def met(size, **how):
        batches = [pa.record_batch([list(x) for x in zip(*keys[i : i + size], strict=True)], schema=schema) for i in range(0, 1500, size)]
        out = {}
        for b in N._neighbours(5, 20, **how)(iter(batches)):
            for region, node, dense in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out.setdefault((region, dense), set()).add(node)
        assert all(len(x) <= 20 for (_, dense), x in out.items() if not dense)
        return out

    whole = met(1500)
    # a dense run's pairs are settled by its name, so its regions need not be the same
    named = {k: x for k, x in whole.items() if k[1]}
    inside = lambda x: any(x <= y for y in named.values())
    assert max(map(len, named.values())) >= 600 and any(not inside(x) for k, x in whole.items() if not k[1])
    for size in (1500, 64, 7):
        cut = met(size, limit=limit)
        assert {k: x for k, x in cut.items() if k[1]} == named
        sets = list(cut.values())
        assert all(inside(x) or any(x <= y for y in sets) for x in whole.values())


def test_rare_elements_lose_no_link():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 40)).astype(np.uint64)) for _ in range(80)]
    sets += [np.union1d(s[rng.random(len(s)) < 0.9], rng.integers(0, 90, 2).astype(np.uint64)) for s in sets]
    link = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 70 * len(np.union1d(a, b))
    want = {(i, j) for i in range(160) for j in range(160) if i != j and link(sets[i], sets[j])}
    assert set(N.exact_joins(sets, 70, np.ones(160, bool))) == want and len(want) > 50


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "q r s t"), (2, "zz"), (2, "other words here now")]
    got = sorted(map(tuple, N.document_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 2, None, True), (2, 1, 2, True), (2, 2, 2, True)], key=str)
    kept = N.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "a b c d"), (None, "q r s t"), (2, "zz"), (2, "other words here now")], key=str)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert N.document_components(none).count() == 0 and N.drop_near_duplicates(none).count() == 0


@pytest.mark.parametrize("limit", [10**6, 0])
def test_star_contraction(spark, monkeypatch, limit):
    monkeypatch.setattr(CC, "BROADCAST_EDGES", limit)
    edges = [("%03d" % i, "%03d" % (i + 1)) for i in range(40)] + [("900", "901"), ("901", "901"), ("000", "020")]
    got = dict(map(tuple, CC.connected_components(spark.createDataFrame(edges, "u string, v string")).collect()))
    assert got == {**{"%03d" % i: "000" for i in range(41)}, "900": "900", "901": "900"}


def test_null_ids_are_linked_with_near_texts(spark):
    words = [f"w{i}" for i in range(200)]
    near = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(words))
    rows = [(1, near(3)), (None, near(3, 60)), (None, near(60, 120)), (2, near(60, 120, 180)), (None, "q r s t")]
    want, _ = components([t for _, t in rows], 3, 85)
    assert want[:4] == [0] * 4
    got = sorted(map(tuple, N.document_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id", "kept").collect()), key=str)
    assert got == sorted([(1, 1, True), (None, 1, False), (None, 1, False), (2, 1, False), (None, None, True)], key=str)


def test_blocks_of_two_threads_keep_their_own_tables(spark):
    """What one thread stages is not another's to delete."""
    import threading

    from tracewright.llm.staging import staged, temporary

    mine, entered, left = [], threading.Event(), threading.Event()

    def other():
        with temporary(spark):
            entered.set()
            left.wait(60)

    thread = threading.Thread(target=other)
    thread.start()
    entered.wait(60)
    with temporary(spark) as block:
        mine.append(staged(spark.range(3)))
        assert len(block) == 1
        left.set()
        thread.join()
        assert mine[0].count() == 3
    kept = staged(spark.range(2))
    assert kept.count() == 2

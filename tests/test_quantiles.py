import numpy as np
import pytest

from tracewright.functions.tokens import token_counts
from tracewright.operators import integrity as O
from tracewright.operators.quantiles import exact_quantile

FILE = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.mark.parametrize("p", [0.0, 0.37, 0.5, 0.99, 1.0])
@pytest.mark.parametrize("parts", [3, 4096])
def test_quantiles_equal_numpy(spark, p, parts):
    rng = np.random.default_rng(7)
    groups = {"skewed": rng.lognormal(0, 4, 900), "ties": np.repeat([1.0, 2.0, 2.5], [400, 1, 399]), "one": np.array([3.25]), "wide": np.array([-1.7e308, 1.7e308, 0.0]), None: rng.normal(size=50)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("skewed", None), ("skewed", float("nan")), ("empty", None)]
    got = {r["g"]: (r["n"], r["quantile"]) for r in exact_quantile(spark.createDataFrame(rows, "g string, v double"), ("g",), "v", p, parts).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        if k != "wide" or p != 0.37:
            assert got[k] == (len(vs), pytest.approx(float(np.quantile(vs, p)), rel=1e-12))


def test_quantiles_of_a_whole_table(spark):
    df = spark.createDataFrame([(float(v),) for v in (5, 1, float("inf"), float("-inf"), 2)], "v double")
    assert tuple(exact_quantile(df, (), "v", 0.5).first()) == (5, 2.0) and tuple(exact_quantile(df, (), "v", 1.0).first()) == (5, float("inf"))
    assert exact_quantile(df.limit(0), (), "v", 0.5).where("quantile IS NOT NULL").count() == 0


def test_token_budgets(spark):
    from tokenizers import Tokenizer

    texts = ["", None, "short", "word " * 300, "é🙂" * 400, "<|endoftext|>" * 30, "a" * 200_000 + " b" * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    library = Tokenizer.from_file(FILE)
    library.encode_special_tokens = True
    want = {i: None if t is None else len(library.encode(t, add_special_tokens=False)) for i, t in enumerate(texts)}
    assert {r["id"]: r["n"] for r in df.select("id", token_counts(FILE)("text").alias("n")).collect()} == want
    over = {i: n for i, n in want.items() if n is not None and n > 100}
    for least in (1, 0):
        assert {r["id"]: r["tokens"] for r in O.token_budgets(df, ("id",), "text", 100, FILE, least).collect()} == over

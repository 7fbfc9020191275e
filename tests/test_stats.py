import math

import pytest
from pyspark.sql import functions as F

from tracewright.functions import stats as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("k,n,lo,hi", [(7, 10, 0.397, 0.892), (8, 15, 0.301, 0.752), (10, 15, 0.417, 0.848), (5, 5, 0.566, 1.0), (0, 0, 0.0, 0.0), (0, 4, 0.0, 0.490)])
def test_wilson(spark, k, n, lo, hi):
    got = one(spark, S.wilson(F.lit(k), F.lit(n)))
    assert (round(got["lo"], 3), round(got["hi"], 3)) == (lo, hi)


@pytest.mark.parametrize("b,c", [(2, 8), (0, 16), (0, 0), (5, 5), (1, 3), (0, 60), (600, 500)])
def test_mcnemar(spark, b, c):
    n = b + c
    want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n)
    assert one(spark, S.mcnemar_p(F.lit(b), F.lit(c))) == pytest.approx(want, rel=1e-9)


def test_published_values(spark):
    assert one(spark, S.mcnemar_p(F.lit(2), F.lit(8))) == pytest.approx(0.109375)
    assert [round(one(spark, S.mcnemar_p(F.lit(b), F.lit(c))), 3) for b, c in ((1, 3), (6, 0), (1, 1))] == [0.625, 0.031, 1.0]


def test_unknown_is_not_zero(spark):
    null = F.lit(None).cast("long")
    assert one(spark, S.priced(null, F.lit(3.0))) is None
    assert one(spark, S.percent_change(F.lit(0), F.lit(5))) is None
    assert one(spark, S.percent_change(F.lit(100), F.lit(112))) == pytest.approx(12)
    assert one(spark, S.rate(F.lit(0), F.lit(0))) == 0.0
    assert one(spark, S.signed_percent(F.lit(12.06))) == "+12.1%"
    assert one(spark, S.adjusted_prevalence(F.lit(0.5), F.lit(0.5), F.lit(0.5))) is None


def test_proxies(spark):
    v = lambda *x: [F.lit(i) for i in x]
    # a proxy with an eighth of errors on both sides: 0.8 seen, 0.9 true
    assert one(spark, S.proxy_bound(*v(0.8, 0.875, 0.875))) == pytest.approx(0.9) and one(spark, S.proxy_bound(*v(0.01, 0.9, 0.9))) == 0.0
    assert one(spark, S.proxy_bound(*v(0.8, 0.3, 0.6))) is None and one(spark, S.proxy_bound(*v(0.8, 0.5, 0.5))) is None
    assert one(spark, S.proxy_variance(*v(0.8, 100, 0.875, 0.875))) == pytest.approx(0.0016 / 0.5625)
    assert one(spark, S.proxy_variance(*v(0.8, 0, 0.875, 0.875))) is None
    assert one(spark, S.ratio_variance(*v(4, 2.0, 0.0, 1.0, 1.0, 0.0))) is None

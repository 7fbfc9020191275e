"""Statistics as column expressions: no Python runs for a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of a 95 % interval.
Z95 = 1.959963984540054


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def truthy(x) -> Column:
    """A flag with null taken as false."""
    return F.coalesce(_col(x), F.lit(False))


def rate(k, n, empty: float = 0.0) -> Column:
    """k / n, and ``empty`` where n is 0."""
    k, n = _col(k), _col(n)
    return F.when(n == 0, F.lit(empty)).otherwise(k.cast("double") / n)


def wilson(k, n, z: float = Z95) -> Column:
    """struct(lo, hi): the Wilson score interval, clamped to [0, 1]; (0, 0) for n = 0."""
    k, n = _col(k).cast("double"), _col(n).cast("double")
    p = F.try_divide(k, n)
    shrink = F.lit(1.0) + F.try_divide(F.lit(z * z), n)
    middle = (p + F.try_divide(F.lit(z * z), 2 * n)) / shrink
    half = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / shrink
    side = lambda x: F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))
    return F.struct(side(middle - half).alias("lo"), side(middle + half).alias("hi"))


def mcnemar_p(b, c) -> Column:
    """Two-sided exact McNemar test of discordant counts, summed from logarithms so that no term underflows early."""
    b, c = _col(b).cast("long"), _col(c).cast("long")
    n, low = b + c, F.least(b, c)
    start = F.struct((n * F.lit(-0.6931471805599453)).alias("term"), F.lit(0.0).alias("sum"))
    step = lambda acc, i: F.struct(
        (acc["term"] + F.when(i < n, F.ln((n - i).cast("double")) - F.ln((i + 1).cast("double"))).otherwise(F.lit(0.0))).alias("term"),
        (acc["sum"] + F.exp(acc["term"])).alias("sum"),
    )
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), low), start, step, lambda acc: acc["sum"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def percent_change(base, other) -> Column:
    """100 * (other - base) / base; null where base is 0 or null."""
    return F.try_divide((_col(other) - _col(base)).cast("double") * 100, _col(base).cast("double"))


def priced(tokens, rate_per_million) -> Column:
    """Cost of tokens; null, not 0, where either is unknown."""
    return _col(tokens).cast("double") / 1_000_000 * _col(rate_per_million)


def signed_percent(x) -> Column:
    return F.format_string("%+.1f%%", _col(x))


def interval(lo, hi) -> Column:
    """A confidence interval as percentages."""
    return F.format_string("[%.1f%%, %.1f%%]", _col(lo) * 100, _col(hi) * 100)


def adjusted_prevalence(observed, sensitivity, specificity) -> Column:
    """Rogan-Gladen estimate of a true rate, clamped; null where the test tells nothing."""
    raw = F.try_divide(_col(observed) + _col(specificity) - 1, _col(sensitivity) + _col(specificity) - 1)
    return F.when(raw.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))


def proxy_bound(observed, sensitivity, specificity) -> Column:
    """The worst-case (Natarajan) lower bound of a true rate behind a noisy proxy, clamped; null where the proxy tells nothing.

    The observed rate less the false positives' rate, over one less both error
    rates.  Unlike the Rogan-Gladen estimate it is null, not turned around, for
    a proxy that is worse than chance.
    """
    false_positives, false_negatives = 1 - _col(specificity), 1 - _col(sensitivity)
    left = 1 - false_positives - false_negatives
    return F.when(left > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (_col(observed) - false_positives) / left)))


def proxy_variance(observed, n, sensitivity, specificity) -> Column:
    """Variance of a rate corrected for its proxy: the binomial one over the square of Youden's index."""
    p, youden = _col(observed), _col(sensitivity) + _col(specificity) - 1
    return F.try_divide(p * (1 - p), _col(n).cast("double") * youden * youden)


def ratio_variance(n, mean_top, mean_bottom, var_top, var_bottom, covariance) -> Column:
    """Delta-method variance of a ratio of two means over n clusters; null with fewer than two, never below zero."""
    r = F.try_divide(_col(mean_top), _col(mean_bottom))
    spread = _col(var_top) - 2 * r * _col(covariance) + r * r * _col(var_bottom)
    out = F.try_divide(spread, _col(n).cast("double") * _col(mean_bottom) * _col(mean_bottom))
    return F.when(out.isNotNull(), F.greatest(F.lit(0.0), out))

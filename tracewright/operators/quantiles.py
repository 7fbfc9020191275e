"""Exact quantiles of large groups: no task sorts a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Equal parts of a group's range; rows outside the one or two that hold the quantile are only counted.
PARTS = 4096


def exact_quantile(df: DataFrame, by: tuple[str, ...], value: str, p: float, parts: int = PARTS) -> DataFrame:
    """(…, n, quantile): the p-quantile of a numeric column by group, interpolated between the two values about it.

    The group's range is cut into equal parts; their counts, at most ``parts``
    rows a group, tell where the two ranks lie.  Only rows there are grouped by
    value, so a value that repeats is one row, and a window runs over these
    alone.  Null and NaN do not count; a group without values has no row.
    Infinite values are kept apart from the range as parts of their own.
    """
    x = F.col(value).cast("double")
    rows = df.select(*by, x.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    finite = F.when(F.abs("_v") < float("inf"), F.col("_v"))
    ends = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi"))
    rank = F.floor((F.col("n") - 1) * F.lit(float(p)))
    ends = ends.select(*by, "n", "_lo", "_hi", rank.alias("_k"), ((F.col("n") - 1) * F.lit(float(p)) - rank).alias("_part"))
    # halves, so that the range of two large numbers of either sign stays a number
    step = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
    inside = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(parts - 1), F.floor(step * parts))).otherwise(0)
    bucket = F.when(F.col("_v") == float("inf"), parts).when(F.col("_v") == float("-inf"), -1).otherwise(inside).cast("int")
    dealt = _joined(rows, ends, by).select(*by, "_v", bucket.alias("_b"))
    counts = dealt.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = _joined(counts.withColumn("_before", before), ends, by)
    wanted = placed.where((F.col("_before") <= F.col("_k") + 1) & (F.col("_before") + F.col("_c") > F.col("_k"))).select(*by, "_b", "_before", "n", "_k", "_part")
    values = _joined(dealt, wanted, (*by, "_b")).groupBy(*by, "_b", "_before", "n", "_k", "_part", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    held = values.withColumn("_upto", upto)
    at = lambda k: F.min(F.when(F.col("_upto") > k, F.col("_v")))
    low, high = at(F.col("_k")).alias("_low"), at(F.col("_k") + 1).alias("_high")
    found = held.groupBy(*by, "n", "_part").agg(low, high)
    between = F.col("_low") + F.col("_part") * (F.col("_high") - F.col("_low"))
    exact = (F.col("_part") == 0) | F.col("_high").isNull() | (F.col("_high") == F.col("_low"))
    return found.select(*by, "n", F.when(exact, F.col("_low")).otherwise(between).alias("quantile"))


def _joined(left: DataFrame, right: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """An equi-join in which null is a key."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") for c in by], *[c for c in right.columns if c not in by])
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(named, on).drop(*[f"_r_{c}" for c in by])

"""Sketches that are kept by day and merged into longer periods, with the error that each estimate may have.

A day's sketch is a row of bounded size, whatever its rows; longer periods need
the sketches alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Registers of a distinct-count sketch, as a power of two, and the size of a quantile sketch.
REGISTERS, ITEMS = 12, 200
#: Least hashes that a sketch of minima keeps.
MINIMA = 256
#: Standard deviations between an estimate and its bounds.
WIDE = 3
_HASHES = 1 << 60


def sketches(rows: DataFrame, by: tuple[str, ...], key: str, number: str) -> DataFrame:
    """By group: the rows' count, a sketch of distinct keys and one of a number's quantiles; nulls are in neither."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(key, REGISTERS).alias("keys"), F.kll_sketch_agg_double(F.col(number).cast("double"), ITEMS).alias("numbers")
    )


def merged(held: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Sketches of longer periods, or of fewer groups, from kept ones."""
    return held.groupBy(*by).agg(F.sum("rows").alias("rows"), F.hll_union_agg("keys").alias("keys"), F.kll_merge_agg_double("numbers").alias("numbers"))


def estimates(held: DataFrame, by: tuple[str, ...], ranks: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(by…, rows, distinct, distinct_low, distinct_high) and for each rank p (p50, p50_low, p50_high), …

    A merged distinct count has a relative standard error of 1.04 / sqrt(2**REGISTERS);
    a quantile's rank is off by 2.296 / ITEMS**0.9723 at most in 99 % of cases,
    so its bounds are the sketch's quantiles that much to either side.
    """
    error = WIDE * 1.04 / (1 << REGISTERS) ** 0.5
    about = F.hll_sketch_estimate("keys")
    off = 2.296 / ITEMS**0.9723
    some = F.kll_sketch_get_n_double("numbers") > 0  # else there are no quantiles
    at = lambda p: F.when(some, F.kll_sketch_get_quantile_double("numbers", F.lit(min(max(p, 0.0), 1.0))))
    told: list[Column] = []
    for p in ranks:
        name = f"p{p * 100:g}".replace(".", "_")
        told += [at(p).alias(name), at(p - off).alias(f"{name}_low"), at(p + off).alias(f"{name}_high")]
    bounds = [F.floor(about / (1 + error)).cast("long").alias("distinct_low"), F.ceil(about / (1 - error)).cast("long").alias("distinct_high")]
    return held.select(*by, "rows", about.alias("distinct"), *bounds, *told)


def key_hash(key: Column) -> Column:
    """60 bits of a key's text, the same in any engine."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("long")


def minima(rows: DataFrame, by: tuple[str, ...], key: str, k: int = MINIMA) -> DataFrame:
    """By group the ``k`` least distinct hashes of a key, in order: a sketch that merges to the very one of all rows together.

    Only k hashes of a group leave a task.  Null keys are left out, and groups without others.
    """
    return _least(rows.where(F.col(key).isNotNull()).select(*by, key_hash(F.col(key)).alias("_h")), by, k)


def merged_minima(held: DataFrame, by: tuple[str, ...], k: int = MINIMA) -> DataFrame:
    return _least(held.select(*by, F.explode("minima").alias("_h")), by, k)


def _least(hashes: DataFrame, by: tuple[str, ...], k: int) -> DataFrame:
    first = hashes.distinct().withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy("_h"))).where(F.col("_place") <= k)
    return first.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias("minima"))


def minima_estimates(held: DataFrame, by: tuple[str, ...], k: int = MINIMA) -> DataFrame:
    """(by…, kept, distinct, distinct_low, distinct_high): exact below ``k`` keys, else (k - 1) / the k-th least hash as a share of all.

    The relative standard error is 1 / sqrt(k - 2).
    """
    kept = F.size("minima").cast("long")
    share = F.element_at("minima", -1) / F.lit(float(_HASHES))
    about, error = (k - 1) / share, WIDE / (k - 2) ** 0.5
    full = kept == k
    return held.select(
        *by, kept.alias("kept"), F.when(full, F.round(about).cast("long")).otherwise(kept).alias("distinct"),
        F.when(full, F.floor(about / (1 + error))).otherwise(kept).cast("long").alias("distinct_low"), F.when(full, F.ceil(about / (1 - error))).otherwise(kept).cast("long").alias("distinct_high"),
    )


def shared_keys(a: Column, b: Column, k: int = MINIMA) -> Column:
    """The share of keys that two sketches have in common (of those that either has), from the least of both together."""
    both = F.slice(F.array_sort(F.array_distinct(F.concat(a, b))), 1, k)
    return F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both)

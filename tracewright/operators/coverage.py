"""Coverage: which models did which kinds of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import rate, truthy


def primary_model(turns: DataFrame, key: str = "path") -> DataFrame:
    """The model of most turns per session; a tie goes to the greatest name."""
    return turns.groupBy(key).agg(F.max_by("model", F.struct("turns", "model")).alias("primary_model"))


def cross_tab(rows: DataFrame, row: str, column: str, columns: list[str], value: Column, listed: DataFrame | None = None) -> DataFrame:
    """A pivot with a total column and a total row; ``listed`` rows appear even when empty.

    The total row counts exactly the rows shown.
    """
    cells = rows.groupBy(row).pivot(column, columns).agg(value)
    if listed is not None:
        cells = listed.join(cells, row, "left")
    cells = cells.na.fill(0)
    total = sum((F.col(f"`{c}`") for c in columns[1:]), F.col(f"`{columns[0]}`"))
    body = cells.withColumn("total", total)
    foot = body.agg(*[F.sum(f"`{c}`").alias(c) for c in columns], F.sum("total").alias("total")).select(F.lit("TOTAL").alias(row), "*")
    return body.unionByName(foot)


def top_rows(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The rows of the n most frequent keys, ties by key."""
    # ``n`` keys at most leave the ordered limit
    top = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), key).limit(n).select(key)
    return rows.join(F.broadcast(top), key, "left_semi")


def placed(report: DataFrame, *order: Column) -> DataFrame:
    """A report's rows with their place in its order: one row for each group, so one task numbers them."""
    return report.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def shares(rows: DataFrame, row: str, column: str, of: str) -> DataFrame:
    """Per row value: how many are of one column value, and their share; numerically ordered by it."""
    counts = rows.groupBy(row).agg(F.count_if(F.col(column) == of).alias("k"), F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", rate("k", "n"))


def date_ranges(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(start).alias("first"), F.max(end).alias("last"), F.count(F.lit(1)).alias("sessions"))


def strong_outcome() -> Column:
    return truthy("mentions_tests_passed") | (F.coalesce("n_commits", F.lit(0)) > 0)


def turn_totals(turns: DataFrame) -> DataFrame:
    """Turns per model, in sessions and in sub-agents, from (path, model, turns, side_turns)."""
    return turns.groupBy("model").agg(F.sum("turns").cast("long").alias("main_turns"), F.sum("side_turns").cast("long").alias("side_turns")).withColumn("all_turns", F.col("main_turns") + F.col("side_turns"))

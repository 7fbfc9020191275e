"""Functions that SQL texts can call by name."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from .text import compatible


@F.udtf(returnType="nth bigint, word string")
class _FirstWords:
    """The first words of a text, numbered from 1."""

    def eval(self, text: str, n: int):
        for i, word in enumerate((text or "").split()[:n], 1):
            yield i, word


_HEADER = re.compile(r"@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@")
_NUMBERS = ("old_start", "old_declared", "new_start", "new_declared", "old_counted", "new_counted", "added", "removed", "shift")
_FLAGS = ("old_ok", "new_ok", "overlaps", "placed_ok")


@F.udtf
class _Hunks:
    """Hunks of unified diffs: a table of (path, line_no, line), which the function itself deals by path and orders by line.

    A line may also be an array of lines, a block that begins at line_no: a row
    costs this function far more than a line does.  What it holds of a file is
    the block and the hunk that it is in and the shift so far.
    """

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        if not lines.isTable:
            raise ValueError("tw_hunks takes a table of (path, line_no, line)")
        kinds = {f.name: f.dataType for f in lines.dataType.fields}
        missing = {"path", "line_no", "line"} - set(kinds)
        if missing:
            raise ValueError(f"tw_hunks needs columns {sorted(missing)}")
        fields = [T.StructField("path", kinds["path"]), T.StructField("hunk", T.LongType())]
        fields += [T.StructField(n, T.LongType()) for n in _NUMBERS] + [T.StructField(n, T.BooleanType()) for n in _FLAGS]
        return AnalyzeResult(schema=T.StructType(fields), partitionBy=[PartitioningColumn("path")], orderBy=[OrderingColumn("line_no")])

    def __init__(self) -> None:
        self.path, self.number, self.start, self.shift, self.end = None, 0, None, 0, None

    def eval(self, row: Row):
        lines = row["line"]
        self.path = row["path"]
        for line in lines if isinstance(lines, list) else (lines,):
            if line is None:
                continue
            if line.startswith("@@"):
                yield from self._told()
                found = _HEADER.match(line)
                a, b, c, d = found.groups() if found else (None,) * 4
                self.number += 1
                self.start = (int(a or 0), 1 if b is None else int(b), int(c or 0), 1 if d is None else int(d))
                self.removed = self.added = self.kept = 0
            elif self.start is not None:
                self.removed += line.startswith("-")
                self.added += line.startswith("+")
                self.kept += line.startswith(" ")

    def terminate(self):
        yield from self._told()

    def _told(self):
        if self.start is None:
            return
        old, old_n, new, new_n = self.start
        before, after = self.removed + self.kept, self.added + self.kept
        yield (
            self.path, self.number, old, old_n, new, new_n, before, after, self.added, self.removed, self.shift,
            old_n == before, new_n == after, self.end is not None and old < self.end, new == old + self.shift,
        )
        self.end = old + before
        self.shift += self.added - self.removed


#: Line numbers that a block spans at most; Spark hands Python a hundred blocks at once.
BLOCK_LINES = 250


def line_blocks(lines: DataFrame, size: int = BLOCK_LINES) -> DataFrame:
    """(path, line_no, line), as tw_hunks takes them: a file's lines of ``size`` line numbers are one array, at the first of these.

    Nulls among the lines are kept.  Blocks, not files, are dealt to tasks, so
    that a file of any length is never one row or one task here.
    """
    block = F.col("line_no") - F.pmod("line_no", F.lit(size))
    in_order = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("path", block.alias("block")).agg(F.min("line_no").alias("line_no"), in_order["line"].alias("line")).drop("block")


@F.pandas_udf(T.DoubleType())
def _concentration(values: pd.Series) -> float:
    """Gini's measure of a group's numbers, from 0 (all alike) towards 1 (one has all); nulls are left out, and sums of 0 give 0."""
    x = values.dropna().sort_values().to_numpy(dtype=float)
    total = x.sum()
    return 0.0 if not total else float(((2 * pd.RangeIndex(1, len(x) + 1).to_numpy() - len(x) - 1) * x).sum() / (len(x) * total))


#: The form in which quotes compare, over the column expression of its own; only NFKC is Python.
_QUOTE_KEY = r"""CREATE OR REPLACE TEMPORARY FUNCTION tw_quote_key(quote STRING) RETURNS STRING RETURN
  lower(regexp_replace(regexp_replace(regexp_replace(
    translate(tw_nfkc(quote), '‘’‚‛“”„‟–—―−', concat(repeat(chr(39), 4), repeat(chr(34), 4), '----')),
    r'[*_`]', ''), r'(?U)\s+', ' '), r'(?U)^\s+|\s+$', ''))"""


def register(spark: SparkSession) -> None:
    """tw_quote_key(text), a SQL function; tw_first_words(text, n) and tw_hunks(TABLE(lines)), table functions, the second faster over line_blocks(lines); tw_concentration(number), an aggregate of a group that fits into one task."""
    spark.udf.register("tw_nfkc", compatible)
    spark.sql(_QUOTE_KEY)
    spark.udtf.register("tw_first_words", _FirstWords)
    spark.udtf.register("tw_hunks", _Hunks)
    spark.udf.register("tw_concentration", _concentration)

"""Joins by order: spans that meet, the row before a time, and counts of either, without an equality key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def _level(start: Column, end: Column, unit: int) -> Column:
    """The least k for which a bin of ``unit`` * 2**k is longer than the span, which then meets two bins at most."""
    steps = F.call_function("div", end - start, F.lit(unit))
    return F.when(steps == 0, 0).otherwise(F.length(F.bin(steps))).cast("int")


def _bin(at: Column, width: Column) -> Column:
    """The number of the bin, also of a negative time."""
    return F.call_function("div", at - F.pmod(at, width), width)


def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], unit: int = 1) -> DataFrame:
    """All pairs of rows whose spans (start, end), whole numbers with both ends inside, have a point in common.

    A row's home is at the level whose bins are just longer than its span, so
    it meets two bins there at most; and it looks into the homes of the other
    side's longer spans, at each level that occurs.  So a row is copied twice
    for each level, however long it is.  A pair meets in one or two bins of the
    longer span's level and is taken in the one where the common part begins.
    The join is by (level, bin), which adaptive execution can split where a
    time is hot.  ``unit`` is the length of the shortest bins.

    Rows whose start or end is null, or that end before they start, meet
    nothing; repeated rows meet each for itself.  The two sides share no column name.
    """
    shared = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    if shared:
        raise ValueError(f"both sides have columns {sorted(shared)}")

    def placed(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        s, e = (F.col(c).cast("long") for c in span)
        return df.where(s <= e).select(F.struct(*df.columns).alias("row"), s.alias("s"), e.alias("e"), _level(s, e, unit).alias("home"))

    sides = placed(left, left_span), placed(right, right_span)
    levels = [sorted(r["home"] for r in x.select("home").distinct().collect()) for x in sides]  # 64 at most

    def entries(side: DataFrame, own: bool, others: list[int]) -> DataFrame:
        """Rows at their homes, or in the bins of other levels above."""
        at = F.array("home") if own else F.filter(F.array(*[F.lit(k) for k in others]) if others else F.array().cast("array<int>"), lambda k: k > F.col("home"))
        each = side.withColumn("level", F.explode(at)).withColumn("width", F.lit(unit) * F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level")))
        return each.withColumn("bin", F.explode(F.sequence(_bin(F.col("s"), F.col("width")), _bin(F.col("e"), F.col("width")))))

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        l, r = a.alias("l"), b.alias("r")  # noqa: E741
        same = (F.col("l.level") == F.col("r.level")) & (F.col("l.bin") == F.col("r.bin"))
        overlap = (F.col("l.s") <= F.col("r.e")) & (F.col("r.s") <= F.col("l.e"))
        owner = _bin(F.greatest("l.s", "r.s"), F.col("l.width")) == F.col("l.bin")
        return l.join(r, same & overlap & owner).select(F.col("l.row").alias("l"), F.col("r.row").alias("r"))

    a, b = sides
    homes = entries(a, True, []), entries(b, True, [])
    pairs = met(homes[0], homes[1]).unionByName(met(entries(a, False, levels[1]), homes[1])).unionByName(met(homes[0], entries(b, False, levels[0])))
    return pairs.select("l.*", "r.*")


def _in_blocks(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows dealt by ranges of ``order``, with the number of their block; written, since another pass may deal them otherwise."""
    return written(rows.repartitionByRange(*order).withColumn("_block", F.spark_partition_id()))


def as_of(left: DataFrame, right: DataFrame, left_at: str, right_at: str, by: tuple[tuple[str, str], ...] = (), tie: str | None = None, strict: bool = False) -> DataFrame:
    """Each left row with the last right row at or before its time (``strict``: before it), all nulls without one.

    Both tables are dealt together by ranges of (``by``, time); a window finds
    the row before within a block, and what a block hands on to the next is one
    row.  So neither the whole order nor a hot key is one task's, and nothing is
    multiplied.  ``by``: pairs of names that must be equal as well; of right rows
    at one time the greatest by ``tie`` counts.

    Left rows with a null time or key get nulls; such right rows are no one's.
    The two sides share no column name.
    """
    shared = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    if shared:
        raise ValueError(f"both sides have columns {sorted(shared)}")
    kinds = {f.name: f.dataType for f in right.schema}
    key = lambda side: F.struct(*[F.col(pair[side]).cast(kinds[pair[1]]).alias(f"k{i}") for i, pair in enumerate(by)]) if by else F.lit(0)
    known = lambda at, side: F.col(at).isNotNull() & F.forall(F.array(*[F.col(p[side]).isNotNull() for p in by]) if by else F.array(F.lit(True)), lambda x: x)
    none = lambda df: F.lit(None).cast(df.select(F.struct(*df.columns).alias("x")).schema["x"].dataType)
    time = kinds[right_at]
    tied = F.col(tie) if tie else F.lit(0)
    asked = left.select(key(0).alias("_by"), F.col(left_at).cast(time).alias("_t"), F.lit(1 if not strict else -1).alias("_side"), F.lit(None).cast(right.select(tied.alias("x")).schema["x"].dataType).alias("_tie"), F.struct(*left.columns).alias("_l"), none(right).alias("_r"), known(left_at, 0).alias("_known"))
    given = right.where(known(right_at, 1)).select(key(1).alias("_by"), F.col(right_at).alias("_t"), F.lit(0).alias("_side"), tied.alias("_tie"), none(left).alias("_l"), F.struct(*right.columns).alias("_r"), F.lit(True).alias("_known"))
    order = ["_by", "_t", "_side", "_tie"]
    rows = _in_blocks(asked.unionByName(given), order)
    inside = Window.partitionBy("_block", "_by").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("_seen", F.last("_r", ignorenulls=True).over(inside)).where("_side <> 0")
    is_right = F.col("_side") == 0
    ends = rows.groupBy("_block").agg(F.max("_by").alias("_by"), F.max_by("_r", F.when(is_right, F.struct(*order))).alias("_r"), F.max(F.when(is_right, F.struct("_by"))).alias("_of"))
    ends = ends.withColumn("_r", F.when(F.col("_of._by") == F.col("_by"), F.col("_r")))
    after = F.last("_r", ignorenulls=True).over(Window.partitionBy("_by").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.withColumn("_carried", after)
    in_turn = Window.orderBy("_block")  # one row for each block
    handed = ends.select(F.col("_block"), F.lag("_by").over(in_turn).alias("_by"), F.lag("_carried").over(in_turn).alias("_carried")).where("_carried IS NOT NULL")
    out = seen.join(F.broadcast(handed), ["_block", "_by"], "left")
    found = F.when(F.col("_known"), F.coalesce("_seen", "_carried"))
    return out.select("_l.*", found.alias("_r")).select(*left.columns, "_r.*")


#: Rows of a block that ``overlap_counts`` adds up in one task, at about.
BLOCK_ROWS = 500_000


def overlap_counts(left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """(key, n): how many right spans each left one meets, without making the pairs: those begun by its end less those over before its start.

    Rows of one time are one row before anything is ordered; running sums go
    over blocks of the common order, and over the blocks' totals before.  The
    number of blocks grows with the rows, so a task's memory does not.  Left spans that
    are null or end before they start meet none; rows that share a key add up.
    """
    s, e = (F.col(c).cast("long") for c in right_span)
    ls, le = (F.col(c).cast("long") for c in left_span)
    point = lambda df, t, side, begun, over: df.select(t.alias("t"), F.lit(side).alias("side"), F.lit(begun).cast("long").alias("begun"), F.lit(over).cast("long").alias("over"))
    good, asked = right.where(s <= e), left.where(ls <= le).select(F.col(key).alias("_k"), ls.alias("_s"), le.alias("_e"))
    rows = point(good, s, 0, 1, 0).unionByName(point(good, e, 2, 0, 1)).unionByName(point(asked, F.col("_e"), 1, 0, 0)).unionByName(point(asked, F.col("_s"), 1, 0, 0))
    # at most one row for each time and side
    rows = written(rows.groupBy("t", "side").agg(F.sum("begun").alias("begun"), F.sum("over").alias("over")))
    blocks = rows.count() // BLOCK_ROWS + 1
    rows = written(rows.repartitionByRange(blocks, "t", "side").withColumn("_block", F.spark_partition_id()))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    totals = rows.groupBy("_block").agg(F.sum("begun").alias("b"), F.sum("over").alias("o"))
    totals = totals.select("_block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("b", "o")])
    inside = Window.partitionBy("_block").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.repartition(blocks, "_block").select("_block", "t", "side", F.sum("begun").over(inside).alias("b"), F.sum("over").over(inside).alias("o")).where("side = 1").join(F.broadcast(totals), "_block")
    run = written(run.select("t", (F.col("b") + F.col("b_before")).alias("b"), (F.col("o") + F.col("o_before")).alias("o")))
    spans = asked.select("_s", "_e").distinct()
    spans = spans.join(run.select(F.col("t").alias("_e"), "b"), "_e").join(run.select(F.col("t").alias("_s"), "o"), "_s").select("_s", "_e", (F.col("b") - F.col("o")).alias("n"))
    each = left.select(F.col(key), ls.alias("_s"), le.alias("_e")).join(spans, ["_s", "_e"], "left")
    return each.groupBy(key).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def overlap_summaries(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], first: str, unit: int = 1) -> DataFrame:
    """Each left row that meets a right span, with ``n``, the least ``first`` and the ``longest`` common length of those that it meets.

    Rows of equal spans are one on either side before they meet, and a left
    row reads its span's figures: the pairs are those of distinct spans, which
    end growing once all times of a period occur, not those of rows.
    """
    (ls, le), (rs, re) = left_span, right_span
    spans = left.where(F.col(ls) <= F.col(le)).select(F.col(ls).alias("_s"), F.col(le).alias("_e")).distinct()
    given = right.where(F.col(rs) <= F.col(re)).groupBy(F.col(rs).alias("_rs"), F.col(re).alias("_re")).agg(F.count(F.lit(1)).alias("_n"), F.min(first).alias("_first"))
    pairs = interval_join(written(spans), written(given), ("_s", "_e"), ("_rs", "_re"), unit=unit)
    common = F.least("_e", "_re") - F.greatest("_s", "_rs")
    told = pairs.groupBy("_s", "_e").agg(F.sum("_n").alias("n"), F.min("_first").alias("first"), F.max(common).alias("longest"))
    return left.join(told, (F.col(ls) == F.col("_s")) & (F.col(le) == F.col("_e"))).drop("_s", "_e")

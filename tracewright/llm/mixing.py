"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a word target: its weight's part of the whole budget, at most
``cap`` times its size, the excess dealt again by weight.  A source's target is
met by complete epochs over all its documents first; the fraction left is
filled with documents in the order of exponential keys ``-ln(u) / quality``,
prefix-summed to the budget.

No source is ever sorted in one task.  Keys fall into buckets that are monotone
in the key and hold about BUCKET_ROWS rows each; bucket sums, run up at two
levels, tell the bucket in which a source's budget ends, and only that bucket's
rows are ordered.  What comes of it is one row for each source, beside which
each document is decided by its own key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import columns_of, fresh_name, named, staged

#: Rows of a source that one bucket of keys holds on average.
BUCKET_ROWS = 512
#: Sources whose goals are broadcast to the documents; beyond it the join is shuffled.
BROADCAST_ROWS = 100_000
#: Rows that one task may order; beyond it they are ordered in ranges.
FEW_ROWS = 100_000
#: Lowest quality weight; bounds how uneven the key buckets can be.
MIN_QUALITY = 0.25
#: Fixed characters that count against a text's quality.
SYMBOLS = "#*$%&|<>"

WORD_RUN = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of non-white-space (ASCII) characters; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RUN)), F.lit(0)).cast("long")


def symbol_quality(text: Column, size: Column) -> Column:
    """A weight in [MIN_QUALITY, 1] that falls with symbols per word."""
    symbols = F.coalesce(F.length(text) - F.length(F.translate(text, SYMBOLS, "")), F.lit(0))
    return F.greatest(F.lit(MIN_QUALITY), F.lit(1.0) - symbols / F.greatest(size, F.lit(1)))


def uniform(key: Column) -> Column:
    """A number in (0, 1) that depends on the key's text alone (52 bits of its md5)."""
    bits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def prefix_sums(rows: DataFrame, order: tuple[str, ...], sums: dict[str, Column]) -> DataFrame:
    """The staged rows with each of ``sums`` taken over all rows before them in ``order``, which tells all rows apart.

    Beyond FEW_ROWS rows, which one task can order, there are two levels: rows
    are dealt into ranges; each range sums within itself, and the ranges' own
    sums, one row for each, are summed in one small task.
    """
    keys = [F.col(k) for k in order]
    if rows.count() <= FEW_ROWS:
        above = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({n: F.coalesce(F.sum(c).over(above), F.lit(0)) for n, c in sums.items()})
    own = {n: f"{n}_own" for n in sums}
    ranged = rows.withColumns({own[n]: c for n, c in sums.items()}).repartitionByRange(_partitions(rows), *keys)
    ranged = staged(ranged.withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("below").rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.groupBy(F.col("range").alias("below")).agg(*[F.sum(c).alias(c) for c in own.values()])
    bases = whole.select("below", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{n}_base") for n, c in own.items()])
    inside = Window.partitionBy("range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(bases), F.col("range") == F.col("below"))  # as many rows as ranges
    return joined.select(*rows.columns, *[(F.col(f"{n}_base") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for n, c in own.items()])


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, n_docs, source_size) -> the same with ``target``.

    The bounded water level is closed-form: with sources ordered by the level
    at which they reach their cap, the level is the first one that its source
    does not reach.  Ranks and running sums have two levels, as sources may be
    many.
    """
    told = staged(sizes.withColumns({"unnamed": F.col("source").isNull(), "name": F.coalesce("source", F.lit("")), "full": F.lit(cap) * F.col("source_size")}))
    ranked = prefix_sums(told, ("unnamed", "name"), {"rank": F.lit(1)})
    listed = F.array(*[F.lit(w) for w in weights])
    weighed = ranked.withColumn("weight", F.element_at(listed, (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int")).cast("double"))
    weighed = staged(weighed.withColumn("full_at", F.col("full") / F.col("weight")))
    summed = staged(prefix_sums(weighed, ("full_at", "unnamed", "name"), {"full_below": F.col("full"), "weight_below": F.col("weight")}))
    whole = summed.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    level = (F.lit(share) * F.col("all_size") - F.col("full_below")) / (F.col("all_weight") - F.col("weight_below"))
    leveled = summed.crossJoin(F.broadcast(whole)).withColumn("level", level)  # beside one row
    water = leveled.where(F.col("full_at") >= F.col("level")).agg(F.min(F.struct("full_at", "level"))["level"].alias("water"))
    return summed.crossJoin(F.broadcast(water)).select(  # beside one row
        "source", "n_docs", "source_size", F.coalesce(F.least(F.col("full"), F.col("water") * F.col("weight")), F.col("full")).alias("target")
    )


#: Orders the documents of a source; equal ones are alike in all that the mix reads.
ORDER = ("key", "doc_id", "size", "tie")


def _keyed(docs: DataFrame, id: str, source: str, text: str, *also: Column) -> DataFrame:
    """doc_id, source, size, key, tie of each row, and the columns ``also``: all from the row itself."""
    body, own = named(text).cast("string"), named(id)
    digest = F.md5(F.coalesce(body, F.lit("")).cast("binary"))
    # rows without an id draw by their text, so that they do not all draw alike
    drawn = F.coalesce(own.cast("string"), digest)
    sized = docs.select(
        own.alias("doc_id"), named(source).cast("string").alias("source"), word_count(body).alias("size"), body.alias("_body"),
        uniform(drawn).alias("_u"), F.xxhash64(body).alias("tie"), *also,
    )
    key = -F.ln(F.col("_u")) / symbol_quality(F.col("_body"), F.col("size"))
    return sized.withColumn("key", key).drop("_body", "_u")


def _bucket() -> Column:
    """exp(-MIN_QUALITY * key) is monotone in the key and has a density of at most 1 / MIN_QUALITY."""
    return F.floor((F.lit(1.0) - F.exp(F.lit(-MIN_QUALITY) * F.col("key"))) * F.col("buckets")).cast("long")


def _beside(rows: DataFrame, by_source: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """Rows with what is known of their source; a staged table of ``few`` sources is broadcast, a larger one joined by shuffle."""
    own = by_source.withColumnRenamed("source", "_source")
    side = F.broadcast(own) if few else own
    return rows.join(side, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def _goals(keyed: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """One row for each source, staged: its target, its whole epochs, and where its last, fractional epoch ends.

    Keys fall into buckets that are monotone in the key.  The sums of all
    buckets tell ``cut_bucket``, in which the budget ends; only that bucket's
    documents are ordered, those that are alike as one, to find ``cut``, the
    last one within the budget.  ``n_cut`` of the ``n_alike`` rows that equal
    the cut are in.
    """
    sizes = keyed.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = staged(
        source_targets(sizes, weights, share, cap)
        .withColumn("epochs", epochs)
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("buckets", F.greatest(F.lit(1.0), F.ceil(F.col("n_docs") / BUCKET_ROWS)))
    )
    few = goals.count() <= BROADCAST_ROWS
    placed = _beside(keyed.select("source", *ORDER), goals, few).withColumn("bucket", _bucket())
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    told = staged(sums.withColumns({"unnamed": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))}))
    summed = staged(prefix_sums(told, ("unnamed", "name", "bucket"), {"all_before": F.col("bucket_size")}))
    starts = summed.groupBy("source").agg(F.min("all_before").alias("source_before"))
    based = _beside(_beside(summed.select("source", "bucket", "bucket_size", "all_before"), starts if few else staged(starts), few), goals.select("source", "rest"), few)
    based = based.withColumn("base", F.col("all_before") - F.col("source_before"))
    over = based.where(F.col("base") + F.col("bucket_size") > F.col("rest"))
    ends = staged(over.groupBy("source").agg(F.min(F.struct("bucket", "base")).alias("x")).select("source", F.col("x.bucket").alias("cut_bucket"), "x.base"))
    last = _beside(placed, ends, few).where(F.col("bucket") == F.col("cut_bucket"))
    alike = last.groupBy("source", *ORDER).agg(F.count(F.lit(1)).alias("n_alike"), F.first("base").alias("base"), F.first("rest").alias("rest"))
    before = Window.partitionBy("source").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    prefix = F.col("base") + F.coalesce(F.sum(F.col("size") * F.col("n_alike")).over(before), F.lit(0))
    room = 2 * F.col("rest") - (2 * F.col("prefix") + F.col("size"))  # the first of the rows fits where this is not below 0
    fitting = F.when(F.col("size") > 0, F.least(F.col("n_alike"), F.floor(room / (2 * F.col("size"))) + 1)).otherwise(F.col("n_alike"))
    within = alike.withColumn("prefix", prefix).where(room >= 0).withColumn("n_cut", fitting)
    cut = within.groupBy("source").agg(F.max(F.struct(*ORDER, "n_cut", "n_alike")).alias("x"))
    cut = cut.select("source", F.struct(*[F.col("x")[c].alias(c) for c in ORDER]).alias("cut"), "x.n_cut", "x.n_alike")
    return staged(_beside(_beside(goals, ends.select("source", "cut_bucket"), few, "left"), cut, few, "left"))


def _dealt(keyed: DataFrame, goals: DataFrame) -> DataFrame:
    """``keyed`` with its source's goal and copies.

    A row is decided by itself and its source's goal.  Only where a budget ends
    among rows that are alike are those counted out, whichever comes first; they
    are written, and each of the parts they stand in is told how many it gives.
    """
    sources, split_ = goals.agg(F.count(F.lit(1)), F.count_if(F.col("n_cut") < F.col("n_alike"))).first()
    rows = _beside(keyed, goals, sources <= BROADCAST_ROWS)
    own = F.struct(*ORDER)
    below = (_bucket() < F.col("cut_bucket")) | F.coalesce(own <= F.col("cut"), F.lit(False))
    out = rows.withColumn("once_more", F.coalesce(below, F.lit(False)))
    if split_:
        split = F.coalesce(own.eqNullSafe(F.col("cut")) & (F.col("n_cut") < F.col("n_alike")), F.lit(False))
        last = staged(out.where(split).withColumn("lot", F.spark_partition_id()))
        before = Window.partitionBy("source").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
        lots = last.groupBy("source", "lot").agg(F.count(F.lit(1)).alias("n"))
        lots = lots.select(F.col("source").alias("_source"), F.col("lot").alias("_lot"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("given"))
        told = last.join(lots, F.col("source").eqNullSafe(F.col("_source")) & (F.col("lot") == F.col("_lot")))
        nth = F.col("given") + F.row_number().over(Window.partitionBy("source", "lot").orderBy("size"))
        out = out.where(~split).unionByName(told.withColumn("once_more", nth <= F.col("n_cut")).select(out.columns))
    return out.withColumn("copies", F.col("epochs") + F.col("once_more").cast("long"))


def mix_sources(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """Deal out ``share`` times all words over the sources.

    Returns one row per input row: doc_id, source, size, source_size, target
    (its source's), taken (words the mix takes, repeats counted: whole epochs
    plus one more copy where the fraction reaches the document).

    Cases: a null text has size 0; null sources form one source, ordered last;
    a null id draws as the digest of its text; repeated ids share a key and are
    ordered by size, then text, so reruns agree, and of rows alike in all of
    these as many are taken as fit; a very long text is counted whole; an empty
    table gives no rows; other columns are ignored.  The document at the end of
    a budget is taken when that comes nearer to the target.
    """
    keyed = staged(_keyed(docs, id, source, text))
    dealt = _dealt(keyed, _goals(keyed, weights, share, cap))
    return dealt.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    into: str = "copies",
) -> DataFrame:
    """The rows with ``into``, how often the mix takes each; columns stay as they are, so ``into`` must be none of them.

    A row that the mix leaves out has 0 copies.  ``mix_sources`` is the digest
    of the same deal, and its cases hold.  Texts are not shuffled: the keys are
    worked out again beside the whole rows.
    """
    if into != fresh_name(docs.columns, into):
        raise ValueError(f"the input has a column {into}")
    goals = _goals(staged(_keyed(docs, id, source, text)), weights, share, cap)
    dealt = _dealt(_keyed(docs, id, source, text, F.struct(*columns_of(docs)).alias("whole")), goals)
    return dealt.select(*[F.col("whole").getField(c).alias(c) for c in docs.columns], F.col("copies").alias(into))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0) AS symbols, md5(coalesce(text, '')) AS digest
  FROM documents),
k AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, digest)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
         / greatest(0.25, 1.0 - symbols / greatest(size, 1)) AS key
  FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
v AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS full_at,
         (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER lower, 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER lower, 0)) AS level
  FROM w
  WINDOW lower AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
         coalesce(least(2.0::DOUBLE * source_size, weight * (SELECT arg_min(level, full_at) FROM v WHERE full_at >= level)), 2.0::DOUBLE * source_size) AS target
  FROM v),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (
  SELECT k.doc_id, k.source, k.size, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source, size, source_size, target,
       (size * (epochs + CASE WHEN 2 * prefix + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""
